"""Every registered query with an oracle, compared at the smallest scale factor."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.derived import GIVEN

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
# a cross-section by default; PAPERWEFT_ALL=1 compares every query
SAMPLE = ["x7", "x19", "p2", "p6", "m2", "m6", "d9", "d12", "e10", "e12", "v1", "u3", "r1", "r2", "c1", "c4", "s4", "t2"]


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in GIVEN:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [
    n for n in entry.oracle_sql() if os.environ.get("PAPERWEFT_ALL") or n.split("_")[0] in SAMPLE])
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted("|".join(norm(r[i]) for i in at) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_result_does_not_depend_on_partitions(spark):
    seen = []
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, entry.queries()["m2_detect_specifications"](spark, FOLDER).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]
