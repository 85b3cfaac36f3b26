"""Suffix arrays by linear grouping, and repeated byte strings found with them.

Grouping construction: suffixes are grouped by their Lyndon prefix, groups are processed in descending
order, and each suffix extends the prefix of its previous smaller suffix; a second pass emits the order
within the groups along the same pointers. No names are formed recursively.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import words as W
from .repeats import Unit, earlier

_U = np.uint64


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of non-negative integers, in ascending order."""
    n = len(symbols) + 1
    text = np.concatenate([np.asarray(symbols, np.int64) + 1, [0]])  # a smallest symbol ends it
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.concatenate([new, [n]]))
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(new, size)
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    array, group, place = order.tolist(), group_of.tolist(), place_of.tolist()  # group: index of its first slot
    stop = [0] * n  # by first slot: end of the group
    for a, b in zip(new.tolist(), size.tolist()):
        stop[a] = a + b
    smaller = [-1] * n
    high = n
    while high > 1:
        low = group[array[high - 1]]
        times: dict[int, int] = {}
        for i in (sorted(array[low:high]) if high - low > 1 else array[low:high]):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_group: dict[int, list[tuple[int, int]]] = {}
        for j, t in times.items():
            by_group.setdefault(group[j], []).append((t, j))
        for g, extended in by_group.items():
            if len(extended) == 1:
                if stop[g] - g == 1:
                    continue
            else:
                extended.sort(reverse=True)
            end = last_end = stop[g]
            last = extended[0][0]
            tail: list[int] = []
            for t, j in extended:  # most repetitions last, each number a group of its own
                if t != last:
                    for x in tail:
                        group[x] = end
                    stop[end] = last_end
                    tail, last, last_end = [], t, end
                end -= 1
                other, here = array[end], place[j]
                array[here], array[end] = other, j
                place[other], place[j] = here, end
                tail.append(j)
            for x in tail:
                group[x] = end
            stop[end] = last_end
            if end > g:
                stop[g] = end
        high = low
    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))  # by first slot: next slot of the group
    placed = bytearray(n)
    placed[n - 1] = 1
    for slot in range(n):
        j = out[slot] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = smaller[j]
    return np.array(out[1:], np.int64)


def context_bytes(unit: Unit, raw: np.ndarray, items: np.ndarray, at: np.ndarray, back: np.ndarray, stop: np.ndarray) -> Callable:
    """Payload: the bytes of the owned windows without the anchor."""
    data = raw.tobytes()
    begin, at, stop = (at - back).tolist(), at.tolist(), stop.tolist()
    return lambda i: data[begin[i] : at[i]] + data[at[i] + unit.gram : stop[i]]


def judge_suffixes(unit: Unit, key, doc, start, own, data, length) -> np.ndarray:
    """Windows that occur earlier, by a suffix array over the distinct contexts of the keys.

    The contexts of a key are aligned at their anchor. A context is a sequence of symbols: 8-byte blocks
    to the left of the anchor, the anchor itself, blocks to its right, a separator. A window starts r < 8
    bytes before a block; two are equal when those r bytes are, and their block suffixes share at
    least ``window`` - r bytes, which neighbours in suffix order with their common prefixes tell. An
    equal context of a later document repeats as a whole.
    """
    hit = np.zeros((len(own), unit.window - unit.gram + 1), bool)
    n_starts = length - unit.window + 1
    pooled: dict[tuple[int, int, bytes], int] = {}
    firsts: list[int] = []
    for i, text in enumerate(zip(key.tolist(), own.tolist(), data)):
        first = pooled.setdefault(text, i)
        if first == i:
            firsts.append(i)
        elif (doc[first], start[first]) != (doc[i], start[i]):
            hit[i, : n_starts[i]] = True
    use = np.array(firsts)
    _, inverse, count = np.unique(key[use], return_inverse=True, return_counts=True)
    use = use[count[inverse] > 1]
    if not len(use):
        return hit
    left = own[use]
    right = np.array([len(data[i]) for i in use.tolist()]) - left
    n_left, n_right = -(-left // 8), -(-right // 8)
    # every context takes its left blocks, one slot for the anchor, its right blocks, one for the separator
    slots = n_left + n_right + 2
    base = np.concatenate([[0], np.cumsum(slots)])
    room = np.zeros(base[-1] * 8, np.uint8)
    flat = np.frombuffer(b"".join(data[i] for i in use.tolist()), np.uint8)
    row = np.repeat(np.arange(len(use)), left + right)
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(left + right)[:-1]]), left + right)
    shift = np.where(at < left[row], 8 * n_left[row] - left[row], 8 * n_left[row] + 8 - left[row])
    room[8 * base[row] + shift + at] = flat
    blocks = room.view(">u8").astype(_U)
    anchor, border = base[:-1] + n_left, base[1:] - 1
    plain = np.ones(len(blocks), bool)
    plain[anchor] = plain[border] = False
    _, ranks = np.unique(blocks[plain], return_inverse=True)
    _, key_rank = np.unique(key[use], return_inverse=True)
    symbols = np.zeros(len(blocks), np.int64)  # separators are the smallest, anchors come next
    symbols[anchor] = 1 + key_rank
    symbols[plain] = 2 + key_rank.max() + ranks
    order = suffix_array(symbols)
    weight = np.full(len(blocks) + 1, 8)
    weight[anchor], weight[border], weight[-1] = unit.gram, 0, 0
    common = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    a, b = order[:-1].copy(), order[1:].copy()
    while len(live):
        same = (symbols[a] == symbols[b]) & (weight[a] > 0)
        common[live[same]] += weight[a[same]]
        a_end, b_end = a[~same], b[~same]
        both = plain[a_end] & plain[b_end]
        differ = blocks[a_end[both]] ^ blocks[b_end[both]]
        equal = np.zeros(len(differ), np.int64)
        for k in range(1, 8):
            equal += differ < (_U(1) << _U(64 - 8 * k))
        common[live[~same][both]] += equal
        live, a, b = live[same], a[same] + 1, b[same] + 1
        inside = (a < len(symbols)) & (b < len(symbols))
        live, a, b = live[inside], a[inside], b[inside]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = n_starts[use]
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(use)), n)
    place = np.arange(first[-1]) - first[row]
    before = left[row] - place  # bytes between the window's start and the anchor
    slot = anchor[row] - before // 8
    part = before % 8
    group = np.zeros(len(row), _U)
    for r in range(8):
        mine = np.flatnonzero(part == r)
        classes = np.cumsum(common < unit.window - r)[rank[slot[mine]]].astype(_U)
        lead = blocks[np.maximum(slot[mine] - 1, 0)] & _U((1 << (8 * r)) - 1) if r else np.zeros(len(mine), _U)
        group[mine] = W.mix(classes + W.mix(lead + W.mix(before[mine].astype(_U))))
    group ^= W.mix(key[use].view(_U))[row]
    hit[use] |= earlier(group, row, place, doc[use], start[use], own[use], unit)
    return hit
