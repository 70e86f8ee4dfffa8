"""Periodic runs of words by maximal pairs with bounded distance over LCP intervals.

Two occurrences i < j of a stretch of L words that differ in the word before
them and in the word behind them are a maximal pair.  Where j - i is at most
L / 3, words i to j + L repeat with period j - i at least four times and no
neighbour goes on: the pair is the run, nothing is extended afterwards.  Pairs
come from the suffixes of a text: intervals of equal prefixes are joined from
the longest prefix up, the smaller side looks up the larger one within L / 3
words, in lists by left word.  Within that distance the occurrences of a
stretch form one arithmetic progression, in which all but the first have the
same left word, so the first neighbour on each side shows which list to walk,
and a text has no more such pairs than words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPONENT = 4                     # least length in periods
SHORTEST = 6                     # least length in words
LEAST_COMMON = 5                 # shortest stretch shared by a pair of a run: six words of period 1
SLICE_BYTES = 4_000_000          # text handled at once; a longer text is handled alone
MARKS = ("n_runs", "start", "length", "period", "exponent_milli", "runs")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """All words one after another, words per text, and each text's words joined by one space."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    full = pc.greater(pc.binary_length(texts), 0)
    n = np.where(full.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
    return lists.filter(full).flatten(), n.astype(np.int64), pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _groups(keys: np.ndarray) -> np.ndarray:
    """True where a new value begins in sorted ``keys``."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _firsts(new: np.ndarray) -> np.ndarray:
    """For each position the position where its group begins."""
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _repeated(new: np.ndarray) -> np.ndarray:
    """True for members of groups of two or more."""
    return ~(new & np.append(new[1:], True))


def suffix_groups(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``LEAST_COMMON`` words occur twice in their text, in suffix order, and where such groups begin.

    ``ids`` holds each text's words and a mark of its own behind them.  Ranks
    of prefixes are doubled, first for all positions, then only for positions
    whose prefix is not yet unique.
    """
    n, width = len(ids), int(ids.max()) + 1
    reach = 1
    while reach < 3 and (int(doc[-1]) + 1) * width ** (reach + 1) < 2 ** 62:
        reach += 1
    keys, padded = doc.astype(np.int64), np.append(ids, np.zeros(reach, np.int64))
    for k in range(reach):
        keys = keys * width + padded[k:k + n]
    order = np.argsort(keys)
    new = _groups(keys[order])
    rank = np.empty(n, np.int64)
    rank[order] = _firsts(new)
    live, wide, base = order[_repeated(new)], reach, None
    while len(live):
        step = min(wide, LEAST_COMMON - wide) if wide < LEAST_COMMON else wide
        keys = rank[live] * n + rank[live + step]
        by = np.argsort(keys)
        live, keys = live[by], keys[by]
        old = rank[live]
        slots = old + np.arange(len(live)) - _firsts(_groups(old))
        new = _groups(keys)
        rank[live] = slots[_firsts(new)]
        live, wide = live[_repeated(new)], wide + step
        if wide == LEAST_COMMON:
            base, starts = live, rank[live].copy()
    if base is None or not len(base):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    by = np.lexsort((rank[base], starts))
    return base[by], _groups(starts[by])


def common_lengths(ids: list[int], suffixes: np.ndarray, begins: np.ndarray) -> list[int]:
    """Common words of each suffix and the one before it in its group (0 where a group begins), by Kasai's rule."""
    before = np.append(suffixes[:1], suffixes[:-1])
    out = [0] * len(suffixes)
    by = np.argsort(suffixes)
    last, known = -2, 0
    for slot, i, j, first in zip(by.tolist(), suffixes[by].tolist(), before[by].tolist(), begins[by].tolist()):
        if first:
            last = -2
            continue
        k = max(known - 1, LEAST_COMMON) if last == i - 1 else LEAST_COMMON
        while ids[i + k] == ids[j + k]:
            k += 1
        out[slot], last, known = k, i, k
    return out


class Interval:
    """Occurrences of a common prefix: all in order, and in lists by left word."""

    __slots__ = ("places", "by_left")

    def __init__(self, place: int, left: int):
        self.places, self.by_left = [place], {left: [place]}


def _added(places: list[int], more: list[int]) -> None:
    if len(more) > 16:
        places.extend(more)
        places.sort()
    else:
        for p in more:
            insort(places, p)


def joined(a: Interval, b: Interval, common: int, left: list[int], found: dict) -> Interval:
    """Both intervals as one; maximal pairs between them with ``common`` words go to ``found`` as (start, length): least period."""
    if len(a.places) < len(b.places):
        a, b = b, a
    reach = common // (EXPONENT - 1)
    places = a.places
    for i in b.places:
        k = bisect_right(places, i)
        if k < len(places) and places[k] - i <= reach and left[places[k]] != left[i]:
            behind = a.by_left[left[places[k]]]
            for j in behind[bisect_right(behind, i):bisect_right(behind, i + reach)]:
                _note(found, i, j, common)
        k = bisect_left(places, i - reach)
        if k < len(places) and places[k] < i and left[places[k]] != left[i]:
            _note(found, places[k], i, common)
    _added(places, b.places)
    for word, some in b.by_left.items():
        if word in a.by_left:
            _added(a.by_left[word], some)
        else:
            a.by_left[word] = some
    return a


def _note(found: dict, i: int, j: int, common: int) -> None:
    period = j - i
    if period + common >= SHORTEST:
        key = (i, period + common)
        found[key] = min(period, found.get(key, period))


def maximal_pairs(suffixes: list[int], common: list[int], left: list[int], found: dict) -> None:
    """Bottom-up over the LCP intervals of one group of suffixes."""
    stack: list[tuple[int, Interval]] = []
    node = None
    for i, n in zip([*suffixes, -1], [*common, 0]):
        if node is not None:
            while stack and stack[-1][0] > n:
                m, upper = stack.pop()
                node = joined(upper, node, m, left, found)
            if stack and stack[-1][0] == n:
                stack[-1] = (n, joined(stack[-1][1], node, n, left, found))
            else:
                stack.append((n, node))
        if i >= 0:
            node = Interval(i, left[i])


def runs_of(words: pa.Array, n: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text of ``n`` words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in n]
    if not len(words):
        return out
    codes = pc.dictionary_encode(words)
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    begins = np.cumsum(n + 1) - n - 1                       # one mark behind each text
    doc = np.repeat(np.arange(len(n)), n + 1)
    ids = np.empty(len(doc), np.int64)
    marks = begins + n
    is_word = np.ones(len(doc), bool)
    is_word[marks] = False
    ids[is_word] = codes.indices.to_numpy(zero_copy_only=False)
    ids[marks] = len(codes.dictionary) + np.arange(len(n))
    suffixes, first = suffix_groups(ids, doc)
    if not len(suffixes):
        return out
    as_list = ids.tolist()
    common = np.array(common_lengths(as_list, suffixes, first))
    # A group whose nearest members are further apart than its longest common stretch allows has no run.
    group = np.cumsum(first) - 1
    edges = np.flatnonzero(first)
    near = np.lexsort((suffixes, group))
    gaps = np.diff(suffixes[near], prepend=0)
    gaps[first] = np.iinfo(np.int64).max
    able = np.minimum.reduceat(gaps, edges) <= np.maximum.reduceat(common, edges) // (EXPONENT - 1)
    found: dict[tuple[int, int], int] = {}
    left = [-1, *as_list]
    ends = np.append(edges[1:], len(suffixes))
    for g in np.flatnonzero(able).tolist():
        s = slice(int(edges[g]), int(ends[g]))
        maximal_pairs(suffixes[s].tolist(), common[s].tolist(), left, found)
    if found:
        at = np.array([k[0] for k in found], np.int64)
        for d, (start, length), period in zip(doc[at].tolist(), found, found.values()):
            out[d].append((start - int(begins[d]), length, period))
    for some in out:
        some.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; the least start, then period, on ties."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Words that no run holds behind its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= SLICE_BYTES:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` reduced to the words outside of repeats, and what was found.

    Words are stretches without ASCII white space.  A run is a stretch of words
    with least period q and at least ``SHORTEST`` words and ``EXPONENT``
    periods that no neighbour continues.  Each run keeps its first q words; the
    text's kept words are joined by one space.  Added columns (input columns of
    these names are replaced): ``n_runs``, the strongest run's ``start``,
    ``length``, ``period``, ``exponent_milli`` (null without a run) and
    ``runs``, all of them by start, then period.

    A null or empty text has no word, no run and the empty text.  Each row is
    handled by itself, so ids may be null or repeat.  One pass without a
    shuffle; a task holds about ``SLICE_BYTES`` of text at once, or one text.
    """
    docs = docs.drop(*[c for c in MARKS if c != text])
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    at = docs.columns.index(text)

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n, plain = words_in(batch.column(at))
        found = runs_of(words, n)
        texts = plain
        changed = [i for i, r in enumerate(found) if r]
        if changed:
            ends = np.cumsum(n)
            new = [" ".join(kept_words(words.slice(int(ends[i] - n[i]), int(n[i])).to_pylist(), found[i])) for i in changed]
            mask = np.zeros(len(n), bool)
            mask[changed] = True
            texts = pc.replace_with_mask(plain, pa.array(mask), pa.array(new, plain.type))
        best = [strongest(r) for r in found]
        columns = batch.columns
        columns[at] = texts.cast(pa.string())
        long = pa.int64()
        columns += [pa.array([len(r) for r in found], long), *[pa.array([b and b[k] for b in best], long) for k in range(3)],
                    pa.array([b and 1000 * b[1] // b[2] for b in best], long),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found],
                             pa.list_(pa.struct([("start", long), ("length", long), ("period", long)])))]
        return pa.RecordBatch.from_arrays(columns, names)

    names = [*docs.columns, *MARKS]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    schema = ", ".join([*fields, *[f"{m} bigint" for m in MARKS[:-1]], f"runs {RUNS}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for s in _slices(sizes):
                yield some(batch.slice(s.start, s.stop - s.start))

    return docs.mapInArrow(run, schema)
