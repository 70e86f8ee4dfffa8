"""Line dedup by pairwise alignment: documents that share lines are aligned with a patience diff.

Partners come from minimal runs: consecutive lines that just reach the words of
a block, counted from each line forwards and from each line backwards.  Any
block that two documents share is covered by runs they share, so it is enough
to pair a document with the first holder of each of its runs: one pair per
document and run, however many hold it.  A pair is aligned; aligned blocks with
enough words are deleted from the later document, and so are the runs of it
that the alignment missed (crossed or repeated lines) though the partner has
them.  So no run stays that any earlier document has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, stored, words_of

MIN_WORDS = 8
RARE = 4                     # of the former rule, which the brute-force test states; no longer bounds partners
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (ascending in the first) that ascends in the second."""
    tails: list[int] = []                      # position in ``pairs`` of the end of each pile
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        lo, hi = 0, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            if ends[mid] < j:
                lo = mid + 1
            else:
                hi = mid
        back[k] = tails[lo - 1] if lo else -1
        if lo == len(tails):
            tails.append(k)
            ends.append(j)
        else:
            tails[lo], ends[lo] = k, j
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal elements: anchors are elements unique on both sides, gaps are solved alike."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        alo, ahi, blo, bhi = work.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        where: dict[int, int] = {}
        for i in range(alo, ahi):
            where[a[i]] = -1 if a[i] in where else i
        seen: dict[int, int] = {}
        for j in range(blo, bhi):
            if b[j] in where:
                seen[b[j]] = -1 if b[j] in seen else j
        anchors = _increasing(sorted((where[x], j) for x, j in seen.items() if j >= 0 and where[x] >= 0))
        if not anchors:
            continue
        out.extend(anchors)
        for (i0, j0), (i1, j1) in zip([(alo - 1, blo - 1), *anchors], [*anchors, (ahi, bhi)]):
            work.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Positions of ``b`` in aligned blocks (consecutive on both sides) with at least ``min_words`` words."""
    out, block, last = [], [], (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def minimal_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the shortest runs of lines with ``min_words`` words, from each line forwards and backwards."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n, need = len(words), max(min_words, 1)
    ends = np.searchsorted(total, total[:-1] + need)
    starts = np.searchsorted(total, total[1:] - need, side="right") - 1
    fore, back = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate([fore * (n + 1) + ends[fore], starts[back] * (n + 1) + back + 1]))
    return both // (n + 1), both % (n + 1)


def run_hashes(seq: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Distinct hashes of the minimal runs of a document."""
    starts, ends = minimal_runs(words, min_words)
    out, at, size = np.zeros(len(starts), np.uint64), starts.copy(), ends - starts
    lines = seq.astype(np.int64).view(np.uint64)
    for _ in range(int(size.max(initial=0))):
        on = np.flatnonzero(at < ends)
        if len(on) < 8:                                                  # few long runs: each on its own
            for k in on.tolist():
                h = int(out[k])
                for x in lines[at[k]:ends[k]].tolist():
                    h = (h ^ x) * int(_BASE) & 0xFFFFFFFFFFFFFFFF
                    h ^= h >> 29
                out[k] = h
            break
        h = (out[on] ^ lines[at[on]]) * _BASE
        out[on] = h ^ (h >> np.uint64(29))
        at[on] += 1
    return np.unique(out).view(np.int64)


def shared_runs(a: np.ndarray, a_words: np.ndarray, b: np.ndarray, words: np.ndarray, min_words: int) -> set[int]:
    """Positions of ``b`` in minimal runs that ``a`` has too."""
    a, b, out = np.ascontiguousarray(a, np.int64).tobytes(), np.ascontiguousarray(b, np.int64).tobytes(), set()
    held = {a[8 * s:8 * e] for s, e in zip(*(x.tolist() for x in minimal_runs(a_words, min_words)))}
    for s, e in zip(*(x.tolist() for x in minimal_runs(words, min_words))):
        if b[8 * s:8 * e] in held:
            out.update(range(s, e))
    return out


def _lines(text: Column) -> Column:
    return F.split(words_of(text.cast("string")), "\n")


def marks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id, body, deleted``: positions (from 0) of the deleted lines of each document that loses any; ``body`` is its text's hash.

    A document is its id and text: ids that repeat with another text are other
    documents (ordered by the text's hash), repeated rows are one document.
    Rows with a null id, null and empty texts neither lose nor cause anything.
    Lines are compared without outer white space; only runs with a word count
    for pairs.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).filter("id is not null and length(t) > 0")
    seqs = stored(rows.select("id", F.xxhash64("t").alias("body"), F.transform(_lines(F.col("t")), lambda x: F.trim(x)).alias("l"))
                  .select("id", "body", F.transform("l", lambda x: F.xxhash64(x)).alias("seq"),
                          F.transform("l", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+")))).alias("words"))
                  .dropDuplicates(["id", "body"]), "line-sequences")

    @F.pandas_udf("array<bigint>")
    def runs(seq: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([run_hashes(x, w, min_words) for x, w in zip(seq, words)])

    flat = seqs.select(F.struct("id", "body").alias("doc"), F.explode(runs("seq", "words")).alias("h"))
    held = flat.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).filter("n > 1")
    pairs = (flat.join(held, "h").filter(F.col("first") < F.col("doc"))
             .select(F.col("first.id").alias("a_id"), F.col("first.body").alias("a_body"),
                     F.col("doc.id").alias("id"), F.col("doc.body").alias("body")).distinct())
    a = seqs.select(F.col("id").alias("a_id"), F.col("body").alias("a_body"), F.col("seq").alias("a_seq"), F.col("words").alias("a_words"))
    both = pairs.join(a, ["a_id", "a_body"]).join(seqs, ["id", "body"])

    @F.pandas_udf("array<int>")
    def align(a: pd.Series, a_words: pd.Series, b: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([sorted({*common_blocks(x.tolist(), y.tolist(), w.tolist(), min_words), *shared_runs(x, v, y, w, min_words)})
                          for x, v, y, w in zip(a, a_words, b, words)])

    hit = both.select("id", "body", align("a_seq", "a_words", "seq", "words").alias("cut")).filter(F.size("cut") > 0)
    return hit.select("id", "body", F.explode("cut").alias("line")).distinct().groupBy("id", "body").agg(F.array_sort(F.collect_list("line")).alias("deleted"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text shortened, and ``n_lines``, ``deleted`` (positions of deleted lines); such input columns are replaced.

    Untouched texts are returned byte for byte; a null text stays null with no
    lines; a document whose lines all go has the empty text.  An empty table
    gives none.
    """
    docs = docs.drop("n_lines", "deleted")
    i, h, cut = fresh(docs, "cut_id", "cut_body", "cut_lines")
    m = marks(docs, doc_id, text, min_words).toDF(i, h, cut)
    t = F.col(text).cast("string")
    out = docs.join(m, (F.col(f"`{doc_id}`") == F.col(i)) & (F.xxhash64(t) == F.col(h)), "left")
    kept = F.filter(_lines(t), lambda x, k: ~F.array_contains(F.col(cut), k.cast("int")))
    short = F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return out.select(*[(short.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns],
                      F.when(t.isNull(), 0).otherwise(F.size(_lines(t))).alias("n_lines"),
                      F.coalesce(F.col(cut), F.array().cast("array<int>")).alias("deleted"))
