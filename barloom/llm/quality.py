"""Text quality by hashed word n-grams and a logistic regression trained with follow-the-regularised-leader updates.

A text is a sparse vector: words, and pairs of neighbouring words, hashed to
``2 ** BITS`` features of weight 1 + ln(count), scaled to length 1, and a
constant.  The trainer holds per feature the sums of the FTRL-proximal method
(McMahan et al., 2013); a weight is exactly zero until its gradients outweigh
the L1 penalty.  A score is the logistic of the sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_size, stored, words_of

BITS = 18                        # features: 2 ** BITS, the last one constant
TRAIN_ROWS = 65_536              # labelled documents that are learnt from, by least hash of their ids
SHARD_ROWS = 8_192               # of them, documents of one trainer; trainers are averaged
EPOCHS = 5                       # passes over each block of the trainer's documents
BLOCK_FEATURES = 4_000_000       # features a trainer holds at once
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.05, 0.0
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Codes(dict):
    """64-bit codes of words, looked up once per worker and cache fill."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


_KNOWN = Codes()


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature and value of all entries of some texts, by text, then feature; the constant is left out."""
    if len(_KNOWN) > CACHE_WORDS:
        _KNOWN.clear()
    words = [_WORD.findall(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    total = int(n.sum())
    codes = np.fromiter((_KNOWN[w] for some in words for w in some), np.uint64, total)
    text = np.repeat(np.arange(len(texts)), n)
    pairs = codes[:-1] * _PAIR + codes[1:] if total else codes
    inside = text[:-1] == text[1:] if total else np.zeros(0, bool)
    every = np.concatenate([codes, pairs[inside]])
    owner = np.concatenate([text, text[1:][inside]]) if total else text
    feature = ((every ^ every >> np.uint64(32)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)
    feature = np.minimum(feature, (1 << BITS) - 2)
    keys = np.sort(owner << BITS | feature)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(keys)))
    owner, feature = keys[at] >> BITS, keys[at] & (1 << BITS) - 1
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, value * value, len(texts)))
    return owner, feature, value / norm[owner]


def margins(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """Sparse dot products of ``weights`` and the texts' vectors, the constant included."""
    owner, feature, value = vectors(texts)
    return np.bincount(owner, weights[feature] * value, len(texts)) + weights[-1]


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Trainer:
    """FTRL-proximal sums of gradients and of their squares."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, feature: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(feature)
        g = (logistic(w @ value) - label) * value
        n = self.n[feature]
        self.z[feature] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[feature] = n + g * g

    def learn_block(self, block: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        for _ in range(EPOCHS):
            for feature, value, label in block:
                self.learn(feature, value, label)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, label, text`` of at most ``TRAIN_ROWS`` labelled documents that are not held out.

    Labels other than 0 and 1 do not count; of several labels of an id the
    greatest counts, of several texts the least.  Which ids are learnt from
    depends on their hashes only, so copies and sources do not change the odds.
    """
    kept = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
            .filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("text"))
    return (texts.join(F.broadcast(kept), "doc_id")            # at most TRAIN_ROWS rows of two numbers
            .groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights of all features, learnt from ``training_rows``.

    Trainers of about ``SHARD_ROWS`` documents each run side by side and are
    averaged.  A trainer holds ``BLOCK_FEATURES`` features at once.  Without any
    labelled row all weights are zero and every score is 0.5.
    """
    rows = stored(training_rows(docs, labels, label), "quality-rows")
    shards = max(1, -(-rows.count() // SHARD_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, block, held, seen = Trainer(), [], 0, 0
        for batch in batches:
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in by_size(texts):
                owner, feature, value = vectors(texts[lo:hi])
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    s = slice(ends[k], ends[k + 1])
                    block.append((np.append(feature[s], (1 << BITS) - 1), np.append(value[s], 1.0), marks[lo + k]))
                    held += ends[k + 1] - ends[k]
                    if held > BLOCK_FEATURES:
                        trainer.learn_block(block)
                        block, held = [], 0
                seen += hi - lo
        trainer.learn_block(block)
        if seen:
            w = trainer.weights()
            at = np.union1d(np.flatnonzero(w), [len(w) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at] * seen), pa.array([seen] + [0] * (len(at) - 1))],
                                             ["feature", "weight", "seen"])

    dealt = rows.repartition(shards, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    sums = dealt.select("text", "label").mapInArrow(run, "feature long, weight double, seen long")
    got = stored(sums, "quality-weights").groupBy("feature").agg(F.sum("weight").alias("weight"), F.sum("seen").alias("seen"))\
        .orderBy("feature").toPandas()                         # at most 2 ** BITS rows
    weights = np.zeros(1 << BITS)
    if len(got):
        weights[got["feature"].to_numpy()] = got["weight"].to_numpy() / max(1, got["seen"].sum())
    return weights


def scores(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (clashing input columns are replaced); null counts as empty.

    Whole texts are scored; a text without words gets the constant alone, as
    every empty text does.  Rows are scored one by one, whatever their ids.
    """
    docs = docs.drop("score", "predicted")
    weights = docs.sparkSession.sparkContext.broadcast(weights)   # 2 ** BITS numbers
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            got = [margins(w, texts[lo:hi]) for lo, hi in by_size(texts)]
            score = logistic(np.concatenate(got)) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names)

    names = [*docs.columns, "score"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "score double"])
    return docs.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
