"""Language identification by interpolated Kneser-Ney character models.

A word stands between three start marks and an end mark; its letters and the
end are predicted from three characters before.  Counts of the four-grams of
all training texts are gathered on the cluster; lower orders follow from them
(distinct left neighbours, or plain counts right after a start mark).  The
model is a set of sorted arrays of packed n-grams with one column of
probabilities and one of back-off weights per language; a text gets the
language of lowest cross-entropy per predicted character, and is rejected when
that lies far above what the training texts of the language show.  Every n-gram
is kept.  Languages are independent of each other, so where their arrays are
large together they form several parts, and texts pass the parts one by one.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_size, fresh, give_back, stored

ORDER = 4
START, END = "\x02", "\x03"
PART_CELLS = 1 << 24             # n-grams times languages of a part; a single language is a part whatever its n-grams
MARGIN = 8.0                     # standard deviations above the mean cross-entropy up to which no text is rejected
SCORE_CHARS = 64
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")
_SCORERS: dict[str, "Scorer"] = {}


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def letters(token: str) -> list[str]:
    """The runs of letters of a token."""
    if token.isalpha():
        return [token]
    return [w for w in ("".join(filter(str.isalpha, x)) for x in _WORD.findall(token)) if w]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-grams of the words (UTF-16 units, 16 bits each) and the number of the word of each."""
    text = "".join([START * (ORDER - 1) + w + END for w in words])
    a = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    ends = a == ord(END)
    word = np.cumsum(ends) - ends
    g = (a[:-3] << np.uint64(48)) | (a[1:-2] << np.uint64(32)) | (a[2:-1] << np.uint64(16)) | a[3:]
    real = a[3:] != ord(START)
    return g[real], word[3:][real]


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows with text and lang."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush(lang: str) -> pa.RecordBatch:
            tokens = held.pop(lang)
            words = [(w, n) for t, n in tokens.items() for w in letters(t)]
            if not words:
                return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())],
                                                  ["lang", "gram", "n"])
            g, word = grams([w for w, _ in words])
            keys, at = np.unique(g, return_inverse=True)
            n = np.bincount(at, weights=np.array([n for _, n in words], float)[word], minlength=len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = held.setdefault(lang, Counter())
                tokens.update(text.lower().split())
                if len(tokens) > CACHE_WORDS:
                    yield flush(lang)
            while len(held) > 16 and sum(map(len, held.values())) > CACHE_WORDS:
                yield flush(max(held, key=lambda k: len(held[k])))
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    return (rows.mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _suffix_table(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of one order less with their counts: left neighbours, or plain counts behind a start mark."""
    low = keys & np.uint64((1 << 16 * (order - 1)) - 1)
    out, at = np.unique(low, return_inverse=True)
    kinds, plain = np.bincount(at), np.bincount(at, weights=n)
    begins = out >> np.uint64(16 * (order - 2)) == ord(START)
    if order == 2:
        begins[:] = False
    return out, np.where(begins, plain, kinds)


class Model:
    """Per order: sorted grams with probabilities and sorted contexts with back-off weights, a column per language."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], uniform: float):
        self.key, self.langs, self.uniform = uuid.uuid4().hex, langs, uniform
        tables = []
        for keys, n in counts:
            per = {ORDER: (keys, n.astype(float))}
            for order in range(ORDER, 1, -1):
                per[order - 1] = _suffix_table(*per[order], order)
            tables.append(per)
        self.orders = []
        for order in range(1, ORDER + 1):
            grams_ = np.unique(np.concatenate([t[order][0] for t in tables])) if tables else np.zeros(0, np.uint64)
            ctxs = np.unique(grams_ >> np.uint64(16)) if order > 1 else np.zeros(1, np.uint64)
            seen, back = np.zeros((len(grams_), len(langs)), np.float32), np.ones((len(ctxs), len(langs)), np.float32)
            for j, t in enumerate(tables):
                keys, n = t[order]
                ones, twos = int((n == 1).sum()), int((n == 2).sum())
                d = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
                at = np.searchsorted(ctxs, keys >> np.uint64(16)) if order > 1 else np.zeros(len(keys), np.int64)
                total = np.bincount(at, weights=n, minlength=len(ctxs))
                kinds = np.bincount(at, minlength=len(ctxs))
                known = total > 0
                back[known, j] = d * kinds[known] / total[known]
                seen[np.searchsorted(grams_, keys), j] = np.maximum(n - d, 0) / total[at]
            self.orders.append((grams_, seen, ctxs, back))

    def log_prob(self, g: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of packed four-grams, a column per language."""
        p = np.full((len(g), len(self.langs)), self.uniform)
        for order, (grams_, seen, ctxs, back) in enumerate(self.orders, 1):
            low = g & np.uint64((1 << 16 * order) - 1) if order < ORDER else g
            ctx = low >> np.uint64(16) if order > 1 else np.zeros(len(g), np.uint64)
            p *= self._rows(ctxs, back, ctx, 1.0)
            p += self._rows(grams_, seen, low, 0.0)
        return np.log(p)

    @staticmethod
    def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(wanted), values.shape[1]), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], values[at], default)


class Scorer:
    """A worker's view of a model: sums of log-probabilities per distinct token."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.table = np.zeros((0, len(model.langs) + 1))

    def _learn(self, tokens: list[str]) -> None:
        words = [letters(t) for t in tokens]
        flat = [w for ws in words for w in ws]
        new = np.zeros((len(tokens), self.table.shape[1]))
        if flat:
            owner = np.repeat(np.arange(len(tokens)), [len(ws) for ws in words])
            g, word = grams(flat)
            keys, at = np.unique(g, return_inverse=True)
            lp, to = self.model.log_prob(keys), owner[word]
            for j in range(lp.shape[1]):
                new[:, j] = np.bincount(to, weights=lp[at, j], minlength=len(tokens))
            new[:, -1] = np.bincount(to, minlength=len(tokens))
        start = len(self.index)
        self.index.update(zip(tokens, range(start, start + len(tokens))))
        if start + len(tokens) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), start + len(tokens)), self.table.shape[1]))
            grown[:start] = self.table[:start]
            self.table = grown
        self.table[start:start + len(tokens)] = new

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row per text: summed log-probabilities per language, and the number of predicted characters."""
        cuts = [t.lower().split() for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.index, self.table = {}, self.table[:0]
        missing = list(set().union(*cuts).difference(self.index))
        if missing:
            self._learn(missing)
        get, out = self.index.__getitem__, np.zeros((len(texts), self.table.shape[1]))
        for i, c in enumerate(cuts):
            if c:
                out[i] = self.table[np.fromiter(map(get, c), np.int64, len(c))].sum(axis=0)
        return out


@dataclass
class Models:
    """Parts of the model as broadcast variables, and per language the cross-entropy above which a text is rejected."""

    langs: list[str]
    parts: list[tuple[int, Broadcast]]
    uniform: float
    limits: np.ndarray


def heard(model: Model, first: int, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Per text by the languages of a part, of which the first is number ``first``: best language (-1: no letter), its
    cross-entropy per character, the logarithm of all languages' summed likelihoods over up to ``SCORE_CHARS`` characters,
    and the number of characters.
    """
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    sums = _SCORERS[model.key](texts)
    n = sums[:, -1]
    some = n > 0
    best, cross, mass = np.full(len(texts), -1), np.full(len(texts), np.inf), np.full(len(texts), -np.inf)
    if some.any():
        h = -sums[some, :-1] / n[some, None]
        best[some] = first + h.argmin(axis=1)
        cross[some] = h.min(axis=1)
        k = np.minimum(n[some], SCORE_CHARS)
        # relative to the best, so that nothing underflows
        mass[some] = -cross[some] * k + np.log(np.exp((cross[some, None] - h) * k[:, None]).sum(axis=1))
    return best, cross, mass, n


HEARD = ("best", "cross", "mass", "chars")


def scored(docs: DataFrame, models: Models, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the verdict over all parts in four more columns, and the names of these.

    Each part is one pass over the texts, in which a worker holds that part
    alone; between passes the rows are stored.
    """
    names = fresh(docs, *HEARD)
    at = docs.columns.index(text)
    out = docs.withColumns({names[0]: F.lit(-1).cast("long"), names[1]: F.lit(float("inf")), names[2]: F.lit(float("-inf")), names[3]: F.lit(0.0)})
    for i, (first, part) in enumerate(models.parts):
        def run(batches: Iterator[pa.RecordBatch], first=first, part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                for a, b in by_size(texts):
                    rows = batch.slice(a, b - a)
                    old = [np.asarray(c) for c in rows.columns[-4:]]
                    best, cross, mass, n = heard(part.value, first, texts[a:b])
                    better = cross < old[1]
                    new = [np.where(better, best, old[0]), np.where(better, cross, old[1]), np.logaddexp(old[2], mass), np.maximum(old[3], n)]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-4], *map(pa.array, new)], rows.schema.names)
            give_back()

        if i:
            out = stored(out, "languages")
        out = out.mapInArrow(run, out.schema)
    return out, names


def _score(cross: str, mass: str, chars: str) -> Column:
    """Share of the best language in all likelihoods over up to ``SCORE_CHARS`` characters."""
    return F.when(F.col(chars) > 0, F.least(F.lit(1.0), F.exp(-F.col(cross) * F.least(F.col(chars), F.lit(float(SCORE_CHARS))) - F.col(mass)))).otherwise(0.0)


def _rejected(models: Models, best: str, cross: str) -> Column:
    if not models.langs:
        return F.lit(True)
    limit = F.get(F.array(*[F.lit(float(x)) for x in models.limits]), F.col(best).cast("int"))
    return (F.col(best) < 0) | (F.col(cross) > limit)


def train(docs: DataFrame, part_cells: int = PART_CELLS) -> Models:
    """Fit on all rows of ``docs`` (``doc_id, text, lang``) with text and lang.

    The four-gram counts cover every text, and every four-gram is kept.
    Languages are dealt to parts of about ``part_cells`` n-grams times
    languages, each a broadcast; the arrays of one language must fit a worker.
    Rejection limits come from all rightly predicted training texts of a
    language; one without any gets the floor of all languages' mean.  Without
    any labelled text the model has no language.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna(subset=["text", "lang"])
    counts = stored(gram_counts(rows), "grams")
    sizes = {r.lang: r.k for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}         # a row per language
    langs = sorted(sizes)
    units = counts.select(F.col("gram").bitwiseAND(0xFFFF)).distinct().count()
    models = Models(langs, [], 1.0 / (units + 1), np.full(len(langs), np.inf))
    if not langs:
        return models
    dealt: list[list[str]] = []
    for lang in langs:
        if dealt and (sum(sizes[x] for x in dealt[-1]) + sizes[lang]) * (len(dealt[-1]) + 1) <= part_cells:
            dealt[-1].append(lang)
        else:
            dealt.append([lang])
    for some in dealt:
        kept, per = counts.filter(F.col("lang").isin(some)).toPandas(), []
        for lang in some:
            k = kept[kept.lang == lang]
            keys = k.gram.to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            per.append((keys[order], k.n.to_numpy(np.int64)[order]))
        models.parts.append((langs.index(some[0]), rows.sparkSession.sparkContext.broadcast(Model(some, per, models.uniform))))
    heard_rows, (best, cross, *_) = scored(rows.select("text", "lang"), models)
    own = F.get(F.array(*[F.lit(x) for x in langs]), F.col(best).cast("int"))
    stats = (heard_rows.filter((F.col(best) >= 0) & (own == F.col("lang"))).groupBy(best)
             .agg(F.count(F.lit(1)).alias("n"), F.avg(cross).alias("m"), F.stddev_pop(cross).alias("s")).collect())     # a row per language
    unknown = -np.log(models.uniform)
    right = sum(r.n for r in stats)
    models.limits[:] = ((sum(r.n * r.m for r in stats) / right if right else unknown) + 2 * unknown) / 3
    for r in stats:
        models.limits[r[best]] = max(r.m + MARGIN * r.s, (r.m + 2 * unknown) / 3)     # two thirds of the way to knowing nothing, at least
    return models


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` per row; only ``doc_id`` and ``text`` are read.

    A null text or one without a letter is ``und`` with score 0, null
    cross-entropy and rejected; so is every text if the model has no language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, (best, cross, mass, chars) = scored(rows, models)
    name = F.get(F.array(*[F.lit(x) for x in models.langs]), F.col(best).cast("int")) if models.langs else F.lit(None).cast("string")
    return out.select("doc_id", F.coalesce(F.when(F.col(best) >= 0, name), F.lit("und")).alias("lang_pred"), _score(cross, mass, chars).alias("score"),
                      F.when(F.col(best) >= 0, F.col(cross)).alias("cross_entropy"), _rejected(models, best, cross).alias("rejected"))


def accepted(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected; a null or empty text is."""
    out, (best, cross, *rest) = scored(docs, models, text)
    return out.filter(~_rejected(models, best, cross)).drop(best, cross, *rest)


def fit_on_training_rows(docs: DataFrame, **settings) -> Models:
    return train(docs.filter(~held_out(F.col("doc_id"))), **settings)
