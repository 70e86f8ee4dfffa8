"""Duplicates of all kinds against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, line_dedup, simhash, subspace
from barloom.llm.common import ship_package
from barloom.llm.components import components


def components_of(near):
    label = np.arange(len(near))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(near))]) if len(near) else label
        if (new == label).all():
            return label
        label = new


@pytest.fixture(scope="module")
def texts(spark):
    ship_package(spark)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [[" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 12))] for _ in range(25)]
    out = [None, "", " \t", "\n\n", "Same", "same", "same", "a b", "long " * 40000]
    for lines in base:
        out.append("\n".join(lines))
        for _ in range(rng.randint(0, 4)):
            copy = list(lines)
            if rng.random() < 0.7:
                copy.insert(rng.randrange(len(copy) + 1), word())
            if rng.random() < 0.3:
                copy = copy[rng.randrange(len(copy)):] + base[0]
            out.append("\n".join(copy))
    out += ["hot copy of a text with some words"] * 40
    rows = [(i, t, 1, "x", "y", True) for i, t in enumerate(out)]
    rows += [rows[20], rows[20], (None, "same", 1, "x", "y", False), (None, "only without id", 1, "x", "y", False)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id int, fp string, n_lines string, kept boolean"), rows


@pytest.mark.parametrize("digest", [exact_dedup.md5_128, lambda t: F.length(t).cast("string")])
def test_exact_classes_even_when_hashes_clash(texts, digest):
    df, rows = texts
    got = exact_dedup.classes(df, digest=digest).collect()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    assert len(got) == len(rows)
    for r in got:
        ids = [d for d in groups[r.text or ""] if d is not None]
        assert r.group_size == len(groups[r.text or ""]) and r.keep_id == (max(ids) if ids else None)
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.classes(df, keep="min").filter("text = 'same'").select("keep_id").distinct().collect()[0][0] == 5


def test_exact_deduplicate_keeps_columns_and_one_row(texts):
    df, rows = texts
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    got = [r.text or "" for r in out.collect()]
    assert sorted(got) == sorted({t or "" for _, t, *_ in rows})
    assert {r.kept for r in out.filter("doc_id is not null").collect()} == {True} and set(out.toPandas().keep_id) == {1}
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def test_simhash_rows(texts):
    df, rows = texts
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    x = np.array(fps, dtype=np.uint64)
    label = components_of(np.bitwise_count(x[:, None] ^ x[None]) <= 4)
    least = {}
    for (d, *_), k in zip(rows, label):
        if d is not None:
            least[k] = min(least.get(k, d), d)
    want = sorted(((d, f"{f:016x}", least.get(k)) for (d, *_), f, k in zip(rows, fps, label)), key=repr)
    assert got == want
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, *least.values()}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk, uneven", [(2048, False), (15, False), (40, True)])
def test_simhash_links_lose_nothing(spark, monkeypatch, chunk, uneven):
    ship_package(spark)
    rng = np.random.default_rng(1)
    x = []
    for b in rng.integers(0, 2 ** 63, 25).tolist():
        for _ in range(40):
            v = b
            for k in rng.integers(0, 64, rng.integers(0, 8)).tolist():
                v ^= 1 << k
            x.append(v)
    x = np.unique(np.array(x, dtype=np.uint64))
    if uneven:
        monkeypatch.setattr(simhash, "plan", lambda n, j, r: [(list(range(32)), 1), (list(range(32, 64)), 2)])
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = {r.node: r.component for r in components(simhash.links(df, 4, chunk)).collect()}
    want = components_of(np.bitwise_count(x[:, None] ^ x[None]) <= 4)
    match = {}
    for v, k in zip(x.view(np.int64).tolist(), want.tolist()):
        assert match.setdefault(k, found.get(v, v)) == found.get(v, v)
    assert len(set(match.values())) == len(match)


def test_threshold_plan_covers_the_radius():
    rng = np.random.default_rng(0)
    bits = rng.random((500, 64)) < rng.uniform(0.2, 0.8, 64)
    joint = bits.T.astype(float) @ bits
    for n in (10, 10 ** 5, 10 ** 8, 10 ** 10):
        plan = simhash.plan(n, joint * n / 500, 4)
        assert sum(t + 1 for _, t in plan) == 5 and len({b for bits_, _ in plan for b in bits_}) == sum(len(b) for b, _ in plan)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 2001), (2001, 2000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_patience_alignment():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    assert line_dedup.patience([1, 2, 3, 4], [0, 1, 2, 9, 4]) == [(0, 1), (1, 2), (3, 4)]
    assert line_dedup.patience([1, 2, 3], [3, 1, 2]) == [(0, 1), (1, 2)]
    assert line_dedup.common_blocks([1, 2, 3], [1, 2, 9, 3], [3, 3, 3, 3], 5) == [0, 1]


def test_line_dedup_against_brute_force(texts):
    df, rows = texts
    got = {(r.doc_id, tuple(r.deleted), r.text, r.n_lines) for r in
           line_dedup.deduplicate(df).select("doc_id", "deleted", "text", "n_lines").collect()}
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)
    docs = sorted({(d, h(t)): t for d, t, *_ in rows if d is not None and t}.items())
    lines = {k: [x.strip(" ") for x in t.split("\n")] for k, t in docs}
    holders = {}
    for k, _ in docs:
        for x in dict.fromkeys(lines[k]):
            if x:
                holders.setdefault(x, []).append(k)
    want = set()
    for d, t, *_ in rows:
        cut = set()
        if d is not None and t:
            mine = lines[(d, h(t))]
            partners = {a for x in mine if x for a in (holders[x] if len(holders[x]) <= line_dedup.RARE else holders[x][:1])}
            for a in partners:
                if a < (d, h(t)):
                    cut |= set(line_dedup.common_blocks(lines[a], mine, [len(x.split()) for x in mine], 8))
        kept = t if not cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        want.add((d, tuple(sorted(cut)), kept, 0 if t is None else t.count("\n") + 1))
    assert got == want
    assert line_dedup.deduplicate(df.limit(0)).count() == 0


def test_line_dedup_leaves_no_run_of_any_earlier_document(spark):
    ship_package(spark)
    ones = [f"one {i} two three" for i in range(3)]                     # two of them make a block
    long = [f"long line {i} of nine words in all here" for i in range(2)]
    texts = ([f"{ones[0]}\nalone {i}" for i in range(3)] + [f"{ones[1]}\napart {i}" for i in range(3)]       # first holders of either line differ
             + [f"mine {i}\n{ones[0]}\n{ones[1]}\nend {i}" for i in range(4)]
             + [f"{long[1]}\n{long[0]}", *[f"{long[0]}\n{long[1]}\ntail {i}" for i in range(5)]]              # crossed in the first holder
             + ["x\np q r s\nq r s t\np q r s\nq r s t\ny", "u\np q r s\nq r s t\np q r s\nq r s t\nv"])            # no unique common line
    got = {r.doc_id: r.deleted for r in line_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {**{i: [] for i in range(7)}, **{i: [1, 2] for i in range(7, 10)}, 10: [], **{i: [0, 1] for i in range(11, 16)}, 16: [], 17: [1, 2, 3, 4]}
    assert got == want


def test_line_dedup_deletes_all_that_any_earlier_holder_aligns(spark):
    ship_package(spark)
    rng = random.Random(3)
    lines = [" ".join([f"w{i}"] * rng.randint(0, 9)) for i in range(14)]
    docs = [[rng.choice(lines) for _ in range(rng.randint(1, 9))] for _ in range(120)]
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: set(r.deleted) for r in line_dedup.deduplicate(df).collect()}
    for i, d in enumerate(docs):
        words, aligned, run = [len(x.split()) for x in d], set(), set()
        for a in docs[:i]:
            aligned |= set(line_dedup.common_blocks(a, d, words, 8))
            for s in range(len(d)):
                for e in range(s + 1, len(d) + 1):
                    if sum(words[s:e]) >= 8 and any(a[k:k + e - s] == d[s:e] for k in range(len(a))):
                        run |= set(range(s, e))
        if any(d):
            assert aligned <= got[i] == run


def brute_links(v, ids, cosine):
    n = np.linalg.norm(v, axis=1)
    near = v @ v.T / np.outer(n, n) >= cosine
    np.fill_diagonal(near, True)
    label = components_of(near)
    return {ids[i]: (int(near[i].sum()) - 1, ids[label[i]]) for i in range(len(v))}


@pytest.mark.parametrize("cosine, chunk", [(0.9, 2000), (0.95, 12)])
def test_subspace_join_is_exact(spark, monkeypatch, cosine, chunk):
    ship_package(spark)
    monkeypatch.setattr(subspace, "CELL_ROWS", 20)
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((40, 24))
    v = np.concatenate([c + rng.standard_normal((15, 24)) * rng.uniform(0.05, 0.35) for c in centre] + [np.repeat(centre[:1], 30, axis=0), 3 * centre[:1]])
    ids = list(range(100, 100 + len(v)))
    df = spark.createDataFrame([(i, [float(x) for x in a], 0) for i, a in zip(ids, v)], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in subspace.near_duplicates(df, cosine, chunk=chunk, block_dims=6).collect()}
    assert got == brute_links(v, ids, cosine)


def test_subspace_join_odd_vectors(spark):
    ship_package(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1e300, 0.0]), (9, [1e-300, 0.0]), (10, [0.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, subspace.near_duplicates(df).collect()), key=repr)
    linked = [(i, 4, 1, i == 1) for i in (1, 2, 2, 8, 9)]
    assert got == sorted(linked + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 10, None)], key=repr)
    assert subspace.near_duplicates(df.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [3.0]), (4, [1.0, 2.01]), (5, [-1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in subspace.near_duplicates(mixed).collect()} == {
        1: (1, 1), 3: (1, 1), 2: (1, 2), 4: (1, 2), 5: (0, 5)}


def test_a_dense_group_at_the_limit_gives_no_pair_rows(spark, monkeypatch):
    """1,500 vectors whose cosines all lie near 0.95: over a million pairs to settle, a few thousand rows."""
    ship_package(spark)
    rng, written = np.random.default_rng(1), {}

    def noted(df, name):
        out = stored(df, name)
        written[name] = out.count()
        return out

    stored = subspace.stored
    monkeypatch.setattr(subspace, "stored", noted)
    noise = rng.standard_normal((1500, 64))
    v = np.eye(64)[0] + noise / np.linalg.norm(noise, axis=1, keepdims=True) * np.sqrt(0.05 / 0.95)
    df = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in subspace.near_duplicates(df).collect()}
    assert got == brute_links(v, list(range(1500)), 0.95)
    assert written["settled"] < 20 * 1500 and written["verified"] < 1500


def test_subspace_tiles_are_pulled_not_copied(spark, monkeypatch):
    """The pairs of tiles come without an exchange or an explode, and the tiles hold every vector once."""
    ship_package(spark)
    stored, seen = subspace.stored, {}

    def noted(df, name):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        out = stored(df, name)
        seen[name + "-rows"] = out
        return out

    monkeypatch.setattr(subspace, "stored", noted)
    v = np.random.default_rng(3).standard_normal((300, 64))
    df = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(v)], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.vec_id: (r.n_links, r.component_id) for r in subspace.near_duplicates(df, 0.3, chunk=100).collect()}
    assert got == brute_links(v.astype(np.float32).astype(float), list(range(300)), 0.3)
    assert not any(x in seen["settled"] for x in ("Exchange", "Generate")) and "CartesianProduct" in seen["settled"]
    assert sum(len(r.rows) for r in seen["tiles-rows"].collect()) == 300 * (16 + 3 * 64)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
