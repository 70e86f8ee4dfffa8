"""Near-duplicates at a Jaccard similarity of 0.8 against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import near
from barloom.llm.common import ship_package, stored

DOC = "doc_id long, text string"


def classes(texts, similarity=0.8):
    """Smallest id reachable by links, every pair of texts compared."""
    sets = {i: set(near.shingles(t or "").tolist()) for i, t in texts.items()}
    ids, least = sorted(sets), {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    pairs = 0
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                pairs += 1
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: root(i) for i in ids}, pairs


def copies(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def corpus(seed, groups, size):
    """Groups of texts whose members change one word in about 60 of the group's first text."""
    rng, rows = random.Random(seed), {}
    for _ in range(groups):
        base = [f"w{rng.randrange(5_000)}" for _ in range(rng.choice([20, 70, 200, 900]))]
        for _ in range(rng.randrange(1, size)):
            rows[len(rows)] = " ".join(copies(rng, base, rng.randrange(0, max(2, len(base) // 60))))
    return rows


def found(spark, rows, **kw):
    ship_package(spark)
    docs = stored(spark.createDataFrame(list(rows.items()), DOC), "docs")
    return {r.doc_id: r.component_id for r in near.near_duplicates(docs, **kw).collect()}


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus(1, 60, 6)
    want, _ = classes(rows)
    got = found(spark, rows)
    assert set(got) == set(rows)
    joined = sum(want[i] != i for i in rows)
    assert joined > 50 and sum(got[i] != want[i] for i in rows) <= 0.05 * joined
    assert all(want[got[i]] == want[i] for i in rows)             # nothing is linked that should not be


def test_recall_of_pairs_about_the_limit(spark):
    rng, rows, near_pairs = random.Random(3), {}, []
    for k in range(250):
        base = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice([100, 300, 600]))]
        rows[2 * k], rows[2 * k + 1] = " ".join(base), " ".join(copies(rng, base, round(len(base) * rng.uniform(0.012, 0.032))))
        a, b = set(near.shingles(rows[2 * k]).tolist()), set(near.shingles(rows[2 * k + 1]).tolist())
        near_pairs.append(len(a & b) / len(a | b))
    got = found(spark, rows)
    linked = np.array([got[2 * k + 1] == 2 * k for k in range(250)])
    high = np.array(near_pairs) >= 0.8
    assert high.sum() > 50 and linked[high].mean() >= 0.9 and not linked[~high].any()


def test_a_hot_group_in_chunks_is_whole(spark):
    ship_package(spark)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5_000)}" for _ in range(300)]
    rows = {i: " ".join(copies(rng, base, 2)) for i in range(200)}
    nodes = stored(near.sketches(spark.createDataFrame(list(rows.items()), DOC)).withColumnRenamed("doc_id", "node"), "nodes")
    links = near.banded_links(nodes, 0.8, chunk=16)
    assert links.select("a", "b").distinct().count() < 200 * 199 / 8
    found_links = [(r.a, r.b) for r in links.collect()]
    reach, grew = {0}, True
    while grew:
        more = {x for p in found_links for x in p if reach & set(p)} - reach
        reach, grew = reach | more, bool(more)
    assert len(reach) == 200


def test_odd_rows(spark):
    ship_package(spark)
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "a b c d e f"), (7, "a b c d e f"), (8, "A  B c d e F"), (8, "A  B c d e F"),
            (11, "one two"), (12, "One two"), (13, "one two three"), (21, long), (22, long + " end"), (23, "solo text of these seven words only")]
    docs = spark.createDataFrame(rows, DOC).withColumn("n", F.lit(1)).withColumn("sig", F.lit("s")).withColumn("component_id", F.lit(2))
    got = sorted((r.doc_id, r.component_id) for r in near.near_duplicates(docs).collect())
    assert got == [(3, 3), (5, 3), (7, 7), (8, 7), (8, 7), (9, 3), (11, 11), (12, 11), (13, 13), (21, 21), (22, 21), (23, 23)]
    left = near.deduplicate(docs)
    assert left.columns == ["doc_id", "text", "n", "sig", "component_id"]
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 3, 7, 11, 13, 21, 23]
    assert near.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_the_first_word_is_the_fingerprint_of_distinct_shingles():
    h = near.shingles(" ".join(f"w{i * i % 97}" for i in range(700)))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    want = sum(1 << i for i in range(64) if 2 * bits[i] > len(h))
    assert int(near.long_fingerprint(h)[0]) == want
