"""Prefix trie and runs against brute force, quality against held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import quality, queries, runs, trie
from barloom.llm.common import ship_package

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, n_convs string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text)]} by the definition."""
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    out = set()

    def walk(key):
        cost = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        below = [walk(k) for k in kids.get(key, [])]
        leaves, saved = sum(b[0] for b in below) or 1, cost + sum(b[1] for b in below)
        ended = sorted(c for c in members[key] if len(convs[c]) == len(key))
        out.add((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(kids.get(key, [])),
                 leaves, saved, sha(",".join(map(str, ended)))))
        return leaves, saved

    if members:
        walk(())
    return out


def turn_order(t):
    return (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")


def plain_rebuilt(rows):
    convs = {}
    for t in sorted((r for r in rows if r[0] is not None), key=turn_order):
        convs.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return convs, out


@pytest.fixture(scope="module")
def talks(spark):
    ship_package(spark)
    rng = random.Random(11)
    rows = []
    for c in range(60):
        if rng.random() < 0.15:
            continue                                             # absent, so what it leads is shorter
        same = rng.random() < 0.6
        for t in range(rng.choice([0, 1, 2, 5, 9, 12, 23])):
            said = "hot" if t == 0 else f"t{t}" if same else rng.choice(["a", "b", "", None, "é" * 3])
            rows.append((c, rng.choice([None, t]) if t == 3 else t, "user" if t % 2 else None, said, "x"))
    rows += [(70, 1, "r", "tie", "x"), (70, 1, "r", "tie", "x"), (70, 1, "q", "tie", "x"), (None, 0, "user", "lost", "x"),
             (71, 5, "r", "long " * 50_000, "x")]
    rows += [(75, k, "user", f"w{k}", "x") for k in range(300)] + [(76, k, "user", f"w{k}", "x") for k in range(260)]
    return spark.createDataFrame(rows, TURNS), rows


@pytest.mark.parametrize("block, span, piece", [(4, 4096, 8192), (2, 3, 2)])
def test_trie_of_rebuilt_conversations(talks, monkeypatch, block, span, piece):
    df, rows = talks
    for name, value in (("BLOCK", block), ("SPAN", span), ("PIECE", piece)):
        monkeypatch.setattr(trie, name, value)
    got = [tuple(r) for r in trie.prefix_trie(*trie.rebuilt(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(plain_rebuilt(rows)[1])


def test_trie_of_plain_conversations_and_of_none(talks):
    df, rows = talks
    assert {tuple(r) for r in trie.prefix_trie(*trie.plain(df)).collect()} == plain_trie(plain_rebuilt(rows)[0])
    assert trie.prefix_trie(*trie.rebuilt(df.limit(0))).count() == 0


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_row(words):
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def test_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            words = []
            while rng.random() < 0.8:
                words += [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9)
                words = words[:len(words) - rng.randint(0, 3)]
            docs.append(words)
        texts = pa.array([" ".join(d) if d else rng.choice([None, "", " \t"]) for d in docs])
        words, n, _ = runs.words_in(texts)
        assert runs.runs_of(words, n) == [plain_runs(d) for d in docs]


def test_maximal_pairs_are_few_on_one_word_texts():
    n = 20_000
    words, sizes, _ = runs.words_in(pa.array([" ".join(["a"] * n), "b"]))
    assert runs.runs_of(words, sizes) == [[(0, n, 1)], []]


def test_collapse_keeps_columns_and_odd_texts(spark):
    ship_package(spark)
    odd = [(None, None, 1, "s"), (1, "", 2, None), (1, "x " * 9, 3, "s"), (1, "x " * 9, 3, "s"), (2, "\x1cno split\x85" + " a b" * 50_000, 4, "s"),
           (3, "one two", 5, "s")]
    df = spark.createDataFrame(odd, "doc_id long, text string, start int, n_chars string")
    out = runs.collapse(df)
    assert out.columns == ["doc_id", "text", "n_chars", *runs.MARKS]
    got = sorted(((r.n_runs, r.start, r.length, r.period, r.text, r.n_chars) for r in out.collect()), key=repr)
    want = [(0, None, None, None, "", "s"), (0, None, None, None, "", None), (0, None, None, None, "one two", "s"),
            (1, 0, 9, 1, "x", "s"), (1, 0, 9, 1, "x", "s"), (1, 1, 100_000, 2, "\x1cno split\x85 a b", "s")]
    assert got == sorted(want, key=repr)
    assert runs.collapse(df.limit(0)).count() == 0


def test_runs_query_by_the_definition(spark):
    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_maximal_pair_runs"](spark, SF).collect()}
    assert set(got) == set(docs)
    changed = 0
    for d, words in docs.items():
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)], changed + 1
        if n < 3000:
            assert got[d] == plain_row(words), d
    assert changed > 5 and sum(r[0] > 0 for r in got.values()) > 5


def test_quality_of_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_ftrl_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
               for d, r in got.items())
    test = [(labels[d], r.score, r.predicted) for d, r in got.items() if r.held_out and labels.get(d) is not None]
    good, bad = [t for t in test if t[0] == 1], [t for t in test if t[0] == 0]
    assert len(bad) >= 5 and np.mean([g[1] > b[1] for g in good for b in bad]) > 0.98
    assert np.mean([t[2] for t in good]) > 0.98 and np.mean([t[2] == 0 for t in bad]) > 0.6


def test_quality_of_odd_rows(spark):
    ship_package(spark)
    rows = [(None, None, "x"), (1, "", "x"), (1, "good words here", "x"), (1, "good words here", "x"), (2, "bad ### ###", "x"),
            (3, "long ### " * 50_000, "x"), (4, "😀 一二 _ __", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (7, 1), (4, 5)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    assert {r.doc_id: r.label for r in quality.training_rows(docs, labels).collect()} == \
        {d: q for d, q in {1: 1, 2: 0}.items() if zlib.crc32(str(d).encode()) % 5}
    out = quality.scores(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    none = quality.fit(docs.limit(0), labels)
    assert not none.any() and {r.score for r in quality.scores(docs, none).collect()} == {0.5}
    assert quality.scores(docs.limit(0), none).count() == 0


def test_leader_updates_follow_the_method():
    """One feature by hand: the closed form minimises the sum of linearised losses and penalties."""
    t, z, n, w = quality.Trainer(), 0.0, 0.0, 0.0
    for label in (1, 0, 1, 1, 1):
        t.learn(np.array([3]), np.array([0.5]), label)
        g = (1 / (1 + np.exp(-0.5 * w)) - label) * 0.5
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA * w
        n += g * g
        w = 0.0 if abs(z) <= quality.L1 else -(z - np.sign(z) * quality.L1) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2)
    assert t.weights()[3] == pytest.approx(w)
