"""Sharding, URL rules, language identification, registered queries and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import language, sharding, url_filter
from barloom.llm.common import ship_package, stored
from check import compare, oracle
from conftest import SF
from test_llm_near import classes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sharded(df, n, **settings):
    path = sharding.write_shards(df, n, **settings)
    return sharding.read_shards(df.sparkSession, path, df)


@pytest.mark.parametrize("n, bucket_bytes", [(16, 400), (3, 1 << 20)])
def test_shards_are_even_and_whole(spark, n, bucket_bytes):
    rows = [(i, None if i % 9 == 0 else "hot" if i % 3 else f"text {i}", i, "s", "r") for i in range(200)] + [(7, "twice", 1, "s", "r")] * 2 + [(None, "", 1, "s", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string, record string")
    out = sharded(df, n, bucket_bytes=bucket_bytes)
    got = out.collect()
    assert sorted((tuple(r.record) for r in got), key=repr) == sorted(rows, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(n)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    order = [r.record.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    again = [r.record.doc_id for r in sorted(sharded(df, n, bucket_bytes=bucket_bytes).collect(), key=lambda r: (r.shard, r.slot))]
    other = [r.record.doc_id for r in sorted(sharded(df, n, bucket_bytes=bucket_bytes, seed=1).collect(), key=lambda r: (r.shard, r.slot))]
    assert order == again != other and order != sorted(order, key=lambda d: d or 0)
    assert sharded(df.limit(0), n).count() == 0


def test_running_offsets(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    got = {r.k: r.offset for r in sharding.running_offsets(df, "k", "n").collect()}
    assert all(got[k] == sum(i % 7 for i in range(k)) for k in range(0, 3000, 97))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("COM", "/de/", "block"),
         ("b.c", "", "block"), ("x.org", "/", "allow"), ("x.org", "/", "block")]
URLS = [None, "", "org/", "http://org", "http://org/", "HTTP://A.ORG/x?y", "http://example.org/es/1", "http://sub.Example.org/en/123#f", "http://notexample.org/es/",
        "http://example.org/en", "a://b.com/de/x", "a://b.com/de", "://com/fr/", "http://a.b.c", "http://ab.c/", "http://x.org/a", "http://e.com?://org/",
        "http://com/fr/?q", "http://" + "a." * 3000 + "org/" + "p" * 5000, "x://y://org/", "http://user@org/", "http://org:80/", "http://a.com/x\n/fr/"]


def plain_verdict(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


@pytest.mark.parametrize("words", [1, 64, url_filter.FILTER_WORDS])
def test_url_rules_with_any_filter(spark, words):
    rows = [(i, u, "clash", 5) for i, u in enumerate(URLS + URLS[4:6])] + [(100 + i, "http://hot.org/p", "c", 1) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules, words=words).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if True) == sorted((i, *plain_verdict(u)) for i, u, *_ in rows)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_kneser_ney_probabilities_sum_to_one(spark):
    ship_package(spark)
    import numpy as np

    df = spark.createDataFrame([(i, t, l, "s", 1) for i, (t, l) in enumerate([("abra cadabra", "x"), ("abba baba abracadabra", "x"), ("zzyzx xyzzy", "y")])], DOC)
    m = language.train(df).parts[0][1].value
    units = np.unique(m.orders[0][0])
    for ctx in ("\x02\x02\x02", "\x02\x02a", "abr", "qqq", "zzy"):
        base = 0
        for c in ctx:
            base = base << 16 | ord(c)
        g = np.array([base << 16 | int(u) for u in units], dtype=np.uint64)
        assert np.allclose(np.exp(m.log_prob(g)).sum(axis=0) + np.exp(m.log_prob(np.array([base << 16 | 0x9999], dtype=np.uint64)))[0], 1, atol=1e-5)


def test_language_of_odd_texts(spark):
    ship_package(spark)
    rng = random.Random(2)
    text = lambda ab: " ".join("".join(rng.choice(ab) for _ in range(rng.randint(2, 7))) for _ in range(30))
    rows = [(i, text("abcdeio") if i % 2 else text("xyzuvwé"), "one" if i % 2 else "two", "s", 1) for i in range(120)]
    rows += [(500, None, "one", "s", 1), (501, "", None, "s", 1), (502, "12 34 ½ !", "one", "s", 1), (503, "語" * 400, None, "s", 1), (504, "ABIDE ice!", None, "s", 1), (None, "abc de", None, None, None),
             rows[0], (505, "abc io " * 40000, None, "s", 1)]
    df = spark.createDataFrame(rows, DOC)
    m = language.fit_on_training_rows(df)
    got = {r.doc_id: r for r in language.predict(df.withColumn("score", F.lit("clash")), m).collect()}
    assert all(got[i].lang_pred == ("one" if i % 2 else "two") and not got[i].rejected and 0 <= got[i].score <= 1 for i in range(120))
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (500, 501, 502))
    assert got[503].rejected and got[503].lang_pred in m.langs
    assert got[504].lang_pred == got[505].lang_pred == got[None].lang_pred == "one" and not got[505].rejected
    kept = language.accepted(df, m)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got) - {500, 501, 502, 503}
    none = language.train(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"} and language.accepted(df, none).count() == 0


def test_parts_change_no_prediction_and_drop_no_gram(spark):
    """Sixty languages in one part, in many parts, and four of them alone: one prediction per text."""
    ship_package(spark)
    rng = random.Random(6)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(25)] for k in range(60)}
    rows = [(100 * i + j, " ".join(rng.choice(ws) for _ in range(20)), lang) for i, (lang, ws) in enumerate(words.items()) for j in range(3)]
    rows.append((9_999, "", "l00"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many, few = language.train(df), language.train(df, part_cells=2_000), language.train(df.filter("lang < 'l04'"))
    assert len(one.parts) == 1 and len(many.parts) > 10 and np.allclose(one.limits, many.limits)
    grams = [
        len({g for r in rows if r[2] == lang for g in language.grams([w for t in r[1].lower().split() for w in language.letters(t)])[0].tolist()})
        for lang in words]
    kept = [int((p.value.orders[-1][1][:, j] > 0).sum()) for _, p in many.parts for j in range(len(p.value.langs))]
    assert kept == grams
    a, b = ({r.doc_id: r for r in language.predict(df, m).collect()} for m in (one, many))
    assert all(a[i].lang_pred == b[i].lang_pred and abs(a[i].score - b[i].score) < 1e-9 and a[i].rejected == b[i].rejected for i in a)
    right = {d: lang for d, _, lang in rows if d != 9_999}
    assert all(a[i].lang_pred == right[i] for i in right) and a[9_999].lang_pred == b[9_999].lang_pred == "und"
    c = {r.doc_id: r.lang_pred for r in language.predict(df.filter("lang < 'l04'"), few).collect()}
    assert all(c[i] == a[i].lang_pred for i in c)


def test_rejection_limits_come_from_all_training_rows(spark):
    ship_package(spark)
    text = lambda i: f"{'abcdefgh'[i % 8]}a {'klmnop'[i % 6]}o {'rstu'[i % 4] * (1 + i % 3)}"
    rows = [(i, text(i), "one") for i in range(7000)] + [(i, f"zyx {'vw'[i % 2]}yx", "rare") for i in range(7000, 7003)] \
        + [(10_000 + i, text(i), "twin") for i in range(7000)]               # never predicted: equal counts, and the first wins
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.train(df)
    h = {}
    for r in language.predict(df, m).join(df.select("doc_id", "lang"), "doc_id").filter("lang = lang_pred").collect():
        h.setdefault(r.lang, []).append(r.cross_entropy)
    unknown, every = -np.log(m.uniform), [x for xs in h.values() for x in xs]
    missing = set(m.langs) - set(h)
    assert len(missing) == 1 and len(h["rare"]) == 3
    for lang, limit in zip(m.langs, m.limits):
        own = h.get(lang)
        want = (np.mean(every) + 2 * unknown) / 3 if own is None else max(np.mean(own) + language.MARGIN * np.std(own), (np.mean(own) + 2 * unknown) / 3)
        assert np.isclose(limit, want, rtol=1e-9)


def test_language_accuracy_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op9_kneser_ney_language"](spark, SF).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op8_url_rules"])
def test_sql_of_queries(spark, name):
    err, _ = compare(entry.queries()[name](spark, SF), oracle(SF), entry.oracle_sql()[name])
    assert err is None, err


def test_pipeline_stages(spark):
    ship_package(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(
        [(10_001, None, "en", "s", 0), (10_002, "", None, "s", 0), (10_003, "123 456", "en", "s", 7)], DOC))
    docs = docs.unionByName(docs.filter("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 20_000))
    before, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "nnls_packing"]
    stage = dict(corpus_pipeline.STAGES)
    a = stored(stage["language_id"](spark, before, SF), "a")
    m = language.fit_on_training_rows(before)
    rejected = {r.doc_id for r in language.predict(before, m).filter("rejected").collect()}
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in before.collect()} - rejected and {10_001, 10_002, 10_003} <= rejected
    b = stored(stage["exact_dedup"](spark, a, SF), "b")
    best = {}
    for r in a.collect():
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert {r.doc_id for r in b.collect()} == set(best.values())
    c = stored(stage["simhash_near_dedup"](spark, b, SF), "c")
    component, _ = classes({r.doc_id: r.text for r in b.collect()})
    assert {r.doc_id for r in c.collect()} == set(component.values())
    assert all(x.columns == before.columns for x in (a, b, c))
    d = stage["nnls_packing"](spark, c, SF).collect()
    assert {r.doc_id for r in d} == set(component.values()) and all(r.offset + r.length <= 2048 for r in d)


def test_pipeline_of_no_documents(spark):
    empty = spark.createDataFrame([], DOC)
    for name, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SF), name)
    assert empty.count() == 0
