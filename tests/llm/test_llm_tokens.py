"""Token shards, BPE and packing against the libraries and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from barloom.llm import bpe, packing, tokens, wavelet
from barloom.llm.common import ship_package

SCHEMA = "doc_id long, text string, shard int, ids string, segment string"
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "B", " ", "  ", "\n", "\t", "\x1c", " ", "é", "'s", " 's", "1", "12", "!", "?!", "́", "　",
          "<|endoftext|>", "İ", "Σ", "日本", " \n", "\r\n", "\x85", "😀", "the", "tion", "."]


def odd_texts(n=300, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    texts = [None, "", " ", "one", "one two", *odd_texts(60), "word " * 30000, "x" * 50000, "same text", "same text"]
    rows = [(i * 3, t, i, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id", 1, "c", "c"), (6, "another text of a repeated id", 1, "c", "c")]
    return spark.createDataFrame(rows, SCHEMA), rows


def library_ids(name, text):
    tok = Tokenizer.from_file(P.path(name))
    return np.array(tok.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_wavelet_matrix_access_rank_select():
    rng = np.random.default_rng(0)
    for n, k in ((0, 1), (1, 1), (5, 1), (700, 2), (3000, 7), (5000, 70000)):
        x = rng.integers(0, k, n).astype("<u4")
        m = wavelet.WaveletMatrix.build(x)
        m = wavelet.WaveletMatrix.from_bytes(m.to_bytes(), n, len(m.ids), len(m.planes))
        assert (m.tokens() == x).all()
        for i in rng.integers(0, max(n, 1), min(n, 30)).tolist():
            assert m.access(i) == x[i]
        for c in [*x[:10].tolist(), 99999]:
            at = np.flatnonzero(x == c)
            assert m.rank(c, n) == len(at) and m.rank(c, n // 2, n // 4) == ((at >= n // 4) & (at < n // 2)).sum()
            assert all(m.select(c, j) == at[j] for j in range(min(len(at), 4))) and m.select(c, len(at)) is None


def test_shards_round_trip(spark, docs, tmp_path):
    df, rows = docs
    path = wavelet.write_shards(df, P.path("byte_bpe_50k.json"), str(tmp_path / "s"), segment_tokens=5000)
    got = sorted(map(tuple, wavelet.read_shards(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    want, start = [], 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(library_ids("byte_bpe_50k.json", t), 2).astype("<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("name, keep_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_plain_library_call(name, keep_space):
    texts = ["hello <|endoftext|> world", "<|startoftext|>a  b<|endoftext|>", "<|ENDOFTEXT|> x", "", " a", "a \n b", "one two three", "İx Ⅳ é",
             *odd_texts(200, 8)]
    ids_of = tokens.LibraryEncoder(P.path(name), keep_space)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ids_of(texts)] == [library_ids(name, t).tolist() for t in texts]
    assert 50256 in library_ids("byte_bpe_50k.json", texts[0])
    assert ids_of([]) == [] and ids_of(texts[:1]) == ids_of(texts)[:1]


def test_shards_of_no_rows(spark, docs, tmp_path):
    path = wavelet.write_shards(docs[0].limit(0), P.path("byte_bpe_50k.json"), str(tmp_path / "e"))
    assert wavelet.read_shards(spark, path).count() == 0


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue_equals_library():
    enc, own = tiktoken_encoding(), bpe.encoder(MULTI, P.PATTERN)
    texts = [*odd_texts(1500), "a" * 5000, "ab" * 3000, "abc" * 999, "".join(random.Random(1).choice("aeiou") for _ in range(20000))]
    for t, packed in zip(texts, own(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(t)


def test_lower_rank_may_appear_late(tmp_path):
    """A merge can create a pair of lower rank than its own; it must go first."""
    words = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab"]
    order = {b"abc": 256, b"bc": 400, b"ab": 300}
    lines = [(w, order.get(w, i)) for i, w in enumerate(words)]
    path = tmp_path / "r"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for w, i in lines))
    assert bpe.Ranks(str(path)).encode(b"abab") == [300, 300]
    assert bpe.Ranks(str(path)).encode(b"ababc") == [300, 256]


def test_bpe_digests_and_columns(spark, docs):
    df, rows = docs
    enc = tiktoken_encoding()
    got = sorted(map(str, bpe.round_trip(df, MULTI, P.PATTERN).collect()))
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.lossless) for r in bpe.round_trip(df, MULTI, P.PATTERN).collect()}
    for d, t, *_ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), dtype="<u4")
        assert (d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True) in by
    full = bpe.decode_ids(bpe.encode_texts(df, MULTI, P.PATTERN), MULTI)
    assert set(full.columns) == set(df.columns) | {"ids", "bytes"}
    assert all(r.bytes.decode() == (r.text or "") for r in full.collect())
    assert bpe.round_trip(df.limit(0), MULTI, P.PATTERN).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_solver_uses_every_piece_once(kind):
    rng, h = np.random.default_rng(kind), np.zeros(129, np.int64)
    if kind == 0:
        np.add.at(h, rng.integers(1, 129, 20000), 1)
    elif kind == 1:
        h[100], h[30] = 1000, 10
    elif kind == 2:
        h[1] = 100_000
    elif kind == 3:
        h[rng.integers(1, 129, 9)] = 3
    pats, n = packing.solve(h)
    used = np.zeros(129, np.int64)
    for k in range(pats.shape[1]):
        np.add.at(used, pats[:, k], n)
    used[0] = 0
    assert (used == h).all() and (pats.sum(axis=1) <= 128).all()
    if kind == 0:
        assert (np.arange(129) * h).sum() / (128 * n.sum()) > 0.98


def test_packing_places_every_token(spark, docs):
    df, rows = docs
    placed = packing.pack(df, P.path("word_bpe_49k.json"), window=64).collect()
    want = []
    for d, t, *_ in rows:
        ids = np.append(library_ids("word_bpe_49k.json", t), 1).astype("<u4")
        want += [(d, s, min(64, len(ids) - s), zlib.crc32(ids[s:s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in placed), key=key) == sorted(want, key=key)
    where = {}
    for r in placed:
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in where.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(where) == list(range(len(where)))
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "some words here " * (i % 7)) for i in range(40)], "doc_id long, text string")
    vocabulary = P.path("word_bpe_49k.json")
    placed = packing.pack(df, vocabulary, window=16)
    seqs = packing.sequences(df, placed, vocabulary, window=16, pad_id=0).collect()
    total = sum(len(library_ids("word_bpe_49k.json", r.text)) + 1 for r in df.collect())
    assert all(len(s.ids) == 16 for s in seqs) and sum(i != 0 for s in seqs for i in s.ids) == total
