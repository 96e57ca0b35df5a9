"""BPE, packing and language-model scores."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_rows import SF, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltwork.llm import bpe, lm, packing, queries
from siltwork.llm.words import word_hashes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def same_as_library(docs, got):
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got)


def test_bpe_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    same_as_library(docs, queries.op4_bpe(spark, SF).collect())


@pytest.mark.parametrize("lexicon", [0, 5, 1000])
def test_bpe_odd(odd, none, lexicon):
    got = bpe.encode(odd, VOCABULARY, words=lexicon, keep=("doc_id", "score"))
    same_as_library([(r.doc_id, r.text) for r in odd.collect()], got.collect())
    row = got.where("doc_id = 12").first()
    assert len(row.ids) == row.n_tokens and sha(row.decoded.encode()) == row.decoded_sha256 and 49407 in row.ids
    assert bpe.encode(none, VOCABULARY, words=lexicon).count() == 0


def test_bpe_follows_the_library_on_any_character():
    """Characters that Python, its regex module and the library class or lower-case differently, and a sample of all others."""
    with open(VOCABULARY, encoding="utf-8") as f:
        merges = bpe.Merges(f.read())
    lower, classes = bpe.library_unicode()
    encoder = bpe.Encoder(merges, bpe.Transducer.mapped(bpe.Transducer.build([], [])), bpe.Pieces(lower, classes))
    rnd = random.Random(8)
    odd = [chr(c) for c in (0x1C89, 0x558, 0x323B0, 0x10D50, 0xA7DC, 0x130, 0x3A3, 0x1E9E)] + sorted(lower)
    some = odd + [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 41 == 0)]
    texts = [f"a{c}b" for c in some] + ["".join(rnd.choice(odd + list("aB1' \t.é")) for _ in range(12)) for _ in range(2000)]
    library = Tokenizer.from_file(VOCABULARY)
    for text, (ids, _), want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == struct.pack(f"<{len(want.ids)}I", *want.ids), ascii(text)


def test_transducer_is_minimal_and_exact():
    rnd = random.Random(4)
    held = sorted({bytes(rnd.choice(b"abc\xc3") for _ in range(rnd.randrange(1, 7))) for _ in range(500)})
    ids = [[rnd.randrange(49000) for _ in range(rnd.randrange(1, 4))] for _ in held]
    t = bpe.Transducer.mapped(bpe.Transducer.build(held, ids))
    assert t.find([*held, b"zz", b"", held[0] + b"q" * 90]).tolist() == [*range(len(held)), -1, -1, -1]
    assert all(t.ids[t.offsets[k] : t.offsets[k + 1]].tolist() == i for k, i in enumerate(ids))
    # Minimal: as many states as there are different sets of endings.
    starts = {w[:k] for w in held for k in range(len(w) + 1)}
    assert len(t.final) == len({frozenset(w[len(s) :] for w in held if w.startswith(s)) for s in starts})
    ends = bpe.Transducer.mapped(bpe.Transducer.build([b"ring", b"sing", b"wing"], [[1], [2], [3]]))
    assert len(ends.final) == 5
    assert bpe.Transducer.mapped(bpe.Transducer.build([], [])).find([b"a"]).tolist() == [-1]


def unpacked(rows, length):
    """Documents' ids, put together again from packed rows."""
    parts = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, f"<u{len(r.ids) // length}")
        places = np.frombuffer(r.positions, "<u4")
        assert len(ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)):
            assert places[a:b].tolist() == [*range(b - a)] and b > a
            parts[r.doc_ids[k]].setdefault((r.shard, r.pieces[k]), []).append((r.last[k], ids[a:b].tolist()))
    return parts


def test_packing_round_trip(spark, odd, none):
    length = 64
    rows = packing.pack_texts(odd, queries.RANKS, length, shard=700).collect()
    got = unpacked(rows, length)
    with open(queries.RANKS, "rb") as f:
        vocabulary = {int(i): base64.b64decode(b) for b, i in map(bytes.split, f)}
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text or "")
    assert set(got) == set(texts)
    for doc, parts in got.items():
        if len(texts[doc]) == 1:
            pieces = [v[0] for _, v in sorted(parts.items())]
            flat = [t for _, ids in pieces for t in ids]
            assert flat[-1] == 50256 and [last for last, _ in pieces] == [False] * (len(pieces) - 1) + [True]
            assert b"".join(vocabulary[t] for t in flat[:-1]).decode() == texts[doc][0]
    assert packing.pack_texts(none, queries.RANKS, length).count() == 0
    lists = spark.createDataFrame([(1, [5, 6, 7]), (2, None), (3, []), (4, [70000] * 9)], "doc_id long, ids array<int>")
    packed = packing.pack_ids(lists, 4, vocabulary=100_000).collect()
    assert {d for r in packed for d in r.doc_ids} == {1, 4} and packing.matrix(packed, 4).sum() == 18 + 9 * 70000


def test_packed_matrices_are_files(spark, odd, none, tmp_path):
    """What is written is read again, repeated ids and null ids included."""
    length = 64
    with open(queries.RANKS, "rb") as f:
        vocabulary = {int(i): base64.b64decode(b) for b, i in map(bytes.split, f)}
    packing.write_matrices(packing.pack_texts(odd, queries.RANKS, length, shard=700), f"{tmp_path}/m")
    rows = sorted(packing.read_matrices(spark, f"{tmp_path}/m").collect(), key=lambda r: (r.shard, r.row))
    assert packing.matrix(rows, length).shape == (len(rows), length) and all(len(r.positions) == 4 * length for r in rows)
    pieces = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert (ids[r.n_tokens :] == 50256).all()
        for d, k, last, a, b in zip(r.doc_ids, r.pieces, r.last, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces[str(d), r.shard].append((k, last, ids[a:b].tolist()))
    assert Counter((t, i == 50256) for p in pieces.values() for _, _, ids in p for t, i in ((i, i) for i in ids if i == 50256)).total() == odd.count()
    # Tokens but the ends, counted over all pieces, are those of all texts.
    text = Counter(t for p in pieces.values() for _, _, ids in p for t in ids if t != 50256)
    whole = sum((len(vocabulary[t]) * n for t, n in text.items()), 0)
    assert whole == sum(len((r.text or "").encode()) for r in odd.collect())
    packing.write_matrices(packing.pack_texts(none, queries.RANKS, length), f"{tmp_path}/none")
    assert packing.read_matrices(spark, f"{tmp_path}/none").count() == 0 and packing.digests(packing.read_matrices(spark, f"{tmp_path}/none")).count() == 0


def test_packing_query(spark):
    """Every token of every document is in the rows, whose digests are of what the files hold."""
    import tiktoken

    rows = queries.op7_packing(spark, SF).collect()
    with open(queries.RANKS, "rb") as f:
        encoding = tiktoken.Encoding("r", pat_str=packing.PATTERN, mergeable_ranks={base64.b64decode(b): int(i) for b, i in map(bytes.split, f)}, special_tokens={})
    want = {r.doc_id: len(encoding.encode_ordinary(r.text or "")) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: Counter = Counter()
    for r in rows:
        for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            got[d] += b - a
    assert got == want and all(len(r.ids_sha256) == len(r.positions_sha256) == 64 for r in rows)
    assert sum(r.n_tokens for r in rows) > 0.98 * packing.LENGTH * len(rows)
    packed = packing.pack_texts(spark.read.parquet(f"{SF}/documents.parquet"), queries.RANKS)
    assert Counter((sha(r.ids), sha(r.positions)) for r in packed.collect()) == Counter((r.ids_sha256, r.positions_sha256) for r in rows)


@pytest.mark.parametrize("length", [5, 64, 1000])
def test_best_fit(length):
    sizes = np.random.default_rng(length).integers(1, length + 1, 800)
    rows = packing.pack_lengths(sizes, length)
    free = []
    for k in np.argsort(-sizes, kind="stable"):  # the plain way
        fits = [f for f in free if f >= sizes[k]]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else length) - sizes[k])
    assert sorted(k for r in rows for k in r) == [*range(800)] and sorted(length - sizes[r].sum() for r in rows) == sorted(free)
    assert packing.pack_lengths(np.zeros(0, np.int64), length) == []


def test_elias_fano_and_trie():
    rnd = np.random.default_rng(0)
    for top in (3, 500, 1 << 45):
        v = np.sort(rnd.integers(0, top, 400).astype(np.uint64)) if top > 3 else np.array([0, 1, 2], np.uint64)
        v = np.unique(v)
        e = lm.EliasFano.build(v)
        x = rnd.integers(0, top + 9, 2000).astype(np.uint64)
        place, found = e.successor(x)
        assert (e.get(np.arange(len(v))) == v).all() and (place == np.searchsorted(v, x)).all() and (found == np.isin(x, v)).all()
    pairs = np.unique(np.stack([rnd.integers(0, 50, 600), rnd.integers(1, 900, 600)], 1), axis=0).astype(np.uint64)
    trie = lm.Trie.load(lm.Trie.build(pairs[:, 0], pairs[:, 1], np.arange(1, len(pairs) + 1)).dump())
    assert (trie.find(pairs[:, 0], pairs[:, 1]) == np.arange(1, len(pairs) + 1)).all()
    known = {tuple(p) for p in pairs.tolist()}
    asked = np.stack([rnd.integers(0, 60, 500), rnd.integers(0, 1000, 500)], 1).astype(np.uint64)
    assert all((c > 0) == (tuple(a) in known) for a, c in zip(asked.tolist(), trie.find(asked[:, 0], asked[:, 1]), strict=True))


def brute_scores(docs, train, prior):
    tokens = [(d, [*words(t), None], d is not None and train(d)) for d, t in docs]
    one, two, starts = Counter(), Counter(), 0
    for _, w, learn in tokens:
        if learn:
            one.update(w)
            two.update(zip(["<s>", *w], w, strict=False))
            starts += 1
    n, v = sum(one.values()), len(one)
    for d, w, learn in tokens:
        uni = [(one[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        seen = [starts if h == "<s>" else one[h] for h in ["<s>", *w[:-1]]]
        p = [(two[h, x] + prior * u) / (c + prior) for h, x, u, c in zip(["<s>", *w[:-1]], w, uni, seen, strict=True)]
        yield d, not learn, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, uni)), sum(map(math.log10, p))


@pytest.mark.parametrize("small", [False, True])
def test_lm(spark, odd, none, monkeypatch, tmp_path, small):
    if small:  # many blocks and shards
        for name, value in (("BLOCK", 900), ("WORDS", 64), ("PAIRS", 300), ("RANGES", 5), ("RUN", 200)):
            monkeypatch.setattr(lm, name, value)
    docs = odd if small else spark.read.parquet(f"{SF}/documents.parquet")
    got = lm.score(docs, F.col("doc_id") % 5 != 1).collect()
    want = list(brute_scores([(r.doc_id, r.text) for r in docs.collect()], lambda d: d % 5 != 1, lm.PRIOR))
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and abs(a[6] - b[6]) <= 2e-4 * b[2]
    assert lm.score(none, F.lit(True)).count() == 0
    kept = f"{tmp_path}/model"
    again = lm.score(docs, F.col("doc_id") % 5 != 1, save=kept)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    half = docs.where("doc_id % 2 = 0")
    assert sorted(map(str, lm.score(half, F.col("doc_id") % 5 != 1, model=kept).collect())) == sorted(map(str, again.where("doc_id % 2 = 0").collect()))


def test_spool():
    rnd = np.random.default_rng(3)
    for n, limit in ((0, 10), (7, 10), (5000, 300)):
        spool = lm.Spool({"x": "<i8"}, {"y": "<i8"}, limit)
        keys = rnd.integers(0, max(1, n // 3), n).astype(np.uint64)
        for i in range(0, n, 90):
            spool.add(key=keys[i : i + 90], x=keys[i : i + 90].astype(np.int64) * 2)
        seen = []
        for part in spool.passes():
            assert (np.diff(part["key"].astype(np.int64)) >= 0).all() and (part["x"] == part["key"].astype(np.int64) * 2).all()
            seen.append(set(part["key"].tolist()))
            spool.answer(part, y=part["x"] + 1)
        assert sum(map(len, seen)) == len(set(keys.tolist())) and (spool.results["y"] == keys.astype(np.int64) * 2 + 1).all()


def test_lm_query(spark):
    got = queries.op9_lm(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_word_hashes(monkeypatch):
    from siltwork.llm import words as module

    texts = ["Ab c", "", None, "aB\tC ab", " x\x0b", "é É", "w" * 300 + " " + "v" * 200]
    hashes, sizes = word_hashes(texts)
    plain = [w for t in texts for w in words(t)]
    assert sizes.tolist() == [len(words(t)) for t in texts] and len(set(plain)) == len(set(hashes.tolist()))
    assert all((plain[a] == plain[b]) == (hashes[a] == hashes[b]) for a in range(len(plain)) for b in range(a))
    monkeypatch.setattr(module, "SLICE", 16)
    assert (word_hashes(texts)[0] == hashes).all()


def test_lexicon_counts_all_documents(spark):
    """Pieces whose counts differ by one in many documents are told apart: no sample could."""
    rows = [("x" * (k + 1),) for k in range(10) for _ in range(2300 + k)]
    docs = spark.createDataFrame(rows, "text string").repartition(4)
    merges = bpe.Merges(open(VOCABULARY, encoding="utf-8").read())
    lexicon = bpe.Transducer.mapped(bpe.compile_lexicon(docs, merges, words=5))
    assert lexicon.find([b"x" * (k + 1) for k in range(10)]).tolist() == [-1] * 5 + list(range(5))


def test_lexicon_is_built_in_little_memory():
    """The driver's memory for 60,000 words: 5 MB of states, where a dictionary for each took far more."""
    import random
    import tracemalloc

    rnd = random.Random(3)
    words = sorted({"".join(rnd.choices(("th", "er", "in", "an", "re"), k=9)).encode() for _ in range(60_000)})
    ids = [[1]] * len(words)
    tracemalloc.start()
    try:
        bpe.Transducer.build(words, ids)
        assert tracemalloc.get_traced_memory()[1] < 300 * len(words)
    finally:
        tracemalloc.stop()


def test_written_tables_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from siltwork.llm.common import CLEANUP, Scratch

    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    before, scratch = held(), Scratch(spark, "shuffles")
    rows = scratch.put(spark.range(100_000).repartition(5, "id"), "rows")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before  # they stayed before
    assert rows.count() == 100_000 and spark.conf.get(CLEANUP, None) is None
