"""Exact dedup, the Jaccard join and mixing against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from llm_rows import ROWS, long_text, shingles

from siltwork.llm import exact_dedup, jaccard, mixing
from siltwork.llm.common import Scratch, connected_components


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (16, 64), (16, 3)])
def test_exact(odd, none, block, bits):
    got = exact_dedup.exact_duplicates(odd, block_bytes=block, key_bits=bits).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            want.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)
    assert exact_dedup.exact_duplicates(none, block_bytes=block, key_bits=bits).count() == 0


def test_distinct_documents(odd, none):
    got = exact_dedup.distinct_documents(odd)
    assert got.columns == odd.columns and sorted((r.text or "") for r in got.collect()) == sorted({r[1] or "" for r in ROWS})
    assert exact_dedup.distinct_documents(none).count() == 0


def brute(rows, width, percent):
    """(doc_id, size, component) of each row."""
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[find(a)].append(r[0])
    return [(r[0], len(sets[a]), (min(least[find(a)]) if least[find(a)] else None) if sets[a] else r[0]) for a, r in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_odd(odd, none, width, percent):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(odd, width=width, percent=percent).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(ROWS, width, percent)))
    assert jaccard.similar_documents(none, width=width, percent=percent).count() == 0


@pytest.mark.parametrize("limit", [500, 1 << 20])
def test_jaccard_near_copies(spark, monkeypatch, limit):
    """Chains of edits, a shared passage, and a cluster that is dealt in several parts."""
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows, k = [], 0
    for size in (8, 15, 30, 60, 150, 400):
        for _ in range(6):
            text = [rnd.choice(vocabulary) for _ in range(size)]
            if size == 60:
                text = passage[: rnd.randrange(30, 55)] + text[:20]
            for _ in range(rnd.randrange(1, 7)):
                rows.append((k, " ".join(text)))
                k += 1
                for _ in range(rnd.randrange(0, max(2, size // 40))):
                    text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
    base = [rnd.choice(vocabulary) for _ in range(120)]
    for _ in range(60):
        text = list(base)
        for _ in range(rnd.randrange(1, 4)):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        rows.append((k, " ".join(text)))
        k += 1
    monkeypatch.setattr(jaccard, "LEAST", limit)
    monkeypatch.setattr(jaccard, "MOST", limit)
    monkeypatch.setattr(jaccard, "KEYS", limit)
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 4, 85))


def test_directory_loses_no_pair():
    """Whatever order rarity gives the coordinates, the first ones of two similar sets hold a common one."""
    rnd = np.random.default_rng(1)
    for percent in (50, 80, 85, 95, 100):
        directory = jaccard.Directory(percent)
        for n in (1, 2, 3, 5, 7, 12, 40, 300, 3000):
            for _ in range(30):
                a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
                drop = rnd.integers(0, max(1, n * (100 - percent) // 100) + 1)
                b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 2**63, rnd.integers(0, 1 + n // 12)).astype(np.uint64)]))
                same = len(np.intersect1d(a, b))
                if 100 * same < percent * (len(a) + len(b) - same):
                    continue
                salt = np.uint64(rnd.integers(0, 2**63))
                cells = []
                for s in (a, b):
                    own = set()
                    for keys, code in directory.lookups(s):
                        other = np.concatenate([k for k, c in directory.lookups(b if s is a else a) if c % 2 == code % 2] or [keys[:0]])
                        shared = np.intersect1d(keys, other)
                        ranked = shared[np.argsort(jaccard.mix(shared ^ salt))]
                        own |= {(code % 2, k) for k in ranked[: max(0, (code >> 1) + len(shared))].tolist()}
                    cells.append(own)
                assert cells[0] & cells[1], (percent, n, len(b), same)


def test_unlike_documents(spark, odd, none):
    got = jaccard.unlike_documents(odd)
    assert got.columns == odd.columns and jaccard.unlike_documents(none).count() == 0
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) and len([k for k in kept if k[0] == 2]) == 0 and len([k for k in kept if k[0] == 1]) == 1
    classes = brute(ROWS, 5, 80)
    assert {6, 8, 1, 10, 14} <= {k[0] for k in kept} and not {7, 9, 11, 15} & {k[0] for k in kept} and len(classes) == len(ROWS)
    text = long_text(9, 300)
    rows = [(1, text), (None, text + " more"), (None, "not like any other one at all"), (None, "not like any other one at all"), (None, text + " again"), (5, None), (5, None), (7, "same"), (7, "other")]
    got = jaccard.unlike_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, text), (None, "not like any other one at all"), (5, None), (5, None), (7, "same"), (7, "other")]))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(300):03}", f"n{rnd.randrange(300):03}") for _ in range(200)] + [("hub", f"n{k:03}") for k in range(0, 300, 7)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)] + [("solo", "solo"), (None, "x")]
    got = dict(connected_components(spark.createDataFrame(edges, "src string, dst string"), Scratch(spark, "t")).collect())
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {n: find(n) for n in root}


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    free, left, out = set(names), share * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark, odd, none):
    rnd = random.Random(2)
    rows = [(k, " ".join("w" * rnd.randrange(1, 60)), "s%d" % min(int(rnd.expovariate(0.7)), 5) if rnd.random() < 0.95 else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for docs in (df, odd):
        got = mixing.mix(docs).collect()
        sizes, most, taken = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in got:
            sizes[r.source] += r.size
            most[r.source] = max(most[r.source], r.size)
            taken[r.source] += r.taken
        want = water(sizes)
        assert len(got) == docs.count()
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert all(abs(taken[s] - want[s]) <= 2 * most[s] for s in sizes)
        if docs is df:
            assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, mixing.mix(df).collect()))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    rows = mixing.mixed(df)
    assert rows.columns == df.columns and rows.count() == sum(r.copies for r in mixing.mix(df).collect())


def test_budgets_nest(spark):
    df = spark.createDataFrame([(k, "a b c " * (k % 5 + 1), "s") for k in range(200)], "doc_id long, text string, source string")
    small, large = ({r.doc_id for r in mixing.mix(df, budget=b).collect() if r.taken} for b in (0.3, 0.6))
    assert small < large


def test_passages_shared_by_unlike_texts_make_no_cluster(spark):
    """A chain of texts that each share a passage with the next is no candidate; their near copies are."""
    from siltwork.llm import jaccard

    own = lambda k, n: [f"w{k}-{i}" for i in range(n)]
    texts = [" ".join([*own(k, 60), *own(k + 1, 60)]) for k in range(120)]
    near = [" ".join([*texts[k].split()[:-1], "else"]) for k in range(0, 120, 10)]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    seen, plain = [], jaccard._links
    jaccard._links = lambda t, members, *a: seen.append(members.groupBy("cluster").count().agg({"count": "max"}).first()[0]) or plain(t, members, *a)
    try:
        got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs, width=4, percent=85).collect()}
    finally:
        jaccard._links = plain
    assert got == {k: k for k in range(120)} | {120 + k: 10 * k for k in range(12)}
    assert max(seen) <= 4  # before, all of them were one


def test_texts_with_a_common_passage_do_not_meet(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage = [" ".join(word() for _ in range(18)) for _ in range(2)]
    rows = []
    for k in range(600):  # sentences of their own, which others have too, and one of two passages
        own = " ".join(f"s{k // 2 * 2 + j}w{i}" for j in (0, k % 2) for i in range(9))
        rows.append((k, f"{own} {passage[k % 2]}"))
    rows += [(1000 + k, f"{rows[k][1]} more") for k in range(0, 600, 50)]
    seen, plain = [], jaccard._links
    jaccard._links = lambda t, members, *a: seen.append(members.groupBy("cluster").count().agg({"count": "max"}).first()[0]) or plain(t, members, *a)
    try:
        got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=80).collect()
    finally:
        jaccard._links = plain
    assert sorted(map(tuple, got)) == sorted(brute(rows, 5, 80))
    assert seen[0] <= jaccard.PAIRED  # one cluster of most texts before


def test_tree_of_fine_counts_verifies_few():
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(400)]
    sets = [np.unique(np.array([x if rng.random() < 0.8 else rng.getrandbits(64) for x in base], np.uint64)) for _ in range(200)]
    links, done = jaccard.Links(sets, 80), []
    plain = links._verify
    links._verify = lambda a, b: done.append((a, b)) or plain(a, b)
    assert links.join() == [] and len(done) < 200 * 199 // 20  # most pairs before: a group held several shingles
