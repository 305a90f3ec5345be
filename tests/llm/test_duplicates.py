import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import common, embedding_dedup, minhash_dedup, suffix_dedup


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def check_groups(rows, corpus):
    sets, nodes = [(i, shingles(t)) for i, t in corpus], {i for i, _ in corpus if i is not None}
    g = Groups(nodes)
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                g.join(i, j)
    want = Counter((i, len(s), g.root(i) if i is not None else None, i is None or g.root(i) == i) for i, s in sets)
    assert Counter(tuple(r) for r in rows) == want


def test_near_duplicates(docs, corpus, empty):
    check_groups(minhash_dedup.group_near_duplicates(docs).collect(), corpus)
    assert minhash_dedup.group_near_duplicates(empty).count() == 0


def test_loose_family(spark):
    """Copies with several edits: some link only through others, many not at all; no leader rounds and three agree."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(90)]
    corpus, last = [], base
    for i in range(60):
        source = list(base if i % 3 else last)
        for k in rng.integers(0, 90, rng.integers(0, 4)):
            source[k] = f"e{rng.integers(0, 50)}"
        last = source
        corpus.append((i, " ".join(source)))
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    check_groups(minhash_dedup.group_near_duplicates(df).collect(), corpus)
    check_groups(minhash_dedup.group_near_duplicates(df, leader_rounds=0).collect(), corpus)


def test_super_minhash_is_the_plain_algorithm_and_estimates():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 900).astype(np.uint64)
    counts = np.array([0, 1, 3, 40, 300, 556])
    sig = minhash_dedup.super_minhash(h, counts, 32)
    assert (sig[0] == np.iinfo(np.uint64).max).all() and all(len(set(s.tolist())) == 32 for s in sig[1:])
    one = minhash_dedup.super_minhash(h[1:4], np.array([1, 1, 1]), 32)
    assert (sig[2] == one.min(axis=0)).all()  # the signature of a set is the least of its elements' ones
    a, b = h[:500], h[100:600]
    s = minhash_dedup.super_minhash(np.concatenate([a, b]), np.array([500, 500]), 120)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.15


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7), (None, 3)]
    g = Groups({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None and b is not None:
            g.join(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {n: g.root(n) for n in linked}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [(k, x.tolist()) for k, x in enumerate(base)]
    rows += [(100 + k, (base[0] + 0.05 * rng.standard_normal(16)).tolist()) for k in range(80)]
    rows += [(200 + k, (3 * base[1]).tolist()) for k in range(5)]
    for k in range(20):  # just within the bound
        y = rng.standard_normal(16)
        x = base[20 + k] / np.linalg.norm(base[20 + k])
        y -= (y @ x) * x
        rows.append((300 + k, (0.905 * x + np.sqrt(1 - 0.905**2) * y / np.linalg.norm(y)).tolist()))
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, []), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (None, base[0].tolist())]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, label string, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_embeddings(df).collect()}
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 900]
    g, links = Groups({i for i, _ in good}), Counter()
    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                g.join(i, j)
                links.update((i, j))
    found = sum(got[i][0] for i, _ in good)
    assert found >= 0.9 * sum(links.values()) and all(got[i][0] <= links[i] for i, _ in good)
    assert sum(got[i][1] == g.root(i) for i, _ in good) >= 0.95 * len(good)
    assert all(got[i] == (0, i, True) for i in range(900, 907)) and got[None] == (0, None, True)
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


def brute_links(x, least=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return ((x @ x.T) >= least).sum(axis=1) - 1


@pytest.mark.parametrize("block", [8192, 700])
def test_links_of_a_large_loose_family_are_all_counted(spark, block):
    """3000 vectors at mutual cosines of 0.90 to 0.96, a tight ball beside them, copies, and pairs."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre, noise = unit(rng.standard_normal(48)), unit(rng.standard_normal((3000, 48)))
    loose = centre + np.sqrt(1 / rng.uniform(0.91, 0.96, (3000, 1)) - 1) * noise
    tight = unit(loose[0]) + 0.03 * unit(rng.standard_normal((900, 48)))
    lone = rng.standard_normal((40, 48))
    x = np.concatenate([tight, loose, loose[:50], lone, lone[:20] + 0.05 * rng.standard_normal((20, 48))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_embeddings(df, block=block).collect()}
    want = brute_links(x)
    assert want.max() > 2 * embedding_dedup.WINDOW * embedding_dedup.PASSES
    assert [got[k] for k in range(len(x))] == want.tolist()


def test_passes_follow_the_number_of_vectors(spark):
    """A pair that just links is missed with a chance under MISS at any size, not only among few vectors."""
    share = 1 - np.arccos(0.9) / np.pi
    for n in (10, 10_000, 1_000_000, 100_000_000):
        met = share ** max(0.0, np.log2(n / embedding_dedup.WINDOW))
        assert (1 - met) ** embedding_dedup.passes_for(n) <= embedding_dedup.MISS
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((6000, 64)))
    y = rng.standard_normal((300, 64))
    y = unit(y - (y * x[:300]).sum(axis=1)[:, None] * x[:300])
    cosine = np.concatenate([np.full(150, 0.9 + 1e-6), np.full(150, 0.9 - 1e-6)])[:, None]  # closer to the bound than 16 bits tell
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, cosine * x[:300] + np.sqrt(1 - cosine**2) * y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_embeddings(df, window=1).collect()}
    assert sum(got[6000 + k] == (1, k) for k in range(150)) >= 149
    assert all(got[6000 + k] == (0, 6000 + k) for k in range(150, 300))


def brute_repeats(corpus, least):
    raw = [(t or "").encode() for _, t in corpus]
    times = Counter(x[i : i + least] for x in raw for i in range(len(x) - least + 1))
    out = []
    for (doc_id, _), x in zip(corpus, raw, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - least + 1):
            if times[x[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(x), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


def test_components_of_large_ids(spark):
    """Ids like 64-bit hashes, whose plain sums would overflow."""
    top = 2**63 - 10
    edges = spark.createDataFrame([(top - 1, top - 2), (top - 2, top - 3), (top - 3, top - 4), (5 - top, 6 - top), (None, 1), (3, 3)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {top - 1: top - 4, top - 2: top - 4, top - 3: top - 4, top - 4: top - 4, 5 - top: 5 - top, 6 - top: 5 - top}


def digests(left):
    """The contract's columns from what the operator returns."""
    return Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in left.collect())


@pytest.mark.parametrize("most", [8192, 2, 1])
def test_repeats(docs, corpus, most):
    assert digests(suffix_dedup.remove_repeats(docs, k=50, most_segments=most)) == brute_repeats(corpus, 400)


def test_repeats_of_a_crowded_minimiser(spark):
    """Hundreds of edited copies of one text: its minimisers have more segments than one transform may take."""
    rng = np.random.default_rng(12)
    base = "".join(rng.choice(list("abcdefgh "), 900))
    rows = [(i, base[: (p := int(rng.integers(0, 880)))] + "#" + base[p + 1 :]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(suffix_dedup.remove_repeats(df, k=50, most_segments=3, parts=3)) == brute_repeats(rows, 400)


def test_repeats_shorter_and_empty(docs, corpus, empty):
    assert digests(suffix_dedup.remove_repeats(docs, least=60, k=20, batch_bytes=2000)) == brute_repeats(corpus, 60)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_intervals_against_counting():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = bytes(rng.integers(97, 100, 60).astype(np.uint8))
        segments = []
        for _ in range(rng.integers(1, 12)):
            a = rng.integers(0, 40)
            x = bytearray(base[a : a + rng.integers(8, 20)])
            x[rng.integers(0, len(x))] = 100
            segments.append(bytes(x))
        copies = rng.integers(1, 3, len(segments))
        times = Counter()
        for x, n in zip(segments, copies, strict=True):
            for i in range(len(x) - 7):
                times[x[i : i + 8]] += int(n)
        for x, ranges in zip(segments, suffix_dedup.repeated_starts(segments, copies, 8), strict=True):
            assert {i for a, b in ranges for i in range(a, b + 1)} == {i for i in range(len(x) - 7) if times[x[i : i + 8]] > 1}


def test_minimisers_agree_between_copies():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 255, 900).astype(np.uint8)
    b = np.concatenate([rng.integers(0, 255, 77).astype(np.uint8), a[100:700], rng.integers(0, 255, 50).astype(np.uint8)])
    runs = [suffix_dedup.minimiser_runs(x, np.array([0, len(x)]), 400, 50) for x in (a, b)]
    assert sum(e - s + 1 for s, e in zip(runs[0][2], runs[0][3])) == 501
    assert set(runs[0][1].tolist()) & set(runs[1][1].tolist())
    assert suffix_dedup.minimiser_runs(a[:399], np.array([0, 399]), 400, 50)[0].size == 0
