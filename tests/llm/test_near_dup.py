import random
import re

import numpy as np
import pytest

from statuta.llm import near_dup
from statuta.llm._words import shingle_sets, word_hashes
from statuta.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, k, num, den):
    sets = [(i, brute_set(t, k)) for i, t in rows if i is not None]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and den * len(x & y) >= num * len(x | y)]
    comp = roots({i for i, _ in sets}, links)
    return sorted(((i, len(brute_set(t, k)), comp.get(i), i is None or comp[i] == i) for i, t in rows), key=str)


def run(df, **options):
    return sorted((tuple(r) for r in near_dup.near_duplicates(df, **options).collect()), key=str)


@pytest.mark.parametrize("words, threshold", [(3, (85, 100)), (5, (80, 100))])
def test_odd_rows(odd_docs, words, threshold):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert run(odd_docs, words=words, threshold=threshold) == brute(rows, words, *threshold)


def test_empty(no_docs):
    assert run(no_docs) == []


def chains(seed, sizes=(3, 20, 60)):
    """Groups in which neighbours are linked and far members are not."""
    r = random.Random(seed)
    rows, n = [], 0
    for size in sizes:
        base = [f"w{r.randint(0, 10**9)}" for _ in range(120)]
        for _ in range(size):
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = f"w{r.randint(0, 10**9)}"
            rows.append((n, " ".join(base)))
            n += 7
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, shingles", [(1024, 1 << 18), (30, 1 << 18), (2, 1 << 18), (1024, 500)])
def test_chains_of_copies_and_blocks(spark, monkeypatch, block, shingles):
    """Blocks of all members, two, and forty of a group, bounded by members or by shingles: the same whole components."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", shingles)
    rows = chains(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, words=3, threshold=(85, 100)) == brute(rows, 3, 85, 100)


def test_large_component_against_the_rest(spark, monkeypatch):
    """Many near copies of one text, and others of every similarity to them."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    r = random.Random(6)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(90):
        text = list(base)
        for k in r.sample(range(100), 1 if i % 3 else r.randint(2, 40)):
            text[k] = f"x{r.randint(0, 10**9)}"
        rows.append((i, " ".join(text)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold=(85, 100)) == brute(rows, 3, 85, 100)


@pytest.mark.parametrize("num, den", [(80, 100), (85, 100), (1, 2), (1, 1)])
def test_forest_links_all_that_brute_force_links(num, den):
    r = np.random.default_rng(5)
    for sides in (1, 2):
        sets = []
        for _ in range(12):
            base = r.integers(0, 10**6, r.integers(1, 60))
            sets += [np.unique(np.where(r.random(len(base)) < r.choice([0, 0.02, 0.1]), r.integers(0, 10**6, len(base)), base)) for _ in range(5)]
        size, side = np.array([len(x) for x in sets]), r.integers(0, sides, len(sets))
        other = side == 1 if sides == 2 else side == 0
        label = np.arange(len(sets))
        found = near_dup.forest(np.concatenate(sets), size, label, side == 0, other, num, den)
        linked = lambda i, j: den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))
        pairs = [(i, j) for i in np.flatnonzero(side == 0) for j in np.flatnonzero(other) if i != j and linked(i, j)]
        nodes = range(len(sets))
        assert all(linked(i, j) for i, j in found) and roots(nodes, pairs) == roots(nodes, found)
        assert len(set(label.tolist())) == len(set(roots(nodes, pairs).values()))


def test_bitmaps_follow_the_number_of_ids():
    assert near_dup.bitmap_bits(0) == 1024 and near_dup.bitmap_bits(1000) == 1 << 14
    assert [near_dup.bitmap_bits(n) // n for n in (1 << 12, 1 << 20, 1 << 24)] == [16, 16, 16] and near_dup.bitmap_bits(1 << 40) == near_dup.MOST_BITS


def test_keep_one(spark, odd_docs):
    kept = near_dup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r[0]) for r in kept.select("doc_id").collect())
    assert "6" not in ids and "5" in ids and "None" in ids and ids.count("10") == 2


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.85):
        errors = []
        for _ in range(20):
            common = r.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            rest = r.integers(0, 2**63, 2 * (400 - len(common)), dtype=np.uint64)
            a, b = np.concatenate((common, rest[::2])), np.concatenate((common, rest[1::2]))
            s = near_dup.sketch([a, b, a[:1]], 256)
            errors.append((s[0] == s[1]).mean() - len(common) / (len(common) + len(rest)))
            assert (s[2] != np.iinfo(np.uint64).max).all()
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_word_hashes_cut_long_texts_as_short_ones():
    import pyarrow as pa

    word = "q" * 1_300_000
    texts = pa.array([f"a {word} b", None, "", f"{word}", "a b"] + [f"t{i} " * 3000 for i in range(300)])
    h, at = word_hashes(texts)
    assert (at[1:] - at[:-1]).tolist() == [3, 0, 0, 1, 2] + [3000] * 300
    assert h[1] == h[3] and h[0] == h[4] and h[2] == h[5]
    assert [len(s) for s in shingle_sets(texts, 3)[:5]] == [1, 0, 0, 1, 1]


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2000), (None, 3)]
    got = dict(tuple(x) for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    real = [x for x in links if x[0] is not None]
    assert got == roots({n for x in real for n in x}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
