import itertools
import random
import re

import numpy as np
from lexiquarry.llm import near_dedup as N


def shingles(t):
    """Distinct five-word shingles as tuples of words; a shorter text is one shingle."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(rng, n):
    vocab = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocab, k=50)
    out = []
    for k in range(n):
        base = rng.choices(vocab, k=rng.choice([3, 6, 12, 40, 120, 400]))
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def run(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect())


def test_against_brute_force(docs):
    rows = corpus(random.Random(5), 150)
    assert run(docs(*rows, extra=["c", "th", "n", "g"])) == brute(rows)


def test_chain_of_near_copies(docs):
    """Each text links with its neighbours only: one component all the same."""
    words = [f"v{k}" for k in range(300)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 160])) for k in range(12)]
    assert run(docs(*rows)) == brute(rows)


def test_small_empty_and_null(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d"), (8, "a b c d")]
    assert run(docs(*rows)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7)]
    got = N.near_duplicates(docs((None, "a b c d"), (9, "a b c d"), (9, "a b c d"))).collect()
    assert [r.component_id for r in got] == [9, 9, 9]
    assert N.near_duplicates(docs().limit(0)).count() == 0


def test_items_of_linked_sets_meet():
    """Property behind the join: linked sets share enough weight of items in some band."""
    rng = np.random.default_rng(4)
    for n in [1, 2, 4, 5, 9, 15, 16, 31, 33, 64, 100, 300, 1000]:
        for _ in range(20):
            s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
            other = s.copy()
            for k in rng.choice(len(s), size=len(s) // 9, replace=False):
                other[k] = rng.integers(0, 1 << 63)
            other = np.unique(other)
            if not N.linked(len(np.intersect1d(s, other)), len(s), len(other)):
                continue
            common = rng.integers(0, 256, 1 << (N.TABLE_BITS - 3), dtype=np.uint8) if n > 50 else np.zeros(1 << (N.TABLE_BITS - 3), np.uint8)
            both = np.intersect1d(N.items(s, common), N.items(other, common))
            assert (both & np.uint64(3)).sum() >= N.ENOUGH


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(6)
    for a, b in [(30, 40), (100, 120), (200, 260)]:
        x, y = (np.unique(rng.integers(0, 1 << 62, k).astype(np.uint64)) for k in (a, b))
        y = np.union1d(y[: b // 2], x[: a // 2])
        assert N.hamming(N.bit_sketch(x), N.bit_sketch(y)) <= len(np.setxor1d(x, y))


def test_large_edge_lists_are_connected_step_by_step(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k, 2001 + k) for k in range(40)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    one = {r.node: r.root for r in N.connected(edges).collect()}
    assert one == {r.node: r.root for r in N.connected(edges, most=10).collect()}
    assert {one[1000 + k] for k in range(60)} == {1000} and {one[2000 + k] for k in range(41)} == {2000}


def test_threshold_is_exact(docs):
    """Sets at, and one shingle below, similarity 0.8; one of 90 words and more, and a long text."""
    words = [f"u{k}" for k in range(4000)]
    rows = []
    for n, gone, base in ((10, 2, 0), (20, 4, 100), (90, 18, 300), (40, 9, 600), (1000, 200, 800), (1000, 201, 2000)):
        own = words[base : base + n + 4]  # n shingles
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(own[:-gone]))]
    got = run(docs(*rows))
    assert got == brute(rows)
    assert [c == i for i, _, c in got] == [True, False, True, False, True, False, True, True, True, False, True, True]


def test_hot_partner_and_very_long_texts(docs, monkeypatch):
    monkeypatch.setattr(N, "PARTNERS", 4)
    rng = random.Random(3)
    base = [f"h{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    long = [f"l{rng.randrange(10**6)}" for _ in range(60_000)]
    rows += [(100, " ".join(long)), (101, " ".join(long[:-3000])), (102, " ".join(long[:-20_000]))]
    assert run(docs(*rows)) == brute(rows)


def flagged(table):
    return np.flatnonzero(np.unpackbits(table))


def test_common_shingles_are_counted_over_all_texts(docs, monkeypatch):
    """The table that ranks items holds every shingle of two sets or more, whatever the input's size."""
    tables, plain = [], N.classes
    monkeypatch.setattr(N, "classes", lambda docs, slices, common, *a: tables.append(common) or plain(docs, slices, common, *a))
    monkeypatch.setattr(N, "SAMPLE_SHINGLES", 100, raising=False)  # no sample, however small, stands for the rest
    rows = corpus(random.Random(6), 120)
    assert run(docs(*rows)) == brute(rows)
    memo = N.word_memo()
    sets = {s.tobytes(): s for s in (N.shingle_set(t.encode(), memo) for _, t in rows)}
    pos, n = np.unique(np.concatenate([s >> np.uint64(64 - N.TABLE_BITS) for s in sets.values()]), return_counts=True)
    # A set that two tasks read counts twice: nothing that sets share may be missing.
    assert (n > 1).sum() > 1000 and set(pos[n > 1].tolist()) <= set(flagged(tables[0]).tolist()) <= set(pos.tolist())
    assert np.array_equal(tables[0], N.common_shingles(docs(*rows), 4 << 30, "text", "doc_id"))  # more slices


def test_full_table_still_tells_common_shingles(docs, monkeypatch):
    """With 40 shingles a position, those of a passage that all texts share are common, most others not."""
    monkeypatch.setattr(N, "TABLE_BITS", 12)
    monkeypatch.setattr(N, "TABLE_SLICES", 2)
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(24))
    rows = [(k, passage + " " + " ".join(f"r{rng.randrange(10**9)}" for _ in range(400))) for k in range(400)]
    table = flagged(N.common_shingles(docs(*rows), 1 << 20, "text", "doc_id"))
    shared = N.shingle_set(passage.encode(), N.word_memo()) >> np.uint64(52)
    assert set(shared.tolist()) <= set(table.tolist()) and len(table) <= (1 << 12) // 4 + len(shared)


def test_any_table_finds_the_same_links(docs, monkeypatch):
    rows = corpus(random.Random(7), 60)
    for fill in (0, 255, None):
        table = np.random.default_rng(1).integers(0, 256, 1 << (N.TABLE_BITS - 3), dtype=np.uint8) if fill is None else np.full(1 << (N.TABLE_BITS - 3), fill, np.uint8)
        monkeypatch.setattr(N, "common_shingles", lambda *a: table)
        assert run(docs(*rows)) == brute(rows)
