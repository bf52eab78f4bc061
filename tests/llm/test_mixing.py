import hashlib
import random

from lexiquarry.llm.mixing import mix, position, uses
from pyspark.sql import functions as F


def brute(rows):
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    full = set()
    while True:
        rest = [s for s in sources if s not in full]
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    return size, total, {s: 2.0 * total[s] if s in full else level * weight[s] for s in sources}


def test_targets_and_taken(docs):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 50, 400])), rng.choice(["b", "a", "ä", "c", None, "z"])) for i in range(300)]
    size, total, target = brute(rows)
    got = {r.doc_id: r for r in mix(docs(*[(i, t, None, s) for i, t, s in rows], extra=["size", "taken", "key", "weight"])).collect()}
    taken = {}
    for k, (i, _, s) in enumerate(rows):
        r = got[i]
        assert (r.size, r.source_size) == (size[k], total[s])
        assert abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 1


def test_uses_follow_the_curriculum(docs):
    rows = [(i, "w " * 20, None, s) for i, s in enumerate(["early"] * 50 + ["late"] * 50 + ["mid"] * 50)]
    mixed = mix(docs(*rows))
    got = uses(mixed).collect()
    assert sum(r.words for r in got) == mixed.agg(F.sum("taken")).first()[0]
    assert all(0 <= r.position <= 1 for r in got) and [r.position for r in got] == sorted(r.position for r in got)


def test_position_inverts_demand(spark):
    for slope in (0.5, -0.5, 0.0):
        rows = spark.range(1, 10).select(position(F.col("id") * 10.0, F.lit(100.0), F.lit(slope)).alias("t"), (F.col("id") * 10.0).alias("at")).collect()
        for r in rows:
            assert abs(100 * (r.t + slope * (r.t - r.t**2)) - r.at) < 1e-6


def test_reruns_nulls_and_empty(docs):
    rows = [(1, None, None, None), (2, "", None, "a"), (None, "x y", None, "a"), (3, "x", None, None), (3, "x", None, None)]
    a, b = (sorted(mix(docs(*rows)).select("doc_id", "size", "target", "taken").collect(), key=str) for _ in range(2))
    assert a == b and {r.doc_id: r.taken for r in a if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert mix(docs().limit(0)).count() == 0


def test_order_is_by_hash(docs):
    rows = [(i, "w " * 10, None, s) for i, s in enumerate(["a"] * 20 + ["b"] * 20)]
    got = sorted(mix(docs(*rows)).where("source = 'a'").collect(), key=lambda r: r.before)
    keys = [hashlib.md5(str(r.doc_id).encode()).hexdigest() for r in got]
    assert keys == sorted(keys)
