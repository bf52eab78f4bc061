import hashlib
import random
import re

from lexiquarry.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups.setdefault(hashlib.sha256(n.encode()).hexdigest(), []).append(i)
    out = []
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


def test_against_brute_force(docs):
    rng = random.Random(1)
    texts = ["a  b", "a b", "a\tb\n", "", None, " ", "ß é", "long " * 30000] + [f"t{k}" for k in range(20)]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    got = exact_dedup(docs(*rows, extra=["sha", "kept", "word", "flag"])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_nulls_repeats_and_empty(docs):
    rows = [(None, "x"), (3, "x"), (2, "x"), (2, "x"), (None, "y"), (None, "y"), (7, None), (8, "")]
    got = exact_dedup(docs(*rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    assert {(r.keep_id, r.group_size) for r in got} == {(2, 4), (None, 2), (7, 2)}
    assert exact_dedup(docs().limit(0)).count() == 0
