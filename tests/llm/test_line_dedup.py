import hashlib
import random

from lexiquarry.llm import line_dedup as L
from pyspark.sql import functions as F


def brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                where.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= 3 and max(where[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(df):
    marked = L.with_bitmaps(df.select("doc_id", "text"), L.keep_bitmaps(df)).collect()
    out = []
    for r in marked:
        n, gone, text = L.surviving((r.text or "").encode(), r["__lq_keep"])
        out.append((r.doc_id, n, gone, hashlib.sha256(text).hexdigest()))
    return sorted(out)


def make(rng, n):
    shared = ["Ä common line, number %d of many" % k for k in range(6)] + ["short", "", "x" * 19, "é" * 20]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"own line {i} {rng.random()} here" for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(("  " + x.upper() if rng.random() < 0.2 and x.isascii() else x) for x in lines)))
    return rows


def test_against_brute_force(docs, monkeypatch):
    rows = make(random.Random(7), 200) + [(900, None), (901, "")]
    df = docs(*rows, extra=["h", "pos", "kind"])
    want = brute(rows)
    assert run(df) == want
    monkeypatch.setattr(L, "PART_ROWS", 40)  # keys run over partition borders
    assert run(df) == want


def test_long_key_is_passed_on_open():
    import pyarrow as pa

    limit, L.LIMIT = L.LIMIT, 5
    try:
        rows = [(b"k", d, 0, 1, b"\0\0\0\0") for d in range(20, 0, -1)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["h", "doc_id", "th", "n_lines", "pos"])
        out = [r for part in L.resolve([batch], 3) for r in part]
    finally:
        L.LIMIT = limit
    assert sum(r[0] == L.OPEN for r in out) == 20
    assert [(r[2], r[6]) for r in out if r[0] == L.COUNT] == [(20, 20)]


def test_apply_keeps_columns_and_nulls(docs):
    line = "this line occurs in many documents"
    rows = [(k, f"{line}\nown {k}", "en", "s") for k in range(4)] + [(9, None)]
    out = L.apply(docs(*rows, extra=["keep"]))
    assert out.columns == [*docs().columns, "keep"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[3].startswith(line) and got[0] == "own 0" and got[9] is None


def test_repeated_and_empty(docs):
    line = "this line occurs in many documents"
    got = run(docs((1, line), (1, line), (2, line)))
    assert all(r[2] == 0 for r in got)  # two documents only: a repeated row counts once
    assert run(docs().limit(0)) == []
    assert L.dropped(docs((None, line), (None, line), (3, line), (4, line))).select(F.sum("n_lines")).first()[0] == 3
