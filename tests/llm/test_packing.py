import random
import zlib

import numpy as np
import pytest
from lexiquarry.llm.packing import pack, plan_histogram, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_tokens_pieces_and_layout(docs):
    rng = random.Random(2)
    words = ["the", "Zebra's", "don't", "ÄÖ", "naïve", "<|endoftext|>x", "42", "!!", "x" * 90, "日本", "and/or", "É"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 900])))) for i in range(60)] + [(60, None), (61, ""), (None, "a"), (5, "again")]
    got = pack(docs(*rows, extra=["part", "length", "rank", "p"]), capacity=256).collect()
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    n = check_layout(got, 256)
    assert n <= 1.1 * -(-sum(r.length for r in got) // 256) + 1


def test_random_strings_are_encoded_as_by_the_tokenizer(monkeypatch):
    from lexiquarry.llm import packing

    monkeypatch.setattr(packing, "CHUNK", 3000)  # long texts are divided, and pieces forgotten
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    rng = random.Random(1)
    signs = "aAzZ09 \n\t'.,<|>#éÉßÿ×÷日本́İÀΣσς  \u0085\x1c\x00٣½ﬁ🙂ç`-"
    whole = ["<|endoftext|>", "<|startoftext|>", "'S", "'ll", "don't", "l'Été"]
    texts = ["".join(rng.choice(signs) if rng.random() < 0.9 else rng.choice(whole) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD7FF)])) for _ in range(rng.randrange(30))) for _ in range(5000)]
    texts += ["", " ", "x" * 10_000, " ".join(texts[:2000]), ""]
    want = tokenizers.Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    got = list(packing.encode_texts(packing.Encoder(tokenizer_path()), [t.encode() for t in texts]))
    assert [k for k, _ in got] == list(range(len(texts)))
    assert all(ids.tolist() == want[k].ids for k, ids in got)


def test_empty_table(docs):
    assert pack(docs().limit(0)).count() == 0


def test_plan_covers_every_rank_once():
    rng = random.Random(3)
    counts = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(30)}
    plan = plan_histogram(counts, 64)
    used = {}
    for length, rank, n, first, offset in plan.tolist():
        assert offset + length <= 64
        for k in range(n):
            used.setdefault(first + k, []).append((offset, length))
    for length, n in counts.items():
        ranks = sorted(r for row in plan.tolist() if row[0] == length for r in range(row[1], row[1] + row[2]))
        assert ranks == list(range(n))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    room = []  # best-fit-decreasing, one piece at a time
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else 64) - length)
    assert len(used) == len(room)
