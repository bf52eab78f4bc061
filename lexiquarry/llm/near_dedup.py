"""N-gram Jaccard join by parity sketches.

Documents are sets of distinct five-word shingles; two link when their Jaccard similarity is at
least 0.8. Documents with one and the same set form a *class*; the join runs on classes.

Candidates. XOR-hashing a set's shingles into a bit sketch gives the parity of every bit; the
Hamming distance of two sketches is at most the size of the symmetric difference, which for linked
sets of sizes a and b is at most (a + b) / 9. The sketch of a size band is K wide, sparse words. A set
may differ from a linked one in at most D words (D from its size), so of its K (place, word) items
any D + e contain e common ones if both sides choose them in one common order. The order puts items
with many bits of uncommon shingles first and empty ones last; counts over all texts tell which shingles
(of lines and passages that many documents share) are common. A set emits its first D + e items in its
band, and in the next band if a linked set may lie there; a pair with fewer than e common items (e is
1 to 3 by band) is no link. No link is lost.

Items meet by hashed slices. A mapper emits arrays (key, class) per slice, each class once a task; a
reducer keeps only keys with two classes or more, and lists that several keys repeat only once.

Components. Pairs of short lists count if their common items weigh enough. In a longer list all classes
are compared with one of them first (the class that shares most keys, then a hashed choice), after
which lists whose classes are connected are done. Of what remains, all pairs across components are
compared by their whole sketches, of one to two bits a shingle, block by block in memory; only pairs
that these allow become rows. Every pair that is left is decided on the sets' sizes and intersection.

Shingles and class ids are 64-bit hashes; set sizes and intersections are counted on them. Two
different sets with one class id would link wrongly: with n distinct sets about n * n / 2**65 pairs
are expected (0.03 for 10**9 sets).

Defined results
  null or empty text, no word   n_shingles 0, linked with nothing; component_id is its own doc_id
  fewer than five words         the whole sequence is the one shingle
  null doc_id                   linked like others; ignored for the smallest id of a component
  repeated rows                 same class
  empty table                   no rows
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm._scratch import arrow_map, discard, few, join_back, join_checked, materialize, width
from lexiquarry.llm._words import U, mix, raw, set_digest, shingle_set, word_memo

#: Words of a shingle, and the similarity as a fraction.
SHINGLE, NUMER, DENOM = 5, 80, 100
#: Keys of one reducer, about; slices a reducer gets; classes of a key that is passed on unlisted;
#: classes of a list whose pairs are all taken at once.
REDUCER_KEYS, SLICES, WIDE, SHORT = 1_000_000, 8, 4096, 16
#: Members of a block of a long list.
BLOCK = 1024
#: Partners of a class that one task compares with it, about; edges that one task connects by itself.
PARTNERS, EDGES = 512, 2_000_000
#: What the keys that linked sets share must weigh; a key's last two bits are its weight.
ENOUGH = 3
#: Bits of the table of common shingles, and of the number of its slices: at least, and at most (one slice
#: for every SLICE_BYTES of text, about); one in CROWDED positions may look common by chance.
TABLE_BITS, TABLE_SLICES, MOST_SLICES, SLICE_BYTES, CROWDED = 27, 6, 12, 32 << 20, 4
#: Entries a reducer holds before it compacts them.
HOLD = 6_000_000


def linked(inter: int, a: int, b: int) -> bool:
    return DENOM * inter >= NUMER * (a + b - inter)


def most_different(n: int) -> int:
    """Largest symmetric difference of a set of ``n`` and any set linked with it."""
    return (n + n * DENOM // NUMER) * (DENOM - NUMER) // (DENOM + NUMER)


def band(n: int) -> int:
    return n.bit_length() - 1


def sketch_words(f: int) -> int:
    """Words of the sketch of band ``f`` (sizes 2**f to 2**(f+1) - 1)."""
    return int(0.35 * (2 << f)) + 4


def needed(g: int) -> int:
    """Items that two linked sets have in common in band ``g``, by choice: more for larger sets."""
    return 1 if g < 4 else 2 if g < 6 else 3


def items(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys of the items that the sorted set ``s`` emits; ``common`` is a bitmap over hashed shingles.

    A place holds two words, the parities of its uncommon and of its common shingles; a shingle that
    differs still changes one place only. A word is wide and sparse (a bit for every hash), so it is
    kept as the XOR of the hashes of its odd bits: equal words, equal XORs. The order is a function of
    the item alone.
    """
    n = len(s)
    own = mix(s)  # stands for the shingle's bit among 2**64
    at = (s >> U(64 - TABLE_BITS)).astype(np.int64)
    usual = (common[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
    rare_own, usual_own = np.where(usual, U(0), own), np.where(usual, own, U(0))
    rare_one = (~usual).astype(np.int64)
    f = band(n)
    out = []
    for g in (f, f + 1) if n * DENOM // NUMER >= 2 << f else (f,):
        k, take = sketch_words(g), most_different(n) + needed(g)
        place = ((s >> U(32)) * U(k)) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        rare, seen = np.bitwise_xor.reduceat(rare_own, starts), np.bitwise_xor.reduceat(usual_own, starts)
        n_rare = np.minimum(np.add.reduceat(rare_one, starts), 63).astype(U)
        n_seen = np.minimum(np.diff(np.append(starts, n)) - n_rare.astype(np.int64), 63).astype(U)
        places = place[starts]
        key = mix(rare ^ mix(seen ^ mix(places + (U(g + 1) << U(40)))))
        if len(key) > take:
            rank = ((U(63) - n_rare) << U(58)) | ((U(63) - n_seen) << U(52)) | (key >> U(12))
            key = key[np.argpartition(rank, take - 1)[:take]]
        elif len(key) < take:  # empty places are needed as well, in their own common order
            empty = np.setdiff1d(np.arange(k, dtype=U), places)
            zero = np.sort(mix(mix(empty + (U(g + 1) << U(40)))))
            key = np.concatenate((key, zero[: take - len(key)]))
        out.append((key & ~U(3)) | U(ENOUGH // needed(g) + (ENOUGH % needed(g) > 0)))
    return np.concatenate(out)


def common_shingles(docs: DataFrame, size: int, text: str, doc_id: str) -> np.ndarray:
    """Bitmap of hashed shingles that two or more different sets have, counted over all documents
    (``size`` bytes of text).

    The bitmap has 2**TABLE_BITS positions, whatever the input. Shingles that share a position are
    counted together; where the input fills the table, a position is common from two sets above the
    level that all but one in CROWDED positions keep (0 in a table that is not full). A set that
    several tasks read counts once for each. Flags only rank items: any ranking finds every link.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), t.alias("text"))
    cut = max(TABLE_SLICES, min(MOST_SLICES, (size // SLICE_BYTES).bit_length()))
    low = TABLE_BITS - cut
    names, kinds = ["p", "at", "more", "extra"], (pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def deal(batches):
        memo, known = word_memo(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                sets = []
                for x in raw(whole.column(1).slice(at, 2000)):
                    s = shingle_set(x, memo, SHINGLE)
                    d = set_digest(s)
                    if len(s) and d not in known:
                        known.add(d)
                        sets.append(s)
                if not sets:
                    continue
                pos, n = np.unique((np.concatenate(sets) >> U(64 - TABLE_BITS)).astype(np.uint32), return_counts=True)
                again, extra = n > 1, (n - 1).astype(np.uint32)
                edge = np.searchsorted(pos >> np.uint32(low), np.arange((1 << cut) + 1))
                out = [(p, pos[a:b].tobytes(), pos[a:b][again[a:b]].tobytes(), extra[a:b][again[a:b]].tobytes()) for p, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def collect(batches):
        counts: dict[int, np.ndarray] = {}
        mask, calm = np.uint32((1 << low) - 1), (1 << low) - 1 - (1 << low) // CROWDED
        for b in batches:
            for p, at, more, extra in zip(*(b.column(k).to_pylist() for k in names)):
                if p not in counts:
                    counts[p] = np.zeros(1 << low, np.uint32)
                counts[p][np.frombuffer(at, np.uint32) & mask] += np.uint32(1)  # a row has a position once
                counts[p][np.frombuffer(more, np.uint32) & mask] += np.frombuffer(extra, np.uint32)
        for p, n in counts.items():
            bits = np.packbits(n >= np.partition(n, calm)[calm] + np.uint32(2)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([bits], pa.binary())], names=["p", "bits"])

    dealt = arrow_map(rows, deal, "p int, at binary, more binary, extra binary").repartition(1 << cut, "p")
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in arrow_map(dealt, collect, "p int, bits binary").collect():  # 2**TABLE_BITS bits in all
        table[r.p << (low - 3) : (r.p + 1) << (low - 3)] = np.frombuffer(r.bits, np.uint8)
    return table


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity of the set's shingles in one to two bits a shingle (a power of two of bits)."""
    m = max(64, 2 << band(len(s)))
    return np.packbits((np.bincount((s & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(bool)).tobytes()


def hamming(x: bytes, y: bytes) -> int:
    """Distance of two sketches; the longer one is folded to the length of the shorter one."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def classes(docs: DataFrame, slices: int, common: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One pass over the texts: rows of documents (doc_id, th, n, c) and, once a
    task and class, sketches (c, n, sk) and slices of keys (p, blob)."""
    names = ["doc_id", "th", "n", "c", "sk", "p", "blob"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())

    shared = docs.sparkSession.sparkContext.broadcast(common)  # 2**TABLE_BITS bits

    def run(batches):
        memo, seen = word_memo(), set()
        usual = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                n_col, c_col, sk_col, keys, owners = [], [], [], [], []
                for t in raw(b.column(2)):
                    s = shingle_set(t, memo, SHINGLE)
                    n_col.append(len(s))
                    if not len(s):
                        c_col.append(None)
                        sk_col.append(None)
                        continue
                    c = int.from_bytes(set_digest(s)[:8], "little", signed=True)
                    c_col.append(c)
                    sk_col.append(None if c in seen else bit_sketch(s))
                    if c not in seen:
                        seen.add(c)
                        key = items(s, usual)
                        keys.append(key)
                        owners.append(np.full(len(key), c, dtype=np.int64))
                m = b.num_rows
                blank = pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_col, pa.int64()), pa.array(c_col, pa.int64()), pa.array(sk_col, pa.binary()), *blank], names=names)
                if keys:
                    key, own = np.concatenate(keys), np.concatenate(owners)
                    p = ((key >> U(40)) % U(slices)).astype(np.int32)
                    order = np.argsort(p, kind="stable")
                    key, own, p = key[order].astype(np.uint32), own[order], p[order]
                    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
                    blobs = [key[i:j].tobytes() + own[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(p)))]
                    void = [pa.nulls(len(blobs), k) for k in kinds[:5]]
                    yield pa.RecordBatch.from_arrays([*void, pa.array(p[first], pa.int32()), pa.array(blobs, pa.binary())], names=names)

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))
    return arrow_map(rows, run, "doc_id long, th long, n long, c long, sk binary, p int, blob binary")


def _runs(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, class) entries by key, where each key's run starts, and its length."""
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(key) else np.empty(0, bool)
    key, own = key[new], own[new]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key, own, at, np.diff(np.append(at, len(key)))


def _weights(key: np.ndarray) -> np.ndarray:
    return (key & U(3)).astype(np.int64)


def shared_lists(batches):
    """Reducer: pairs (a, b, w) of classes whose shared keys with short lists weigh w, and members (g, a, w)
    of longer lists g whose keys weigh w (both within this partition)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, wide = 0, np.empty(0, dtype=U)

    def members(g, c, w):
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c), pa.nulls(len(c), pa.int64()), pa.array(w, pa.int64())], names=["g", "a", "b", "w"])

    def gather():
        nonlocal wide
        key = np.concatenate([k for k, _ in held]) if held else np.empty(0, U)
        own = np.concatenate([c for _, c in held]) if held else np.empty(0, np.int64)
        key, own, at, size = _runs(key, own)
        wide = np.union1d(wide, key[at[size >= WIDE]])
        loose = np.isin(key, wide)
        return key[~loose], own[~loose], key[loose], own[loose]

    for b in batches:
        for p, blob in zip(b.column("p").to_pylist(), b.column("blob").to_pylist()):
            m = len(blob) // 12
            held.append((np.frombuffer(blob, np.uint32, m).astype(U) | (U(p) << U(32)), np.frombuffer(blob, np.int64, m, 4 * m)))
            count += m
        if count > HOLD:
            key, own, wkey, wown = gather()
            held[:], count = [(key, own)], len(key)
            if len(wkey):
                yield members(mix(wkey), wown, _weights(wkey))
    key, own, wkey, wown = gather()
    if len(wkey):
        yield members(mix(wkey), wown, _weights(wkey))
    key, own, at, size = _runs(key, own)
    if not len(key):
        return
    mark = np.add.reduceat(mix(own.view(U)), at) ^ (size.astype(U) << U(48))
    many = np.flatnonzero(size >= 2)
    if not len(many):
        return
    g, first, back = np.unique(mark[many], return_index=True, return_inverse=True)
    weight = np.bincount(back, _weights(key[at[many]]), minlength=len(g)).astype(np.int64)
    runs = many[first]
    short = size[runs] <= SHORT
    # Short lists: all pairs, by the two places in the run (classes are sorted within a run).
    start, length, w = at[runs[short]], size[runs[short]], weight[short]
    left, right, each = [], [], []
    for k in range(1, SHORT):
        ok = length > k
        if not ok.any():
            break
        start, length, w = start[ok], length[ok], w[ok]
        for i in range(k):
            left.append(own[start + i])
            right.append(own[start + k])
            each.append(w)
    if left:
        a, b, w = np.concatenate(left), np.concatenate(right), np.concatenate(each)
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(new), pa.int64()), pa.array(a[new]), pa.array(b[new]), pa.array(np.add.reduceat(w, new), pa.int64())], names=["g", "a", "b", "w"])
    g, runs, weight = g[~short], runs[~short], weight[~short]
    if len(runs):
        length = size[runs]
        offset = np.repeat(at[runs], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        yield members(np.repeat(mix(g), length), own[offset], np.repeat(weight, length))


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches are near enough for a link; drops no link."""
    one = sketches.select(F.col("c").alias("ca"), F.col("n").alias("na"), F.col("sk").alias("ska"))
    two = sketches.select(F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("sk").alias("skb"))
    both = pairs.join(one, F.col("a") == F.col("ca")).join(two, F.col("b") == F.col("cb")).select("a", "b", "na", "nb", "ska", "skb")

    def run(batches):
        for x in batches:
            rows = zip(*(x.column(k).to_pylist() for k in ("na", "nb", "ska", "skb")))
            ok = [min(m, n) * DENOM >= max(m, n) * NUMER and hamming(u, v) * (DENOM + NUMER) <= (m + n) * (DENOM - NUMER) for m, n, u, v in rows]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(both, run, "a long, b long")


def _fold(words: np.ndarray, width_: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to ``width_`` words."""
    while words.shape[1] > width_:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def near_in_block(c, n, root, sketches: list[bytes], side) -> list[tuple[int, int]]:
    """Pairs of different components whose sketches are near enough, of one block or across two.

    ``side`` is 0 or 1; if both occur, only pairs across the sides are compared.
    """
    length = np.array([len(x) for x in sketches])
    across = side.min() != side.max()
    out = []
    for size in np.unique(length):
        wide = np.flatnonzero(length >= size)
        folded = np.empty((len(wide), size // 8), dtype=U)
        for other in np.unique(length[wide]):
            at = np.flatnonzero(length[wide] == other)
            folded[at] = _fold(np.frombuffer(b"".join(sketches[wide[k]] for k in at), U).reshape(len(at), -1), size // 8)
        for k in np.flatnonzero(length[wide] == size):
            i = wide[k]
            free = (root[wide] != root[i]) & ((length[wide] > size) | (wide > i))
            if across:
                free &= side[wide] != side[i]
            ok = np.flatnonzero(free & (np.minimum(n[wide], n[i]) * DENOM >= np.maximum(n[wide], n[i]) * NUMER))
            if len(ok):
                d = np.bitwise_count(folded[ok] ^ folded[k]).sum(axis=1, dtype=np.int64)
                hit = wide[ok[d * (DENOM + NUMER) <= (n[wide[ok]] + n[i]) * (DENOM - NUMER)]]
                out.extend((min(c[i], c[j]), max(c[i], c[j])) for j in hit)
    return out


def across_components(open_: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): pairs of one list and different components that their sketches allow.

    A list is cut into blocks of about BLOCK members; two blocks meet in one group, in which sketches
    are compared in memory, so pairs that are no candidates never become rows.
    """
    sizes = open_.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("g", "sg")
    rows = open_.join(sizes, F.col("g") == F.col("sg")).select("g", "c", "n", "root", "blocks", F.pmod(F.xxhash64("c", F.lit(7)), F.col("blocks")).cast("int").alias("own"))
    rows = rows.join(sketches.select(F.col("c").alias("sc"), "sk"), F.col("c") == F.col("sc")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "c", "n", "root", "sk")
    dealt = dealt.repartition(width(open_.sparkSession), "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")

    def run(batches):
        def done(rows):
            side, c, n, root, sk = zip(*rows)
            found = near_in_block(np.array(c), np.array(n), np.array(root), list(sk), np.array(side))
            cols = list(zip(*set(found))) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["a", "b"])

        at, held = None, []
        for b in batches:
            for g, lo, hi, *row in zip(*(b.column(k).to_pylist() for k in ("g", "lo", "hi", "side", "c", "n", "root", "sk"))):
                if (g, lo, hi) != at:
                    if held:
                        yield done(held)
                    at, held = (g, lo, hi), []
                held.append(row)
        if held:
            yield done(held)

    return arrow_map(dealt, run, "a long, b long").distinct()


def fetch(docs: DataFrame, firsts: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(c, s): the shingle sets of classes ``firsts`` (c, id, th), from the text of one document each."""
    wanted = firsts.select("c", F.col("id").alias("_id"), F.col("th").alias("_th"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(doc_id).cast("long").alias("_doc"), t.alias("text"), F.xxhash64(t).alias("_h"))
    texts = join_checked(texts, wanted, (F.col("_h") == F.col("_th")) & F.col("_doc").eqNullSafe(F.col("_id"))).select("c", "text")

    def run(batches):
        memo = word_memo()
        for b in batches:
            s = [shingle_set(x, memo, SHINGLE).tobytes() for x in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], names=["c", "s"])

    return arrow_map(texts, run, "c long, s binary")


def compare(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that link. ``b``'s set is sent once per group of its partners.

    Groups are (b, salt): a class has a salt for every ``PARTNERS`` partners, so that one with very
    many is spread over tasks.
    """
    counts = materialize(pairs.groupBy(F.col("b").alias("k")).agg(F.count(F.lit(1)).alias("n")), "near-partners")
    salts = F.floor(F.col("n") / PARTNERS).cast("int") + 1
    counted = join_back(pairs.select("a", "b"), counts.select(F.col("k").alias("b"), "n"), "b", "n", pairs.count())
    salted = materialize(counted.select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt")), "near-salted")
    small = few(salted)
    hint = F.broadcast if small else (lambda x: x)
    left = sets.join(hint(salted), F.col("c") == F.col("a")).select("b", "salt", "a", "s")
    centre = sets.join(hint(salted.select("b", "salt").distinct()), F.col("c") == F.col("b")).select("b", "salt", F.lit(None).cast("long").alias("a"), "s")

    def run(batches):
        at, mine = None, None
        for batch in batches:
            out = []
            for b, salt, a, s in zip(*(batch.column(k).to_pylist() for k in ("b", "salt", "a", "s"))):
                if a is None:
                    at, mine = (b, salt), np.frombuffer(s, U)
                elif at == (b, salt):
                    other = np.frombuffer(s, U)
                    short, long = (mine, other) if len(mine) < len(other) else (other, mine)
                    spot = np.minimum(np.searchsorted(long, short), len(long) - 1)
                    if linked(int((long[spot] == short).sum()), len(mine), len(other)):
                        out.append((a, b))
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["a", "b"])

    dealt = left.unionByName(centre).repartition(width(sets.sparkSession), "b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return arrow_map(dealt, run, "a long, b long")


def _union_find(batches):
    """(node, root) over all edges (u, v) of a partition: minimum labels spread along edges and are
    shortened by pointer jumping until nothing changes."""
    held = list(batches)
    u, v = (np.concatenate([b.column(k).to_numpy() for b in held] or [np.empty(0, np.int64)]) for k in ("u", "v"))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        for end in (root[i], root[j]):  # the ends' roots take the smaller root
            np.minimum.at(after, end, low)
        while not np.array_equal(jumped := after[after], after):
            after = jumped
        if np.array_equal(after, root):
            break
        root = after
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def connected(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); ``root`` is the smallest node of its component.

    At most ``most`` edges are connected by one task. Beyond that, large-star and small-star steps on
    the edge list until it no longer changes; a node's neighbours are only ever aggregated, and a node
    with a large share of the edges gets its minimum by broadcast.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = materialize(e, "near-edges"), None
    if e.count() <= most:
        return arrow_map(e.coalesce(1), _union_find, "node long, root long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_back(both, low, "u", "n", 2 * e.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_back(large, low, "u", "n", 2 * e.count())
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = materialize(small, "near-edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = after
        if mark == before:
            break
        before = mark
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _across(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Lists (g, c, w, n) with each class's component, without lists that lie in one component."""
    if roots is None:
        return lists.withColumn("root", F.col("c"))
    placed = join_checked(lists, roots, F.col("c") == F.col("node"), "left")
    placed = placed.withColumn("root", F.coalesce("root", "c")).drop("node")
    open_ = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("g").alias("og"))
    return join_checked(placed, open_, F.col("g") == F.col("og"), "left_semi")


def _similar_size(a: str, b: str):
    return F.least(a, b) * DENOM >= F.greatest(a, b) * NUMER


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, th (text fingerprint), n_shingles, root (names the component; none
    without words), component_id, n_component."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    reducers = max(width(spark), size // 18 // REDUCER_KEYS)  # a byte of text makes about 1/18 key
    both = materialize(classes(docs, int(reducers) * SLICES, common_shingles(docs, size, text, doc_id), text, doc_id), "near-classes")
    rows = materialize(both.where(F.col("p").isNull()).select("doc_id", "th", "n", "c", "sk"), "near-rows")
    total = rows.count()
    dealt = both.where(F.col("p").isNotNull()).select("p", "blob").repartition(int(reducers), "p")
    found = materialize(arrow_map(dealt, shared_lists, "g long, a long, b long, w long"), "near-found")
    discard(both)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), "th"))
    per_class = rows.where("n > 0").groupBy("c").agg(first.alias("first"), F.max("n").alias("n"), F.max("sk").alias("sk"), F.count(F.lit(1)).alias("copies"))
    per_class = materialize(per_class.select("c", F.col("first.id").alias("id"), F.col("first.th").alias("th"), "n", "sk", "copies"), "near-per-class")

    pairs = materialize(found.where(F.col("g").isNull()).groupBy("a", "b").agg(F.sum("w").alias("w")), "near-pairs")
    lists = materialize(found.where(F.col("g").isNotNull()).groupBy("g", F.col("a").alias("c")).agg(F.sum("w").alias("w")), "near-lists")
    discard(found)
    strong = pairs.where(F.col("w") >= ENOUGH)
    met = strong.select(F.col("a").alias("k")).unionByName(strong.select(F.col("b").alias("k"))).unionByName(lists.select(F.col("c").alias("k"))).distinct()
    sketches = materialize(per_class.join(met, F.col("c") == F.col("k"), "left_semi").select("c", "n", "sk", "id", "th"), "near-sketches")
    degree = lists.groupBy("c").agg(F.sum("w").alias("d")).withColumnRenamed("c", "k")
    degree = degree.join(sketches.select("c", "n"), F.col("k") == F.col("c")).select("k", "d", "n")
    lists = materialize(lists.join(degree, F.col("c") == F.col("k")).select("g", "c", "w", "d", "n"), "near-members")

    edges, tested, roots, sets = None, None, None, None
    for turn in range(3):
        open_ = materialize(_across(lists, roots), f"near-open-{turn}")
        if turn and not open_.head(1):
            break
        if turn < 2:
            order = F.col("d") if turn == 0 else F.xxhash64("c", F.lit(turn))
            centre = open_.groupBy("g").agg(F.max(F.struct(order.alias("o"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))).alias("x"))
            centre = centre.select(F.col("g").alias("cg"), "x.b", "x.nb", "x.rb")
            more = open_.join(centre, F.col("g") == F.col("cg")).where("root <> rb").where(_similar_size("n", "nb"))
            more = more.select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()
            if turn == 0:
                more = more.unionByName(strong.select("a", "b")).distinct()
        else:  # every pair across components; a weak pair that may link shares a long list as well
            more = across_components(open_, sketches)
        if tested is not None:
            more = more.join(tested, ["a", "b"], "left_anti")
        more = materialize(more, f"near-more-{turn}")
        likely = materialize(plausible(more, sketches), f"near-likely-{turn}") if turn < 2 else more
        tested = more if tested is None else tested.unionByName(more)
        if not likely.head(1):
            continue
        ends = likely.select(F.col("a").alias("k")).unionByName(likely.select(F.col("b").alias("k"))).distinct()
        firsts = sketches.join(ends, F.col("c") == F.col("k"), "left_semi").select("c", "id", "th")
        if sets is not None:
            firsts = firsts.join(sets.select(F.col("c").alias("k")), F.col("c") == F.col("k"), "left_anti")
        firsts = materialize(firsts, f"near-firsts-{turn}")
        if firsts.head(1):
            fresh = materialize(fetch(docs, firsts, text, doc_id), f"near-sets-{turn}")
            sets = fresh if sets is None else sets.unionByName(fresh)
        good = materialize(compare(sets, likely), f"near-links-{turn}")
        edges = good if edges is None else edges.unionByName(good)
        roots = materialize(connected(edges), f"near-roots-{turn}")

    # Components: the smallest id over the classes of a root, then one row per class, then documents.
    placed = per_class if roots is None else join_checked(per_class, roots, F.col("c") == F.col("node"), "left").drop("node")
    placed = placed.withColumn("root", F.coalesce(F.col("root"), F.col("c")) if roots is not None else F.col("c"))
    tops = placed.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("copies").alias("n_component")).withColumnRenamed("root", "top")
    named = placed.join(tops, F.col("root") == F.col("top")).select("c", "copies", "root", "component_id", "n_component")
    named = materialize(named, "near-named")
    out = join_back(rows.where("n > 0"), named, "c", "copies", total).select("doc_id", "th", F.col("n").alias("n_shingles"), "root", "component_id", "n_component")
    alone = rows.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_component"))
    return out.unionByName(alone)


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
