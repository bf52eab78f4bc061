"""Balanced label propagation into shards, in DataFrame functions only.

Documents are linked through *hubs* (here: equal texts). Labels start even and unlinked; rounds move
linked documents to where their neighbours are, under quotas; the rest fills the shards up so that
the law ``rows`` holds exactly: shard sizes differ by one row at most.

start   every linked document has a label by its own hash, so that shards hold equal parts.
rounds  hub members are counted by shard (partial sums). A hub wants to be where most of its members
        are (ties by hash; later only shards with room). A hub larger than 1/BLOCKS of a shard's
        capacity would not fit everywhere: these, fewer than shards x BLOCKS, get a plan over shards,
        the largest hub first: the shards that can hold most of it, in turn, as far as there is room.
        Quotas: the part of the wishes for shard t that is granted, f(t), is the largest for which
        t's members, less those that leave it, plus those that come, are within its capacity. Whole
        hubs are granted or not. Hubs that are whole leave the iteration.
fill    within each shard hubs are taken, large ones first, up to the capacity. Hubs beyond it and
        all unlinked documents fill the remaining places by rank, hubs first and together.

Ranks are exact two-level running counts, so no task sorts a shard. Joins of documents with their
hub's counts broadcast the hubs that hold a large share of the rows (a bounded number) and shuffle
the others.

Defined results
  null text        size 1, crc32 0; linked with other null texts and with empty ones
  null doc_id      placed like any other row
  repeated rows    each is a row with its own slot
  ties             by hash of the hub, or of the row's number
  extra columns    are ignored, whatever their names
  empty table      no rows
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm._scratch import bucket_count, join_back, join_checked, materialize, running

SHARDS, ROUNDS, BLOCKS = 8, 5, 32
SCALE = 1 << 20


def nodes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(uid, doc_id, size, text_crc32, hub): the hub is a digest of the text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"),
        F.unhex(F.sha2(t, 256)).alias("hub"),
    )


def _draw(*cols) -> F.col:
    """A number from 0 to SCALE - 1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(SCALE))


def _by_hub(members: DataFrame, shards: int) -> DataFrame:
    """(hub, members, count in each shard as an array)."""
    counts = [F.sum((F.col("shard") == s).cast("long")).alias(f"_{s}") for s in range(shards)]
    table = members.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), *counts)
    return table.select("hub", "members", F.array(*[F.col(f"_{s}") for s in range(shards)]).alias("at"))


def plan_large(at: list[int], room: list[int]) -> list[tuple[int, int, int]]:
    """Moves (from, to, number) of one large hub; ``room`` is updated.

    The shards that can hold most of the hub are filled in turn (ties: more members, lower number).
    """
    shards, left, take = range(len(at)), sum(at), [0] * len(at)
    for s in sorted(shards, key=lambda s: (-min(sum(at), at[s] + room[s]), -at[s], s)):
        take[s] = max(0, min(left, at[s] + room[s]))
        left -= take[s]
    for s in shards:  # no room anywhere: stay
        stay = min(left, at[s] - min(at[s], take[s]))
        take[s], left = take[s] + stay, left - stay
    moves, gives = [], [[s, at[s] - take[s]] for s in shards if at[s] > take[s]]
    for t in shards:
        wanted = take[t] - at[t]
        while wanted > 0:
            n = min(wanted, gives[-1][1])
            moves.append((gives[-1][0], t, n))
            gives[-1][1] -= n
            wanted -= n
            if not gives[-1][1]:
                gives.pop()
        room[t] -= take[t] - at[t]
    return moves


def granted(wishes: dict[tuple[int, int], int], held: list[int], capacity: list[int]) -> list[float]:
    """f(t) for every shard: shares of the wishes for t such that no shard grows beyond its capacity.

    Found from above: outflow counts as far as it is granted itself.
    """
    shards = range(len(held))
    wanted = [sum(n for (_, t), n in wishes.items() if t == k) for k in shards]
    f = [1.0] * len(held)
    for _ in range(200):
        leaves = [sum(n * f[t] for (s, t), n in wishes.items() if s == k) for k in shards]
        new = [min(f[t], max(0.0, (capacity[t] - held[t] + leaves[t]) / wanted[t])) if wanted[t] else 1.0 for t in shards]
        if max(abs(a - b) for a, b in zip(f, new)) < 1e-6:
            break
        f = new
    return new


def _large_moves(spark, plans: list[tuple], turn: int) -> DataFrame:
    """(hub, from, lo, hi, to): a member whose draw is in [lo, hi) goes. Bounded by the large hubs."""
    rows = []
    for hub, at, moves in plans:
        used = [0] * len(at)
        for s, t, n in moves:
            lo, used[s] = used[s], used[s] + n
            rows.append({"h": hub.hex(), "from": s, "lo": SCALE * lo // at[s], "hi": SCALE * used[s] // at[s], "goes": t})
    moves = F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<h: string, from: int, lo: bigint, hi: bigint, goes: int>>"))
    return spark.range(1).select(moves).withColumn("h", F.unhex("h"))


def propagate(linked: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (uid, hub, members, ..; one hub a document) with the column ``shard`` after the rounds."""
    spark = linked.sparkSession
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    block = max(1, capacity[-1] // BLOCKS)
    open_ = materialize(linked.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(shards)).cast("int")), "shard-labels")
    finished, settled = [], [0] * shards
    columns = open_.columns
    for turn in range(rounds):
        n = open_.count()
        cells = materialize(_by_hub(open_, shards), "shard-cells")
        sums = cells.agg(*[F.sum(F.get("at", F.lit(s))).alias(f"_{s}") for s in range(shards)]).first()
        held = [settled[s] + (sums[s] or 0) for s in range(shards)]
        split = F.array_max("at") < F.col("members")
        room = [capacity[s] - held[s] for s in range(shards)]
        large = sorted(cells.where(F.col("members") > block).collect(), key=lambda r: (-r.members, r.hub))  # fewer than shards x BLOCKS rows
        plans = [(bytes(r.hub), list(r["at"]), plan_large(list(r["at"]), room)) for r in large]
        wishes: dict[tuple[int, int], int] = {}
        for _, _, moves in plans:
            for s, t, k in moves:
                held[s], held[t] = held[s] - k, held[t] + k
        usable = [turn == 0 or room[s] > 0 for s in range(shards)]
        order = F.array(*[F.struct(F.when(F.lit(usable[s]), F.get("at", F.lit(s))).otherwise(F.lit(-1)).alias("n"), F.xxhash64("hub", F.lit(s), F.lit(turn)).alias("tie"), F.lit(s).alias("s")) for s in range(shards)])
        aims = cells.where(F.col("members") <= block).select("hub", "members", "at", F.when(split, F.array_max(order)["s"]).alias("to"))
        each = aims.where("to is not null").select("to", F.posexplode("at").alias("s", "k")).where("s <> to").groupBy("s", "to").agg(F.sum("k").alias("k"))
        for r in each.collect():  # at most shards x shards rows
            wishes[r.s, r.to] = wishes.get((r.s, r.to), 0) + r.k
        if not any(wishes.values()) and not any(moves for _, _, moves in plans):
            break
        f = granted({k: v for k, v in wishes.items() if v}, held, capacity)
        share = F.element_at(F.array(*[F.lit(int(SCALE * x)) for x in f]), F.col("to") + 1)
        small = join_back(open_.where(F.col("members") <= block), aims.select("hub", "members", "to").withColumnRenamed("members", "_members"), "hub", "_members", n)
        goes = F.col("to").isNotNull() & (_draw("hub", F.lit(10 + turn)) < share)
        moved = small.select(*[F.when(goes, F.col("to")).otherwise(F.col("shard")).alias(c) if c == "shard" else F.col(c) for c in columns], F.col("to").isNull().alias("whole"))
        draw = _draw("uid", F.lit(50 + turn))
        into = F.broadcast(_large_moves(spark, plans, turn))
        hot = open_.where(F.col("members") > block).join(into, (F.col("hub") == F.col("h")) & (F.col("shard") == F.col("from")) & (draw >= F.col("lo")) & (draw < F.col("hi")), "left")
        hot = hot.select(*[F.coalesce("goes", "shard").alias(c) if c == "shard" else F.col(c) for c in columns], F.lit(False).alias("whole"))
        after = materialize(moved.unionByName(hot), "shard-labels")
        done = after.where("whole").drop("whole")
        finished.append(done)
        for r in done.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
            settled[r.shard] += r.n
        open_ = after.where("not whole").drop("whole")
    for part in finished:
        open_ = open_.unionByName(part)
    return open_


def _bucket(key, buckets: int):
    """Order-keeping bucket of a hashed long key."""
    at = F.floor((key.cast("double") / F.lit(float(1 << 63)) + F.lit(1.0)) * F.lit(buckets / 2)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), at))


def _fill(state: DataFrame, capacity: list[int], block: int, buckets: int) -> DataFrame:
    """``state`` with ``fits``: hubs are taken, large ones first, up to a shard's capacity.

    Only a hub with more than ``block`` members in the shard is cut at the border.
    """
    limit = F.element_at(F.array(*[F.lit(c) for c in capacity]), F.col("shard") + 1)
    cells = state.groupBy("shard", "hub").agg(F.max("members").alias("members"), F.count(F.lit(1)).alias("n"))
    first = F.col("n") > block
    ordered = running(cells.withColumn("key", F.xxhash64("hub")), ["shard"], [F.col("key"), F.col("hub")], F.col("n"), buckets, F.when(first, 0).otherwise(_bucket(F.col("key"), buckets) + 1))
    ordered = materialize(ordered.select("shard", "hub", "members", "n", "before", (limit - F.col("before")).alias("room")), "shard-cells")
    small, large = state.where(F.col("members") <= block), state.where(F.col("members") > block)
    over = ordered.where((F.col("members") <= block) & (F.col("n") > F.col("room"))).select("shard", "hub", F.lit(True).alias("over"))
    small = join_checked(small, over, ["shard", "hub"], "left").withColumn("fits", F.col("over").isNull()).drop("over")
    # Cells of large hubs: fewer than shards x shards x BLOCKS.
    cut = ordered.where(F.col("members") > block).select("shard", "hub", "n", "room")
    large = large.join(F.broadcast(cut), ["shard", "hub"])
    ranked = running(large, ["shard", "hub"], [F.xxhash64("uid"), F.col("uid")], F.lit(1), buckets, _bucket(F.xxhash64("uid"), buckets))
    fits = (F.col("n") <= F.col("room")) | ((F.col("n") > block) & (F.col("rank") < F.col("room")))
    return small.unionByName(ranked.withColumn("fits", fits).select(*small.columns))


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = materialize(nodes(docs, text, doc_id), "shard-nodes")
    total = rows.count()
    buckets = bucket_count(total)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    block = max(1, capacity[-1] // BLOCKS)
    hubs = materialize(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shard-hubs")
    every = materialize(join_back(rows, hubs, "hub", "members", total, how="left"), "shard-linked")
    linked = every.where("members is not null")
    state = materialize(_fill(propagate(linked, total, shards), capacity, block, buckets), "shard-fill")
    fixed = state.where("fits")

    used = {r.shard: r.n for r in fixed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = ["uid", "doc_id", "size", "text_crc32"]
    # Places that are left: documents of hubs first (together; those of a cut hub by their own hash), then the others.
    key = F.when(F.col("members") <= block, F.xxhash64("hub")).otherwise(F.xxhash64("uid"))
    pool = state.where("not fits").select(*keep, key.alias("key"), F.col("hub"), _bucket(key, buckets).alias("bucket"))
    single = every.where("members is null").select(*keep, F.xxhash64("uid").alias("key"), F.col("hub"), (_bucket(F.xxhash64("uid"), buckets) + buckets).alias("bucket"))
    pool = running(pool.unionByName(single).withColumn("all", F.lit(0)), ["all"], [F.col("key"), F.col("hub"), F.col("uid")], F.lit(1), 2 * buckets, F.col("bucket"))
    end, ends = 0, []
    for s in range(shards):
        end += capacity[s] - used.get(s, 0)
        ends.append(end)
    place = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        place = F.when(F.col("rank") < ends[s], F.lit(s)).otherwise(place)
    placed = materialize(fixed.select(*keep, "shard").unionByName(pool.select(*keep, place.cast("int").alias("shard"))), "shard-placed")
    own = F.xxhash64("uid", F.lit(2))  # not the order of the places, which is one of shards too
    slots = running(placed, ["shard"], [own, F.col("uid")], F.lit(1), buckets, _bucket(own, buckets))
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
