"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard puts ``vnodes`` points on the 64-bit ring. A row belongs to the
first point clockwise of its key's hash. A shard takes rows up to its bound;
the rows beyond it continue clockwise to the next point whose shard has room.
The bounds are ``n // shards``, one more for the first ``n % shards`` shards, so
counts differ by one at most, and only overflow leaves its place on the ring
when rows or shards are added.

The overflow is decided on counts per arc (``shards x vnodes`` numbers, whatever
the input), then each arc's rows are cut by rank. DataFrame operations only.

Defined cases: a null text has size 1 and CRC 0; a null key hashes like any
other value; repeated rows are rows of their own; very long texts only count by
their size; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .tables import buckets_for, rank_within, small_table

RING_CELL_BITS = 12
SALTS = 16


def ring_points(spark: SparkSession, n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise; a shard's points do not depend on the others."""
    nodes = (
        spark.range(n_shards * vnodes)
        .select((F.col("id") % n_shards).cast("int").alias("shard"), F.floor(F.col("id") / n_shards).alias("replica"))
        .select(F.xxhash64(F.lit("ring"), "shard", "replica").alias("place"), "shard")
    )
    return sorted({r.place: (r.place, r.shard) for r in nodes.sort("place", "shard").collect()}.values())


def arc_cells(points: list[tuple[int, int]]) -> list[dict]:
    """Arcs cut at the cells of an even grid, so that a row finds its arc by an equi-join on its cell."""
    places, width, low = [p for p, _ in points], 1 << (64 - RING_CELL_BITS), -(1 << 63)
    out = []
    for cell in range(1 << RING_CELL_BITS):
        start, last = low + cell * width, low + (cell + 1) * width - 1
        at = start
        while at <= last:
            k = bisect_left(places, at)
            to = min(last, places[k]) if k < len(places) else last
            out.append({"cell": cell, "at": at, "to": to, "arc": k % len(places)})
            at = to + 1
    return out


def spread(counts: dict[int, int], owner: list[int], bounds: list[int]) -> list[dict]:
    """Cut each arc's ranks into segments that go to one shard each.

    One clockwise pass lets every shard take its own arcs' rows, another lap or
    more carries the overflow on; first come, first served.
    """
    room, used, out = list(bounds), [0] * len(bounds), []

    def take(shard: int, arc: int, lo: int, hi: int) -> int:
        n = min(room[shard], hi - lo)
        if n:
            out.append({"arc": arc, "lo": lo, "hi": lo + n, "shard": shard, "slot0": used[shard]})
            room[shard] -= n
            used[shard] += n
        return lo + n

    over: dict[int, list[tuple[int, int, int]]] = {}
    for arc, shard in enumerate(owner):
        n = counts.get(arc, 0)
        if n and (lo := take(shard, arc, 0, n)) < n:
            over[arc] = [(arc, lo, n)]
    carried: list[tuple[int, int, int]] = []
    for step in range(2 * len(owner)):
        at = step % len(owner)
        left = []
        for arc, lo, hi in carried:
            if (lo := take(owner[at], arc, lo, hi)) < hi:
                left.append((arc, lo, hi))
        carried = left + over.pop(at, [])
        if not carried and not over:
            break
    for arc, lo, hi in carried:  # a shard that lost all its points to equal places
        for shard in range(len(bounds)):
            lo = take(shard, arc, lo, hi)
    return out


def even_bounds(n: int, n_shards: int) -> list[int]:
    return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]


def shard_rows(df: DataFrame, key: str, n_shards: int = 8, vnodes: int = 128, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``keep`` of every row with shard int and slot long (gapless from 0 in its shard)."""
    spark = df.sparkSession
    points = ring_points(spark, n_shards, vnodes)
    owner = [s for _, s in points]
    cells = small_table(spark, arc_cells(points), "cell int, at bigint, to bigint, arc int")
    named = df.select(F.struct(key, *keep).alias("row"), F.xxhash64(key).alias("place"), F.spark_partition_id().alias("part"))
    placed = (
        named.withColumn("cell", F.shiftright("place", 64 - RING_CELL_BITS).cast("int") + (1 << (RING_CELL_BITS - 1)))
        .join(F.broadcast(cells), "cell")
        .where("place between at and to")
        .select("row", "place", "part", "arc")
    )
    placed = materialize(placed, "ring")
    counts = {r.arc: r.n for r in placed.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    segments = small_table(spark, spread(counts, owner, even_bounds(sum(counts.values()), n_shards)), "arc int, lo bigint, hi bigint, shard int, slot0 bigint")
    ranked = rank_within(placed, "arc", [F.col("place"), F.col("row")], buckets_for(max(counts.values(), default=0), SALTS), ["row", "part"])
    return (
        ranked.join(F.broadcast(segments), "arc")
        .where("rank >= lo and rank < hi")
        .select("row.*", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))
    )


def with_size(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = shard_rows(with_size(docs), "doc_id", 8, keep=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
