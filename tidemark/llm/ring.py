"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

The ring has ``cells`` cells.  Each shard's virtual nodes lie in cells that a digest of shard and number picks (the next
free one clockwise when taken).  A key falls into the cell of its hash and prefers the shards in the order in which their nodes
follow clockwise.  Loads are bounded: a shard takes keys up to its capacity, first those that prefer it first, cell by cell around
the ring; keys that find it full go on clockwise, so every shard ends at its capacity or under it, and most keys
stay with their first choice.  With no slack the capacities add up to the rows, so counts are at most one apart.

Keys of one cell share their preferences, so the counts of the cells (at most ``cells`` rows on the driver, whatever the
input) settle which ranks of each cell go where: a plan of at most cells x shards rows, which is broadcast.  Rows need only
their rank in the cell, in order of their keys.  A cell of more than ``PART_ROWS`` rows is cut into equal ranges of keys, and a range that holds more than that
all the same (one key, say) is dealt by the rows' numbers in a stored table; ranks are counted within those parts, and parts begin where those before them end.  So
no task sorts more than about ``PART_ROWS`` rows at a time, whatever one key holds.

A null id is placed by its text's hash; null texts have size 1 and the checksum of no bytes; equal rows are placed each, their ranks
by size and checksum (where their key fills several parts: by their numbers); rows that agree in everything are interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, text_of

CELLS, NODES = 4096, 128
PART_ROWS = 1 << 18


def nodes(shards: int, per_shard: int = NODES, cells: int = CELLS) -> list[int | None]:
    """The shard whose virtual node lies in each cell.  A shard's nodes are placed before those of later shards, so adding one moves none."""
    ring: list[int | None] = [None] * cells
    if shards * per_shard > cells:
        raise ValueError("more virtual nodes than cells")
    for s in range(shards):
        for v in range(per_shard):
            at = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % cells
            while ring[at] is not None:
                at = (at + 1) % cells
            ring[at] = s
    return ring


def preferences(ring: list[int | None], shards: int) -> list[list[int]]:
    """For each cell the shards in the order in which their nodes follow, its own included."""
    n = len(ring)
    out: list[list[int]] = [[] for _ in range(n)]
    order: list[int] = []
    for at in range(2 * n - 1, -1, -1):
        s = ring[at % n]
        if s is not None:
            if s in order:
                order.remove(s)
            order.insert(0, s)
        if at < n:
            out[at] = list(order)
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-(-int(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, *, per_shard: int = NODES, cells: int = CELLS, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot): who takes which ranks of each cell."""
    prefer = preferences(nodes(shards, per_shard, cells), shards)
    room = capacities(sum(counts.values()), shards, slack)
    used, given, out = [0] * shards, dict.fromkeys(counts, 0), []
    for choice in range(shards):
        for cell in sorted(counts):
            shard = prefer[cell][choice]
            n = min(counts[cell] - given[cell], room[shard] - used[shard])
            if n > 0:
                out.append((cell, given[cell], given[cell] + n, shard, used[shard]))
                given[cell] += n
                used[shard] += n
    return out


def cell_of(key: Column, cells: int = CELLS) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20), F.lit(cells)).cast("int")


def key_of() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text_of()))


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows (stored, with cell, key and __row) plus ``rank``, from 0 in each cell."""
    spark = rows.sparkSession
    order = ["key", "doc_id", "size", "text_crc32", "__row"]
    ranges = {c: -(-n // PART_ROWS) for c, n in counts.items() if n > PART_ROWS}
    if not ranges:
        return rows.withColumn("rank", (F.row_number().over(Window.partitionBy("cell").orderBy(*order)) - 1).cast("long"))
    sizes = F.broadcast(spark.createDataFrame(list(ranges.items()), "r_cell int, ranges int"))
    # equal ranges of the signed 64-bit keys, in their order
    at = F.floor((F.col("key") / F.lit(2.0**64) + F.lit(0.5)) * F.coalesce("ranges", F.lit(1))).cast("int")
    cut_up = rows.join(sizes, F.col("cell") == F.col("r_cell"), "left").withColumn("range", F.least(at, F.coalesce("ranges", F.lit(1)) - 1)).drop("r_cell", "ranges")
    full = cut(cut_up.groupBy("cell", "range").agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS).select(F.col("cell").alias("f_cell"), F.col("range").alias("f_range"), F.ceil(F.col("n") / PART_ROWS).cast("int").alias("deals")))
    cut_up = cut_up.join(full, (F.col("cell") == F.col("f_cell")) & (F.col("range") == F.col("f_range")), "left").drop("f_cell", "f_range")
    parts = cut(cut_up.withColumn("part", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("deals")), F.lit(0)).cast("int")).drop("deals"))
    before = Window.partitionBy("s_cell").orderBy("s_range", "s_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(F.col("cell").alias("s_cell"), F.col("range").alias("s_range"), F.col("part").alias("s_part")).agg(F.count("*").alias("n"))
    starts = cut(starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    own = F.row_number().over(Window.partitionBy("cell", "range", "part").orderBy(*order)) - 1
    found = parts.withColumn("own", own).join(starts, (F.col("cell") == F.col("s_cell")) & (F.col("range") == F.col("s_range")) & (F.col("part") == F.col("s_part")))
    return found.withColumn("rank", (F.col("start") + F.col("own")).cast("long")).drop("s_cell", "s_range", "s_part", "start", "own", "range", "part")


def assign(docs: DataFrame, shards: int = 8, *, per_shard: int = NODES, cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; slots of a shard are gapless from 0."""
    text = text_of().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), key_of().alias("key"))
    rows = cut(rows.withColumns({"cell": cell_of(F.col("key"), cells), "__row": F.monotonically_increasing_id()}))
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    table = F.broadcast(rows.sparkSession.createDataFrame(plan(counts, shards, per_shard=per_shard, cells=cells, slack=slack), "p_cell int, first long, after long, shard int, base long"))
    placed = ranked(rows, counts).join(table, F.expr("cell = p_cell AND rank >= first AND rank < after"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
