"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly over the shards.

Groups (equal texts) are the items; only a group that exceeds a shard's own share of some
total is split.  Large groups are whole too: they are few, and are given their shards first.
The other items are dealt to cells, each of which has an equal part of what is free of every shard; in a cell
they are taken in descending size and each goes to the shard where the dot product of its size
vector with the residual capacities is highest.  Items that are large for a cell, though not for a
shard, go first, and the small ones then fill what is really free, so that what the cells leave
uneven is of the size of their smallest items.  Only the cells' loads (cells x shards rows, both
bounded parameters) reach the driver.

Law: ``bytes``.  Defined cases: a null text has no bytes and is grouped with empty ones;
repeated rows are rows of one group; a null id is carried along; ties go to the lowest
bin; an empty table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_DIMENSIONS = ("size", "tokens", "rows")
_PLACED = "doc_id long, size long, text_crc32 long, tokens long, cell int, shard int, at long"
_PLACED_ARROW = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("tokens", pa.int64()),
                           ("cell", pa.int32()), ("shard", pa.int32()), ("at", pa.int64())])


def best_bin(item: np.ndarray, residual: np.ndarray) -> int:
    """The bin whose residual capacity has the highest dot product with the item."""
    return int(np.argmax(residual @ item))


def settle(groups: list[tuple], totals: np.ndarray, shards: int) -> tuple[dict[int, int], np.ndarray]:
    """Shard of each (group, size, tokens, rows), largest first, and what is then free of each shard's share."""
    room, out = np.ones((shards, 3)), {}
    scale = shards / np.maximum(totals, 1.0)
    for group, *sums in sorted(groups, key=lambda g: (-(np.array(g[1:]) * scale).max(), g[0])):
        item = np.array(sums) * scale
        out[group] = best_bin(item, room)
        room[out[group]] -= item
    return out, room


def _place(totals: np.ndarray, shards: int, room: np.ndarray):
    def run(batches):
        """Rows sorted by unit, units in descending size: all rows of a unit go to one shard.

        ``room`` is this cell's part of what is free of each shard; rows of a settled group go to its shard.
        """
        cell = TaskContext.get().partitionId()
        turn = (np.arange(shards) + cell) % shards         # equal residuals: cells begin at different shards
        residual = room[turn]
        used = np.zeros(shards, np.int64)
        scale = shards / np.maximum(totals, 1.0)
        open_unit, target = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group, salt, settled = (batch.column(c).to_numpy() for c in ("group", "salt", "settled"))
            sums = np.stack([batch.column("unit_" + d).to_numpy() for d in _DIMENSIONS], axis=1) * scale
            starts = np.concatenate([[0], np.flatnonzero((np.diff(group) != 0) | (np.diff(salt) != 0)) + 1])
            ends = np.append(starts[1:], n)
            shard, at = np.zeros(n, np.int32), np.zeros(n, np.int64)
            for a, b in zip(starts.tolist(), ends.tolist()):
                unit = (group[a], salt[a])
                if unit != open_unit:          # else it goes on from the batch before
                    open_unit = unit
                    if settled[a] >= 0:
                        target = int(settled[a])
                    else:
                        best = best_bin(sums[a], residual)
                        residual[best] -= sums[a]
                        target = int(turn[best])
                shard[a:b] = target
                at[a:b] = used[target] + np.arange(b - a)
                used[target] += b - a
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), batch.column("tokens"),
                 pa.array(np.full(n, cell, np.int32)), pa.array(shard), pa.array(at)], schema=_PLACED_ARROW)
    return run


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id",
                    overhead: int = 16, share: float = 1 / 64, cell_rows: int = 20_000,
                    most_cells: int = 4096) -> DataFrame:
    """Per row: doc_id, size, text_crc32, tokens, shard, slot (gapless from 0 in its shard).

    ``share``: a group with more than this part of a shard's share of any total is large; such groups
    number at most 3 * shards / share.  One that fits a shard's share gets one shard, one that
    exceeds it is split into items of that size.
    ``tokens`` counts white space characters plus one.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    blank = F.char_length(body) - F.char_length(F.translate(body, " \n\t\r", ""))
    rows = materialise(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(blank + 1, F.lit(0)).cast("long").alias("tokens"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("group"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")
    sums = [F.sum("size"), F.sum("tokens"), F.count("*")]
    total = rows.agg(*(s.cast("long").alias(d) for s, d in zip(sums, _DIMENSIONS))).first()
    totals = np.array([total[d] or 0 for d in _DIMENSIONS], dtype=np.float64)
    limit = np.maximum(totals * share / shards, 1.0)
    by_group = rows.groupBy("group").agg(*(s.alias(d) for s, d in zip(sums, _DIMENSIONS)))
    parts = F.ceil(F.greatest(*(F.col(d) / F.lit(float(x)) for d, x in zip(_DIMENSIONS, limit)))).cast("long")
    large = by_group.where("rows > 1").withColumn("parts", parts).where("parts > 1").collect()
    fitting = [(r["group"], *(r[d] for d in _DIMENSIONS)) for r in large if all(r[d] * shards <= t for d, t in zip(_DIMENSIONS, totals))]
    shard_of, room = settle(fitting, totals, shards)
    large = spark.createDataFrame([(r["group"], r["parts"], shard_of.get(r["group"], -1)) for r in large],
                                  "group long, parts long, settled int")
    # pmod by parts: a large group's rows over several tasks, also where its shard is settled
    rows = rows.join(F.broadcast(large), "group", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))).withColumn(
        "settled", F.coalesce("settled", F.lit(-1))).drop("parts")
    unit = Window.partitionBy("group", "salt")
    cells = int(min(most_cells, max(1, -(-int(totals[2]) // cell_rows))))
    weight = F.greatest(*(F.col("unit_" + d) / F.lit(float(max(x, 1.0))) for d, x in zip(_DIMENSIONS, totals)))
    sized = rows.repartition(cells, "group", "salt").select("*", *(
        s.over(unit).alias("unit_" + d) for s, d in zip(sums, _DIMENSIONS))).withColumn("weight", weight)
    steps = [sized]
    if cells > 1:
        # items over an eighth of a cell's share of a shard go first: the others can then even out what those leave
        sized = materialise(sized, "shard-sized")
        big = (F.col("weight") > 1 / (8 * shards * cells)) & (F.col("settled") < 0)
        steps = [sized.where(big).repartition(cells, "group", "salt"), sized.where(~big).repartition(cells, "group", "salt")]
    out, before = [], np.zeros(shards, np.int64)
    for step in steps:
        ordered = step.sortWithinPartitions(F.col("weight").desc(), "group", "salt", "row").drop("weight")
        placed = materialise(ordered.mapInArrow(_place(totals, shards, room / cells), _PLACED), "shard-placed")
        loads = placed.groupBy("cell", "shard").agg(F.count("*").alias("rows")).collect()
        begin = []
        for r in sorted(loads, key=lambda r: (r["shard"], r["cell"])):
            begin.append((r["cell"], r["shard"], int(before[r["shard"]])))
            before[r["shard"]] += r["rows"]
        first = spark.createDataFrame(begin, "cell int, shard int, before long")
        out.append(placed.join(F.broadcast(first), ["cell", "shard"]).select(
            "doc_id", "size", "text_crc32", "tokens", "shard", (F.col("before") + F.col("at")).alias("slot")))
        if step is not steps[-1]:
            for r in placed.groupBy("shard").agg(*(s.alias(d) for s, d in zip(sums, _DIMENSIONS))).collect():
                room[r["shard"]] -= np.array([r[d] for d in _DIMENSIONS]) * (shards / np.maximum(totals, 1.0))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
