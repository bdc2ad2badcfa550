"""Filling containers of fixed capacity by hierarchical residual packing.

Items are cut only above the capacity. Each round deals the open bins (at first: single items) over groups of bounded
size, packs every group best-fit decreasing, emits bins that are nearly full and hands the underfull ones, now items
themselves, to the next round with fewer groups. The last round has one group of bounded size, or rounds end when one
more no longer saves bins.
"""

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolmill.sources.tables import cut

GROUP = 20_000
#: Most container kinds: their table is a short list of settings.
KINDS = 1000
FULL = 0.995
MEMBERS = "array<struct<item:bigint,part:int,size:int>>"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, best fit decreasing: the open bin with the least room that still suffices."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    room: list[tuple[int, int]] = []
    count = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, count = capacity, count, count + 1
        bins[i] = b
        if left > s:
            insort(room, (left - s, b))
    return bins


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    bins = best_fit(pdf["fill"].to_numpy(), capacity)
    order = np.argsort(bins, kind="stable")
    starts = np.searchsorted(bins[order], np.arange(bins.max() + 1))
    fill = np.add.reduceat(pdf["fill"].to_numpy()[order], starts)
    ids, members = pdf["bin_id"].to_numpy()[order], pdf["members"].to_numpy()[order]
    cuts = [*starts.tolist(), len(order)]
    least = [min(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
    held = [[m for ms in members[a:b] for m in ms] for a, b in zip(cuts, cuts[1:])]
    return pd.DataFrame({"container": pdf["container"].iloc[0], "capacity": capacity, "bin_id": least, "fill": fill, "members": held})


def pack(items: DataFrame, containers: DataFrame, group: int = GROUP, full: float = FULL) -> DataFrame:
    """(container, capacity, bin_id, item, part, start, size) for items(item, size) and containers(container, capacity).

    An item above the capacity is cut into parts of the full capacity and a rest; ``start`` is the part's offset in the
    item. Items of size 0 or null take no room and lie in the container's first bin, which is made if there is none.
    Containers with a null or non-positive capacity are dropped. Empty inputs give no rows. Ties fall by bin_id, which
    is unique within a container: the smallest packed part's key.
    """
    caps = containers.select("container", F.col("capacity").cast("int").alias("capacity")).filter("capacity > 0")
    sized = items.select(F.col("item").cast("bigint").alias("item"), F.coalesce(F.col("size"), F.lit(0)).cast("int").alias("size"))
    kinds = caps.limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    if not kinds:
        return sized.select(F.lit("").alias("container"), F.lit(0).alias("capacity"), F.lit("").alias("bin_id"), "item", F.lit(0).alias("part"), F.lit(0).alias("start"), "size").filter("false")
    each = F.explode(F.array(*[F.struct(F.lit(r["container"]).alias("container"), F.lit(r["capacity"]).alias("capacity")) for r in kinds]))
    pairs = sized.select("item", "size", each.alias("c")).select("item", "size", "c.container", "c.capacity")
    parts = pairs.filter("size > 0").select(
        "container", "capacity", "item",
        F.posexplode(F.expr("transform(sequence(0, size - 1, capacity), s -> struct(s as start, least(capacity, size - s) as size))")).alias("part", "p"),
    ).select("container", "capacity", "item", "part", F.col("p.size").alias("size"))
    level = parts.select(
        "container", "capacity",
        F.concat_ws(":", "container", "item", "part").alias("bin_id"),
        F.col("size").alias("fill"),
        F.array(F.struct("item", "part", "size")).alias("members"),
    )
    closed = level.filter(F.col("fill") >= F.col("capacity") * full)
    level = cut(level.filter(F.col("fill") < F.col("capacity") * full))
    schema = f"container string, capacity int, bin_id string, fill int, members {MEMBERS}"
    count = level.count()
    while count:
        groups = -(-count // (group * 1))
        packed = cut(
            level.withColumn("_g", F.pmod(F.xxhash64("bin_id"), F.lit(groups)))
            .groupBy("container", "_g")
            .applyInPandas(lambda pdf: _pack(pdf), schema)
        )
        level = packed.filter(F.col("fill") < F.col("capacity") * full)
        left = level.count()
        # emit what is nearly full; the rest are the next round's items
        if groups == 1 or left > 0.98 * count:
            closed = closed.unionByName(packed)
            break
        closed = closed.unionByName(packed.filter(F.col("fill") >= F.col("capacity") * full))
        count = left
    placed = closed.select("container", "capacity", "bin_id", F.explode("members").alias("m")).select(
        "container", "capacity", "bin_id", F.col("m.item").alias("item"), F.col("m.part").alias("part"),
        (F.col("m.part") * F.col("capacity")).alias("start"), F.col("m.size").alias("size"),
    )
    first = closed.groupBy("container").agg(F.min("bin_id").alias("bin_id"))
    empty = (
        pairs.filter("size <= 0").join(F.broadcast(first), "container", "left")
        .select("container", "capacity", F.coalesce("bin_id", F.concat_ws(":", "container", F.lit("empty"))).alias("bin_id"), "item", F.lit(0).alias("part"), F.lit(0).alias("start"), F.lit(0).alias("size"))
    )
    return placed.unionByName(empty)
