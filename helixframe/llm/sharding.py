"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with u
hashed from the key and the child's name, and the smallest draw wins, so a child gets rows in
proportion to its weight. A draw depends on nothing but key, name and weight: where weights change,
rows only move between children of the nodes whose weights changed.

The law is ``key``: the key and the number of shards decide. Shards beyond a finished tree open a
region each, so one more shard leaves every other draw as it was and takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, saved


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. Weights of racks and regions are the sums of what they hold."""

    region: str
    rack: str
    index: int
    weight: float = 1.0


def tree(shards: int, racks: int = 3, per_rack: int = 4, finished: int = 24) -> list[Shard]:
    """``finished`` shards in regions of ``racks`` x ``per_rack``; each later shard opens a region of its own."""
    held = racks * per_rack
    return [Shard(f"g{i // held}", f"k{i % held // per_rack}", i) if i < finished else Shard(f"s{i}", "k0", i) for i in range(shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw with rate ``weight``, from 52 bits of md5(key : name)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _winner(key: Column, prefix: Column, level: list[tuple[str, float]]) -> Column:
    """The name of the child of ``prefix`` with the smallest draw (ties: the first by name)."""
    if len(level) == 1:
        return F.lit(level[0][0])
    return F.least(*(F.struct(_draw(F.concat(key, prefix), name, weight).alias("d"), F.lit(name).alias("n")) for name, weight in level))["n"]


def _descend(key: Column, path: Column, level: dict[str, list[tuple[str, float]]]) -> Column:
    """One level further down: ``path`` with the winner's name. Nodes with like children share an expression."""
    alike: dict[tuple, list[str]] = {}
    for parent, below in level.items():
        alike.setdefault(tuple(sorted(below)), []).append(parent)
    out = None
    for below, parents in alike.items():
        won = _winner(key, path, list(below))
        out = won if out is None else F.when(path.isin(parents), won).otherwise(out)
    return F.concat(path, F.lit("/"), out)


def with_shard(df: DataFrame, key: str, leaves: list[Shard], name: str) -> DataFrame:
    """Adds the shard index of ``key`` (any castable column; null counts as a key of its own) as ``name``."""
    hashed = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    totals: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    at: dict[str, int] = {}
    places: dict[str, int] = {}
    for leaf in (x for x in leaves if x.weight > 0):
        rack = f"/{leaf.region}/{leaf.rack}"
        place = str(places.setdefault(rack, -1) + 1)
        places[rack] += 1
        at[f"{rack}/{place}"] = leaf.index
        for level, parent, child in ((0, "", leaf.region), (1, f"/{leaf.region}", leaf.rack), (2, rack, place)):
            below = totals[level].setdefault(parent, {})
            below[child] = below.get(child, 0.0) + leaf.weight
    path = free_name(df, "_path")
    out = df.withColumn(path, F.lit(""))
    for level in totals:
        out = out.withColumn(path, _descend(hashed, F.col(path), {parent: list(below.items()) for parent, below in level.items()}))
    index = F.create_map(*(F.lit(x) for pair in at.items() for x in pair))
    return out.withColumn(name, F.element_at(index, F.col(path)).cast("int")).drop(path)


def assign_shards(df: DataFrame, key: str, leaves: list[Shard], grown: list[Shard], chunk: int = 50_000) -> DataFrame:
    """Adds ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard`` and ``law`` to every row.

    Slots count in two levels: row number within a bounded run of rows of one input partition, plus
    the rows of the shard in the runs before it. No task sees a whole shard, however hot its key.
    Runs refer to row positions, so the rows are first written to the shared folder once; pass the
    columns that are needed rather than whole texts.

    Null keys share a draw of their own. Repeated rows go to one shard and get a slot each. An empty
    input gives no rows. Input columns whose names clash with added ones keep them; the added column
    then ends in an underscore.
    """
    names = {k: free_name(df, k) for k in ("shard", "slot", "grown_shard", "law", "_run", "_at", "_before")}
    shard, slot, run, at, before = (names[k] for k in ("shard", "slot", "_run", "_at", "_before"))
    placed = with_shard(with_shard(df, key, leaves, shard), key, grown, names["grown_shard"])
    placed = placed.withColumns({names["law"]: F.lit("key"), at: F.monotonically_increasing_id()})
    placed = saved(placed.withColumn(run, F.floor(F.col(at) / F.lit(chunk))))
    sizes = placed.groupBy(shard, run).agg(F.count("*").alias(slot))
    earlier = Window.partitionBy(shard).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, run, F.coalesce(F.sum(slot).over(earlier), F.lit(0)).alias(before))
    numbered = placed.withColumn(slot, F.row_number().over(Window.partitionBy(shard, run).orderBy(at)).cast("long") - 1)
    out = numbered.join(starts, [shard, run]).withColumn(slot, F.col(slot) + F.col(before))
    return out.select(*df.columns, names["law"], shard, slot, names["grown_shard"])
