"""Groups of any size dealt to tasks of bounded size: stars around leaders, pairs of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAR = 1024
#: Columns that name one task's work.
STARS = ["leader", "chunk"]
BLOCKS = ["name", "kind", "low", "high"]


def dealt_stars(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """leader, chunk, member, n and data: at most about ``STAR`` members of a leader, and the leader itself, per chunk."""
    chunks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / STAR).cast("int").alias("chunks"))
    placed = pairs.join(chunks, "leader").select(
        "leader", "member", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int").alias("chunk")
    )
    members = placed.join(data, "member").select("leader", "chunk", "member", "n", "data")
    heads = chunks.join(data.withColumnRenamed("member", "leader"), "leader").select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("leader").alias("member"), "n", "data"
    )
    return members.unionByName(heads)


def dealt_blocks(found: DataFrame, data: DataFrame, block: int, block_weight: int | None = None) -> DataFrame:
    """name, kind, low, high, own, member, root, n and data: the pairs of blocks of each group of ``found`` (name,
    member, root, main and, for ``block_weight``, weight).

    Members of the main root are dealt to inner blocks, others (all, if main is null) to outer ones. Kind 0 is a pair of
    outer blocks, kind 1 an outer (low) and an inner block (high): a member of the main root travels once per outer
    block, and two of them never meet.
    """
    sized = found.withColumn("outer", ~F.col("root").eqNullSafe(F.col("main")))

    def blocks(where):
        by_count = F.ceil(F.count_if(where) / block)
        if block_weight is None:
            return by_count.cast("int")
        heavy = F.sum(F.when(where, F.col("weight")).otherwise(0)) / block_weight
        return F.greatest(by_count, F.ceil(heavy)).cast("int")

    whole = sized.groupBy("name").agg(blocks(F.col("outer")).alias("outers"), blocks(~F.col("outer")).alias("inners"))
    spot = F.xxhash64("member", "name")
    placed = sized.join(whole, "name").select(
        "name", "member", "root", "outer", "outers", "inners",
        F.pmod(spot, F.when(F.col("outer"), F.col("outers")).otherwise(F.col("inners"))).cast("int").alias("own"),
    )

    def each(count: str):
        return F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))

    def pair(kind: int, low, high):
        return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))

    own = F.col("own")
    to_outer = F.transform(each("outers"), lambda o: pair(0, F.least(own, o), F.greatest(own, o)))
    to_inner = F.transform(each("inners"), lambda i: pair(1, own, i))
    from_inner = F.transform(each("outers"), lambda o: pair(1, o, own))
    pairs = F.when(F.col("outer"), F.concat(to_outer, to_inner)).otherwise(from_inner)
    rows = placed.join(data, "member").withColumn("pair", F.explode(pairs))
    return rows.select("name", "pair.kind", "pair.low", "pair.high", "outer", "own", "member", "root", "n", "data")


def sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first and the second block of a pair; the same for a block with itself."""
    kind, low, high = (rows.column(c)[0].as_py() for c in ("kind", "low", "high"))
    own, outer = rows.column("own").to_numpy(), rows.column("outer").to_numpy()
    if kind == 1:
        return np.flatnonzero(outer), np.flatnonzero(~outer)
    return np.flatnonzero(own == low), np.flatnonzero(own == high)
