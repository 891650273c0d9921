"""Connected components of links, and the ids that name them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aggregate_salted, freed, kept_table, salt_of


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m, the least of u and all its neighbours; a hot u is spread over salts."""
    least = aggregate_salted(edges, ["u"], ["v"], {"m": F.min("v")}, {"m": F.min("m")})
    return edges.withColumn("_salt", salt_of("v")).join(least, ["u", "_salt"]).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component for every node of the (a, b) links (stored)."""
    current = kept_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = fingerprint(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _least_neighbour(large)
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m"))
        before, current = current, kept_table(small.where("u <> v").distinct(), "edges")
        freed(before)
        after = fingerprint(current)
        if after == state:
            break
        state = after
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def named(rows: DataFrame, roots: DataFrame, spread: str) -> DataFrame:
    """``rows`` (class_key, doc_id and others) with ``component_id``, the smallest id that is not null of all rows whose
    classes have one root, and ``component_key``, that root (a class without a root in ``roots`` is its own). Rows
    without a class are their own component, with a null key. ``spread`` tells rows of a hot class apart.
    """
    filled = rows.where(F.col("class_key").isNotNull())
    per_class = kept_table(
        aggregate_salted(filled, ["class_key"], [spread], {"least": F.min("doc_id")}, {"least": F.min("least")}), "class-ids"
    )
    one = per_class.groupBy("class_key").agg(F.min("least").alias("least"))
    linked = roots.join(one, roots.node == one.class_key).select("node", "root", "least")
    least = aggregate_salted(linked, ["root"], ["node"], {"component": F.min("least")}, {"component": F.min("component")})
    of_node = (
        linked.withColumn("_salt", salt_of("node"))
        .join(least, ["root", "_salt"])
        .select(F.col("node").alias("class_key"), "root", "component")
    )
    per_class = per_class.join(of_node, "class_key", "left").select(
        "class_key", "_salt", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"),
        F.coalesce("root", "class_key").alias("component_key"),
    )
    return rows.withColumn("_salt", salt_of(spread)).join(per_class, ["class_key", "_salt"], "left").select(
        *rows.columns, F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "component_key"
    )
