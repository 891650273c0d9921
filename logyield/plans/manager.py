"""The manager tables together, over two passes of the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import yields
from ..schema import FAIL, PASS
from ..session import stored


def manager_view(runs: DataFrame, top: int = yields.PARETO_TOP) -> dict[str, DataFrame]:
    """The five manager tables from two scans of the runs: the summary's, and one that counts days, stations, lots and
    failure labels together. Those counts are stored, as four tables read them."""
    counts = stored(bucket_counts(runs), "buckets")

    def section(name: str, label: str, *columns: str) -> DataFrame:
        rows = counts.filter(F.col("section") == name).withColumn("total", F.col("pass") + F.col("fail"))
        return rows.select(F.col("label").alias(label), *columns).orderBy(label)

    labels = counts.filter(F.col("section") == "pareto").select(F.col("label").alias("reason"), "fail")
    ranked = labels.rollup("reason").agg(F.coalesce(F.sum("fail"), F.lit(0)).alias("count"), F.grouping("reason").alias("is_total"))
    return {
        "summary": yields.manager_summary(runs),
        "trend": section("trend", "date", "pass", "fail", "yield"),
        "pareto": yields.ranked_shares(ranked, top),
        "stations": section("stations", "station", "pass", "fail", "total", "yield"),
        "lots": section("lots", "lot", "pass", "fail", "total", "yield"),
    }


def bucket_counts(runs: DataFrame) -> DataFrame:
    """Daily, station, lot and failure-label counts from a single scan.

    Grouping sets count all four in one aggregation, which pays when producing
    the runs costs more than repeating each row four times in the map side.
    """
    failed = F.col("result") == FAIL
    keyed = runs.filter(F.col("result").isin(PASS, FAIL)).select(
        yields.day().alias("date"),
        yields.station_label().alias("station"),
        yields.lot_label().alias("lot"),
        F.when(failed, yields.failure_label()).alias("reason"),
        "result",
    )
    names = ["date", "station", "lot", "reason"]
    counted = keyed.groupingSets([[n] for n in names], *names).agg(
        F.grouping_id().alias("_set"),
        F.count_if(F.col("result") == PASS).alias("pass"),
        F.count_if(failed).alias("fail"),
    )
    # The bit of the one grouped column is 0 in grouping_id.
    section = F.when(F.col("_set") == 7, "trend").when(F.col("_set") == 11, "stations").when(F.col("_set") == 13, "lots")
    total = F.col("pass") + F.col("fail")
    return (
        counted.withColumns({"section": section.otherwise("pareto"), "label": F.coalesce(*names)})
        .filter(F.col("label").isNotNull())
        .select(
            "section",
            "label",
            F.when(F.col("section") != "pareto", F.col("pass")).alias("pass"),
            "fail",
            F.when(F.col("section") != "pareto", yields.percent(F.col("pass"), total)).alias("yield"),
        )
    )
