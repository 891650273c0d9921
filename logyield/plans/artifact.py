"""Per-product JSON: unit lines, summary documents and their sizes.

A product may own most of the runs, so its units are JSON lines spread over as
many files as their size needs, beside one small summary document per product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redaction import redact
from ..functions.text import cap, or_null
from ..operators.attempts import latest_runs
from ..operators.yields import product_summary
from ..schema import FAIL

# Document version, snippet size, field names and order of a unit.
SCHEMA_VERSION = 2
SNIPPET_BUDGET = 2000
FAIL_FIELDS = (
    "unit_id", "serial_number", "result", "op_id", "station_id", "host", "lot_id", "start_time", "end_time",
    "duration_s", "steps", "error_code", "error_message", "failing_step", "ftrunner_snippet", "debug_excerpt",
)
OTHER_FIELDS = (
    "serial_number", "result", "op_id", "station_id", "host", "lot_id", "start_time", "end_time", "duration_s",
)
HEAVY_FIELDS = ("steps", "debug_excerpt", "ftrunner_snippet", "error_message")
RUN_COLUMNS = tuple(dict.fromkeys([*FAIL_FIELDS, "product_code", "run_folder"]))


def iso(ts: Column) -> Column:
    return F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))


def unit_rows(runs: DataFrame, compact: bool = True, mask_host: bool = False) -> DataFrame:
    """Latest run of each unit per product, with the fields as they are written."""
    product = F.coalesce(or_null(F.col("product_code")), F.lit("UNKNOWN"))
    columns = [c for c in RUN_COLUMNS if c in runs.columns]
    latest = latest_runs(runs, columns, within=[product.alias("product")])
    snippet = or_null(redact(F.col("ftrunner_snippet"), keep_serial=True))
    shown = latest.withColumns(
        {
            "start_time": iso(F.col("start_time")),
            "end_time": iso(F.col("end_time")),
            "error_message": or_null(redact(F.col("error_message"), keep_serial=True)),
            "ftrunner_snippet": cap(snippet, SNIPPET_BUDGET) if compact else snippet,
        }
    )
    if mask_host:
        shown = shown.withColumn("host", F.when(F.col("host").isNotNull(), "[REDACTED_HOST]"))
    if compact:
        texts = [f for f, t in shown.dtypes if t == "string" and f not in ("product", "unit_key")]
        shown = shown.withColumns({f: or_null(F.col(f)) for f in texts})
        shown = shown.withColumn("steps", F.when(F.size("steps") > 0, F.col("steps")))
    return shown


def unit_json(compact: bool = True, pretty: bool = False) -> Column:
    """JSON of one unit: failing units in full, others short; compact leaves empty fields out."""
    options = {"ignoreNullFields": str(compact).lower(), "pretty": str(pretty).lower()}
    full = [F.col(f) for f in FAIL_FIELDS]
    if not compact:
        full += [F.lit("").alias("root_cause"), F.lit("").alias("suggested_solution")]
    short = [F.col(f) for f in OTHER_FIELDS]
    return F.when(F.col("result") == FAIL, F.to_json(F.struct(*full), options)).otherwise(
        F.to_json(F.struct(*short), options)
    )


# Between pretty documents; inside one no line is empty.
PRETTY_END = "\n\n"


def file_name(product: Column) -> Column:
    """A name for the product's files; one that had to be changed keeps a mark of the original."""
    plain = F.regexp_replace(product, "[^A-Za-z0-9._-]", "_")
    return F.when(plain == product, plain).otherwise(F.concat(plain, F.lit("-"), F.substring(F.sha1(product), 1, 8)))


def summary_json(runs: DataFrame, generated_at: Column, warnings: Column | None = None) -> DataFrame:
    """(product, doc): everything of a product document except its units."""
    s = product_summary(runs)
    numbers = F.struct(
        "total", "pass", "fail", "unknown", F.col("final_yield").alias("fpy"), "run_count", "retests"
    )
    doc = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("product_code"),
        F.concat(iso(generated_at), F.lit("Z")).alias("generated_at"),
        numbers.alias("summary"),
        (F.array().cast("array<string>") if warnings is None else warnings).alias("warnings"),
    )
    return s.select(F.col("product_code").alias("product"), F.to_json(doc).alias("doc"))


def write_artifact(
    runs: DataFrame,
    path: str,
    generated_at: Column,
    compact: bool = True,
    pretty: bool = False,
    gzip: bool = False,
    warnings: Column | None = None,
) -> None:
    """Write ``path``/units and ``path``/summary, partitioned by product file name.

    The rebalance hint lets AQE split a large product over files and merge small
    ones, so the number of files follows the data. Pretty units take several lines
    and end with an empty one. ``warnings``: an array of texts for the summaries.
    """
    options = {"compression": "gzip" if gzip else "none"}
    ends = {"lineSep": PRETTY_END} if pretty else {}
    units = unit_rows(runs, compact).select(file_name(F.col("product")).alias("product"), unit_json(compact, pretty).alias("value"))
    units.hint("rebalance", "product").write.options(**options, **ends).partitionBy("product").mode("errorifexists").text(
        f"{path}/units"
    )
    docs = summary_json(runs, generated_at, warnings).select(file_name(F.col("product")).alias("product"), F.col("doc").alias("value"))
    docs.write.options(**options).partitionBy("product").mode("errorifexists").text(f"{path}/summary")


def read_units(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    reader = spark.read.schema("value string, product string")
    return (reader.option("lineSep", PRETTY_END) if pretty else reader).text(f"{path}/units")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, product string").text(f"{path}/summary")


def written_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes on disk per product, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/units")
    product = F.regexp_extract("path", "product=([^/]*)/", 1)
    return files.groupBy(product.alias("product")).agg(F.sum("length").alias("bytes"))


def size_report(runs: DataFrame) -> DataFrame:
    """Per product: bytes of the compact and the pretty form and of the heavy fields."""
    rows = unit_rows(runs)
    size = lambda c: F.octet_length(c).cast("long")
    failed = F.col("result") == FAIL
    field = {
        f: F.coalesce(F.when(failed & F.col(f).isNotNull(), size(F.to_json(F.struct(F.col(f))))), F.lit(0))
        for f in HEAVY_FIELDS
    }
    total = lambda c: F.sum(c)
    per_product = rows.groupBy("product").agg(
        F.count(F.lit(1)).alias("units"),
        total(size(unit_json())).alias("compact_bytes"),
        total(size(unit_json(pretty=True))).alias("pretty_bytes"),
        *[total(c).alias(f"{f}_bytes") for f, c in field.items()],
    )
    share = lambda part, whole: F.bround(F.col(part) / F.col(whole), 4)
    return per_product.withColumns(
        {
            "compact_share": share("compact_bytes", "pretty_bytes"),
            **{f"{f}_share": share(f"{f}_bytes", "compact_bytes") for f in HEAVY_FIELDS},
        }
    )
