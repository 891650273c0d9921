"""Upload paths and manifests: validation, root archives, selection, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_null
from ..operators.skew import ranked_within, salted_lookup

# Limits of names shown, and of an archive folder's name.
SHOWN_NAMES = 3
SHOWN_ITEMS = 20
STEM_CHARS = 80

# Rows of a batch ranked together; larger batches are ranked in slices.
SLICE_ROWS = 10_000


def relative(path: Column) -> Column:
    """Forward slashes, no leading ones."""
    return F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "^/+", "")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(relative(path), "/"), lambda p: ~p.isin("", "."))


def normalized(path: Column) -> Column:
    return F.array_join(path_parts(path), "/")


def rejection(path: Column) -> Column:
    """Why a path is refused, null for a valid one."""
    rel, parts = relative(path), path_parts(path)
    return (
        F.when(rel == "", "empty")
        .when(rel.endswith("/"), "trailing slash")
        .when(F.size(parts) == 0, "empty")
        .when(F.array_contains(parts, ".."), "parent folder")
        .when(F.exists(parts, lambda p: F.contains(p, F.lit(":"))), "colon")
    )


def checked(files: DataFrame, path: str = "path") -> DataFrame:
    """Add the normalized path and the reason of refusal."""
    reason = rejection(F.col(path))
    return files.withColumns({"reason": reason, "target": F.when(reason.isNull(), normalized(F.col(path)))})


def split_valid(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(accepted files, quarantined files with their reason)."""
    judged = checked(files, path)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def is_zip(name: Column) -> Column:
    return F.lower(name).endswith(".zip")


def is_root_archive(path: Column) -> Column:
    rel = relative(path)
    return is_zip(rel) & ~F.contains(rel, F.lit("/"))


def safe_stem(path: Column) -> Column:
    """File name without .zip, odd characters as '_'; a name of dots only keeps its ending."""
    rel = relative(path)
    stem = F.when(rel.rlike(r"(?i)^\.+zip$"), rel).otherwise(F.regexp_replace(rel, r"(?i)\.zip$", ""))
    safe = F.substring(F.regexp_replace(stem, "[^A-Za-z0-9._-]", "_"), 1, STEM_CHARS)
    return F.coalesce(or_null(safe), F.lit("archive"))


def root_archives(files: DataFrame) -> DataFrame:
    """Root archives per batch and the folder each expands into.

    ``files``: batch_id, seq (position in the upload), path. One archive expands
    into the batch root; several get a folder each.
    """
    roots = files.filter(is_root_archive(F.col("path"))).select("batch_id", "seq", "path")
    counted = roots.groupBy("batch_id").agg(F.count(F.lit(1)).alias("archives"))
    prefix = F.concat(F.lit("zip_"), F.col("seq").cast("string"), F.lit("_"), safe_stem(F.col("path")))
    known = counted.withColumnRenamed("archives", "_rows")
    return salted_lookup(roots, counted, ["batch_id"], spread=["seq"], counted=known).withColumn(
        "folder", F.when(F.col("archives") > 1, prefix).otherwise("")
    )


def _in_order(df: DataFrame, rank: str, total: str) -> DataFrame:
    slice_no = F.floor(F.col("seq") / SLICE_ROWS)
    return ranked_within(df, ["batch_id"], ["seq"], [slice_no.alias("_b0")], rank=rank, total=total)


def select_files(files: DataFrame) -> DataFrame:
    """Files of an individual pick that are kept, with their upload path.

    ``files``: batch_id, seq, name, rel_path (nullable), size, mtime. The first
    .zip replaces everything else; otherwise only .txt files stay, each once per
    relative path, or per name, size and time without one.
    """
    kind = files.withColumns({"_zip": is_zip(F.col("name")), "_txt": F.lower("name").endswith(".txt")})
    first = kind.groupBy("batch_id").agg(F.min(F.when(F.col("_zip"), F.col("seq"))).alias("_first_zip"))
    judged = salted_lookup(kind, first, ["batch_id"], spread=["seq"])
    kept = judged.filter(
        F.when(F.col("_first_zip").isNotNull(), F.col("seq") == F.col("_first_zip")).otherwise(F.col("_txt"))
    )
    key = F.coalesce(
        or_null(F.col("rel_path")), F.concat_ws("::", "name", F.col("size").cast("string"), F.col("mtime").cast("string"))
    )
    unique = (
        kept.groupBy("batch_id", key.alias("file_key"))
        .agg(F.min_by(F.struct("seq", "name", "rel_path", "size", "_zip"), F.col("seq")).alias("f"))
        .select("batch_id", "file_key", "f.*")
    )
    numbered = _in_order(unique, "_rank", "files")
    own = F.when(F.col("_zip"), F.col("name")).otherwise(
        F.concat(F.lit("run_"), (F.col("_rank") - 1).cast("string"), F.lit("/"), F.col("name"))
    )
    return numbered.select(
        "batch_id", "seq", "name", "size", F.coalesce(or_null(F.col("rel_path")), own).alias("upload_path")
    )


def skipped_files(files: DataFrame) -> DataFrame:
    """Per batch: individually picked files refused for their ending, surplus archives."""
    name = F.col("name")
    zips = F.count_if(is_zip(name))
    other = F.count_if(~F.lower(name).endswith(".txt"))
    return files.groupBy("batch_id").agg(
        F.when(zips > 0, 0).otherwise(other).cast("long").alias("skipped"),
        F.greatest(zips - 1, F.lit(0)).cast("long").alias("surplus_archives"),
    )


def _listed(first: Column, total: Column) -> Column:
    more = F.when(total > SHOWN_NAMES, F.concat(F.lit("+ "), (total - SHOWN_NAMES).cast("string"), F.lit(" more")))
    return F.array_join(F.array_compact(F.concat(first, F.array(more))), ", ")


def _counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))


BATCH, FOLDER, NAME, FILE = range(4)


def _overview(files: DataFrame, most: int) -> DataFrame:
    """One row per batch, whatever its size: n, zip (any), folders and names (how many), roots (first folders), first (seq,
    name, path of the first ``most`` files) and repeated (names met there that the batch has again).

    Counts of batches, folders and names are one aggregation. Folders, names and files are then cut to the first of a
    batch in every task, before they meet; an earlier file of a shown name is always shown itself.
    """
    base = files.select("batch_id", "seq", "name", "path")
    root = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1))
    parts = [(BATCH, F.lit(None).cast("string")), (FOLDER, root), (NAME, F.col("name"))]
    part = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in parts)))
    groups = (
        base.select("batch_id", "seq", is_zip(F.col("path")).alias("zip"), part.alias("part"))
        .groupBy("batch_id", "part.kind", "part.value")
        # The kind again, as an aggregate: no filter on it goes below, so both uses of the groups share one shuffle.
        .agg(F.max("part.kind").alias("what"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.bool_or("zip").alias("zip"))
        .select("batch_id", "what", "value", "n", "seq", "zip", F.lit(None).cast("string").alias("path"))
    )
    what, is_folder = F.col("what"), (F.col("what") == FOLDER) & F.col("value").isNotNull()
    as_groups = {"what": F.lit(FILE), "value": F.col("name"), "n": F.lit(1).cast("long"), "zip": F.lit(False)}
    single = base.withColumns(as_groups).drop("name")
    candidates = groups.filter(is_folder | (what == NAME) & (F.col("n") > 1)).unionByName(single)
    in_batch = Window.partitionBy("batch_id", "what").orderBy("seq", "value", "path")
    shown = candidates.withColumn("rank", F.row_number().over(in_batch)).filter(F.col("rank") <= most)
    is_shown = F.col("rank").isNotNull()
    one = F.struct("rank", "seq", F.col("value").alias("name"), "path")
    listed = lambda kind: F.array_sort(F.collect_list(F.when(is_shown & (what == kind), one)))
    return groups.unionByName(shown, allowMissingColumns=True).groupBy("batch_id").agg(
        F.max(F.when(what == BATCH, F.col("n"))).alias("n"),
        F.bool_or(F.when(what == BATCH, F.col("zip"))).alias("zip"),
        F.count_if(~is_shown & is_folder).alias("folders"),
        F.count_if(~is_shown & (what == NAME)).alias("names"),
        F.transform(F.slice(listed(FOLDER), 1, SHOWN_NAMES), lambda x: x["name"]).alias("roots"),
        listed(FILE).alias("first"),
        F.collect_list(F.when(is_shown & (what == NAME), F.col("value"))).alias("repeated"),
    )


def manifest_summary(files: DataFrame) -> DataFrame:
    """Title and detail line per batch. ``files``: batch_id, seq, name, path."""
    seen = _overview(files, SHOWN_NAMES)
    n, m = F.col("n"), F.col("folders")
    paths = F.transform("first", lambda x: x["path"])
    single = (n == 1) & F.col("zip")
    title = (
        F.when(single, F.get(paths, F.lit(0)))
        .when(m > 0, _listed(F.col("roots"), m))
        .when(F.col("names") == 1, F.concat(F.get("first", F.lit(0))["name"], F.lit(" ×"), n.cast("string")))
        .otherwise(_listed(paths, n))
    )
    detail = (
        F.when(single, "ZIP archive ready")
        .when(m > 0, F.concat(_counted(n, "file"), F.lit(" selected from "), _counted(m, "folder")))
        .otherwise(F.concat(_counted(n, "file"), F.lit(" ready")))
    )
    return seen.select("batch_id", n.alias("files"), title.alias("title"), detail.alias("detail"))


def manifest_items(files: DataFrame) -> DataFrame:
    """What the list of a batch shows. ``files``: batch_id, seq, name, path.

    A single archive shows its path. Files of picked folders show the first
    folders and how many more there are. Other files show their names, equal ones
    numbered, and how many more there are.
    """
    seen = _overview(files, SHOWN_ITEMS)

    def numbered(x: Column, i: Column) -> Column:
        so_far = F.size(F.filter(F.slice("first", 1, i + 1), lambda y: y["name"] == x["name"]))
        again = F.array_contains("repeated", x["name"])
        return F.when(again, F.concat(x["name"], F.lit(" #"), so_far.cast("string"))).otherwise(x["name"])

    labels = (
        F.when((F.col("n") == 1) & F.col("zip"), F.transform("first", lambda x: x["path"]))
        .when(F.col("folders") > 0, _with_rest(F.col("roots"), F.col("folders"), SHOWN_NAMES))
        .otherwise(_with_rest(F.transform("first", numbered), F.col("n"), SHOWN_ITEMS))
    )
    return seen.select("batch_id", F.posexplode(labels).alias("_at", "label")).select(
        "batch_id", (F.col("_at") + 1).cast("long").alias("position"), "label"
    )


def _with_rest(shown: Column, total: Column, most: int) -> Column:
    """The labels and, if there are more, how many are left."""
    rest = F.concat(F.lit("+ "), (total - most).cast("string"), F.lit(" more"))
    return F.concat(shown, F.when(total > most, F.array(rest)).otherwise(F.array().cast("array<string>")))

