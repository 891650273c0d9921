"""Paths, manifests, folders, archives, artifacts and batch tables derived from the sample tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import yields
from ..plans import artifact, ingest, manager, parse
from ..session import new_table_path
from ..sources import archives, batches, folders, paths, proxies
from .registry import query
from .sql import FAILURES, KEEP_SERIAL, KEY, RUNS, SNIPPET, redact_sql
from .parsing import LINE_COLUMNS, LOGGED
from .yields import DAILY, LABEL, LOT, PASS_FAIL, PRODUCT, STATION, SUMMARY, grouped, pareto

# --- upload paths -------------------------------------------------------------
UPLOADS = r"""uploads AS (SELECT 'b' || (page_id % 5) AS batch_id, page_id AS seq, CASE page_id % 9
    WHEN 0 THEN '/' || p WHEN 1 THEN replace(p, '/', '\') WHEN 2 THEN '../' || p WHEN 3 THEN 'C:/' || p
    WHEN 4 THEN replace(p, '/', ' ') || '.ZIP' WHEN 5 THEN p || '/' WHEN 6 THEN './.' WHEN 7 THEN '' ELSE './' || p END AS path
  FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages))"""
CLEAN = f"""{UPLOADS}, c AS (SELECT *, regexp_replace(replace(path, '\\', '/'), '^/+', '') AS rel FROM uploads),
parts AS (SELECT *, list_filter(string_split(rel, '/'), lambda x: x <> '' AND x <> '.') AS ps FROM c),
judged AS (SELECT *, CASE WHEN rel = '' THEN 'empty' WHEN rel LIKE '%/' THEN 'trailing slash' WHEN len(ps) = 0 THEN 'empty'
    WHEN list_contains(ps, '..') THEN 'parent folder' WHEN len(list_filter(ps, lambda x: contains(x, ':'))) > 0 THEN 'colon' END AS reason
  FROM parts)"""


def uploads(spark, sf_dir):
    i = F.col("page_id")
    p = F.regexp_replace("url", "^https?://", "")
    case = i % 9
    path = (
        F.when(case == 0, F.concat(F.lit("/"), p))
        .when(case == 1, F.replace(p, F.lit("/"), F.lit("\\")))
        .when(case == 2, F.concat(F.lit("../"), p))
        .when(case == 3, F.concat(F.lit("C:/"), p))
        .when(case == 4, F.concat(F.replace(p, F.lit("/"), F.lit(" ")), F.lit(".ZIP")))
        .when(case == 5, F.concat(p, F.lit("/")))
        .when(case == 6, "./.")
        .when(case == 7, "")
        .otherwise(F.concat(F.lit("./"), p))
    )
    pages = proxies.table(spark, sf_dir, "pages")
    return pages.select(F.concat(F.lit("b"), (i % 5).cast("string")).alias("batch_id"), i.alias("seq"), path.alias("path"))


@query(
    "path_check",
    f"WITH {CLEAN} SELECT seq, reason, CASE WHEN reason IS NULL THEN array_to_string(ps, '/') END AS target FROM judged",
)
def path_check(spark, sf_dir):
    return paths.checked(uploads(spark, sf_dir)).select("seq", "reason", "target")


@query("rejected_paths", f"WITH {CLEAN} SELECT seq, reason FROM judged WHERE reason IS NOT NULL")
def rejected_paths(spark, sf_dir):
    return paths.split_valid(uploads(spark, sf_dir))[1].select("seq", "reason")


@query(
    "root_archives",
    f"""WITH {CLEAN}, r AS (SELECT batch_id, seq, path, rel, count(*) OVER (PARTITION BY batch_id) AS archives FROM judged
      WHERE lower(rel) LIKE '%.zip' AND NOT contains(rel, '/'))
    SELECT batch_id, seq, path, archives, CASE WHEN archives > 1 THEN 'zip_' || seq || '_' ||
      coalesce(nullif(left(regexp_replace(regexp_replace(rel, '(?i)\\.zip$', ''), '[^A-Za-z0-9._-]', '_', 'g'), 80), ''), 'archive')
      ELSE '' END AS folder FROM r""",
)
def root_archives(spark, sf_dir):
    return paths.root_archives(uploads(spark, sf_dir))


# --- manifests ----------------------------------------------------------------
PICKED = """picked AS (SELECT 'b' || (event_id % 97) AS batch_id, event_id AS seq,
    CASE WHEN event_id % 97 < 5 AND event_id % 11 = 0 THEN 'logs' || event_id || '.zip' WHEN event_id % 6 = 0 THEN 'note.md'
      ELSE 'ftrunnerlog' || (event_id % 4) || '.TXT' END AS name,
    CASE WHEN event_id % 97 BETWEEN 10 AND 20 THEN 'run' || (event_id % 3) || '/log.txt' WHEN event_id % 97 = 21 THEN '' END AS rel_path,
    user_id AS size, event_id % 5 AS mtime FROM events)"""


def picked(spark, sf_dir):
    e = F.col("event_id")
    b = e % 97
    text = lambda c: c.cast("string")
    name = (
        F.when((b < 5) & (e % 11 == 0), F.concat(F.lit("logs"), text(e), F.lit(".zip")))
        .when(e % 6 == 0, "note.md")
        .otherwise(F.concat(F.lit("ftrunnerlog"), text(e % 4), F.lit(".TXT")))
    )
    rel = F.when(b.between(10, 20), F.concat(F.lit("run"), text(e % 3), F.lit("/log.txt"))).when(b == 21, "")
    return proxies.table(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), text(b)).alias("batch_id"),
        e.alias("seq"),
        name.alias("name"),
        rel.alias("rel_path"),
        F.col("user_id").alias("size"),
        (e % 5).alias("mtime"),
    )


@query(
    "manifest_selection",
    f"""WITH {PICKED}, z AS (SELECT *, min(CASE WHEN lower(name) LIKE '%.zip' THEN seq END) OVER (PARTITION BY batch_id) AS fz FROM picked),
    k AS (SELECT *, coalesce(nullif(rel_path, ''), name || '::' || size || '::' || mtime) AS file_key FROM z
      WHERE CASE WHEN fz IS NOT NULL THEN seq = fz ELSE lower(name) LIKE '%.txt' END),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, file_key ORDER BY seq) AS rn FROM k) WHERE rn = 1)
    SELECT batch_id, seq, name, size, coalesce(nullif(rel_path, ''), CASE WHEN lower(name) LIKE '%.zip' THEN name
      ELSE 'run_' || (row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1) || '/' || name END) AS upload_path FROM u""",
)
def manifest_selection(spark, sf_dir):
    return paths.select_files(picked(spark, sf_dir))


@query(
    "manifest_skipped",
    f"""WITH {PICKED}, c AS (SELECT batch_id, count(*) FILTER (WHERE lower(name) LIKE '%.zip') AS z,
      count(*) FILTER (WHERE lower(name) NOT LIKE '%.txt') AS o FROM picked GROUP BY 1)
    SELECT batch_id, CASE WHEN z > 0 THEN 0 ELSE o END AS skipped, greatest(z - 1, 0) AS surplus_archives FROM c""",
)
def manifest_skipped(spark, sf_dir):
    return paths.skipped_files(picked(spark, sf_dir))


# Every file is in a batch: of many files, loose or in folders, or, from number 90 on, of its own.
LISTED = f"""{PICKED}, listed AS (SELECT CASE WHEN n < 90 THEN batch_id ELSE batch_id || '-' || seq END AS batch_id, seq, name,
    CASE WHEN n % 2 = 0 THEN name ELSE 'top' || (seq % 5) || '/' || name END AS path
    FROM (SELECT *, CAST(substr(batch_id, 2) AS INTEGER) AS n FROM picked))"""


def listed(spark, sf_dir):
    number = F.substring("batch_id", 2, 9).cast("int")
    own = F.concat_ws("-", "batch_id", F.col("seq").cast("string"))
    in_folder = F.concat(F.lit("top"), (F.col("seq") % 5).cast("string"), F.lit("/"), F.col("name"))
    return picked(spark, sf_dir).select(
        F.when(number < 90, F.col("batch_id")).otherwise(own).alias("batch_id"),
        "seq",
        "name",
        F.when(number % 2 == 0, F.col("name")).otherwise(in_folder).alias("path"),
    )


@query(
    "manifest_summary",
    f"""WITH {LISTED}, n AS (SELECT batch_id, count(*) AS files, count(DISTINCT name) AS names, min(name) AS nm,
      bool_or(lower(path) LIKE '%.zip') AS z, list(path ORDER BY seq) AS ps FROM listed GROUP BY 1),
    r AS (SELECT batch_id, string_split(path, '/')[1] AS root, min(seq) AS s FROM listed WHERE contains(path, '/') GROUP BY 1, 2),
    f AS (SELECT batch_id, count(*) AS folders, list(root ORDER BY s) AS rs FROM r GROUP BY 1)
    SELECT batch_id, files, CASE WHEN files = 1 AND z THEN ps[1]
      WHEN folders IS NOT NULL THEN array_to_string(rs[1:3], ', ') || CASE WHEN folders > 3 THEN ', + ' || (folders - 3) || ' more' ELSE '' END
      WHEN names = 1 THEN nm || ' ×' || files
      ELSE array_to_string(ps[1:3], ', ') || CASE WHEN files > 3 THEN ', + ' || (files - 3) || ' more' ELSE '' END END AS title,
    CASE WHEN files = 1 AND z THEN 'ZIP archive ready' ELSE files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END ||
      CASE WHEN folders IS NOT NULL THEN ' selected from ' || folders || CASE WHEN folders = 1 THEN ' folder' ELSE ' folders' END
      ELSE ' ready' END END AS detail FROM n LEFT JOIN f USING (batch_id)""",
)
def manifest_summary(spark, sf_dir):
    return paths.manifest_summary(listed(spark, sf_dir))


@query(
    "manifest_items",
    f"""WITH {LISTED}, b AS (SELECT batch_id, count(*) AS files, bool_or(contains(path, '/')) AS in_folders,
      count(*) = 1 AND bool_or(lower(path) LIKE '%.zip') AS single, min(path) AS path FROM listed GROUP BY 1),
    r AS (SELECT batch_id, root, row_number() OVER (PARTITION BY batch_id ORDER BY s) AS position,
        count(*) OVER (PARTITION BY batch_id) AS folders
      FROM (SELECT batch_id, string_split(path, '/')[1] AS root, min(seq) AS s FROM listed WHERE contains(path, '/') GROUP BY 1, 2)),
    l AS (SELECT listed.*, files, row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS position,
        row_number() OVER (PARTITION BY batch_id, name ORDER BY seq) AS nth, count(*) OVER (PARTITION BY batch_id, name) AS same
      FROM listed JOIN b USING (batch_id) WHERE NOT single AND NOT in_folders)
    SELECT batch_id, 1 AS position, path AS label FROM b WHERE single
    UNION ALL SELECT batch_id, position, CASE WHEN position > 3 THEN '+ ' || (folders - 3) || ' more' ELSE root END
      FROM r JOIN b USING (batch_id) WHERE NOT single AND position <= 4
    UNION ALL SELECT batch_id, position, CASE WHEN position > 20 THEN '+ ' || (files - 20) || ' more'
      WHEN same > 1 THEN name || ' #' || nth ELSE name END FROM l WHERE position <= 21""".replace("1 AS position", "CAST(1 AS BIGINT) AS position"),
)
def manifest_items(spark, sf_dir):
    return paths.manifest_items(listed(spark, sf_dir))


# --- folders ------------------------------------------------------------------
TREE = """tree AS (SELECT CASE WHEN event_id % 23 = 0 THEN 'day/_tool_extracted' ELSE 'day' || (user_id % 7) || '/run' || (event_id // 4) END AS run_folder,
    CASE event_id % 8 WHEN 0 THEN 'FTRunnerLog01.txt' WHEN 1 THEN 'my_ftrunner.TXT' WHEN 2 THEN 'DebugLog.txt' WHEN 3 THEN 'ftrunner.csv'
      WHEN 4 THEN 'trace' || event_id || '.zip' ELSE 'notes' || event_id || '.txt' END AS file_name,
    CASE WHEN event_id % 8 = 4 THEN CASE WHEN user_id % 2 = 0 THEN ['a.txt', 'Seq 1/XDebugLog.TXT'] ELSE ['a.txt'] END END AS members FROM events)"""
SCRATCH = ("_tool_extracted",)
IS_LOG = "(lower(file_name) LIKE '%.txt' AND contains(lower(file_name), 'ftrunner'))"


def tree(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    kind = e % 8
    folder = F.concat(F.lit("day"), text(u % 7), F.lit("/run"), text(F.floor(e / 4)))
    name = (
        F.when(kind == 0, "FTRunnerLog01.txt")
        .when(kind == 1, "my_ftrunner.TXT")
        .when(kind == 2, "DebugLog.txt")
        .when(kind == 3, "ftrunner.csv")
        .when(kind == 4, F.concat(F.lit("trace"), text(e), F.lit(".zip")))
        .otherwise(F.concat(F.lit("notes"), text(e), F.lit(".txt")))
    )
    plain, debug = F.lit(["a.txt"]), F.lit(["a.txt", "Seq 1/XDebugLog.TXT"])
    return proxies.table(spark, sf_dir, "events").select(
        F.when(e % 23 == 0, "day/_tool_extracted").otherwise(folder).alias("run_folder"),
        name.alias("file_name"),
        F.when(kind == 4, F.when(u % 2 == 0, debug).otherwise(plain)).alias("members"),
    )


@query(
    "run_folders",
    f"""WITH {TREE} SELECT run_folder, min(file_name) AS file_name, count(*) AS logs FROM tree
    WHERE {IS_LOG} AND NOT list_contains(string_split(run_folder, '/'), '_tool_extracted') GROUP BY 1""",
)
def run_folders(spark, sf_dir):
    return folders.run_folders(folders.without_folders(tree(spark, sf_dir), SCRATCH))


@query(
    "incomplete_folders",
    f"""WITH {TREE} SELECT run_folder, 'No ftrunnerlog01.txt or debuglog.txt found in: ' || run_folder AS warning FROM tree
    WHERE NOT list_contains(string_split(run_folder, '/'), '_tool_extracted') GROUP BY 1 HAVING NOT bool_or({IS_LOG} OR lower(file_name) = 'debuglog.txt'
      OR (lower(file_name) LIKE '%.zip' AND coalesce(len(members), 0) > 1))""",
)
def incomplete_folders(spark, sf_dir):
    return folders.incomplete_folders(folders.without_folders(tree(spark, sf_dir), SCRATCH))


@query("decode_logs", "SELECT doc_id, text FROM documents")
def decode_logs(spark, sf_dir):
    # A stray byte that is never valid in UTF-8 goes between two copies' halves.
    raw = F.concat(F.lit(bytearray(b"\xff")), F.encode("text", "UTF-8"), F.lit(bytearray(b"\xfe")))
    content = F.when(F.col("doc_id") % 3 == 0, raw).otherwise(F.encode("text", "UTF-8"))
    docs = proxies.table(spark, sf_dir, "documents")
    return docs.select("doc_id", folders.decoded(content).alias("text"))


# --- archives -----------------------------------------------------------------
LISTING = """listing AS (SELECT 'a' || (doc_id * doc_id % 61) AS archive, 'm' || doc_id || '.txt' AS member, n_chars AS size FROM documents)"""
LIMITS = {"max_files": 40, "max_member": 20_000, "max_total": 60_000}
AUDIT = f"""{LISTING}, audit AS (SELECT archive, count(*) AS files, max(size) AS largest, CAST(sum(size) AS BIGINT) AS total FROM listing GROUP BY 1),
judged AS (SELECT *, CASE WHEN files > {LIMITS['max_files']} THEN 'too many files' WHEN largest > {LIMITS['max_member']} THEN 'member too large'
    WHEN total > {LIMITS['max_total']} THEN 'too large after extraction' END AS reason FROM audit)"""


def listing(spark, sf_dir):
    d = F.col("doc_id")
    return proxies.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("a"), (d * d % 61).cast("string")).alias("archive"),
        F.concat(F.lit("m"), d.cast("string"), F.lit(".txt")).alias("member"),
        F.col("n_chars").alias("size"),
        F.lit(None).cast("string").alias("error"),
    )


@query("archive_audit", f"WITH {AUDIT} SELECT archive, files, largest, total, reason FROM judged")
def archive_audit(spark, sf_dir):
    return archives.audit(listing(spark, sf_dir), **LIMITS)


@query(
    "accepted_members",
    f"WITH {AUDIT} SELECT archive, member, size FROM listing JOIN judged USING (archive) WHERE reason IS NULL",
)
def accepted_members(spark, sf_dir):
    members = listing(spark, sf_dir)
    return archives.accepted(members, archives.audit(members, **LIMITS)).select("archive", "member", "size")


def zip_bytes(entries) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, data in entries:
            zf.writestr(name, data)
    return buffer.getvalue()


def packed(batches):
    """One archive per document; some are broken or hold an escaping path."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            if doc_id % 10 == 9:
                content = b"not a zip " + text.encode()
            else:
                second = "../escape.txt" if doc_id % 10 == 8 else "deep/./copy.txt"
                content = zip_bytes([("log.txt", text), (second, str(doc_id))])
            rows.append((f"doc{doc_id}", content))
        yield pd.DataFrame(rows, columns=["archive", "content"])


def document_archives(spark, sf_dir):
    docs = proxies.dealt(proxies.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.mapInPandas(packed, "archive string, content binary")


@query(
    "expand_archives",
    """SELECT 'doc' || doc_id AS archive, 'log.txt' AS member, 'log.txt' AS target, CAST(octet_length(encode(text)) AS BIGINT) AS size,
      sha1(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents WHERE doc_id % 10 < 8
    UNION ALL SELECT 'doc' || doc_id, 'deep/./copy.txt', 'deep/copy.txt', length(CAST(doc_id AS VARCHAR)), sha1(CAST(doc_id AS VARCHAR)), NULL
      FROM documents WHERE doc_id % 10 < 8
    UNION ALL SELECT 'doc' || doc_id, NULL, NULL, NULL, NULL,
      CASE WHEN doc_id % 10 = 9 THEN 'not a valid zip archive' ELSE 'invalid path: ../escape.txt' END FROM documents WHERE doc_id % 10 >= 8""",
)
def expand_archives(spark, sf_dir):
    out = archives.expand(document_archives(spark, sf_dir))
    return out.select("archive", "member", "target", "size", F.sha1("content").alias("digest"), "error")


@query(
    "archive_members",
    """SELECT 'doc' || doc_id AS archive, 'log.txt' AS member, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS error
      FROM documents WHERE doc_id % 10 < 9
    UNION ALL SELECT 'doc' || doc_id, CASE WHEN doc_id % 10 = 8 THEN '../escape.txt' ELSE 'deep/./copy.txt' END,
      length(CAST(doc_id AS VARCHAR)), NULL FROM documents WHERE doc_id % 10 < 9
    UNION ALL SELECT 'doc' || doc_id, NULL, NULL, 'not a valid zip archive' FROM documents WHERE doc_id % 10 = 9""",
)
def archive_members(spark, sf_dir):
    return archives.list_members(document_archives(spark, sf_dir))


def debug_archives(batches):
    """Archives of a run: a debug log at nesting depth 0 to 3, or none."""
    for batch in batches:
        rows = []
        for folder, e in zip(batch["run_folder"], batch["e"]):
            text = f"head {e}\nTOKEN=abc{e}\nfail at Thermal Test {e}\n".encode() + b"\xff tail"
            content = zip_bytes([("readme.txt", "x"), ("Seq 1/DebugLog.txt" if e % 6 != 5 else "other.txt", text)])
            for level in range(e % 6 if e % 6 < 4 else 0):
                content = zip_bytes([(f"n{level}.zip", content)])
            rows.append((folder, "b.zip", content))
            rows.append((folder, "a.zip", b"broken"))
        yield pd.DataFrame(rows, columns=["run_folder", "archive", "content"])


@query(
    "debug_logs",
    f"""WITH {LOGGED} SELECT unit_id, e % 6 NOT IN (3, 5) AND result = 'FAIL' AS has_debuglog,
    CASE WHEN e % 6 NOT IN (3, 5) AND result = 'FAIL' THEN 'head ' || e || chr(10) || 'TOKEN=[REDACTED]' || chr(10) ||
      'fail at Thermal Test ' || e || chr(10) || ' tail' END AS debug_excerpt FROM parsed""",
)
def debug_logs(spark, sf_dir):
    runs = parse.one_log_per_folder(parse.parse_logs(proxies.logs(spark, sf_dir)).drop("steps"))
    ids = proxies.runs_from_events(proxies.table(spark, sf_dir, "events")).select(
        "run_folder", F.col("unit_id").cast("long").alias("e")
    )
    zips = ids.mapInPandas(debug_archives, "run_folder string, archive string, content binary")
    return ingest.attach_debug_excerpts(runs, zips).select("unit_id", "has_debuglog", "debug_excerpt")


# --- ingest from files --------------------------------------------------------
# Events of one tester per supplier, so that the number of files follows the table.
TESTERS = """(SELECT s_suppkey AS event_id, s_nationkey AS user_id, CASE s_suppkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error'
    WHEN 2 THEN 'error' ELSE 'view' END AS event_type, TIMESTAMP '2024-03-01 08:00:00' + to_seconds(s_suppkey * 97) AS ts,
    CAST(s_suppkey % 90 AS DOUBLE) AS value, '{"k": ' || (s_suppkey % 50) || '}' AS props FROM supplier)"""
FOLDER = "'day ' || (e % 3) || ' 100%25/' || run_folder"
FILED = LOGGED.replace("FROM events", f"FROM {TESTERS} AS events")


def tester_logs(spark, sf_dir):
    """Logs in folders with blanks and per cents; some padded so that they are read as lines, some beside later logs."""
    s = F.col("s_suppkey")
    n = s.cast("long")
    events = proxies.dealt(proxies.table(spark, sf_dir, "supplier"), "s_suppkey").select(
        n.alias("event_id"),
        F.col("s_nationkey").cast("long").alias("user_id"),
        F.when(n % 5 == 0, "click").when(n % 5 < 3, "error").otherwise("view").alias("event_type"),
        (F.lit("2024-03-01 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(n * 97).cast("decimal(18,6)"))).alias("ts"),
        (n % 90).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), (n % 50).cast("string"), F.lit("}")).alias("props"),
    )
    e = F.substring_index("run_folder", "___", -1).cast("long")
    folder = F.concat(F.lit("day "), (e % 3).cast("string"), F.lit(" 100%25/"), F.col("run_folder"))
    noise = F.when(e % 4 == 0, F.repeat(F.lit("noise of the tester\n"), 2000)).otherwise("")
    return proxies.logs_of(events).select(
        F.concat(folder, F.lit("/FTRunnerLog 01%.txt")).alias("name"),
        F.concat(noise, F.col("text")).alias("text"),
        F.concat(folder, F.lit("/ftrunnerlog09.txt")).alias("later"),
    )


def written_files(files, root):
    """Writes ``files`` (name, text) below the shared folder; returns their number, which the caller must ask for."""

    def write(batches):
        from pyarrow import fs

        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                system, base = fs.FileSystem.from_uri(root.replace("file:", "file://", 1) if root.startswith("file:/") and not root.startswith("file://") else root)
                target = f"{base}/{name}"
                system.create_dir(target.rsplit("/", 1)[0])
                with system.open_output_stream(target) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"files": [len(batch)]})

    return files.mapInPandas(write, "files long").agg(F.sum("files")).first()[0]


def tester_files(spark, sf_dir):
    """The root of a folder tree with these logs."""
    root = new_table_path(spark, "tester-files")
    root = root if ":" in root.split("/")[0] else f"file:{root}"
    logs = tester_logs(spark, sf_dir)
    later = logs.select(F.col("later").alias("name"), F.lit("not read").alias("text"))
    written_files(logs.select("name", "text").unionByName(later), root)
    return root


def ingested(spark, sf_dir):
    return ingest.ingest_folder(spark, tester_files(spark, sf_dir), row_bytes=20_000)


INGESTED = [c for c in LINE_COLUMNS if c not in ("unit_id", "run_folder")]


INGESTED_RUNS = (
    f"WITH {FILED} SELECT left(sha1({FOLDER}), 16) AS unit_id, {FOLDER} AS run_folder, {', '.join(INGESTED)} FROM parsed"
)
INGESTED_STEPS = f"""WITH {FILED}, p AS (SELECT e, result, left(sha1({FOLDER}), 16) AS unit_id FROM parsed)
    SELECT unit_id, 1 AS step_no, 'PowerTest' AS name, CASE WHEN e % 9 < 3 THEN 'PASS' ELSE 'UNKNOWN' END AS result,
      CAST(e % 3000 AS DOUBLE) AS duration_s FROM p WHERE e % 9 <> 8
    UNION ALL SELECT unit_id, CASE WHEN e % 9 = 8 THEN 1 ELSE 2 END, 'Thermal Test', result, 7e0 FROM p"""


@query("ingest_runs", INGESTED_RUNS)
def ingest_runs(spark, sf_dir):
    return ingested(spark, sf_dir).runs.select(*LINE_COLUMNS)


@query("ingest_steps", INGESTED_STEPS)
def ingest_steps(spark, sf_dir):
    return ingested(spark, sf_dir).steps


# --- artifacts ----------------------------------------------------------------
def artifact_runs(spark, sf_dir):
    """Failing proxy runs with two steps each, whole seconds."""
    step = F.struct(F.col("failing_step").alias("name"), F.lit("FAIL").alias("result"), F.lit(1.5).alias("duration_s"))
    runs = proxies.failures(spark, sf_dir)
    return runs.withColumns(
        {
            "start_time": F.date_trunc("second", "start_time").cast("timestamp_ntz"),
            "end_time": F.date_trunc("second", "end_time").cast("timestamp_ntz"),
            "steps": F.when(F.col("result") == "FAIL", F.array(step, step)).otherwise(
                F.array().cast("array<struct<name:string,result:string,duration_s:double>>")
            ),
        }
    )


ARTIFACT = f"""{FAILURES}, units AS (SELECT *, strftime(date_trunc('second', start_time), '%Y-%m-%dT%H:%M:%S') AS st,
    strftime(date_trunc('second', end_time), '%Y-%m-%dT%H:%M:%S') AS et FROM (SELECT *, row_number() OVER (PARTITION BY product_code, {KEY}
    ORDER BY date_trunc('second', start_time) DESC NULLS LAST, date_trunc('second', end_time) DESC NULLS LAST,
    run_folder DESC, unit_id DESC) AS rn FROM failures) WHERE rn = 1)"""
FIELDS = ("unit_id", "serial_number", "result", "host", "lot_id", "start_time", "end_time", "error_code", "error_message",
          "failing_step", "ftrunner_snippet", "debug_excerpt")
UNIT_SQL = f"""WITH {ARTIFACT} SELECT product_code AS product, CASE WHEN result = 'FAIL' THEN unit_id END AS unit_id, serial_number, result,
  host, lot_id, st AS start_time, et AS end_time, nullif(error_code, '') AS error_code,
  nullif({redact_sql('error_message', *KEEP_SERIAL)}, '') AS error_message, failing_step,
  nullif({redact_sql('ftrunner_snippet', *KEEP_SERIAL)}, '') AS ftrunner_snippet, nullif(debug_excerpt, '') AS debug_excerpt,
  CASE WHEN result = 'FAIL' THEN '[{{"name":"' || failing_step || '","result":"FAIL","duration_s":1.5}},{{"name":"' || failing_step ||
    '","result":"FAIL","duration_s":1.5}}]' END AS steps FROM units"""


@query("artifact_units", UNIT_SQL)
def artifact_units(spark, sf_dir):
    units = artifact.unit_rows(artifact_runs(spark, sf_dir)).select("product", artifact.unit_json().alias("doc"))
    return units.select("product", *[F.get_json_object("doc", f"$.{f}").alias(f) for f in (*FIELDS, "steps")])


@query(
    "legacy_units",
    f"""WITH {ARTIFACT} SELECT product_code AS product, result, CASE WHEN result = 'FAIL' THEN 18 ELSE 9 END AS fields,
    CASE WHEN result = 'FAIL' THEN '' END AS root_cause, debug_excerpt FROM units""",
)
def legacy_units(spark, sf_dir):
    units = artifact.unit_rows(artifact_runs(spark, sf_dir), compact=False).select(
        "product", "result", artifact.unit_json(compact=False).alias("doc")
    )
    return units.select(
        "product",
        "result",
        F.size(F.json_object_keys("doc")).alias("fields"),
        F.get_json_object("doc", "$.root_cause").alias("root_cause"),
        F.get_json_object("doc", "$.debug_excerpt").alias("debug_excerpt"),
    )


SUMMARIES = PRODUCT.replace("SELECT product_code, total", "SELECT product_code AS product, total AS units, total").replace(
    "AS final_yield", "AS fpy"
)


@query("product_artifact", f"WITH {RUNS}{SUMMARIES}")
def product_artifact(spark, sf_dir):
    runs = proxies.failures(spark, sf_dir).withColumn(
        "steps", F.array().cast("array<struct<name:string,result:string,duration_s:double>>")
    )
    path = new_table_path(spark, "artifact")
    artifact.write_artifact(runs, path, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), gzip=True)
    units = artifact.read_units(spark, path).groupBy("product").agg(F.count(F.lit(1)).alias("units"))
    numbers = "struct<total:bigint,pass:bigint,fail:bigint,unknown:bigint,fpy:double,run_count:bigint,retests:bigint>"
    docs = artifact.read_summaries(spark, path).withColumn(
        "d", F.from_json("value", f"product_code string, schema_version int, summary {numbers}")
    )
    return docs.join(units, "product").select("product", "units", "d.summary.*")


@query("artifact_bytes")
def artifact_bytes(spark, sf_dir):
    path = new_table_path(spark, "artifact")
    artifact.write_artifact(artifact_runs(spark, sf_dir), path, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), gzip=True)
    return artifact.written_bytes(spark, path)


def _bytes(field: str, value: str) -> str:
    return f"CAST(coalesce(sum(octet_length(encode('{{\"{field}\":\"' || {value} || '\"}}'))), 0) AS BIGINT)"


@query(
    "artifact_size_report",
    f"""WITH {UNIT_SQL.replace('WITH ', '', 1).replace('SELECT product_code AS product', ', shown AS (SELECT product_code AS product', 1)})
    SELECT product, count(*) AS units, CAST(coalesce(sum(octet_length(encode('{{"steps":' || steps || '}}'))), 0) AS BIGINT) AS steps_bytes,
    {_bytes('debug_excerpt', "replace(debug_excerpt, chr(34), chr(92) || chr(34))")} AS debug_excerpt_bytes,
    {_bytes('ftrunner_snippet', "replace(ftrunner_snippet, chr(10), chr(92) || 'n')")} AS ftrunner_snippet_bytes,
    {_bytes('error_message', 'error_message')} AS error_message_bytes FROM shown GROUP BY 1""",
)
def artifact_size_report(spark, sf_dir):
    report = artifact.size_report(artifact_runs(spark, sf_dir))
    return report.select("product", "units", *[f"{f}_bytes" for f in artifact.HEAVY_FIELDS])


@query("artifact_size_shares")
def artifact_size_shares(spark, sf_dir):
    return artifact.size_report(artifact_runs(spark, sf_dir))


# --- manager view and batch tables ---------------------------------------------
VIEW = f"""{SUMMARY.replace('SELECT total_runs', ', summary AS (SELECT total_runs', 1)}),
trend AS ({DAILY}), stations AS ({grouped('station', STATION)}), lots AS ({grouped('lot', LOT)}),
reasons AS (SELECT {LABEL} AS reason, count(*) AS n FROM runs WHERE result = 'FAIL' GROUP BY 1)
SELECT 'trend' AS section, date AS label, "pass", fail, yield FROM trend
UNION ALL SELECT 'stations', station, "pass", fail, yield FROM stations UNION ALL SELECT 'lots', lot, "pass", fail, yield FROM lots
UNION ALL SELECT 'pareto', reason, NULL, n, NULL FROM reasons"""


@query("manager_buckets", f"WITH {RUNS}{VIEW}")
def manager_buckets(spark, sf_dir):
    return manager.bucket_counts(proxies.runs(spark, sf_dir))


@query(
    "manager_view",
    f"""WITH {RUNS}{SUMMARY.replace('SELECT total_runs', ', summary AS (SELECT total_runs', 1)}), trend AS ({DAILY}),
    stations AS ({grouped('station', STATION)}), lots AS ({grouped('lot', LOT)}), top AS (WITH x AS (SELECT 1){pareto(10)})
    SELECT 'summary' AS section, 'fpy' AS label, total_runs AS n, fpy AS value FROM summary
    UNION ALL SELECT 'trend', date, "pass" + fail, yield FROM trend UNION ALL SELECT 'stations', station, total, yield FROM stations
    UNION ALL SELECT 'lots', lot, total, yield FROM lots UNION ALL SELECT 'pareto', reason, "count", cum_pct FROM top""",
)
def manager_view(spark, sf_dir):
    view = manager.manager_view(proxies.runs(spark, sf_dir))
    total = F.col("pass") + F.col("fail")
    rows = {
        "summary": (F.lit("fpy"), F.col("total_runs"), F.col("fpy")),
        "trend": (F.col("date"), total, F.col("yield")),
        "stations": (F.col("station"), F.col("total"), F.col("yield")),
        "lots": (F.col("lot"), F.col("total"), F.col("yield")),
        "pareto": (F.col("reason"), F.col("count"), F.col("cum_pct")),
    }
    out = None
    for name, (label, n, value) in rows.items():
        part = view[name].select(F.lit(name).alias("section"), label.alias("label"), n.alias("n"), value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


AS_OF = "2024-02-15 00:00:00"


@query("live_batches", f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def live_batches(spark, sf_dir):
    events = proxies.table(spark, sf_dir, "events").select("event_id", "ts")
    return batches.live(events, F.lit(AS_OF).cast("timestamp_ntz"), created="ts")


@query(
    "expired_batches",
    f"SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS batch_id FROM events WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY",
)
def expired_batches(spark, sf_dir):
    events = proxies.table(spark, sf_dir, "events")
    old = batches.expired(events, F.lit(AS_OF).cast("timestamp_ntz"), created="ts")
    return old.select(F.date_format("ts", "yyyy-MM-dd").alias("batch_id")).distinct()


@query(
    "batch_rewrite",
    f"""WITH {RUNS} SELECT product_code AS batch_id, CASE WHEN product_code = 'P1' THEN 'second' ELSE 'first' END AS version, count(*) AS runs
    FROM runs WHERE product_code <> 'P1' OR result = 'FAIL' GROUP BY 1, 2""",
)
def batch_rewrite(spark, sf_dir):
    path = new_table_path(spark, "batches")
    runs = proxies.runs(spark, sf_dir).select("unit_id", "result", F.col("product_code").alias("batch_id"))
    batches.write_batches(runs.withColumn("version", F.lit("first")), path)
    again = runs.filter((F.col("batch_id") == "P1") & (F.col("result") == "FAIL"))
    batches.write_batches(again.withColumn("version", F.lit("second")), path)
    batches.write_batches(again.filter("false").withColumn("version", F.lit("none")), path)
    rows = batches.read_batches(spark, path, "unit_id string, result string, version string, batch_id string")
    return rows.groupBy("batch_id", "version").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "expired_dropped",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS batch_id, count(*) AS rows FROM events GROUP BY 1
    HAVING max(ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""",
)
def expired_dropped(spark, sf_dir):
    path, schema = new_table_path(spark, "batches"), "event_id bigint, ts timestamp_ntz, batch_id string"
    events = proxies.table(spark, sf_dir, "events")
    batches.write_batches(events.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("batch_id")), path)
    batches.drop_expired(spark, path, schema, F.lit(AS_OF).cast("timestamp_ntz"), created="ts")
    batches.remove_old(spark, path)
    return batches.read_batches(spark, path, schema).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "batch_states",
    f"""WITH {RUNS}, s AS (SELECT product_code AS batch_id, count(*) FILTER (WHERE result = 'FAIL' AND error_code IS NOT NULL) AS processed,
      count(*) FILTER (WHERE result = 'FAIL') AS total, count(*) AS runs, count(DISTINCT error_message) FILTER (WHERE result = 'FAIL') AS signatures
      FROM runs GROUP BY 1)
    SELECT batch_id, CASE WHEN processed < total THEN 'running' ELSE 'done' END AS status,
      CASE WHEN total = 0 THEN 'No failing run' ELSE processed || ' of ' || total || ' failing runs have an answer' END AS message,
      processed, total, runs, signatures, CAST(0 AS BIGINT) AS warnings FROM s""",
)
def batch_states(spark, sf_dir):
    runs = proxies.runs(spark, sf_dir).select(
        F.col("product_code").alias("batch_id"), "result", F.col("error_message").alias("signature"), "error_code"
    )
    return batches.batch_states(runs, F.col("error_code").isNotNull())
