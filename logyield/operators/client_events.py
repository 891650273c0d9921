"""Client events: level, secret scrubbing, size limit and one readable line per event.

The context is free JSON. It is walked with array expressions over its keys in
document order, to the fixed depth at which scrubbing stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_null, strip

# Levels, secret key parts, depth, list, text and line limits.
LEVELS = ("debug", "info", "warning", "error")
SECRET_KEY_PARTS = ("token", "password", "passwd", "authorization", "secret", "apikey", "api_key")
MAX_DEPTH = 4
MAX_LIST = 50
MAX_CLIENT_TEXT = 500
MAX_CONTEXT = 1000
MAX_CONTEXT_DEBUG = 4000
MAX_VALUE = 120
MAX_MESSAGE = 500
SHOWN = 6
SHOWN_DEBUG = 12
DEFAULT_MESSAGE = "Frontend event"
# A list of nothing but whole numbers: its elements stay as they are and need no walk.
NUMBERS = r"\A\[[0-9,]*\]\z"


def level(raw: Column) -> Column:
    """Known level in lower case, anything else 'info'."""
    low = F.lower(F.coalesce(or_null(raw), F.lit("info")))
    return F.when(low.isin(*LEVELS), low).otherwise("info")


def message(raw: Column) -> Column:
    """Underscores as blanks, trimmed, first letter upper, limited in length."""
    text = strip(F.replace(F.coalesce(or_null(raw), F.lit(DEFAULT_MESSAGE)), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, MAX_MESSAGE - 1))


def is_secret(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SECRET_KEY_PARTS))


# Stand for an escaped backslash and an escaped quote while quotes are looked at; JSON text never holds them.
_BACKSLASH, _QUOTE = "\x02", "\x03"
_MARK = "\\u0001"


def _bare(json: Column) -> Column:
    """JSON text whose every ``"`` begins or ends a string."""
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _unbare(json: Column) -> Column:
    return F.replace(F.replace(json, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _marked(json: Column) -> Column:
    """The same JSON with U+0001 before every string, so that a value's text tells its kind after one parse.

    Text with raw control characters of these kinds is no JSON and stays as it is.
    """
    odd = F.contains(json, F.lit(_BACKSLASH)) | F.contains(json, F.lit(_QUOTE))
    return F.when(odd, json).otherwise(_unbare(F.regexp_replace(_bare(json), '"([^"]*)"', f'"\\{_MARK}$1"')))


def _unmarked(json: Column) -> Column:
    return _unbare(F.replace(_bare(json), F.lit('"' + _MARK), F.lit('"')))


def _typed(raw: Column) -> tuple[Column, Column]:
    """(text, kind) of a value of marked JSON; text below an object or array stays marked, JSON null is null."""
    first = F.substring(raw, 1, 1)
    kind = (
        F.when(first == "\x01", "STRING").when(first == "{", "OBJECT").when(first == "[", "ARRAY")
        .when(first.isin("t", "f"), "BOOLEAN").when(raw.isNotNull(), "NUMBER")
    )
    return F.when(first == "\x01", F.substring(raw, 2, 1 << 30)).otherwise(raw).alias("text"), kind.alias("kind")


def _entries(json: Column) -> Column:
    """(key, text, kind) of a marked JSON object in document order."""
    return _read(F.map_entries(F.from_json(json, "map<string,string>")))


def _children(json: Column, kind: Column) -> Column:
    """Entries of an object, or the first elements of an array with null keys: one walk serves both."""
    elements = F.slice(F.from_json(json, "array<string>"), 1, MAX_LIST)
    keyless = F.transform(elements, lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    return _read(F.when(kind == "OBJECT", F.map_entries(F.from_json(json, "map<string,string>"))).otherwise(keyless))


def _read(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(F.substring(e["key"], 2, 1 << 30).alias("key"), *_typed(e["value"])))


def _quoted(text: Column) -> Column:
    """A JSON string; the writer is only asked when something needs escaping."""
    inner = F.to_json(F.array(text))
    escaped = F.substring(inner, 2, F.length(inner) - 2)
    return F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _scrub_value(item: Column, depth: int, client: bool) -> Column:
    """JSON text of a value at ``depth`` with secrets masked below it."""
    if depth > MAX_DEPTH:
        return F.lit('"[MAX_DEPTH]"')
    text, kind = item["text"], item["kind"]
    # Numbers and booleans keep the digits they were written with.
    scalar = F.when(kind == "STRING", _quoted(text)).otherwise(text)
    if client:
        long_text = (kind == "STRING") & (F.length(text) > MAX_CLIENT_TEXT)
        short = _quoted(F.concat(F.substring(text, 1, MAX_CLIENT_TEXT), F.lit("...[truncated]")))
        scalar = F.when(long_text, short).otherwise(scalar)
    nested = kind.isin("OBJECT", "ARRAY")
    inside = _scrub_parts(_children(text, kind), depth, client)
    if depth < MAX_DEPTH:
        numbers = F.substring_index(F.substring(text, 2, F.length(text) - 2), ",", MAX_LIST)
        inside = F.when((kind == "ARRAY") & text.rlike(NUMBERS), numbers).otherwise(inside)
    around = lambda of_object, of_array: F.when(kind == "OBJECT", of_object).otherwise(of_array)
    return F.when(nested, F.concat(around("{", "["), inside, around("}", "]"))).otherwise(F.coalesce(scalar, F.lit("null")))


def _scrub_parts(children: Column, depth: int, client: bool) -> Column:
    def part(e: Column) -> Column:
        value = F.when(is_secret(e["key"]), '"[REDACTED]"').otherwise(_scrub_value(e, depth + 1, client))
        return F.concat(F.coalesce(F.concat(_quoted(e["key"]), F.lit(":")), F.lit("")), value)

    return F.array_join(F.transform(children, part), ",")


def scrubbed(context: Column, client: bool = False) -> Column:
    """Context JSON with secrets masked, deep parts and long lists cut.

    ``client`` also shortens long strings, as the sender does.
    """
    top = _entries(_marked(F.coalesce(context, F.lit("{}"))))
    return F.concat(F.lit("{"), _scrub_parts(top, 0, client), F.lit("}"))


def ascii_json(json: Column) -> Column:
    """JSON text with every character beyond printable ASCII as \\uXXXX, a pair of them beyond U+FFFF."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(char: Column) -> Column:
        code = F.ascii(char)
        high, low = code - 0x10000, F.lit(0xDC00)
        pair = F.concat(unit(F.shiftright(high, 10) + 0xD800), unit(low + high.bitwiseAND(F.lit(0x3FF))))
        return F.when(code > 0xFFFF, pair).when(code > 0x7E, unit(code)).otherwise(char)

    chars = F.regexp_extract_all(json, F.lit("(?s)(.)"), 1)
    return F.when(json.rlike("[^\\x00-\\x7e]"), F.array_join(F.transform(chars, escaped), "")).otherwise(json)


def trimmed(context: Column, debug: bool = False) -> Column:
    """A context whose escaped form is too long becomes one ``details`` field with that form's beginning."""
    limit = MAX_CONTEXT_DEBUG if debug else MAX_CONTEXT
    escaped = ascii_json(context)
    head = F.concat(F.substring(escaped, 1, limit), F.lit("..."))
    return F.when(F.length(escaped) > limit, F.to_json(F.struct(head.alias("details")))).otherwise(context)


def _shown(text: Column, kind: Column) -> Column:
    named = F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.coalesce(text, F.lit("None")))
    flat = F.translate(named, "\n\r", "  ")
    return F.when(F.length(flat) > MAX_VALUE, F.concat(F.substring(flat, 1, MAX_VALUE - 3), F.lit("..."))).otherwise(flat)


def _flat(json: Column, prefix: Column | None, depth: int) -> Column:
    def one(e: Column) -> Column:
        path = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
        kind = e["kind"]
        count = F.size(F.from_json(e["text"], "array<string>"))
        listed = F.concat(F.lit("["), count.cast("string"), F.lit(" items]"))
        text = F.when(kind == "OBJECT", _unmarked(e["text"])).otherwise(e["text"]) if depth >= MAX_DEPTH else e["text"]
        leaf = F.array(F.concat(path, F.lit("="), F.when(kind == "ARRAY", listed).otherwise(_shown(text, kind))))
        if depth >= MAX_DEPTH:
            return leaf
        return F.when(kind == "OBJECT", _flat(e["text"], path, depth + 1)).otherwise(leaf)

    return F.flatten(F.transform(_entries(json), one))


def pairs(context: Column) -> Column:
    """All ``a.b=v`` pairs of a scrubbed context."""
    return _flat(_marked(context), None, 0)


def details(found: Column, debug: bool = False) -> Column:
    """The first pairs and how many more there are."""
    limit = SHOWN_DEBUG if debug else SHOWN
    more = F.when(F.size(found) > limit, F.concat(F.lit("+"), (F.size(found) - limit).cast("string"), F.lit(" more")))
    return F.array_join(F.array_compact(F.concat(F.slice(found, 1, limit), F.array(more))), ", ")


def normalize_events(events: DataFrame, debug: bool = False) -> DataFrame:
    """``events`` (level, message, context) cleaned; debug events only on request."""
    known = events.withColumn("level", level(F.col("level")))
    if not debug:
        known = known.filter(F.col("level") != "debug")
    # Separate columns: the context is walked once for scrubbing and once for the line.
    return (
        known.withColumn("message", message(F.col("message")))
        .withColumn("context", scrubbed(F.col("context")))
        .withColumn("context", trimmed(F.col("context"), debug))
        .withColumn("_pairs", pairs(F.col("context")))
        .withColumn("details", details(F.col("_pairs"), debug))
        .drop("_pairs")
    )


def event_line(at: Column) -> Column:
    """One log line of a normalized event."""
    suffix = F.when(F.col("details") != "", F.concat(F.lit(" ("), F.col("details"), F.lit(")"))).otherwise("")
    return F.concat(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'"),
        F.lit(" | "),
        F.rpad(F.upper("level"), 7, " "),
        F.lit(" | "),
        F.col("message"),
        suffix,
    )
