"""Repair of conversation structure: cheapest edits to a legal order of roles, on grammar-compressed fault sequences.

1. **Damage and faults** are column expressions. Equal rows (conversation, turn, role, text) become one row with a count
   before they travel; a text seen at an earlier turn is found by digests, and only rows that may have such a text are joined.
2. **Chunks.** Rows are range-partitioned and sorted by (conversation, turn, role, text), so a conversation of any length is
   spread over tasks; each task cuts its share into chunks of bounded size: one symbol per row (role initial and fault), the
   texts that may be kept, and counts that add up over chunks.
3. **Grammar.** Re-Pair over the symbol sequences of all chunks: in each round Spark counts neighbouring pairs over the
   distinct sequences, and the most frequent pairs that do not overlap become rules. At most ``ROUNDS * RULES_PER_ROUND`` rules are
   made, so they can be broadcast; what no rule covers is left as symbols, so the rules decide costs, not results.
4. **Min-plus matrices.** Between the states of ``(s?(ua)+)?`` each symbol is a matrix of (cost, audit) under (min, +, audit
   concatenation, ties to the least audit); a rule's matrix is the product of its parts', made once, bottom-up, with its
   audits as ready pieces for every conversation that uses the rule. Ties are safe: two audits of equal cost between the same states
   over the same rows never begin one another, so the order of the beginnings is the order of the wholes.
5. **Conversations.** One that lies whole in a task's chunk is walked, replayed and hashed there. The others (first and last of
   a task, and long ones) get one matrix per chunk; these are folded in order of the chunks, then the chunks are replayed
   in order through one running SHA-256, which is sequential by nature: memory holds one chunk and the audit.

Rows of one turn are ordered by role, then text. Null role and text read as one space, so a null text is blank and a null
role can only be given another or be deleted; a null conversation id is a conversation of its own, and so is the id of one
space. An empty role has no initial and is treated the same way. Texts of any length are read whole. Repeated rows are duplicates of the first. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, shuffle_width, suspects, tidy

BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
CHUNK_ROWS = 4096
CHUNK_BYTES = 1 << 20
ROUNDS = 8
RULES_PER_ROUND = 16
#: Code points of rule symbols: above all symbols of rows.
FIRST_RULE = 0x100

#: States: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role leads to from each state; from other states it is not legal.
STEPS = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
#: Initials of a symbol's role: lower case, upper case if the text is truncated; "o" is any other role, "D" must go.
MUST_GO = "D"
Entry = tuple[int, str]
Matrix = list[list[Entry | None]]


# ---------------------------------------------------------------------------------------------------------------
# Min-plus algebra
# ---------------------------------------------------------------------------------------------------------------


def times(row: list[Entry | None], matrix: Matrix) -> list[Entry | None]:
    """Vector times matrix: per state the cheapest, then least (cost, audit)."""
    out: list[Entry | None] = [None] * 4
    for entry, onward in zip(row, matrix):
        if entry is None:
            continue
        cost, audit = entry
        for state, step in enumerate(onward):
            if step is None:
                continue
            best = out[state]
            total = cost + step[0]
            if best is None or total < best[0] or (total == best[0] and audit + step[1] < best[1]):
                out[state] = (total, audit + step[1])
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    return [times(row, right) for row in left]


def _matrix(entries: dict[tuple[int, int], Entry]) -> Matrix:
    return [[entries.get((a, b)) for b in range(4)] for a in range(4)]


IDENTITY = _matrix({(state, state): (0, "") for state in range(4)})


def _insertions() -> Matrix:
    """Inserted rows between two rows: the cheapest way from each state to each other."""
    one = {(state, onward): (2, "I") for role in "ua" for state, onward in STEPS[role].items()}
    once = _matrix(one | {(state, state): (0, "") for state in range(4)})
    return product(once, product(once, once))


INSERTIONS = _insertions()


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions, then one edit of the symbol's row."""
    entries = {(state, state): (3, "D") for state in range(4)}
    if symbol != MUST_GO:
        late = int(symbol.isupper())
        for role in "ua":
            for state, onward in STEPS[role].items():
                entries[state, onward] = (2 + late, "R")
        for state, onward in STEPS.get(symbol.lower(), {}).items():
            entries[state, onward] = (late, "K")
    return product(INSERTIONS, _matrix(entries))


SYMBOLS = [MUST_GO, *"suao", *"SUAO"]


class Grammar:
    """Rules (pair of symbols → symbol, in order of making) and the matrix of every symbol."""

    def __init__(self, pairs: list[str] = ()):
        self.pairs = list(pairs)
        self.rules = {pair: chr(FIRST_RULE + i) for i, pair in enumerate(self.pairs)}
        self.matrices = {symbol: symbol_matrix(symbol) for symbol in SYMBOLS}
        for pair, symbol in self.rules.items():  # bottom-up: the parts of a rule are older
            self.matrices[symbol] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        self._known: dict[str, str] = {}

    def compressed(self, symbols: str) -> str:
        found = self._known.get(symbols)
        if found is None:
            found = symbols
            for pair, symbol in self.rules.items():
                found = found.replace(pair, symbol)
            if len(symbols) <= 64 and len(self._known) < 1 << 16:
                self._known[symbols] = found
        return found

    def walk(self, row: list[Entry | None], symbols: str) -> list[Entry | None]:
        for symbol in self.compressed(symbols):
            row = times(row, self.matrices[symbol])
        return row


BEGIN: list[Entry | None] = [(0, ""), None, None, None]


def finish(row: list[Entry | None]) -> Entry:
    """Cheapest (cost, audit) that ends legally: with nothing, or after an assistant."""
    ended = times(row, INSERTIONS)
    return min(e for e in (ended[START], ended[ASSISTANT]) if e is not None)


def replay(audit: str, symbols: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], int, int]:
    """(repaired rows as role:text, state, audit letters used): insertions after the last row are left to the caller."""
    out, at, row, kept = [], 0, 0, 0
    while row < len(symbols):
        letter = audit[at]
        at += 1
        if letter == "I":
            role, text = ("assistant" if state == USER else "user"), ""
        else:
            there = symbols[row] != MUST_GO
            row += 1
            kept += there
            if letter == "D":
                continue
            role, text = roles[kept - 1], texts[kept - 1]
            if letter == "R":
                role = "assistant" if state == USER else "user"
        state = STEPS[role[0]][state]
        out.append(f"{role}:{text}")
    return out, state, at


def inserted(count: int, state: int) -> tuple[list[str], int]:
    """``count`` inserted rows."""
    out = []
    for _ in range(count):
        role = "assistant" if state == USER else "user"
        state = STEPS[role[0]][state]
        out.append(f"{role}:")
    return out, state


# ---------------------------------------------------------------------------------------------------------------
# Damage and faults
# ---------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text and n (how often the row follows itself) after the damage that the contract's checksum deals."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    dealt = F.crc32(F.encode(F.concat_ws(":", *shown), "UTF-8")) % 20
    rows = conversations.select(
        conversation_key().alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dealt.alias("dealt"),
    ).where("dealt <> 0")
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("dealt") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def conversation_key():
    """A text that is never null and tells a null id from all others."""
    return F.to_json(F.struct("conv_id"))


def faulty(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, n and fault of the first of n equal rows ("b", "d", "t" or "")."""
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # Stored, as it is read by the search for earlier texts and by the rows that it judges.
    once = kept_table(once.withColumn("said", F.xxhash64("conv", "role", F.md5("text"))), "said")
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    again = (
        once.groupBy("said", "conv", "role", F.md5("text").alias("digest"))
        .agg(F.min(place).alias("first"), F.count("*").alias("turns"))
        .where("turns > 1")
        .drop("turns")
    )
    single, several = suspects(once, again, "said")
    judged = (
        several.withColumn("digest", F.md5("text"))
        .join(again, ["said", "conv", "role", "digest"], "left")
        .withColumn("earlier", F.col("first").isNotNull() & (F.col("first") < place))
    )
    both = single.withColumn("earlier", F.lit(False)).unionByName(judged.select(*single.columns, "earlier"))
    solid = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(solid == "", "b").when(F.col("earlier"), "d").when(F.right(solid, F.lit(1)).isin(*ENDS), "").otherwise("t")
    )
    return both.select("conv", "turn", "role", "text", "n", fault.alias("fault"))


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
CHUNKS = (
    "conv string, part int, seq long, whole boolean, symbols string, roles array<string>, texts array<string>, "
    + "".join(f"{c} long, " for c in COUNTS)
    + "least_turn long, most_turn long, last_turn long, first_turn long, first_role string, last_role string"
)
LEGAL = ("su", "ua", "au")


class _Chunk:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: str, seq: int):
        self.conv, self.seq, self.size, self.length = conv, seq, 0, 0
        self.symbols: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.count = dict.fromkeys(COUNTS, 0)
        self.least = self.most = self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, n: int, fault: str, more: bool) -> None:
        """``n`` equal rows; ``more``: the first of them is a copy of the row before, too."""
        initial = role[:1]
        if self.first_role is None:
            self.first_role, self.first_turn = initial, turn
        else:
            self.count["illegal"] += self.last_role + initial not in LEGAL
        self.count["illegal"] += n - 1  # no role may follow itself
        if turn is not None and turn != self.last_turn:
            self.count["turns"] += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        self.last_role, self.last_turn = initial, turn
        copies = n if more else n - 1
        self.count["blank" if fault == "b" else "duplicate"] += copies
        if not more:
            if fault:
                self.count[{"b": "blank", "d": "duplicate", "t": "truncated"}[fault]] += 1
            if fault in ("b", "d"):
                self.symbols.append(MUST_GO)
            else:
                symbol = initial if initial in ("s", "u", "a") else "o"
                self.symbols.append(symbol.upper() if fault == "t" else symbol)
                self.roles.append(role)
                self.texts.append(text)
                self.size += len(text)
        self.symbols.append(MUST_GO * copies)
        self.length += n

    def row(self, part: int, whole: bool) -> tuple:
        return (
            self.conv, part, self.seq, whole, "".join(self.symbols), self.roles, self.texts, *(self.count[c] for c in COUNTS),
            self.least, self.most, self.last_turn, self.first_turn, self.first_role, self.last_role,
        )


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` bytes (their last string column and texts counted)."""
    lot, size = [], 0
    for row in rows:
        lot.append(row)
        size += 200 + sum(len(x) if isinstance(x, str) else sum(map(len, x)) if isinstance(x, list) else 0 for x in row)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot), schema)], schema=schema)
            lot, size = [], 0
    if lot:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot), schema)], schema=schema)


def _chunk_schema() -> pa.Schema:
    text, long = pa.string(), pa.int64()
    return pa.schema(
        [("conv", text), ("part", pa.int32()), ("seq", long), ("whole", pa.bool_()), ("symbols", text), ("roles", pa.list_(text)),
         ("texts", pa.list_(text)), *((c, long) for c in COUNTS), ("least_turn", long), ("most_turn", long),
         ("last_turn", long), ("first_turn", long), ("first_role", text), ("last_role", text)]
    )


def chunks(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sorted chunks of all conversations (stored); ``whole``: the chunk is all of its conversation."""
    rows = faulty(damaged(conversations))
    width = 2 * shuffle_width(conversations.sparkSession)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        chunk, inner = None, False  # inner: the conversation began after the task's first row and has one chunk so far
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "n", "fault"))
            for conv, turn, role, text, n, fault in zip(*columns):
                if chunk is not None and chunk.conv != conv:
                    yield chunk.row(part, inner)
                    chunk, inner = _Chunk(conv, 0), True
                elif chunk is None:
                    chunk = _Chunk(conv, 0)
                more = False
                while n:
                    if chunk.size >= CHUNK_BYTES or chunk.length >= chunk_rows:
                        yield chunk.row(part, False)
                        chunk, inner = _Chunk(conv, chunk.seq + 1), False
                    some = min(n, chunk_rows)
                    chunk.add(turn, role, text, some, fault, more)
                    n, more = n - some, True
        if chunk is not None:
            yield chunk.row(part, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(cut(batches), _chunk_schema(), CHUNK_BYTES)

    return kept_table(ordered.mapInArrow(tidy(run), CHUNKS), "chunks")


# ---------------------------------------------------------------------------------------------------------------
# Grammar
# ---------------------------------------------------------------------------------------------------------------


def apart(ranked: list[str], most: int) -> list[str]:
    """The first pairs of ``ranked`` of which no two can overlap in a sequence."""
    taken: list[str] = []
    for pair in ranked:
        if len(taken) < most and not any(pair[0] == p[1] or pair[1] == p[0] for p in taken):
            taken.append(pair)
    return taken


def learn(pieces: DataFrame) -> Grammar:
    """Re-Pair over the distinct symbol sequences of ``pieces``, weighted by how often they occur."""
    spark = pieces.sparkSession
    sequences = kept_table(pieces.groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
    grammar = Grammar()
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(grammar.pairs)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, seen = Grammar(shared.value), Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                    short = known.compressed(symbols)
                    for left, right in zip(short, short[1:]):
                        seen[left + right] += n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pair", "n"])

        counted = sequences.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        ranked = [r["pair"] for r in counted.orderBy(F.desc("n"), "pair").limit(8 * RULES_PER_ROUND).collect()]
        new = [p for p in apart(ranked, RULES_PER_ROUND) if p not in grammar.rules]
        if not new:
            break
        grammar = Grammar([*grammar.pairs, *new])
    return grammar


# ---------------------------------------------------------------------------------------------------------------
# Conversations
# ---------------------------------------------------------------------------------------------------------------

REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report_schema() -> pa.Schema:
    text, long = pa.string(), pa.int64()
    return pa.schema(
        [("conv", text), *((c, long) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", text),
         ("repaired_sha256", text)]
    )


def _gaps(least: int | None, most: int | None, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


def whole_conversations(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """Report rows of the conversations that are one chunk."""
    shared = pieces.sparkSession.sparkContext.broadcast(grammar.pairs)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = Grammar(shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                cost, audit = finish(known.walk(BEGIN, r["symbols"]))
                out, state, used = replay(audit, r["symbols"], r["roles"], r["texts"])
                out += inserted(len(audit) - used, state)[0]
                digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
                yield (
                    r["conv"], _gaps(r["least_turn"], r["most_turn"], r["turns"]), r["blank"], r["duplicate"], r["truncated"],
                    r["illegal"], cost, audit, digest,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(repaired(batches), _report_schema(), CHUNK_BYTES)

    return pieces.where("whole").mapInArrow(tidy(run), REPORT)


MATRICES = "costs array<long>, audits array<string>"


def folded_conversations(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """Report rows of the conversations of several chunks (or of one at the end of a task), folded in order of the chunks."""
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(grammar.pairs)
    parts = pieces.where("NOT whole")
    light = [c for c in parts.columns if c not in ("roles", "texts", "whole")]
    names = [c for c in light if c != "symbols"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Grammar(shared.value)
        for batch in batches:
            costs, audits = [], []
            for symbols in batch.column("symbols").to_pylist():
                matrix = [known.walk(row, symbols) for row in IDENTITY]
                costs.append([None if e is None else e[0] for row in matrix for e in row])
                audits.append([None if e is None else e[1] for row in matrix for e in row])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                [*names, "costs", "audits"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*names).schema)
    matrices = parts.select(*light).mapInArrow(tidy(measured), f"{kinds}, {MATRICES}")
    in_order = matrices.repartition("conv").sortWithinPartitions("conv", "part", "seq")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["conv"] != conv:
                    if conv is not None:
                        yield (conv, _gaps(least, most, total["turns"]), *(total[c] for c in COUNTS[:4]), *finish(row), None)
                    conv, row, total = r["conv"], BEGIN, dict.fromkeys(COUNTS, 0)
                    least = most = last_turn = None
                    last_role = None
                entries = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])]
                row = times(row, [entries[4 * i : 4 * i + 4] for i in range(4)])
                for c in COUNTS:
                    total[c] += r[c]
                if last_role is not None:
                    total["illegal"] += last_role + r["first_role"] not in LEGAL
                    total["turns"] -= r["first_turn"] is not None and r["first_turn"] == last_turn
                if r["least_turn"] is not None:
                    least = r["least_turn"] if least is None else least
                    most = r["most_turn"]
                last_role, last_turn = r["last_role"], r["last_turn"]
        if conv is not None:
            yield (conv, _gaps(least, most, total["turns"]), *(total[c] for c in COUNTS[:4]), *finish(row), None)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(folded(batches), _report_schema(), CHUNK_BYTES)

    reports = kept_table(in_order.mapInArrow(tidy(fold), REPORT), "folded")

    # The audit comes first, then the chunks in order: one pass replays and hashes.
    texts = ["conv", "part", "seq", "symbols", "roles", "texts"]
    heads = reports.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("seq"), F.col("audit").alias("symbols"))
    rows = parts.select(*texts).unionByName(heads, allowMissingColumns=True)
    in_order = rows.repartition("conv").sortWithinPartitions("conv", "part", "seq")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv = None

        def closed() -> tuple:
            for line in inserted(len(audit) - used, state)[0]:
                feed(line)
            return conv, digest.hexdigest()

        def feed(line: str) -> None:
            nonlocal empty
            digest.update(line.encode() if empty else b"\n" + line.encode())
            empty = False

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] < 0:
                    if conv is not None:
                        yield closed()
                    conv, audit, used, state, digest, empty = r["conv"], r["symbols"], 0, START, hashlib.sha256(), True
                    continue
                # Letters of this chunk: no more than its rows and two insertions before each.
                piece = audit[used : used + 3 * len(r["symbols"])]
                lines, state, more = replay(piece, r["symbols"], r["roles"], r["texts"], state)
                used += more
                for line in lines:
                    feed(line)
        if conv is not None:
            yield closed()

    digests = pa.schema([("conv", pa.string()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(hashed(batches), digests, CHUNK_BYTES)

    found = in_order.mapInArrow(tidy(run), "conv string, digest string")
    return reports.drop("repaired_sha256").join(found.withColumnRenamed("digest", "repaired_sha256"), "conv")


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    pieces = chunks(conversations, chunk_rows)
    grammar = learn(pieces)
    reports = whole_conversations(pieces, grammar).unionByName(folded_conversations(pieces, grammar))
    known = conversations.select("conv_id").distinct().withColumn("conv", conversation_key())
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return known.join(reports, "conv", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
