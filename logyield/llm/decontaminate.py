"""Benchmark decontamination with a distributed positional inverted index.

**Index.** Training texts are cut into shards of a few megabytes. A shard is one row: its distinct terms (64-bit word
hashes, sorted), for each term the sorted list of token positions, and where each text begins. Shards are built where
the texts are read: no shuffle, no term whose list could grow beyond a shard. The index is a table in the shared folder
that any number of searches can use.

**Search.** The queries (here: windows of consecutive benchmark words) come in blocks of at most ``BLOCK_WORDS`` words,
so what is broadcast is bounded however large the benchmark or one item of it is; every block reads the index once. Document frequencies of the block's terms are summed
from the index's term lists; every query's terms are ordered by them. In each shard the positions of a query's rarest
term, minus the term's offset, are its candidates; the lists of the other terms, likewise shifted, are intersected with
them from rare to frequent. All queries of the block are intersected side by side in numpy.

- ``phrase_matches``: all terms at their offsets.
- ``proximity_matches``: all distinct terms within ``span`` words around an occurrence of the rarest one, in any order.

Words are what ``words`` says: A-Z lower-cased, then runs of letters, digits and bytes beyond ASCII. Null and empty texts
have no words; they are indexed with 0 tokens and reported without hits. A benchmark item with fewer words than a window
is one window of its own, one without words is none. Repeated training rows are separate rows (``row_no`` tells them
apart), equal windows of several items are searched once and credited to each item; null ids are kept as nulls, a null
item id counts as the item 'null', rows that share an item id are one item. Extra columns are not read. Empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWERED, joined, kept_table, sequence_hashes, slices, span_hashes, texts_of, word_spans

WINDOW = 10
SPAN = 15
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 500_000


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term of every token, first token of every text and one more, byte spans of the tokens in ``joined``)."""
    buffer, text_starts = joined([t.translate(LOWERED) for t in texts])
    starts, ends = word_spans(buffer, ALNUM)
    return span_hashes(buffer, starts, ends), np.searchsorted(starts, text_starts), np.stack([starts, ends], axis=1)


# ---------------------------------------------------------------------------------------------------------------
# Index
# ---------------------------------------------------------------------------------------------------------------


def build_index(documents: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index: shard, row_nos, ids, text_starts (first token per text), terms, list_starts, positions."""
    kind = documents.schema[key].dataType.simpleString()
    schema = (
        f"shard long, row_nos array<bigint>, ids array<{kind}>, text_starts binary, terms binary, list_starts binary,"
        " positions binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row_no = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("id")), texts_of(batch, "text")
            for low, high in slices(texts, shard_bytes):
                terms, first, _ = words(texts[low:high])
                order = np.argsort(terms, kind="stable").astype(np.uint32)
                listed = terms[order]
                new = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]]) if len(listed) else np.zeros(0, np.int64)
                blobs = [first.astype(np.int32), listed[new], np.append(new, len(listed)).astype(np.int32), order]
                size = high - low
                one = pa.array([0, size], pa.int32())
                columns = [
                    pa.array([shard], pa.int64()),
                    pa.ListArray.from_arrays(one, pa.array(np.arange(row_no, row_no + size))),
                    pa.ListArray.from_arrays(one, pa.concat_arrays([ids.slice(low, size)])),
                    *(pa.array([b.tobytes()], pa.binary()) for b in blobs),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["shard", "row_nos", "ids", "text_starts", "terms", "list_starts", "positions"]
                )
                shard += 1
                row_no += size

    return kept_table(documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema), "postings")


@dataclass
class Shard:
    row_nos: np.ndarray
    ids: pa.Array
    text_starts: np.ndarray
    terms: np.ndarray
    list_starts: np.ndarray
    positions: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, row: int) -> Shard:
        def column(name: str) -> pa.Array:
            return batch.column(batch.schema.get_field_index(name))

        def numbers(name: str, dtype) -> np.ndarray:
            return np.frombuffer(column(name)[row].as_py(), dtype)

        return cls(
            column("row_nos")[row].values.to_numpy(), column("ids")[row].values, numbers("text_starts", np.int32),
            numbers("terms", np.uint64), numbers("list_starts", np.int32), numbers("positions", np.uint32),
        )

    def text_of(self, token: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.text_starts, token, side="right") - 1


# ---------------------------------------------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------------------------------------------


@dataclass
class Queries:
    """Distinct windows: row q of ``terms`` has ``lengths[q]`` terms; ``items`` of window q are item numbers."""

    terms: np.ndarray
    lengths: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray
    names: list[str]


def windows(items: list[tuple[object, str]], size: int = WINDOW) -> Queries:
    """Windows of ``size`` consecutive words of each item; items of fewer words are one window."""
    texts = [(text or "").encode("utf-8") for _, text in items]
    terms, first, _ = words(texts)
    numbers: dict[str, int] = {}  # items of one id are one item
    found: dict[bytes, list[int]] = {}
    for row, (key, _) in enumerate(items):
        item = numbers.setdefault("null" if key is None else str(key), len(numbers))
        own = terms[first[row] : first[row + 1]]
        for start in range(max(1, len(own) - size + 1) if len(own) else 0):
            found.setdefault(own[start : start + size].tobytes(), []).append(item)
    table = np.zeros((len(found), size), np.uint64)
    lengths = np.zeros(len(found), np.int64)
    for q, raw in enumerate(found):
        lengths[q] = len(raw) // 8
        table[q, : lengths[q]] = np.frombuffer(raw, np.uint64)
    owners = [sorted(set(v)) for v in found.values()]
    starts = np.r_[0, np.cumsum([len(v) for v in owners])].astype(np.int64)
    return Queries(table, lengths, starts, np.array([i for v in owners for i in v], np.int64), list(numbers))


def parts_of_item(text: str, size: int, most: int) -> Iterator[tuple[str, int]]:
    """(part, its words): the whole item, or parts of at most ``most`` words that share ``size - 1`` words with the next
    one, so that every window of ``size`` words is in exactly one of them."""
    raw = text.encode("utf-8")
    spans = words([raw])[2]
    if len(spans) <= most:
        yield text, len(spans)
        return
    for begin in range(0, len(spans) - size + 1, most - size + 1):
        part = spans[begin : begin + most]
        yield raw[part[0, 0] : part[-1, 1]].decode("utf-8"), len(part)


def blocks_of_items(
    items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW, most: int | None = None
) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of at most ``most`` words (BLOCK_WORDS), read one after the other; longer items are in several."""
    most = max(most or BLOCK_WORDS, size)
    block, held = [], 0
    for row in items.select(key, text).toLocalIterator():
        for part, n in parts_of_item(row[1] or "", size, most):
            n = max(1, n)
            if held + n > most:
                yield block
                block, held = [], 0
            block.append((row[0], part))
            held += n
    if block:
        yield block


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How many tokens of the corpus each of the (sorted, bounded) ``wanted`` terms has."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, starts = np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.int32)
                at, there = look_up(terms, shared.value)
                total[there] += np.diff(starts)[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counted = index.select("terms", "list_starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(wanted), np.int64)
    for row in counted.toLocalIterator():  # at most the block's terms
        out[row["term"]] = row["n"]
    return out


def look_up(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``sorted_keys``, whether it is there) of each wanted key."""
    at = np.searchsorted(sorted_keys, wanted)
    if not len(sorted_keys):
        return at, np.zeros(len(wanted), bool)
    at = np.minimum(at, len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def rare_first(queries: Queries, index: DataFrame) -> np.ndarray:
    """For every query its offsets ordered from the rarest term on (unused offsets last)."""
    wanted = np.unique(queries.terms)
    if not len(wanted):
        return np.zeros(queries.terms.shape, np.int64)
    frequency = document_frequencies(index, wanted)[np.searchsorted(wanted, queries.terms)].astype(np.float64)
    frequency[np.arange(queries.terms.shape[1])[None, :] >= queries.lengths[:, None]] = np.inf
    return np.argsort(frequency, axis=1, kind="stable")


def postings(shard: Shard, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``terms``, position) for all postings of the terms, in this order."""
    at, there = look_up(shard.terms, terms)
    begin = np.where(there, shard.list_starts[at] if len(shard.terms) else 0, 0).astype(np.int64)
    size = np.where(there, shard.list_starts[at + 1] - begin if len(shard.terms) else 0, 0).astype(np.int64)
    owner = np.repeat(np.arange(len(terms)), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return owner, shard.positions[begin[owner] + within].astype(np.int64)


def phrase_matches(shard: Shard, queries: Queries, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, first token) of every place where a query's terms stand at their offsets within one text."""
    rows = np.arange(len(queries.lengths))
    if not len(rows):
        return rows, rows
    query, position = postings(shard, queries.terms[rows, order[:, 0]])
    start = position - order[query, 0]
    end = start + queries.lengths[query] - 1
    fits = (start >= 0) & (end < (shard.text_starts[-1] if len(shard.text_starts) else 0))
    query, start, end = query[fits], start[fits], end[fits]
    same = shard.text_of(start) == shard.text_of(end)
    query, start = query[same], start[same]
    for k in range(1, queries.terms.shape[1]):
        if not len(query):
            break
        more = queries.lengths[query] > k
        offset = order[query, k]
        term = queries.terms[query, offset]
        holds = ~more
        distinct, code = np.unique(term[more], return_inverse=True)
        owner, place = postings(shard, distinct)
        listed = owner * (1 << 32) + place  # ascending: lists one after the other, each in order
        _, there = look_up(listed, code * (1 << 32) + (start + offset)[more])
        holds[more] = there
        query, start = query[holds], start[holds]
    return query, start


def proximity_matches(shard: Shard, queries: Queries, order: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(query, first token of the span) where ``span`` consecutive words of one text hold all terms of a query.

    Spans are tried around every occurrence of the query's rarest term; each such occurrence counts at most once.
    """
    rows = np.arange(len(queries.lengths))
    if not len(rows):
        return rows, rows
    anchor_query, anchor = postings(shard, queries.terms[rows, order[:, 0]])
    text = shard.text_of(anchor)
    low, high = shard.text_starts[text].astype(np.int64), shard.text_starts[text + 1].astype(np.int64)
    # one candidate per place of the span around the anchor
    shift = np.arange(span)
    start = (anchor[:, None] - shift[None, :]).ravel()
    which = np.repeat(np.arange(len(anchor)), span)
    inside = start >= low[which]
    start, which = start[inside], which[inside]
    for k in range(1, queries.terms.shape[1]):
        if not len(which):
            break
        query = anchor_query[which]
        more = queries.lengths[query] > k
        term = queries.terms[query, order[query, k]]
        distinct, code = np.unique(term[more], return_inverse=True)
        owner, place = postings(shard, distinct)
        listed = owner * (1 << 32) + place
        wanted = code * (1 << 32) + start[more]
        at = np.searchsorted(listed, wanted)
        found = np.append(listed, np.iinfo(np.int64).max)[at]
        limit = np.minimum(start + span, high[which])[more] + code * (1 << 32)
        holds = ~more
        holds[more] = found < limit
        start, which = start[holds], which[holds]
    best = np.full(len(anchor), -1)
    best[which[::-1]] = start[::-1]
    some = np.flatnonzero(best >= 0)
    return anchor_query[some], best[some]


# ---------------------------------------------------------------------------------------------------------------
# Results
# ---------------------------------------------------------------------------------------------------------------

MATCHES = "row_no long, id {kind}, item_id string, first_word long, n_words long, exact boolean"


def _index_kind(index: DataFrame) -> str:
    return index.schema["ids"].dataType.elementType.simpleString()


def matches(index: DataFrame, items: DataFrame, size: int = WINDOW, span: int = SPAN) -> DataFrame:
    """Every exact phrase match and every proximity match: row_no, id, item_id, first_word, n_words, exact."""
    out = index.sparkSession.createDataFrame([], MATCHES.format(kind=_index_kind(index)))
    for block in blocks_of_items(items, size=size):
        queries = windows(block, size)
        shared = index.sparkSession.sparkContext.broadcast((queries, rare_first(queries, index)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries, order = shared.value
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = Shard.read(batch, row)
                    for exact in (True, False):
                        found = phrase_matches(shard, queries, order) if exact else proximity_matches(shard, queries, order, span)
                        query, start = found
                        count = np.diff(queries.item_starts)[query]
                        each = np.repeat(np.arange(len(query)), count)
                        within = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                        item = queries.items[queries.item_starts[query[each]] + within]
                        text = shard.text_of(start[each])
                        length = queries.lengths[query[each]] if exact else np.full(len(each), span)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.row_nos[text]), shard.ids.take(pa.array(text)),
                             pa.array([queries.names[i] for i in item], pa.string()),
                             pa.array(start[each] - shard.text_starts[text]), pa.array(length.astype(np.int64)),
                             pa.array(np.full(len(each), exact))],
                            ["row_no", "id", "item_id", "first_word", "n_words", "exact"],
                        )

        out = out.unionByName(index.mapInArrow(run, MATCHES.format(kind=_index_kind(index))))
    return out


REPORT = "row_no long, id {kind}, n_words long, starts array<bigint>, lengths array<bigint>, items array<string>, near array<string>"


def _report_block(index: DataFrame, queries: Queries, order: np.ndarray, span: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((queries, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, order = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard.read(batch, row)
                n = len(shard.row_nos)
                query, start = phrase_matches(shard, queries, order)
                text = shard.text_of(start)
                near_query, near_start = proximity_matches(shard, queries, order, span)
                in_text = np.argsort(text, kind="stable")
                bounds = np.searchsorted(text[in_text], np.arange(n + 1))
                columns = [
                    pa.array(shard.row_nos), shard.ids, pa.array(np.diff(shard.text_starts).astype(np.int64)),
                    _lists(bounds, pa.array((start - shard.text_starts[text])[in_text])),
                    _lists(bounds, pa.array(queries.lengths[query][in_text])),
                    _items_per_text(queries, text, query, n),
                    _items_per_text(queries, shard.text_of(near_start), near_query, n),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row_no", "id", "n_words", "starts", "lengths", "items", "near"])

    return index.mapInArrow(run, REPORT.format(kind=_index_kind(index)))


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _items_per_text(queries: Queries, text: np.ndarray, query: np.ndarray, n: int) -> pa.Array:
    """The distinct items that own a matching window, per text."""
    pairs = np.unique(text.astype(np.int64) * max(1, len(queries.lengths)) + query)
    text, query = np.divmod(pairs, max(1, len(queries.lengths)))
    count = np.diff(queries.item_starts)[query]
    each = np.repeat(np.arange(len(query)), count)
    within = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    item = queries.items[queries.item_starts[query[each]] + within]
    both = np.unique(text[each] * max(1, len(queries.names)) + item)
    text, item = np.divmod(both, max(1, len(queries.names)))
    return _lists(np.searchsorted(text, np.arange(n + 1)), pa.array([queries.names[i] for i in item], pa.string()))


def report(index: DataFrame, items: DataFrame, size: int = WINDOW, span: int = SPAN) -> DataFrame:
    """Per training row: row_no, id, n_words, n_hit (words inside a match), items and near (lists of item ids)."""
    parts, blocks = None, 0
    for block in blocks_of_items(items, size=size):
        queries = windows(block, size)
        part = _report_block(index, queries, rare_first(queries, index), span)
        parts, blocks = part if parts is None else parts.unionByName(part), blocks + 1
    if parts is None:
        parts = _report_block(index, windows([], size), np.zeros((0, size), np.int64), span)
    kind = _index_kind(index)
    if blocks > 1:  # a row's findings of all blocks; a row has as many as there are blocks
        parts = parts.groupBy("row_no").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("lengths")).alias("lengths"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
        )

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pa.Table.from_batches([batch])
            n_hit, digests = [], []
            columns = (frame.column(c).to_pylist() for c in ("starts", "lengths", "items"))
            for starts, lengths, item_ids in zip(*columns):
                hit, upto = 0, 0
                for start, length in sorted(zip(starts, lengths)):
                    hit += max(0, start + length - max(start, upto))
                    upto = max(upto, start + length)
                n_hit.append(hit)
                digests.append(hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest())
            out = frame.select(["row_no", "id", "n_words", "items", "near"])
            out = out.append_column("n_hit", pa.array(n_hit, pa.int64()))
            yield from out.append_column("items_sha256", pa.array(digests, pa.string())).to_batches()

    schema = f"row_no long, id {kind}, n_words long, items array<string>, near array<string>, n_hit long, items_sha256 string"
    return parts.mapInArrow(covered, schema)
