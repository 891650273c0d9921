"""Packing of tokenised documents into sequences of a fixed length by dominance reduction and best fit.

Every document becomes its token ids plus an end id; one longer than a sequence is cut into full pieces, the first piece
taking what is left over. A *bin* is a sequence, an *item* a piece of at most ``capacity`` tokens. Only the lengths
matter, and there are at most ``capacity`` of them, so the instance is a histogram:

1. **Reduction** (Martello and Toth). Walk the lengths from the longest. A set of items holding the current one
   *dominates* when every other feasible set can trade its items for it without needing more bins. Three cases are
   decided from the histogram and fixed for good, as many bins at once as there are such items:
   - no remaining item fits beside it: the item alone;
   - one item fills the bin exactly: the pair, as whatever else went beside it fits in that item's place;
   - at most two items fit beside it and the best single one is at least as long as the best two: that pair.
   Sets of three, which the full procedure also fixes under a condition of their own, are left to the second step.
2. **Best fit decreasing** of the rest, on groups of bins with equal room instead of single bins.

The result is a list of patterns (how many items of which lengths share a bin, how many bins). Its size depends on
``capacity`` alone, so the driver solves it and every task gets it by broadcast. Items find their bin by their rank
among the items of their length: a local rank per batch plus the batch's offset from one window over batch counts.

Null texts are empty documents (one end id). Rows are packed one by one, so repeated rows, repeated or null ids each get
their own pieces; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FACTOR_INVERSE, BYTE_VALUES, joined, kept_table, mix, powers, slices, texts_of

CAPACITY = 1024
END_ID = 2
#: Distinct text units, and ids of them, that a worker remembers before it starts anew.
REMEMBERED_UNITS = 600_000
REMEMBERED_IDS = 1 << 23
PIECES = "batch long, row_no long, doc_id {id_type}, piece int, start long, length int, ids_crc32 long, local_rank int"

#: UTF-8 forms of blanks beyond ASCII (fixed values: the White_Space property).
WIDE_BLANKS = (
    b"\xc2\x85 \xc2\xa0 \xe1\x9a\x80 \xe2\x80\x80 \xe2\x80\x81 \xe2\x80\x82 \xe2\x80\x83 \xe2\x80\x84 \xe2\x80\x85 \xe2\x80\x86"
    b" \xe2\x80\x87 \xe2\x80\x88 \xe2\x80\x89 \xe2\x80\x8a \xe2\x80\xa8 \xe2\x80\xa9 \xe2\x80\xaf \xe2\x81\x9f \xe3\x80\x80"
).split(b" ")
BLANK = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


#: How byte-level vocabularies split text before merging (fixed value).
SPLITTING = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_UNIT = 10_000


def byte_letters() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte, back to the byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class UnitTokenizer:
    """Token ids of whole texts, encoding each distinct unit once.

    A unit starts with a run of blanks and ends before the next such run. The tokenizer's own splitting always breaks
    where a blank follows a non-blank, so ids of units side by side are the ids of the text. Texts with blanks beyond
    ASCII are encoded as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: number for number, t in self.tokenizer.get_added_tokens_decoder().items()}
        plain = {token: number for token, number in self.tokenizer.get_vocab().items() if token not in added}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): number for token, number in plain.items()}
        #: The same vocabulary and merges, several times as fast on words not met before.
        self.fast = tiktoken.Encoding("units", pat_str=SPLITTING, mergeable_ranks=ranks, special_tokens=added)
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, number in ranks.items():
            self.token_bytes[number] = len(token)
        for token, number in added.items():
            self.token_bytes[number] = len(token.encode("utf-8"))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.bounds = np.zeros(1 << 17, np.int64)  # unit k has ids[bounds[k]:bounds[k + 1]]

    def _learn(self, units: list[bytes], hashes: list[int]) -> None:
        """Encodes new units: those that start, but do not end, with a blank side by side, as one text; the others (first
        words, blanks at a text's end) and long ones singly."""
        easy = [BLANK[u[0]] and not BLANK[u[-1]] and len(u) <= LONG_UNIT for u in units]
        side_by_side = [k for k, e in enumerate(easy) if e]
        alone = [k for k, e in enumerate(easy) if not e]
        text = b"".join(units[k] for k in side_by_side).decode("utf-8")
        together = self.fast.encode_to_numpy(text, allowed_special="all")
        upto = np.r_[0, np.cumsum(self.token_bytes[together])]
        unit_ends = np.cumsum([len(units[k]) for k in side_by_side], dtype=np.int64)
        breaks = np.searchsorted(upto, unit_ends)
        if not np.array_equal(upto[np.minimum(breaks, len(upto) - 1)], unit_ends):  # a token crosses two units
            side_by_side, alone = [], list(range(len(units)))
            together, breaks = together[:0], breaks[:0]
        order = np.array(side_by_side + alone, np.int64)
        singly = self.tokenizer.encode_batch([units[k].decode("utf-8") for k in alone], add_special_tokens=False)
        lengths = np.r_[np.diff(breaks, prepend=0), [len(e.ids) for e in singly]].astype(np.int64)
        ids = np.concatenate([together, *(np.array(e.ids, np.uint32) for e in singly)])
        hashes = [hashes[k] for k in order]
        known = len(self.known)
        at, total = int(self.bounds[known]), len(ids)
        if at + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        if known + len(units) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(max(len(self.bounds), len(units)), np.int64)])
        self.ids[at : at + total] = ids
        self.bounds[known + 1 : known + 1 + len(units)] = at + np.cumsum(lengths)
        self.known.update(zip(hashes, range(known, known + len(units))))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        plain = [i for i, t in enumerate(texts) if t and not any(w in t for w in WIDE_BLANKS)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        rest = {i for i, t in enumerate(texts) if t} - set(plain)
        for i in rest:
            ids = self.tokenizer.encode(texts[i].decode("utf-8"), add_special_tokens=False).ids
            out[i] = np.array(ids, np.uint32)
        if not plain:
            return out
        chosen = [texts[i] for i in plain]
        buffer, text_starts = joined(chosen)
        blank = BLANK[buffer]
        starting = np.zeros(len(buffer), bool)
        starting[1:] = blank[1:] & ~blank[:-1]
        starting[text_starts[1:] - 1] = False  # the line feeds between texts belong to none
        starting[text_starts[:-1]] = True
        starts = np.flatnonzero(starting)
        text_of = np.searchsorted(text_starts, starts, side="right") - 1
        ends = np.append(starts[1:], len(buffer))
        last = np.append(text_of[1:] != text_of[:-1], True)
        ends[last] = text_starts[text_of[last] + 1] - 1
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[buffer] * powers(len(buffer)), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(len(buffer) + 1, FACTOR_INVERSE)[starts])
        codes, distinct = pd.factorize(hashes)
        if len(self.known) > REMEMBERED_UNITS or self.bounds[len(self.known)] > REMEMBERED_IDS:
            self._forget()
        values = distinct.tolist()
        new = [k for k, h in enumerate(values) if h not in self.known]
        if new:
            first = np.zeros(len(values), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = buffer.tobytes()
            where = first[new]
            spans = zip(starts[where].tolist(), ends[where].tolist())
            self._learn([raw[a:b] for a, b in spans], [values[k] for k in new])
        unit = np.fromiter((self.known[h] for h in values), np.int64, len(values))[codes]
        begin = self.bounds[unit]
        size = self.bounds[unit + 1] - begin
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        bounds = upto[np.searchsorted(text_of, np.arange(len(chosen) + 1))]
        for k, i in enumerate(plain):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        return out


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids; only the first may be shorter than a bin."""
    head = length % capacity or capacity
    return [(0, min(head, length))] + [(s, capacity) for s in range(head, length, capacity)]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their rank among the equally long pieces of their batch (stored)."""
    id_type = documents.schema["doc_id"].dataType
    schema = PIECES.format(id_type=id_type.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitTokenizer(tokenizer)
        number, row_no = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_column = batch.column(batch.schema.get_field_index("doc_id"))
            texts = texts_of(batch)
            rows, piece, start, length, crc = [], [], [], [], []
            for low, high in slices(texts):
                for k, ids in enumerate(encoder.encode(texts[low:high]), low):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for p, (s, n) in enumerate(cut(len(ids), capacity)):
                        rows.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            sizes = np.array(length, np.int64)
            order = np.argsort(sizes, kind="stable")
            new = np.r_[True, np.diff(sizes[order]) != 0] if len(order) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order)) - begin
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), number)),
                    pa.array(np.array(rows, np.int64) + row_no),
                    ids_column.take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array(crc, pa.int64()),
                    pa.array(rank, pa.int32()),
                ],
                names=["batch", "row_no", "doc_id", "piece", "start", "length", "ids_crc32", "local_rank"],
            )
            number += 1
            row_no += len(texts)

    return kept_table(documents.select("doc_id", "text").mapInArrow(run, schema), "pieces")


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many in a bin), ...), bins


def reduce_instance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fixes dominating sets, longest items first; ``counts[s]`` (items of length s) loses the fixed items."""
    fixed: list[Pattern] = []

    def lengths(limit: int) -> np.ndarray:
        return np.flatnonzero(counts[: limit + 1]) if limit > 0 else np.zeros(0, np.int64)

    for size in range(capacity, 0, -1):
        while counts[size]:
            room = capacity - size
            counts[size] -= 1  # the current item itself is not a candidate
            fitting = lengths(room)  # longer ones too, if they could not be fixed
            counts[size] += 1
            if not len(fitting):
                fixed.append((((size, 1),), int(counts[size])))
                counts[size] = 0
                break
            best = int(fitting[-1])
            if best < room and not _single_dominates(counts, size, best, room, fitting):
                break
            bins = int(counts[size] // 2 if best == size else min(counts[size], counts[best]))
            fixed.append(((((size, 2),) if best == size else ((size, 1), (best, 1))), bins))
            counts[size] -= bins
            counts[best] -= bins
    return fixed


def _single_dominates(counts: np.ndarray, size: int, best: int, room: int, fitting: np.ndarray) -> bool:
    """Whether {size, best} dominates: at most two items fit beside ``size``, and no two exceed ``best``."""
    left = counts[fitting] - (fitting == size)
    smallest = np.repeat(fitting, np.minimum(left, 3))[:3]
    if len(smallest) >= 3 and smallest.sum() <= room:
        return False
    if len(smallest) < 2 or smallest[:2].sum() > room:
        return True
    for k, a in enumerate(fitting):  # every pair that fits, by its longer item
        others = fitting[: np.searchsorted(fitting, room - a, side="right")]
        others = others[others <= a]
        if len(others) and others[-1] == a and left[k] < 2:
            others = others[:-1]
        if len(others) and a + others[-1] > best:
            return False
    return True


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit decreasing on groups of bins with equal room; empties ``counts``."""
    by_room: dict[int, list[list]] = {}  # room → [content, bins]
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        counts[size] = 0
        for room in sorted(r for r in by_room if r >= size):
            each = room // size
            groups = by_room.pop(room)
            kept = []
            for content, bins in groups:
                full = min(bins, left // each)
                if full:
                    by_room.setdefault(room - each * size, []).append([content + ((size, each),), full])
                    left -= full * each
                some = left if full < bins else 0
                if some:
                    by_room.setdefault(room - some * size, []).append([content + ((size, some),), 1])
                    left = 0
                if bins - full - bool(some):
                    kept.append([content, bins - full - bool(some)])
            if kept:
                by_room.setdefault(room, []).extend(kept)
            if not left:
                break
        if left:
            each = capacity // size
            if left // each:
                by_room.setdefault(capacity - each * size, []).append([((size, each),), left // each])
            if left % each:
                by_room.setdefault(capacity - left % each * size, []).append([((size, left % each),), 1])
    return [(content, bins) for groups in by_room.values() for content, bins in groups]


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that pack ``counts[s]`` items of each length s into bins of ``capacity``."""
    counts = counts.copy()
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, ranks, items per bin, first bin, offset), sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for content, bins in patterns:
        offset = 0
        for size, each in content:
            first = taken.get(size, 0)
            rows.append((size, first, each * bins, each, base, offset))
            taken[size] = first + each * bins
            offset += size * each
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, row_no (tells equal ids apart)."""
    cutting = pieces(documents, tokenizer, capacity, end_id)
    per_batch = cutting.groupBy("length", "batch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept_table(
        per_batch.select("length", "batch", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "piece-offsets"
    )
    counts = np.zeros(capacity + 1, np.int64)
    for row in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    chosen = documents.sparkSession.sparkContext.broadcast(slots(solve(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, ranks, each, base, offset = chosen.value.T.copy()
        for batch in batches:
            frame = pa.Table.from_batches([batch])
            length = frame.column("length").to_numpy().astype(np.int64)
            rank = frame.column("rank").to_numpy()
            stride = np.int64(1) << 40
            slot = np.searchsorted(size * stride + first, length * stride + rank, side="right") - 1
            within = rank - first[slot]
            out = frame.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(base[slot] + within // each[slot]))
            out = out.append_column("offset", pa.array(offset[slot] + within % each[slot] * length))
            yield from out.to_batches()

    kinds = dict(cutting.dtypes)
    # One row per length and batch grows with the data: never broadcast, however small its file looks.
    ranked = cutting.join(offsets.select("length", "batch", "first").hint("merge"), ["length", "batch"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "row_no",
        (F.col("first") + F.col("local_rank")).alias("rank"),
    )
    schema = (
        f"doc_id {kinds['doc_id']}, piece int, start long, length long, ids_crc32 long, row_no long,"
        " sequence_id long, offset long"
    )
    return ranked.mapInArrow(place, schema)
