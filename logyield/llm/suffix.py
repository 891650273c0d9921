"""Removal of long passages that an earlier document has too, with run-length indexes (r-index).

Every byte covered by a ``length``-byte string that also starts in a document with a smaller id goes. Strings are judged
on the input, never on what is left, and never cross documents.

1. **Distinct texts.** Equal texts are one text of their smallest id; a copy of at least ``length`` bytes is removed whole.
   Only texts whose digest may occur twice (a bit table of fixed size tells) are shuffled for it. The distinct texts are
   stored as *shards* of about a megabyte.
2. **Anchors.** Each window of ``length`` bytes names one place in it, its *anchor*: the start of the least-hashed gram
   (the leftmost of equals). Equal windows have equal anchors at equal places, and consecutive windows mostly share
   one. Anchors, each once per shard with its number of texts, meet in groups; those of one text only are done.
3. **r-index per bucket.** For each anchor of several texts, the bytes of its windows travel as one *context* (at most
   2 * length - gram bytes). Buckets travel in groups, so that small rows do not multiply with shards times buckets, and
   are judged one by one. A bucket's distinct contexts form a text whose suffixes are sorted; kept of it are the
   run-length Burrows-Wheeler transform as a move structure (run starts, run heads, where each run's first row maps to),
   suffix samples at both ends of each run, and per suffix class of ``length`` bytes the least document id.
   Contexts stream through it from right to left: while the run head equals the next byte the row maps on, else it jumps
   to the nearer run of that byte (the neighbour with the longer common extension). The pointer carried along is an
   occurrence of the longest match at each place; a window of full length whose class has a smaller id is marked.
4. **Removal.** Marks go back to their shard as (place, bits), are widened to bytes and cut out.

Hot passages: an anchor of more than ``HOT_TEXTS`` texts deals its windows out one by one, by the hash of the whole window,
instead of meeting in one bucket. Equal ones meet in three steps: within their shard, then within the square root of the
number of shards, where all but those of the least id are marked, then the rest. So of a window that every shard has, a
bucket holds the square root of the number of shards, whatever number of documents share it.

Ids are integers. A null id is neither smaller nor larger than any: such rows are kept whole and are no source. Rows that
repeat an id do not remove each other. Null and empty texts have 0 bytes; texts shorter than ``length`` are kept whole.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BYTE_VALUES, FACTOR, FACTOR_INVERSE, aggregate_salted, joined, kept_table, mix, powers, salt_of, shuffle_width, slices, suspects,
    texts_of, tidy, tidy_group,
)

LENGTH = 50
SHARD_BYTES = 1 << 20
HOT_TEXTS = 4096
BUCKET_BYTES = 800_000
GROUP_BUCKETS = 16  # buckets that travel together: a shard has a row for each group, not for each bucket
PIECE = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------------------------------------------------------
# Anchors and contexts
# ---------------------------------------------------------------------------------------------------------------


def gram_of(length: int) -> int:
    """Length of an anchor's gram: long enough to be rare, short enough that few windows lack a common one."""
    return max(1, length // 2 - 1)


def gram_hashes(piece: np.ndarray, gram: int) -> np.ndarray:
    """Hash of piece[i : i + gram] for every i, by doubling."""
    out, done = None, 0
    power, size = BYTE_VALUES[piece], 1
    rest = gram
    while rest:
        if rest & 1:
            if out is None:
                out, done = power, size
            else:
                n = len(piece) - done - size + 1
                out = out[:n] * np.uint64(pow(FACTOR, size, 1 << 64)) + power[done : done + n]
                done += size
        rest >>= 1
        if rest:
            n = len(piece) - 2 * size + 1
            power = power[:n] * np.uint64(pow(FACTOR, size, 1 << 64)) + power[size : size + n]
            size *= 2
    return mix(out)


@dataclass
class Anchors:
    """Runs of windows [first, last] (starts in the buffer) with one anchor; ``text`` is the text's number."""

    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray


def anchors(buffer: np.ndarray, text_starts: np.ndarray, length: int = LENGTH) -> Anchors:
    """All windows of ``joined`` texts (each followed by one byte that is not the text's)."""
    gram = gram_of(length)
    span = length - gram + 1
    hashes, firsts, lasts = [], [], []
    total = len(buffer) - length + 1
    ends = text_starts[1:] - 1
    some = np.flatnonzero(ends - text_starts[:-1] >= length)
    valid = np.zeros(max(0, total) + 1, np.int8)
    np.add.at(valid, text_starts[some], 1)
    np.add.at(valid, ends[some] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    for low in range(0, total, PIECE):
        high = min(low + PIECE, total)
        hashed = gram_hashes(buffer[low : high + length - 1], gram)
        least = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if span - size:
            least = np.minimum(least[: -(span - size)], least[span - size :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place[~valid[low:high]] = -1
        begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        end = np.r_[begin[1:], len(place)] - 1
        real = place[begin] >= 0
        begin, end = begin[real], end[real]
        hashes.append(hashed[place[begin]])
        firsts.append(begin + low)
        lasts.append(end + low)
    if not hashes:
        empty = np.zeros(0, np.int64)
        return Anchors(empty.view(np.uint64), empty, empty, empty)
    first = np.concatenate(firsts)
    text = np.searchsorted(text_starts, first, side="right") - 1
    return Anchors(np.concatenate(hashes), first, np.concatenate(lasts), text)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for ``size[0]`` places, then the same from begin[1] on, and so on."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - size), size)


# ---------------------------------------------------------------------------------------------------------------
# Run-length index
# ---------------------------------------------------------------------------------------------------------------


class RunLengthIndex:
    """r-index of a set of distinct contexts with a least document id per ``length``-byte suffix class.

    Position p of the text is a byte (code 1 to 256) or the end of a context (code 0). Ends sort by context number,
    before all bytes, which makes the order of the suffixes total.
    """

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int = LENGTH):
        n = len(sizes)
        total = int(sizes.sum()) + n
        starts = np.cumsum(sizes + 1) - sizes - 1
        self.starts, self.sizes = starts, sizes
        text = np.zeros(total, np.int32)
        text[ragged(starts, sizes)] = contexts.astype(np.int32) + 1
        self.text = text
        left = np.repeat(starts + sizes, sizes + 1) - np.arange(total)  # bytes up to the context's end
        context = np.repeat(np.arange(n), sizes + 1)
        self.left = left.astype(np.int32)

        # Ranks of suffixes by their first 1, 2, 4, ... bytes; a shorter rest counts as filled up with ends.
        self.depths, self.ranks = [1], [text]
        depth, longest = 1, int(sizes.max()) if n else 0
        while depth < longest:
            rank = self.ranks[-1]
            behind = np.where(left >= depth, rank[np.minimum(np.arange(total) + depth, total - 1)], 0)
            self.ranks.append(_ranked(rank, behind))
            depth *= 2
            self.depths.append(depth)
        rank = self.ranks[-1].astype(np.int64)
        self.suffixes = _ordered(rank, context)

        # Classes of equal length-byte strings are neighbours in this order; each gets its least id.
        half = max(d for d in self.depths if d <= length) if n else 1
        table = self.ranks[self.depths.index(half)]
        sa = self.suffixes
        full = left[sa] >= length
        second = np.minimum(sa + length - half, total - 1)
        same = np.zeros(total, bool)
        same[1:] = full[1:] & full[:-1] & (table[sa][1:] == table[sa][:-1]) & (table[second][1:] == table[second][:-1])
        heads = np.flatnonzero(~same)
        least = np.minimum.reduceat(owners[context[sa]], heads) if total else np.zeros(0, np.int64)
        self.owner = np.full(total, np.iinfo(np.int64).max)
        self.owner[sa] = np.repeat(least, np.diff(np.r_[heads, total]))
        self.owner[left < length] = np.iinfo(np.int64).max

        # Run-compressed transform, suffix samples at run ends, and the move structure of the last-to-first mapping.
        before = text[sa - 1]  # the first context is preceded by the last one's end
        self.run_starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if total else np.zeros(0, np.int64)
        self.heads = before[self.run_starts]
        run_ends = np.r_[self.run_starts[1:], total] - 1
        self.first_sample, self.last_sample = sa[self.run_starts], sa[run_ends]
        order = np.argsort(self.heads, kind="stable")
        lengths = run_ends - self.run_starts + 1
        target = np.empty(len(order), np.int64)
        target[order] = np.cumsum(lengths[order]) - lengths[order]
        self.run_target = target  # row that a run's first row maps to; the others follow it
        self.target_run = np.repeat(np.arange(len(order)), lengths)[target]
        self.by_head = self.heads[order].astype(np.int64) * (len(order) + 1) + order  # ascending: head, then run
        self.run_starts = np.r_[self.run_starts, total]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of two suffixes, within their contexts."""
        out = np.zeros(len(a), np.int64)
        for depth, rank in zip(reversed(self.depths), reversed(self.ranks)):
            x, y = a + out, b + out
            out += np.where((rank[x] == rank[y]) & (self.left[x] >= depth) & (self.left[y] >= depth), depth, 0)
        return out

    def whole(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffixes have ``length`` bytes in common, within their contexts."""
        half = max(k for k, depth in enumerate(self.depths) if depth <= length)
        rank, on = self.ranks[half], length - self.depths[half]
        out = (self.left[a] >= length) & (self.left[b] >= length) & (rank[a] == rank[b])
        some = np.flatnonzero(out)
        out[some] = rank[a[some] + on] == rank[b[some] + on]
        return out

    def _map(self, row: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, run) of the suffix one byte longer."""
        row = self.run_target[run] + row - self.run_starts[run]
        run = self.target_run[run]
        # Mostly the target run; a row further on may be any number of runs away.
        beyond = np.flatnonzero(row >= self.run_starts[run + 1])
        run[beyond] += 1
        beyond = beyond[row[beyond] >= self.run_starts[run[beyond] + 1]]
        run[beyond] = np.searchsorted(self.run_starts, row[beyond], side="right") - 1
        return row, run

    def matching_statistics(self, queries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For every place of the queries (one after the other) an occurrence of the longest match from there.

        The queries stream from right to left, all side by side.
        """
        starts = np.cumsum(sizes) - sizes
        pointers = np.zeros(len(queries), np.int64)
        runs = len(self.heads)
        row = np.zeros(len(sizes), np.int64)
        run = np.zeros(len(sizes), np.int64)
        pointer = np.full(len(sizes), self.suffixes[0])
        by_size = np.argsort(-sizes, kind="stable")
        for step in range(int(sizes.max()) if len(sizes) else 0):
            live = by_size[: np.searchsorted(-sizes[by_size], -step, side="left")]
            at = starts[live] + sizes[live] - 1 - step
            code = queries[at].astype(np.int64) + 1
            differs = np.flatnonzero(self.heads[run[live]] != code)
            if len(differs):
                who = live[differs]
                slot = np.searchsorted(self.by_head, code[differs] * (runs + 1) + run[who])
                after = self.by_head[np.minimum(slot, len(self.by_head) - 1)]
                prior = self.by_head[np.maximum(slot - 1, 0)]
                has_after = (slot < len(self.by_head)) & (after // (runs + 1) == code[differs])
                has_prior = (slot > 0) & (prior // (runs + 1) == code[differs])
                after, prior = after % (runs + 1), prior % (runs + 1)
                up = np.where(has_prior, self.common(self.last_sample[prior], pointer[who]), -1)
                down = np.where(has_after, self.common(self.first_sample[after], pointer[who]), -1)
                take_up = up >= down
                chosen = np.where(take_up, prior, after)
                found = has_prior | has_after
                run[who] = np.where(found, chosen, run[who])
                row[who] = np.where(found, np.where(take_up, self.run_starts[prior + 1] - 1, self.run_starts[after]), row[who])
                sample = np.where(take_up, self.last_sample[prior], self.first_sample[after])
                pointer[who] = np.where(found, sample, pointer[who])
                lost = who[~found]  # a byte that the text does not have: start anew behind it
                keep = np.ones(len(live), bool)
                keep[differs[~found]] = False
                pointers[starts[lost] + sizes[lost] - 1 - step] = self.suffixes[0]
                live, at = live[keep], at[keep]
            row[live], run[live] = self._map(row[live], run[live])
            pointer[live] -= 1
            pointers[at] = pointer[live]
        return pointers


def _ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (first, second)."""
    n = len(first)
    width = int(second.max()) + 1 if n else 1
    if n and (int(first.max()) + 1) * width <= 2 * n:  # few pairs: counted, not sorted
        key = first.astype(np.int64) * width + second
        occurs = np.bincount(key) > 0
        return (np.cumsum(occurs) - 1).astype(np.int32)[key]
    bits = max(1, int(max(first.max(), second.max()) if n else 1).bit_length())
    index_bits = max(1, (n - 1).bit_length())
    key = (first.astype(np.uint64) << np.uint64(bits)) | second.astype(np.uint64)
    if 2 * bits + index_bits <= 64:
        packed = np.sort((key << np.uint64(index_bits)) | np.arange(n, dtype=np.uint64))
        order = (packed & np.uint64((1 << index_bits) - 1)).astype(np.int64)
        ordered = packed >> np.uint64(index_bits)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    out = np.empty(n, np.int32)
    out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    # an end is 0 at every depth, so that places beyond a context compare like ends
    return out


def _ordered(rank: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Positions by rank, then by context."""
    n = len(rank)
    bits, index_bits = max(1, int(context.max() if n else 0).bit_length()), max(1, (n - 1).bit_length())
    key = (rank.astype(np.uint64) << np.uint64(bits)) | context.astype(np.uint64)
    if int(rank.max() if n else 0).bit_length() + bits + index_bits <= 64:
        packed = np.sort((key << np.uint64(index_bits)) | np.arange(n, dtype=np.uint64))
        return (packed & np.uint64((1 << index_bits) - 1)).astype(np.int64)
    return np.argsort(key, kind="stable")


def with_partners(sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """Whether a window of the context may also occur under another id: no hash of the others' windows is found twice so.

    ``sums``: running sums of the bytes' values times powers. Equal windows have equal hashes, so none that counts is lost.
    """
    windows = sizes - length + 1
    at = ragged(starts, windows)
    code, distinct = pd.factorize(mix((sums[at + length] - sums[at]) * powers(len(sums), FACTOR_INVERSE)[at]))
    low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, code, np.repeat(least, windows))
    np.maximum.at(high, code, np.repeat(most, windows))
    return np.add.reduceat((low < high)[code], np.cumsum(windows) - windows) > 0


def marked_windows(
    contexts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int = LENGTH
) -> np.ndarray:
    """For each context (with its document id) a bit per window whose bytes also occur under a smaller id.

    Only contexts with a window that may have a partner are indexed and streamed.
    """
    starts = np.cumsum(sizes) - sizes
    sums = np.zeros(len(contexts) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[contexts] * powers(len(contexts)), out=sums[1:])
    hashes = (sums[starts + sizes] - sums[starts]) * powers(len(contexts) + 1, FACTOR_INVERSE)[starts]
    code, distinct = pd.factorize(mix(hashes + sizes.astype(np.uint64)))
    first = np.zeros(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, code, owners)
    np.maximum.at(most, code, owners)
    partnered = with_partners(sums, starts[first], sizes[first], least, most, length)
    bits = np.zeros(len(code), np.uint64)
    if not partnered.any():
        return bits
    some = np.flatnonzero(partnered[code])
    code, owners = (np.cumsum(partnered) - 1)[code[some]], owners[some]
    first, least = first[partnered], least[partnered]
    own = contexts[ragged(starts[first], sizes[first])]
    index = RunLengthIndex(own, sizes[first], least, length)
    pointers = index.matching_statistics(own, sizes[first])
    begin = np.cumsum(sizes[first]) - sizes[first]
    windows = sizes[first] - length + 1
    for k in range(int(windows.max())):
        has = np.flatnonzero(windows > k)
        at = pointers[begin[has] + k]
        owner = np.full(len(first), np.iinfo(np.int64).max)
        full = index.whole(at, index.starts[has] + k, length)  # the match must be of full length
        owner[has] = np.where(full, index.owner[at], np.iinfo(np.int64).max)
        bits[some] |= (owner[code] < owners).astype(np.uint64) << np.uint64(k)
    return bits


# ---------------------------------------------------------------------------------------------------------------
# Shards
# ---------------------------------------------------------------------------------------------------------------


def text_rows(documents: DataFrame) -> DataFrame:
    """doc_id, digest (md5 of the text), n_bytes and sha256 of every row (stored)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return kept_table(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256"),
        ), "texts",
    )


def distinct_texts(documents: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """shard, ids, digests, sizes and body (compressed bytes) — every distinct text of an id and enough bytes (stored)."""
    hashed = F.xxhash64("digest").alias("hash")
    twice = (
        rows.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull())
        .groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(hashed)
    )
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    long_enough = (
        documents.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("body"))
        .select("*", hashed)
    )
    singles, copied = suspects(long_enough, kept_table(twice, "copied"), "hash")
    once = copied.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("body").alias("body"))

    def pack(salt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = (salt << 62) | (TaskContext.get().partitionId() << 30)
            squeeze = zstandard.ZstdCompressor(level=1)
            for batch in batches:
                bodies = texts_of(batch, "body")
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                digests = batch.column(batch.schema.get_field_index("digest"))
                for low, high in slices(bodies, SHARD_BYTES):
                    one = pa.array([0, high - low], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()),
                         pa.ListArray.from_arrays(one, pa.concat_arrays([ids.slice(low, high - low)])),
                         pa.ListArray.from_arrays(one, pa.concat_arrays([digests.slice(low, high - low)])),
                         pa.ListArray.from_arrays(one, pa.array([len(b) for b in bodies[low:high]], pa.int64())),
                         pa.array([squeeze.compress(b"".join(bodies[low:high]))], pa.binary())],
                        ["shard", "ids", "digests", "sizes", "body"],
                    )
                    shard += 1

        return run

    out = "shard long, ids array<bigint>, digests array<string>, sizes array<bigint>, body binary"
    shards = singles.mapInArrow(tidy(pack(0)), out).unionByName(once.select("doc_id", "digest", "body").mapInArrow(tidy(pack(1)), out))
    return kept_table(shards, "shards")


def opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, list[bytes], list[int]]:
    """(ids, texts, sizes) of a shard row."""
    sizes = batch.column(batch.schema.get_field_index("sizes"))[row].as_py()
    body = zstandard.ZstdDecompressor().decompress(batch.column(batch.schema.get_field_index("body"))[row].as_py())
    ends = np.cumsum(sizes).tolist()
    texts = [body[e - s : e] for s, e in zip(sizes, ends)]
    return batch.column(batch.schema.get_field_index("ids"))[row].values.to_numpy(), texts, sizes


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(heads, np.r_[heads[1:], len(order)]):
        yield int(ordered[a]), order[a:b]


def blob(table: pa.Table, column: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(column).to_pylist()]


def flat(table: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


# ---------------------------------------------------------------------------------------------------------------
# Spark steps
# ---------------------------------------------------------------------------------------------------------------

LOW16 = np.uint64(0xFFFF)
S16 = np.uint64(16)


def shared_anchors(shards: DataFrame, buckets: int, length: int) -> DataFrame:
    """shard, anchors (8 bytes each: 48-bit hash, then 1 if hot): the anchors that several texts have (stored)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, texts, _ = opened(batch, row)
                found = anchors(*joined(texts), length)
                once = np.unique((found.hash >> S16 << S16) | found.text.astype(np.uint64))
                hashed = once >> S16
                heads = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]]) if len(hashed) else np.zeros(0, np.int64)
                count = np.diff(np.r_[heads, len(hashed)]).astype(np.uint64)
                entries = (hashed[heads] << S16) | np.minimum(count, LOW16)
                dealt = [(b, entries[at].tobytes()) for b, at in by_bucket((hashed[heads] % np.uint64(buckets)).astype(np.int32))]
                shard = batch.column(batch.schema.get_field_index("shard"))[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in dealt], pa.int32()), pa.array([shard] * len(dealt), pa.int64()),
                     pa.array([x for _, x in dealt], pa.binary())],
                    ["bucket", "shard", "anchors"],
                )

    def meet(rows: pa.Table) -> pa.Table:
        parts = rows.column("anchors").to_pylist()
        entries = np.frombuffer(b"".join(parts), np.uint64)
        ordered = np.sort(entries)
        hashed = ordered >> S16
        heads = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]])
        total = np.add.reduceat((ordered & LOW16).astype(np.int64), heads)
        several = total > 1
        known, hot = hashed[heads][several], (total[several] > HOT_TEXTS).astype(np.uint64)
        own = entries >> S16
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        met = known[at] == own if len(known) else np.zeros(len(own), bool)
        kept = (own[met] << S16) | hot[at[met]]
        upto = np.cumsum(np.r_[0, met])[np.cumsum([0, *(len(x) // 8 for x in parts)])].tolist()
        out = [kept[a:b].tobytes() for a, b in zip(upto, upto[1:])]
        return pa.table({"shard": rows.column("shard"), "anchors": pa.array(out, pa.binary())})

    packed = shards.select("shard", "ids", "sizes", "body").mapInArrow(tidy(emit), "bucket int, shard long, anchors binary")
    met = packed.groupBy("bucket").applyInArrow(tidy_group(meet), "shard long, anchors binary")
    return kept_table(met.where(F.length("anchors") > 0), "anchors")


CONTEXTS = "group int, shift int, shard long, contexts binary, sizes binary, owners binary, places binary, parts binary, sure binary"
MARKS = "shard long, places binary, bits binary, group int, contexts binary, sizes binary, owners binary, parts binary"


def dealing(n_shared: int, width: int, length: int) -> tuple[int, int]:
    """(groups, buckets in each) for so many shared anchors: some groups a task, and few rows a shard."""
    buckets = n_shared * (length + 14) // BUCKET_BYTES + 1
    groups = max(width, min(buckets, 4 * width), -(-buckets // GROUP_BUCKETS))
    return groups, -(-buckets // groups)


def contexts(shards: DataFrame, shared: DataFrame, groups: int, split: int, length: int) -> DataFrame:
    """The windows of shared anchors, dealt by anchor (or, where hot, by window); ``sure``: marked within the shard.

    Bucket b is part b // groups of group b % groups; ``parts`` says the part of each context, doubled, and one more if
    it is a hot window. The others have all their equals in their bucket. Hot windows meet there with those of shards of the
    same salt; ``shift`` buckets before is where those of all shards meet. A shard has at most one row per group.
    """
    buckets = groups * split
    salts = np.uint64(max(1, int(np.ceil(np.sqrt(shards.count())))))
    lists = shared.groupBy("shard").agg(F.collect_list("anchors").alias("anchors"))  # at most the shard's own anchors

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, texts, _ = opened(batch, row)
                shard = batch.column(batch.schema.get_field_index("shard"))[row].as_py()
                known = np.sort(np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("anchors"))[row].as_py()), np.uint64))
                buffer, text_starts = joined(texts)
                found = anchors(buffer, text_starts, length)
                own = found.hash >> S16
                at = np.minimum(np.searchsorted(known >> S16, own), len(known) - 1)
                some = np.flatnonzero((known >> S16)[at] == own)
                hot = (known[at[some]] & LOW16).astype(bool)
                first, last = found.first[some], found.last[some]
                owner, spread = ids[found.text[some]], own[some]
                split = last[hot] - first[hot] + 1
                single = ragged(first[hot], split)
                begin = np.r_[first[~hot], single]
                size = np.r_[last[~hot] - first[~hot], np.zeros(len(single), np.int64)] + length
                owner = np.r_[owner[~hot], np.repeat(owner[hot], split)]
                sums = np.zeros(len(buffer) + 1, np.uint64)
                np.cumsum(BYTE_VALUES[buffer] * powers(len(buffer)), out=sums[1:])
                hashes = mix((sums[begin + size] - sums[begin]) * powers(len(buffer) + 1, FACTOR_INVERSE)[begin] + size.astype(np.uint64))
                spread = np.r_[spread[~hot], hashes[len(begin) - len(single) :] >> S16]
                code, distinct = pd.factorize(hashes)
                least = np.full(len(distinct), np.iinfo(np.int64).max)
                np.minimum.at(least, code, owner)
                surely = owner > least[code]
                out = []
                own_hash = mix(np.array([shard], np.int64).view(np.uint64))[0]
                salt = int(own_hash % salts)
                if surely.any():
                    sure = np.stack([begin[surely], size[surely] - length + 1], axis=1).astype(np.uint32)
                    out.append((int(own_hash % np.uint64(groups)), 0, b"", b"", b"", b"", b"", sure.tobytes()))
                rest = np.flatnonzero(~surely)
                is_hot = rest >= len(begin) - len(single)
                whole = (spread[rest] % np.uint64(buckets)).astype(np.int64)
                bucket = np.where(is_hot, (whole + salt) % buckets, whole)
                part = (bucket // groups * 2 + is_hot).astype(np.uint16)
                for group, which in by_bucket(bucket % groups):
                    parts, which = part[which], rest[which]
                    out.append(
                        (group, salt, squeeze.compress(buffer[ragged(begin[which], size[which])].tobytes()),
                         size[which].astype(np.uint16).tobytes(), owner[which].astype(np.int64).tobytes(),
                         begin[which].astype(np.uint32).tobytes(), parts.tobytes(), b"")
                    )
                columns = list(zip(*out)) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int32()) for c in columns[:2]), pa.array([shard] * len(out), pa.int64()),
                     *(pa.array(c, pa.binary()) for c in columns[2:])],
                    ["group", "shift", "shard", "contexts", "sizes", "owners", "places", "parts", "sure"],
                )

    joined_rows = shards.select("shard", "ids", "sizes", "body").join(lists, "shard")
    return joined_rows.mapInArrow(tidy(emit), CONTEXTS)


def marks(dealt: DataFrame, groups: int, split: int, length: int) -> DataFrame:
    """shard, places, bits: marked windows (bit k: the window at place + k), by one r-index per bucket (stored).

    Hot windows that the others of their bucket leave unmarked meet once more, ``shift`` buckets before.
    """

    def judge(rows: pa.Table) -> pa.Table:
        expand, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        group, shifts, shards = (rows.column(c).to_pylist() for c in ("group", "shift", "shard"))
        raw = np.frombuffer(b"".join(expand.decompress(x) if x else b"" for x in rows.column("contexts").to_pylist()), np.uint8)
        upto = np.cumsum([0, *(len(x) // 2 for x in rows.column("sizes").to_pylist())]).tolist()
        sizes = flat(rows, "sizes", np.uint16).astype(np.int64)
        owners, places, parts = flat(rows, "owners", np.int64), flat(rows, "places", np.uint32), flat(rows, "parts", np.uint16)
        starts = np.cumsum(sizes) - sizes
        bits = np.zeros(len(sizes), np.uint64)
        for _, which in by_bucket(parts >> 1):
            own = raw[ragged(starts[which], sizes[which])]
            bits[which] = marked_windows(own, sizes[which], owners[which], length)
        some = bits != 0
        again = ~some & (parts & 1 > 0)
        out = []
        for k, (a, b) in enumerate(zip(upto, upto[1:])):
            at = a + np.flatnonzero(some[a:b])
            if len(at):
                out.append((shards[k], places[at].tobytes(), bits[at].tobytes(), None, None, None, None, None))
            at = a + np.flatnonzero(again[a:b])
            if len(at):
                bucket = ((parts[at] >> 1).astype(np.int64) * groups + group[k] - shifts[k]) % (groups * split)
                windows = squeeze.compress(raw[ragged(starts[at], sizes[at])].tobytes())
                out.append((shards[k], places[at].tobytes(), None, (group[k] - shifts[k]) % groups, windows, sizes[at].astype(np.uint16).tobytes(),
                            owners[at].tobytes(), (bucket // groups * 2).astype(np.uint16).tobytes()))
        for shard, sure in zip(shards, blob(rows, "sure", np.uint32)):
            if len(sure):
                place, windows = sure.reshape(-1, 2).T
                every = np.where(windows >= 64, np.uint64((1 << 64) - 1), (np.uint64(1) << (windows.astype(np.uint64) % np.uint64(64))) - np.uint64(1))
                out.append((shard, place.tobytes(), every.astype(np.uint64).tobytes(), None, None, None, None, None))
        columns = list(zip(*out)) if out else [[]] * 8
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ["shard", "places", "bits", "group", "contexts", "sizes", "owners", "parts"]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    first = kept_table(dealt.groupBy("group").applyInArrow(tidy_group(judge), MARKS), "marks")
    left = first.where(F.col("bits").isNull()).withColumn("shift", F.lit(0)).withColumn("sure", F.lit(b""))
    last = kept_table(left.groupBy("group").applyInArrow(tidy_group(judge), MARKS), "marks_of_hot")  # all their equals meet now
    both = first.where(F.col("bits").isNotNull()).unionByName(last)
    return both.select("shard", "places", "bits")


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for low, high in spans:
        out.append(text[at:low])
        at = high
    out.append(text[at:])
    return b"".join(out)


def cleaned(shards: DataFrame, marked: DataFrame, length: int, with_text: bool) -> DataFrame:
    """digest, least_id, spans (removed [start, end) of the text's bytes), kept_sha256 and, if asked for and anything
    goes, the kept text (characters that were cut through are dropped)."""
    lists = marked.groupBy("shard").agg(F.collect_list("places").alias("places"), F.collect_list("bits").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, texts, _ = opened(batch, row)
                text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
                raw = [batch.column(batch.schema.get_field_index(n))[row].as_py() or [] for n in ("places", "bits")]
                place = np.frombuffer(b"".join(raw[0]), np.uint32).astype(np.int64)
                bits = np.frombuffer(b"".join(raw[1]), np.uint64)
                covered = np.zeros(text_starts[-1] + length + 64, np.int64)
                for k in range(64):
                    at = place[(bits >> np.uint64(k)) & np.uint64(1) > 0] + k
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + length, -1)
                gone = np.diff(np.r_[0, (np.cumsum(covered) > 0).astype(np.int8), 0])
                low, high = np.flatnonzero(gone == 1), np.flatnonzero(gone == -1)
                bounds = np.searchsorted(low, text_starts)
                spans, digests, kept = [], [], []
                for k, text in enumerate(texts):
                    a, b = bounds[k], bounds[k + 1]
                    own = list(zip((low[a:b] - text_starts[k]).tolist(), (high[a:b] - text_starts[k]).tolist()))
                    left = kept_bytes(text, own) if own else text
                    spans.append([{"start": x, "end": y} for x, y in own])
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode("utf-8", "ignore") if with_text and own else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("digests"))[row].values, pa.array(ids, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digests),
                     pa.array(kept, pa.string())],
                    ["digest", "least_id", "spans", "kept_sha256", "kept_text"],
                )

    schema = "digest string, least_id long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept_text string"
    return kept_table(shards.join(lists, "shard", "left").mapInArrow(tidy(run), schema), "cleaned")


def repeated_passages(documents: DataFrame, length: int = LENGTH, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): every row with its digest, n_bytes, sha256; every distinct long text with the spans to remove."""
    rows = text_rows(documents)
    shards = distinct_texts(documents, rows, length)
    width = shuffle_width(documents.sparkSession)
    n_bytes = rows.agg(F.sum("n_bytes")).first()[0] or 0
    # about one anchor in (length - gram + 2) / 2 bytes, 8 bytes each
    shared = shared_anchors(shards, max(width, int(n_bytes // (8 * GROUP_BUCKETS * BUCKET_BYTES)) + 1), length)
    n_shared = shared.agg(F.sum(F.length("anchors"))).first()[0] or 0
    groups, split = dealing(int(n_shared // 8), width, length)
    dealt = contexts(shards, shared, groups, split, length)
    return rows, cleaned(shards, marks(dealt, groups, split, length), length, with_text)


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``documents`` (doc_id, text)."""
    rows, texts = repeated_passages(documents, length)
    salts = aggregate_salted(
        rows.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull()), ["digest"], ["doc_id"],
        {"n": F.count("*")}, {"n": F.sum("n")},
    )
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    found = texts.select("digest", "least_id", removed.alias("removed"), F.size("spans").cast("long").alias("spans"), "kept_sha256")
    placed = found.join(salts.select("digest", "_salt"), "digest")
    both = rows.withColumn("_salt", salt_of("doc_id")).join(placed, ["digest", "_salt"], "left")
    copy = F.col("least_id").isNotNull() & F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("least_id"))
    source = F.col("least_id").isNotNull() & F.col("doc_id").isNotNull()
    return both.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(source, F.col("removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(source, F.col("spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY_SHA256)).when(source, F.col("kept_sha256")).otherwise(F.col("sha256")).alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with the repeated passages cut out of ``text`` and ``n_chars`` counted anew, if there is such a column.

    Rows of which nothing is left go. Rows that keep everything are not shuffled.
    """
    rows, texts = repeated_passages(documents, length, with_text=True)
    hashed = F.xxhash64("digest").alias("_hash")
    copies = (
        rows.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull())
        .groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    )
    touched = texts.where(F.size("spans") > 0).select("digest").union(copies).distinct()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    marked = documents.withColumn("_digest", F.md5(text)).withColumn("_hash", F.xxhash64("_digest"))
    same, others = suspects(marked, kept_table(touched.select(hashed), "touched"), "_hash")
    salted = others.withColumn("_salt", salt_of("doc_id"))
    salts = aggregate_salted(salted.select("_digest", "doc_id"), ["_digest"], ["doc_id"], {"n": F.count("*")}, {"n": F.sum("n")})
    found = texts.join(touched, "digest", "left_semi").select(
        F.col("digest").alias("_digest"), F.col("least_id").alias("_least_id"), F.col("kept_text").alias("_kept_text"),
        (F.size("spans") > 0).alias("_cut"),
    )
    found = found.join(salts.select("_digest", "_salt"), "_digest")
    both = salted.join(found, ["_digest", "_salt"], "left")
    known = F.col("_least_id").isNotNull() & F.col("doc_id").isNotNull()
    copy = known & (F.col("doc_id").cast("long") > F.col("_least_id"))
    own = known & F.coalesce("_cut", F.lit(False))
    both = both.withColumn("text", F.when(copy, F.lit("")).when(own, F.col("_kept_text")).otherwise(F.col("text")))
    both = both.where(~((copy | own) & (F.col("text") == "")))
    out = same.select(*documents.columns).unionByName(both.select(*documents.columns))
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
