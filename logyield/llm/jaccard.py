"""N-gram Jaccard join: all links between texts whose shingle sets overlap by 75 % or more, found with prefix trees.

A text's set is its distinct shingles of five words (64-bit hashes); one with fewer words has its whole word sequence as
one shingle. Texts with equal sets form a *class*, and everything below works on classes.

1. **Global order.** Shingles that recur within a task's share of the texts are counted; those common in the corpus (at
   most ``MOST_COMMON``, so the list can be broadcast) come last in the order, rarer ones first, the rest by hash. Any
   order gives the same links; this one keeps common passages out of the prefixes.
2. **Groups.** Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of each. Prefix shingles meet in
   buckets; all sets that share one join the *group* named after the smallest of them, so shingles of the same texts
   name the same group. Common shingles carry their group's name with them and need not meet. Every pair that can link
   is in some group, and groups are far fewer than pairs.
3. **Parity filter.** Most members of a group only share a passage. Before any set travels, members bring a parity map: a
   set's shingles hashed to one to two bits each, every hit flipping its bit. Two sets differ in at least as many
   shingles as their maps differ in bits, so members without a partner of fitting size and map cannot link and leave.
   What likely pairs connect is a group from here on, so every member is in one group only and its set travels once.
4. **Leaders.** In a group of more than ``BLOCK`` members each first meets a few leaders (filter and trie join as below).
   Members that this connects never meet one another again; only those outside the largest component so found do, each other
   and the members of other components. Where all links are asked for, this step is left out.
5. **Trie join.** A group is cut into blocks of at most ``BLOCK`` sets (and ``BLOCK_SHINGLES`` shingles); each pair of
   blocks is one task's work, so a group of any size is spread out. In it the sets of one block are stored as a prefix
   tree in one order of their shared shingles, frequent ones first, so that sets with a common beginning share its
   nodes. The sets of the other block walk down the tree side by side; a node's overlap is counted once for all sets
   below it. A subtree is left as soon as overlap so far + what can still come (the rest of the walking set, the longest
   rest below) cannot reach the overlap that the sizes ask for.
6. **Links and components.** :func:`links` returns every link between classes. For components, a task returns only a
   spanning forest of the links it found. They follow by
   alternating large-star and small-star steps on the stored links, with hot centres salted.

Null and empty texts, and texts without words, have the empty set, link with nothing and are their own component.
Repeated rows and ids are rows of their own; a component is named by its smallest id that is not null (null if there is
none). Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    FACTOR, LOWERED, NOT_BLANK, BitTable, aggregate_salted, freed, joined, kept_table, mix, salt_of, sequence_hashes, shuffle_width, signed,
    slices, span_hashes, suspects, texts_of, tidy,
    tidy_group, word_spans,
)
from .dealing import BLOCKS, STARS, dealt_blocks, dealt_stars, sides
from .graphs import components, named

SHINGLE = 5
MOST_COMMON = 1 << 18
COMMON_TEXTS = 64
LOT_SHINGLES = 1 << 19
BUCKET_SHINGLES = 1 << 20
BLOCK = 512
FILTER_BLOCK = 2048
#: Members of a large group that all others meet first.
LEADERS = 4
BLOCK_SHINGLES = 1 << 20
#: Cells of the matrix (walking sets x shared shingles) held at once.
CELLS = 1 << 21


# ---------------------------------------------------------------------------------------------------------------
# Sets
# ---------------------------------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    buffer, text_starts = joined([t.translate(LOWERED) for t in texts])
    starts, ends = word_spans(buffer, NOT_BLANK)
    words = span_hashes(buffer, starts, ends)
    first = np.searchsorted(starts, text_starts)
    shingles = sequence_hashes(words, size)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= size:
            own = np.sort(shingles[low : high - size + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif high > low:
            short = sequence_hashes(words[low:high], high - low)
            out.append(mix(short + np.uint64(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(shingles: np.ndarray) -> int:
    """64-bit key of a set: sum of its mixed hashes and its size, mixed."""
    total = mix(shingles).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))
    return int(signed(mix(total * np.uint64(FACTOR)))[0])


def lots(
    batches: Iterator[pa.RecordBatch], distinct: bool = True, size: int = SHINGLE
) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(class keys, sets) of the non-empty sets, ``LOT_SHINGLES`` shingles at a time, each class once per task."""
    seen: set[int] = set()
    keys, sets, held = [], [], 0
    for batch in batches:
        texts = texts_of(batch)
        for low, high in slices(texts):
            for own in shingle_sets(texts[low:high], size):
                if not len(own):
                    continue
                key = class_key(own)
                if distinct and key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                sets.append(own)
                held += len(own)
            if held >= LOT_SHINGLES:
                yield np.array(keys, np.int64), sets
                keys, sets, held = [], [], 0
    if keys:
        yield np.array(keys, np.int64), sets


def row_hash(documents: DataFrame):
    """64-bit hash of a whole row: equal only for repeated rows."""
    return F.xxhash64(*documents.columns)


def text_classes(documents: DataFrame) -> DataFrame:
    """row_key, doc_id, n_shingles and class key (null for the empty set) of every row (stored)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts = batch.column(0), batch.column(1), texts_of(batch)
            for low, high in slices(texts):
                sets = shingle_sets(texts[low:high])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(low, high - low), ids.slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([class_key(s) if len(s) else None for s in sets], pa.int64())],
                    ["row_key", "doc_id", "n_shingles", "class_key"],
                )

    rows = documents.select(row_hash(documents).alias("row_key"), "doc_id", "text")
    return kept_table(rows.mapInArrow(tidy(run), f"row_key long, doc_id {kind}, n_shingles long, class_key long"), "classes")


# ---------------------------------------------------------------------------------------------------------------
# Global order
# ---------------------------------------------------------------------------------------------------------------


def common_shingles(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles ascending, rank by ascending count from 1, group name) of at most ``MOST_COMMON`` common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in lots(batches):
            shingles = np.concatenate(sets)
            ordered = np.sort(shingles)
            frequent = ordered[3:][ordered[3:] == ordered[:-3]]  # found in four sets or more
            if not len(frequent):
                continue
            frequent = frequent[np.r_[True, frequent[1:] != frequent[:-1]]]
            at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
            there = frequent[at] == shingles
            owner = np.repeat(keys, [len(s) for s in sets])[there]
            count = np.bincount(at[there], minlength=len(frequent))
            least = np.full(len(frequent), np.iinfo(np.int64).max)
            np.minimum.at(least, at[there], owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(frequent)), pa.array(count), pa.array(least)], ["shingle", "n", "name"]
            )

    counted = (
        documents.select("text")
        .mapInArrow(tidy(run), "shingle long, n long, name long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"), F.min("name").alias("name"))
        .where(F.col("n") >= COMMON_TEXTS)
    )
    rows = counted.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    shingle = rows.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    rank = np.arange(len(shingle), 0, -1)
    order = np.argsort(shingle)
    return shingle[order], rank[order], rows.column("name").to_numpy().astype(np.int64)[order]


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


# ---------------------------------------------------------------------------------------------------------------
# Groups
# ---------------------------------------------------------------------------------------------------------------


def groups(documents: DataFrame, buckets: int) -> DataFrame:
    """(name, member) pairs: classes that share a prefix shingle share a name (stored, distinct)."""
    common = documents.sparkSession.sparkContext.broadcast(common_shingles(documents))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, rank, name = common.value
        turn = 0
        for keys, sets in lots(batches):
            sizes = np.array([len(s) for s in sets])
            everything = np.concatenate(sets)
            place = np.full(len(everything), -1)
            if len(shingle):
                at = np.minimum(np.searchsorted(shingle, everything), len(shingle) - 1)
                place = np.where(shingle[at] == everything, at, -1)
            ends = np.cumsum(sizes)
            rare, rare_key, names, members = [], [], [], []
            for key, low, high in zip(keys.tolist(), (ends - sizes).tolist(), ends.tolist()):
                wanted = prefix_length(high - low)
                where = place[low:high]
                own = everything[low:high][where < 0][:wanted]
                rare.append(own)
                rare_key.append(key)
                if len(own) < wanted:
                    last = where[where >= 0]
                    last = last[np.argsort(rank[last])][: wanted - len(own)]
                    own_names = np.unique(name[last])
                    names.append(own_names)
                    members.append(np.full(len(own_names), key))
            owner = np.repeat(np.array(rare_key, np.int64), [len(r) for r in rare])
            rare = np.concatenate(rare)
            bucket = (rare >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.int32), kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            found = [(b, order[bounds[b] : bounds[b + 1]]) for b in range(buckets) if bounds[b] < bounds[b + 1]]
            empty = b""
            rows = [(b, rare[some].tobytes(), owner[some].tobytes(), empty, empty) for b, some in found]
            if names:
                turn += 1
                spread = int(mix(np.array([turn + int(keys[0] & 0xFFFF)], np.uint64))[0] % buckets)
                rows.append((spread, empty, empty, np.concatenate(names).tobytes(), np.concatenate(members).tobytes()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                ["bucket", "shingles", "owners", "names", "members"],
            )

    def meet(rows: pa.Table) -> pa.Table:
        def whole(column: str, dtype) -> np.ndarray:
            return np.frombuffer(b"".join(rows.column(column).to_pylist()), dtype)

        shingles, owners = whole("shingles", np.uint64), whole("owners", np.int64)
        ordered = np.sort(shingles)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        name, member = whole("names", np.int64), whole("members", np.int64)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, shingles), len(twice) - 1)
            some = twice[at] == shingles
            shingles, owners = shingles[some], owners[some]
            order = np.lexsort((owners, shingles))
            shingles, owners = shingles[order], owners[order]
            new = np.r_[True, shingles[1:] != shingles[:-1]]
            leader = owners[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            end = np.r_[new[1:], True]
            last = owners[np.flatnonzero(end)[np.cumsum(new) - 1]]
            several = leader != last
            name, member = np.concatenate([name, leader[several]]), np.concatenate([member, owners[several]])
        if len(name):
            order = np.lexsort((member, name))
            name, member = name[order], member[order]
            keep = np.r_[True, (name[1:] != name[:-1]) | (member[1:] != member[:-1])]
            name, member = name[keep], member[keep]
        return pa.table({"name": pa.array(name, pa.int64()), "member": pa.array(member, pa.int64())})

    packed = documents.select("text").mapInArrow(
        tidy(emit), "bucket int, shingles binary, owners binary, names binary, members binary"
    )
    met = packed.groupBy("bucket").applyInArrow(tidy_group(meet), "name long, member long")
    return kept_table(met.distinct(), "groups")


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """A power of two of bits, at least one per shingle (and 64 in all), each the parity of its hits; as 64-bit words."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    hits = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little").view(np.uint64)


def likely_forest(sizes: np.ndarray, maps: list[np.ndarray], roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all sets of different roots that might link, as sizes and parity maps tell.

    Linking sets x, y have 7 |x & y| >= 3 (|x| + |y|), so they differ in at most (|x| + |y|) / 7 shingles.
    """
    order = np.argsort(sizes, kind="stable")
    width = np.array([len(m) for m in maps])[order]
    ordered, rooted = sizes[order], roots[order]
    stacks = {w: np.stack([maps[i] for i in order[width == w]]) for w in np.unique(width).tolist()}
    first = {w: int(np.flatnonzero(width == w)[0]) for w in stacks}  # maps of one width are neighbours by size
    halves = {w // 2: stack[:, : w // 2] ^ stack[:, w // 2 :] for w, stack in stacks.items() if w > 1}
    part = np.arange(len(sizes))  # parts that the pairs so far connect
    one, other = [], []
    for i, w in enumerate(width.tolist()):
        last = int(np.searchsorted(ordered, ordered[i] * 4 // 3, side="right"))  # sizes up to 4/3 of the own one
        own = stacks[w][i - first[w]]
        for stack, begin in ((stacks[w], first[w]), (halves.get(w), first.get(2 * w, 0))):
            if stack is None:
                continue
            low, high = max(i + 1, begin), min(last, begin + len(stack))
            if low < high:
                differs = np.bitwise_count(stack[low - begin : high - begin] ^ own).sum(axis=1, dtype=np.int64)
                fits = low + np.flatnonzero((7 * differs <= ordered[low:high] + ordered[i]) & (rooted[low:high] != rooted[i]))
                fits = fits[part[fits] != part[i]]
                if len(fits):
                    found, at = np.unique(part[fits], return_index=True)
                    one.append(np.full(len(found), i))
                    other.append(fits[at])
                    part[np.isin(part, found)] = part[i]
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(one)], order[np.concatenate(other)]


def candidates(documents: DataFrame, members: DataFrame, parity: bool) -> DataFrame:
    """member, n and data (set, or its parity map) of every class in ``members``, and of a few others (stored).

    Classes are told apart from the rest by a bit table of a fixed size: a set bit may be another class's, which only
    costs a little more shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(BitTable.of(members, "member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in lots(batches):
            some = np.flatnonzero(shared.value.may_have(keys))
            data = [(parity_map(sets[i]) if parity else sets[i]).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[some]), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array(data, pa.binary())],
                ["member", "n", "data"],
            )

    found = documents.select("text").mapInArrow(tidy(run), "member long, n long, data binary")
    once = found.groupBy("member").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    return kept_table(once, "candidates")


def map_distance(one: np.ndarray, other: np.ndarray) -> int:
    """Bits in which two parity maps differ; a wider one is folded to the width of the other."""
    if len(one) < len(other):
        one, other = other, one
    while len(one) > len(other):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return int(np.bitwise_count(one ^ other).sum())


def survivors(found: DataFrame, maps: DataFrame) -> DataFrame:
    """name, member, root, main and weight of the members of ``found`` that the parity filter leaves (stored), in new
    groups: what likely pairs connect. A member is in one of them, so its set travels once, however many groups it was in.
    """

    def judge(rows: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in rows.column("data").to_pylist()]
        a, b = likely_forest(rows.column("n").to_numpy(), own, rows.column("root").to_numpy())
        member = rows.column("member").to_numpy()
        return pa.table({"a": pa.array(member[a], pa.int64()), "b": pa.array(member[b], pa.int64())})

    dealt = dealt_blocks(found, maps, FILTER_BLOCK, 16 * BLOCK_SHINGLES)
    likely = kept_table(dealt.groupBy(*BLOCKS).applyInArrow(tidy_group(judge), "a long, b long"), "likely")
    merged = components(likely).select(F.col("node").alias("member"), F.col("root").alias("name"))
    known = found.select("member", "root", "weight").distinct()
    joined = kept_table(merged.join(known, "member").select("name", "member", "root", "weight"), "survivors")
    parts = joined.groupBy("name", "root").agg(F.count("*").alias("m"))
    # Only a root of many members is worth blocks of its own.
    main = parts.groupBy("name").agg(F.when(F.max("m") > BLOCK // 8, F.max_by("root", "m")).alias("main"))
    freed(likely)
    return joined.join(main, "name")


def star_links(documents: DataFrame, large: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b) links between the members of ``large`` groups and the ``LEADERS`` of their group (stored): work in
    proportion to the members, after which most of a group of near copies is one component."""
    drawn = F.array(*(F.min_by("member", F.xxhash64("member", F.lit(k))) for k in range(LEADERS)))
    leaders = large.groupBy("name").agg(drawn.alias("leaders")).select("name", F.explode(F.array_distinct("leaders")).alias("leader"))
    pairs = large.join(leaders, "name").where("member <> leader").select("leader", "member").distinct()
    pairs = kept_table(pairs, "stars")

    def judge(rows: pa.Table) -> pa.Table:
        member, n = rows.column("member").to_numpy(), rows.column("n").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in rows.column("data").to_pylist()]
        lead = int(np.flatnonzero(member == rows.column("leader")[0].as_py())[0])
        fits = (4 * n >= 3 * n[lead]) & (4 * n[lead] >= 3 * n)
        fits[lead] = False
        for i in np.flatnonzero(fits):
            fits[i] = 7 * map_distance(own[i], own[lead]) <= n[i] + n[lead]
        return rows.select(["leader", "member"]).filter(pa.array(fits))

    likely = dealt_stars(pairs, maps).groupBy(*STARS).applyInArrow(tidy_group(judge), "leader long, member long")
    likely = kept_table(likely, "likely")
    sets = candidates(documents, likely.select("member").union(likely.select("leader")).distinct(), parity=False)

    def join(rows: pa.Table) -> pa.Table:
        member = rows.column("member").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("data").to_pylist()]
        lead = int(np.flatnonzero(member == rows.column("leader")[0].as_py())[0])
        others = np.flatnonzero(np.arange(len(member)) != lead)
        _, found = trie_join([sets[lead]], [sets[i] for i in others])
        found = others[found]
        return pa.table({"a": pa.array(np.full(len(found), member[lead]), pa.int64()), "b": pa.array(member[found], pa.int64())})

    links = kept_table(dealt_stars(likely, sets).groupBy(*STARS).applyInArrow(tidy_group(join), "a long, b long"), "links")
    freed(pairs, likely, sets)
    return links


def open_groups(large: DataFrame, links: DataFrame) -> DataFrame:
    """name, member, root and main (the most frequent root) of the ``large`` groups that ``links`` leave in several parts."""
    roots = components(links)
    rooted = large.join(roots, large.member == roots.node, "left").select(
        "name", "member", F.coalesce("root", "member").alias("root"), "weight"
    )
    parts = rooted.groupBy("name", "root").agg(F.count("*").alias("m"))
    main = parts.groupBy("name").agg(F.max_by("root", "m").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return rooted.join(main.select("name", "main"), "name")


# ---------------------------------------------------------------------------------------------------------------
# Trie join
# ---------------------------------------------------------------------------------------------------------------


class Trie:
    """Prefix tree over ascending lists of shingle numbers, chains of single children kept as one edge.

    ``levels``: arrays per depth of branching — ``parent`` (edge of the level above), ``tokens`` with ``starts``, and
    of the sets below an edge: ``least`` and ``most`` (set sizes) and ``rest`` (most shingles still to come);
    ``ending``: for each level (edge, list) of the lists that end there.
    """

    def __init__(self, lists: list[np.ndarray], sizes: np.ndarray):
        raw = [x.astype(">u4").tobytes() for x in lists]
        order = sorted(range(len(lists)), key=raw.__getitem__)
        seqs = [lists[i] for i in order]
        lengths = [len(s) for s in seqs]
        shared = [0]
        for a, b in zip(seqs, seqs[1:]):
            m = min(len(a), len(b))
            differs = np.flatnonzero(a[:m] != b[:m])
            shared.append(int(differs[0]) if len(differs) else m)
        sizes = np.asarray(sizes)[order]
        self.levels: list[dict] = []
        work = [(0, len(seqs), 0, -1)]
        while work:
            parents, tokens, starts, least, most, rest, ending = [], [], [0], [], [], [], []
            following = []
            for low, high, depth, parent in work:
                while low < high and lengths[low] == depth:
                    low += 1  # lists that end here were reported with their edge
                begin = low
                while begin < high:
                    end = begin + 1
                    reach = lengths[begin]
                    while end < high and shared[end] > depth:
                        reach = min(reach, shared[end])
                        end += 1
                    edge = len(parents)
                    parents.append(parent)
                    tokens.append(seqs[begin][depth:reach])
                    starts.append(starts[-1] + reach - depth)
                    least.append(sizes[begin:end].min())
                    most.append(sizes[begin:end].max())
                    rest.append(max(lengths[begin:end]) - reach)
                    k = begin
                    while k < end and lengths[k] == reach:
                        ending.append((edge, order[k]))
                        k += 1
                    if k < end:
                        following.append((begin, end, reach, edge))
                    begin = end
            if not parents:
                break
            self.levels.append(
                {
                    "parent": np.array(parents), "tokens": np.concatenate(tokens), "starts": np.array(starts[:-1]),
                    "ends": np.array(starts[1:]), "least": np.array(least), "most": np.array(most), "rest": np.array(rest),
                    "ending": np.array(ending, np.int64).reshape(-1, 2),
                }
            )
            work = following


def enough(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """100 * overlap >= 75 * (sizes - overlap), where ``sizes`` is the sum of both set sizes."""
    return 7 * overlap >= 3 * sizes


def walk(trie: Trie, present: np.ndarray, sizes: np.ndarray, entry_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(walking set, list) of all pairs that link; ``present``: walking sets x shingle numbers, 0 or 1."""
    left = np.cumsum(present[:, ::-1], axis=1, dtype=np.int32)[:, ::-1]  # own shingles from a number on
    left = np.concatenate([left, np.zeros((len(left), 1), np.int32)], axis=1)
    size = sizes[:, None]
    before = np.zeros((len(present), 1), np.int32)
    column = np.zeros(1, np.int64)  # column of ``before`` that an edge of the level above has, -1: left
    walkers, entries = [], []
    for depth, level in enumerate(trie.levels):
        parent = np.zeros(len(level["parent"]), np.int64) if depth == 0 else column[level["parent"]]
        go = np.flatnonzero(parent >= 0)
        column = np.full(len(parent), -1)
        if not len(go):
            continue
        span = level["ends"][go] - level["starts"][go]
        offsets = np.cumsum(span) - span
        at = np.arange(span.sum()) - np.repeat(offsets, span) + np.repeat(level["starts"][go], span)
        tokens = level["tokens"][at]
        overlap = before[:, parent[go]] + np.add.reduceat(present[:, tokens], offsets, axis=1, dtype=np.int32)
        last = level["tokens"][level["ends"][go] - 1]
        reach = overlap + np.minimum(left[:, last + 1], level["rest"][go][None, :])
        alive = enough(reach, size + level["least"][go][None, :])
        alive &= (4 * size >= 3 * level["least"][go][None, :]) & (4 * level["most"][go][None, :] >= 3 * size)
        overlap[~alive] = -(1 << 28)  # nothing below can reach the bound again
        useful = np.flatnonzero(alive.any(axis=0))
        column[go[useful]] = np.arange(len(useful))
        before = overlap[:, useful]
        ending = level["ending"]
        if len(ending):
            ending = ending[column[ending[:, 0]] >= 0]
            own = before[:, column[ending[:, 0]]]
            who, which = np.nonzero(enough(own, size + entry_sizes[ending[:, 1]][None, :]))
            walkers.append(who)
            entries.append(ending[which, 1])
    if not walkers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(walkers), np.concatenate(entries)


def trie_join(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All linking pairs (i, j) between two lists of sets, or within one (each pair once)."""
    within = right is None
    right = left if within else right
    both = left if within else [*left, *right]
    if not left or not right:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, code, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    several = count > 1
    number = np.full(len(distinct), -1)
    kept = np.flatnonzero(several)
    number[kept[np.argsort(-count[kept], kind="stable")]] = np.arange(len(kept))
    numbered = number[code]
    bounds = np.cumsum([0, *(len(s) for s in both)])
    lists = [numbered[a:b] for a, b in zip(bounds, bounds[1:])]
    lists = [np.sort(x[x >= 0]) for x in lists]
    sizes = np.array([len(s) for s in both], np.int64)
    entry_lists = lists if within else lists[len(left) :]
    entry_sizes = sizes if within else sizes[len(left) :]
    trie = Trie(entry_lists, entry_sizes)
    lot = max(1, min(64, CELLS // max(1, len(kept))))
    first, second = [], []
    for low in range(0, len(left), lot):
        some = lists[low : min(low + lot, len(left))]
        present = np.zeros((len(some), max(1, len(kept))), np.uint8)
        for k, x in enumerate(some):
            present[k, x] = 1
        who, which = walk(trie, present, sizes[low : low + len(some)], entry_sizes)
        first.append(who + low)
        second.append(which)
    a, b = np.concatenate(first), np.concatenate(second)
    return (a[a < b], b[a < b]) if within else (a, b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, node) that connect what the links connect."""
    order = np.argsort(np.r_[a, b], kind="stable")
    near = np.r_[b, a][order]
    starts = np.searchsorted(np.r_[a, b][order], np.arange(n + 1))
    seen, out = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            reached = np.unique(np.concatenate([near[starts[u] : starts[u + 1]] for u in front]))
            front = reached[~seen[reached]]
            seen[front] = True
            out.extend((root, int(v)) for v in front)
    return out


def links(documents: DataFrame, classes: DataFrame, spanning: bool = False) -> DataFrame:
    """(a, b) class keys, a < b, of all links between different classes, each once (stored). Rows of one class in
    ``classes`` link with one another and with all rows of the classes that theirs links with.

    ``spanning``: only so many links that the components are the same. Then the members of a large group first meet a few
    leaders; those that are in one component after that never meet one another.
    """
    width = shuffle_width(documents.sparkSession)
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    found = groups(documents, max(width, int(total // 4 // BUCKET_SHINGLES) + 1))
    maps = candidates(documents, found, parity=True)
    sizes = found.groupBy("name").agg(F.count("*").alias("m")).where("m > 1")
    weighed = found.join(maps.select("member", F.col("n").alias("weight")), "member").join(sizes, "name")
    weighed = kept_table(weighed.select("name", "member", "weight", "m"), "weighed")
    freed(found)
    alone = weighed.select("name", "member", F.col("member").alias("root"), F.lit(None).cast("long").alias("main"), "weight", "m")
    stars = None
    if spanning:
        large = weighed.where(F.col("m") > BLOCK).drop("m")
        if not large.isEmpty():
            stars = star_links(documents, large, maps)
            alone = kept_table(alone.where(F.col("m") <= BLOCK).drop("m").unionByName(open_groups(large, stars)), "alone")
    left = survivors(alone.drop("m"), maps)
    freed(weighed, maps)
    sets = candidates(documents, left, parity=False)

    def join(rows: pa.Table) -> pa.Table:
        member, root = rows.column("member").to_numpy(), rows.column("root").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("data").to_pylist()]
        first, second = sides(rows)
        if np.array_equal(first, second):
            a, b = trie_join([sets[i] for i in first])
        else:
            a, b = trie_join([sets[i] for i in first], [sets[i] for i in second])
        a, b = first[a], second[b]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if spanning:
            a, b = np.array(forest(len(sets), a, b), np.int64).reshape(-1, 2).T
        one, other = member[a], member[b]
        return pa.table({"a": pa.array(np.minimum(one, other), pa.int64()), "b": pa.array(np.maximum(one, other), pa.int64())})

    dealt = dealt_blocks(left, sets, BLOCK, BLOCK_SHINGLES)
    out = kept_table(dealt.groupBy(*BLOCKS).applyInArrow(tidy_group(join), "a long, b long").distinct(), "links")
    freed(sets)
    return out if stars is None else out.unionByName(stars)


# ---------------------------------------------------------------------------------------------------------------
# Rows
# ---------------------------------------------------------------------------------------------------------------


def near_duplicates(documents: DataFrame) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id and component_key (null: links with nothing) for every row of
    ``documents`` (doc_id, text and any other columns)."""
    classes = text_classes(documents)
    roots = components(links(documents, classes, spanning=True))
    return named(classes, roots, "row_key").drop("class_key")


def one_per_component(documents: DataFrame) -> DataFrame:
    """``documents`` without the rows of a component but its first: the smallest id (a null id only if all are null),
    then the smallest row hash; of repeated rows one stays. Rows with the empty set all stay."""
    rows = kept_table(near_duplicates(documents).where("component_key IS NOT NULL"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    firsts = aggregate_salted(
        rows, ["component_key"], ["row_key"],
        {"best": F.min(rank), "n": F.count("*")}, {"best": F.min("best"), "n": F.sum("n")},
    ).where("n > 1")
    several = rows.withColumn("_salt", salt_of("row_key")).join(firsts, ["component_key", "_salt"])
    judged = kept_table(
        several.groupBy(F.col("row_key").alias("_row_key")).agg(
            F.first(F.col("row_key") != F.col("best.row_key")).alias("_drop"), F.count("*").alias("_copies")
        ),
        "judged-rows",
    )
    judged = judged.where("_drop OR _copies > 1")
    hashed = documents.withColumn("_row_key", row_hash(documents))
    kept, suspected = suspects(hashed, judged, "_row_key")
    suspected = suspected.join(judged, "_row_key", "left")
    single = suspected.where("_drop IS NULL")
    repeated = suspected.where("NOT _drop").dropDuplicates(["_row_key"])
    return kept.unionByName(single.select(*hashed.columns)).unionByName(repeated.select(*hashed.columns)).drop("_row_key")
