"""Near duplicates from bottom-k sketches: retained hash values meet in inverted lists, exact Jaccard confirms.

A text's set is its distinct shingles of three words as 64-bit hashes of one hash function; a text with fewer words has its
whole word sequence as one shingle. Texts of equal sets form a *class*; all below works on classes.

1. **Sketches.** A class retains its ``KEEP`` smallest hashes. The smallest ``KEEP`` of a union are known from two sketches,
   and the share of them that both retain estimates the Jaccard index (the union-sketch estimate). Sets of at
   most ``KEEP`` shingles are retained whole, so their index is exact.
2. **Inverted lists.** Linked classes share at least ``needed`` retained values (see there), so they share one of the
   first l - needed + 1 of l values in any common order. The order is by corpus count, rare values first, so values of
   common passages head no list. A list has one posting per class.
3. **Stars.** The member of a list whose values are the most common ones of the corpus, thus the most central of a
   group of near copies, leads the list. Every member meets its leaders only: work grows with the postings, not with the
   square of a list. Union-sketch estimates filter the meetings; what is left is confirmed on the full sets.
4. **Open lists.** After that most lists lie within one component and are done: no other pair in them can change
   a component. In the others, members outside the leader's component meet all members of other components, in pairs of
   bounded blocks; members of the leader's component never meet one another. Estimates filter first, full sets confirm, and
   pairs that are connected already are not confirmed again.
5. **Components** of confirmed links by alternating large and small stars; each row gets the smallest id.

The filter lets pass all pairs with at least ``LEAST`` of ``KEEP`` union values in common. At an index of 0.85 a pair has fewer
with a chance below 5e-10 (binomial tail), at 0.9 below 1e-14; sets of at most 54 shingles have no such loss. Results are
otherwise exact: any order, leader or block gives the same components.

Null and empty texts, and texts without words, have the empty set, link with nothing and are their own component. Texts of
any length are read whole. Repeated rows and ids are rows of their own; a component is named by its smallest id that is not
null (null if there is none). Ties among leaders change no result. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitTable, freed, kept_table, signed, slices, texts_of, tidy, tidy_group
from .dealing import BLOCKS, dealt_blocks, dealt_stars, sides
from .graphs import components, named
from .jaccard import class_key, lots, shingle_sets

SHINGLE = 3
KEEP = 64
#: Values that a pair must have in common among the KEEP smallest of its union, to be confirmed.
LEAST = 33
#: Sets up to this size link only with sets that are retained whole, too.
EXACT = 17 * KEEP // 20
#: Values that this many classes retain are common; the most frequent of them are known to every task.
COMMON_CLASSES = 16
MOST_COMMON = 1 << 18
BLOCK = 1024
SET_BLOCK = 256
PAIRS = 4096
PAD = np.uint64((1 << 64) - 1)


def linked(overlap, sizes):
    """100 * overlap >= 85 * (sizes - overlap), where ``sizes`` is the sum of both set sizes."""
    return 37 * overlap >= 17 * sizes


def needed(n: np.ndarray) -> np.ndarray:
    """Retained values that a set of n shingles shares with every set that it links with.

    Up to ``EXACT`` shingles all partners are retained whole, and 85 % of the larger set is shared. Beyond, ``LEAST``.
    """
    return np.where(n <= EXACT, (17 * n + 19) // 20, LEAST)


# ---------------------------------------------------------------------------------------------------------------
# Sketches and inverted lists
# ---------------------------------------------------------------------------------------------------------------


def sketched_rows(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_key (null for the empty set) and turn of every row; the sketch with the first row of a
    class in each task (stored)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        turn = 0
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch)
            for low, high in slices(texts):
                sets = shingle_sets(texts[low:high], SHINGLE)
                keys = [class_key(s) if len(s) else None for s in sets]
                sketches = []
                for key, own in zip(keys, sets):
                    new = key is not None and key not in seen
                    seen.add(key)
                    sketches.append(signed(own[:KEEP]) if new else None)
                turns = np.arange(turn, turn + len(sets), dtype=np.int64)
                turn += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()),
                     pa.array(turns), pa.array(sketches, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "class_key", "turn", "sketch"],
                )

    schema = f"doc_id {kind}, n_shingles long, class_key long, turn long, sketch array<long>"
    return kept_table(documents.select("doc_id", "text").mapInArrow(tidy(run), schema), "rows")


def common_values(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(values ascending, classes that retain each) of the most frequent retained values."""
    counted = classes.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    rows = counted.where(F.col("n") >= COMMON_CLASSES).orderBy(F.desc("n"), "value").limit(MOST_COMMON).toArrow()
    value = rows.column("value").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], rows.column("n").to_numpy().astype(np.int64)[order]


def listed(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The (long) lists of an Arrow column as unsigned arrays."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return []
    values, offsets = array.values.to_numpy().view(np.uint64), array.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def postings(classes: DataFrame) -> DataFrame:
    """value, member and weight (how common the member's values are) for the rarest values of each sketch (stored)."""
    shared = classes.sparkSession.sparkContext.broadcast(common_values(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = shared.value
        for batch in batches:
            keys, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sketches = listed(batch.column(2))
            if not sketches:
                continue
            everything = np.concatenate(sketches)
            often = np.zeros(len(everything), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, everything), len(common) - 1)
                often = np.where(common[at] == everything, count[at], 0)
            ends = np.cumsum([len(s) for s in sketches])
            wanted = needed(sizes)
            some, owners, weights = [], [], []
            for i, (low, high) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                prefix = np.argsort(often[low:high], kind="stable")[: high - low - int(wanted[i]) + 1]
                some.append(everything[low:high][prefix])
                owners.append(np.full(len(prefix), keys[i]))
                score = int(np.log2(often[low:high] + 1.0).sum() * 64)
                weights.append(np.full(len(prefix), (score << 32) | (int(keys[i]) & 0xFFFFFFFF)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(some))), pa.array(np.concatenate(owners)), pa.array(np.concatenate(weights))],
                ["value", "member", "weight"],
            )

    return kept_table(classes.select("class_key", "n", "sketch").mapInArrow(tidy(run), "value long, member long, weight long"), "postings")


def inverted_lists(posted: DataFrame) -> DataFrame:
    """value, member and leader of every list of two or more (stored). Hot values are counted before they travel, and a
    large list is split by the join."""
    heads = (
        posted.groupBy("value").agg(F.count("*").alias("m"), F.max_by("member", "weight").alias("leader")).where("m > 1")
    )
    return kept_table(posted.select("value", "member").join(heads, "value").select("value", "member", "leader", "m"), "lists")


# ---------------------------------------------------------------------------------------------------------------
# Union-sketch estimates
# ---------------------------------------------------------------------------------------------------------------


def padded(sketches: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(sketches), KEEP), PAD)
    for row, sketch in zip(out, sketches):
        row[: len(sketch)] = sketch
    return out


def may_link(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """For each row of two padded sketch matrices: shared values among the smallest of the union (0: cannot link)."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != PAD)
    rank = np.arange(1, 2 * KEEP) - np.cumsum(twice, axis=1) + 1  # distinct values up to here, the second of two not counted again
    shared = (twice & (rank <= KEEP)).sum(axis=1)
    whole = (n_left <= KEEP) & (n_right <= KEEP)
    fits = (20 * n_left >= 17 * n_right) & (20 * n_right >= 17 * n_left)
    overlap = twice.sum(axis=1)
    passes = np.where(whole, linked(overlap, n_left + n_right), shared >= LEAST)
    return np.where(fits & passes, np.where(whole, overlap, shared), 0)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of how many retained values each left and right sketch share, from their inverted lists."""
    out = np.zeros((len(left), len(right)), np.int16)
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    ends = np.r_[starts[1:], len(values)]
    mine = np.cumsum(np.r_[0, owner < len(left)])
    n_left = mine[ends] - mine[starts]
    n_right = ends - starts - n_left
    single = (n_left == 1) & (n_right == 1)
    np.add.at(out, (owner[starts[single]], owner[starts[single] + 1] - len(left)), 1)
    for low, high, split in zip(*(x[(n_left > 0) & (n_right > 0) & ~single].tolist() for x in (starts, ends, starts + n_left))):
        out[np.ix_(owner[low:split], owner[split:high] - len(left))] += 1
    return out


def likely_pairs(
    left: list[np.ndarray], n_left: np.ndarray, right: list[np.ndarray], n_right: np.ndarray, apart: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate) of the pairs that ``apart`` (a matrix) wants and the estimate lets pass."""
    least = np.minimum(needed(n_left)[:, None], needed(n_right)[None, :])
    i, j = np.nonzero((shared_counts(left, right) >= least) & apart)
    one, other = padded(left), padded(right)
    found = [np.zeros(0, np.int64)]
    for low in range(0, len(i), PAIRS):
        a, b = i[low : low + PAIRS], j[low : low + PAIRS]
        found.append(may_link(one[a], n_left[a], other[b], n_right[b]))
    estimate = np.concatenate(found)
    passed = estimate > 0
    return i[passed], j[passed], estimate[passed]


# ---------------------------------------------------------------------------------------------------------------
# Stars
# ---------------------------------------------------------------------------------------------------------------


def estimated_stars(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (leader, member) pairs that the union-sketch estimate lets pass (stored)."""

    def judge(rows: pa.Table) -> pa.Table:
        member, n, sketches = rows.column("member").to_numpy(), rows.column("n").to_numpy(), padded(listed(rows.column("data")))
        lead = int(np.flatnonzero(member == rows.column("leader")[0].as_py())[0])
        passed = np.zeros(len(member), bool)
        for low in range(0, len(member), PAIRS):
            some = slice(low, low + PAIRS)
            size = len(member[some])
            passed[some] = may_link(sketches[some], n[some], np.repeat(sketches[lead][None], size, 0), np.repeat(n[lead], size)) > 0
        passed[lead] = False
        return rows.select(["leader", "member"]).filter(pa.array(passed))

    data = classes.select(F.col("class_key").alias("member"), "n", F.col("sketch").alias("data"))
    dealt = dealt_stars(pairs, data)
    return kept_table(dealt.groupBy("leader", "chunk").applyInArrow(tidy_group(judge), "leader long, member long"), "likely")


def full_sets(documents: DataFrame, members: DataFrame) -> DataFrame:
    """member, n and data (the set) of every class in ``members``, and of a few others (stored).

    The texts are read again, which is cheaper than to store the sets of all; a bit table of a fixed size
    tells most other classes apart.
    """
    shared = documents.sparkSession.sparkContext.broadcast(BitTable.of(members, "member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in lots(batches, size=SHINGLE):
            some = np.flatnonzero(shared.value.may_have(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[some]), pa.array([len(sets[i]) for i in some], pa.int64()),
                 pa.array([sets[i].tobytes() for i in some], pa.binary())],
                ["member", "n", "data"],
            )

    found = documents.select("text").mapInArrow(tidy(run), "member long, n long, data binary")
    return kept_table(found.groupBy("member").agg(F.first("n").alias("n"), F.first("data").alias("data")), "sets")


def sets_of(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in rows.column("data").to_pylist()]


def confirmed_stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose full sets link (stored)."""

    def confirm(rows: pa.Table) -> pa.Table:
        member, n, own = rows.column("member").to_numpy(), rows.column("n").to_numpy(), sets_of(rows)
        lead = int(np.flatnonzero(member == rows.column("leader")[0].as_py())[0])
        overlap = np.array([np.isin(s, own[lead], assume_unique=True, kind="sort").sum() for s in own])
        passed = linked(overlap, n + n[lead])
        passed[lead] = False
        return pa.table({"a": rows.column("leader"), "b": rows.column("member")}).filter(pa.array(passed))

    dealt = dealt_stars(pairs, sets)
    return kept_table(dealt.groupBy("leader", "chunk").applyInArrow(tidy_group(confirm), "a long, b long"), "links")


# ---------------------------------------------------------------------------------------------------------------
# Open lists
# ---------------------------------------------------------------------------------------------------------------


def open_groups(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """name (the leader), member, root and main (the leader's root) of lists in which two members beside the leader have
    different roots (stored). Lists of one leader are one group."""
    of_member = roots.select(F.col("node").alias("member"), F.col("root"))
    several = lists.where("m > 2 AND member <> leader").select("value", "member", "leader")
    rooted = several.join(of_member, "member", "left").withColumn("root", F.coalesce("root", "member"))
    differ = rooted.groupBy("value").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    found = rooted.join(differ.select("value"), "value", "left_semi").select(F.col("leader").alias("name"), "member", "root").distinct()
    main = roots.select(F.col("node").alias("name"), F.col("root").alias("main"))
    return kept_table(found.join(main, "name", "left").withColumn("main", F.coalesce("main", "name")), "open")


def wanted_pairs(rows: pa.Table, sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likely pairs (row numbers and estimates) of different roots in a pair of blocks."""
    n, root, member = (rows.column(c).to_numpy() for c in ("n", "root", "member"))
    first, second = sides(rows)
    if not len(first) or not len(second):
        return (np.zeros(0, np.int64),) * 3
    apart = root[first][:, None] != root[second][None, :]
    if rows.column("kind")[0].as_py() == 0 and rows.column("low")[0] == rows.column("high")[0]:
        apart &= member[first][:, None] < member[second][None, :]
    i, j, estimate = likely_pairs([sketches[x] for x in first], n[first], [sketches[x] for x in second], n[second], apart)
    return first[i], second[j], estimate


def likely_members(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``found`` that have a likely partner of another root (stored)."""

    def judge(rows: pa.Table) -> pa.Table:
        i, j, _ = wanted_pairs(rows, listed(rows.column("data")))
        return rows.select(["name", "member"]).take(pa.array(np.unique(np.r_[i, j])))

    data = classes.select(F.col("class_key").alias("member"), "n", F.col("sketch").alias("data"))
    passed = dealt_blocks(found, data, BLOCK).groupBy(*BLOCKS).applyInArrow(tidy_group(judge), "name long, member long")
    return kept_table(found.join(passed.distinct(), ["name", "member"], "left_semi"), "likely")


def confirmed_members(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) links of different roots that connect what all links in the blocks connect (stored)."""

    def confirm(rows: pa.Table) -> pa.Table:
        own, n, root, member = sets_of(rows), *(rows.column(c).to_numpy() for c in ("n", "root", "member"))
        i, j, estimate = wanted_pairs(rows, [s[:KEEP] for s in own])
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = above.get(above[x], above[x])
                x = above[x]
            return x

        found_a, found_b = [], []
        for k in np.argsort(-estimate, kind="stable").tolist():
            a, b = int(i[k]), int(j[k])
            one, other = top(int(root[a])), top(int(root[b]))
            if one == other:
                continue
            overlap = len(np.intersect1d(own[a], own[b], assume_unique=True))
            if linked(overlap, int(n[a] + n[b])):
                above[one] = other
                found_a.append(int(member[a]))
                found_b.append(int(member[b]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    dealt = dealt_blocks(found, sets, SET_BLOCK)
    return kept_table(dealt.groupBy(*BLOCKS).applyInArrow(tidy_group(confirm), "a long, b long"), "links")


# ---------------------------------------------------------------------------------------------------------------
# The operator
# ---------------------------------------------------------------------------------------------------------------


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents`` (doc_id, text and any other columns)."""
    rows = sketched_rows(documents)
    classes = kept_table(
        rows.where("sketch IS NOT NULL").groupBy("class_key").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "sketches",
    )
    posted = postings(classes)
    lists = inverted_lists(posted)
    freed(posted)
    pairs = kept_table(lists.where("member <> leader").select("leader", "member").distinct(), "stars")
    likely = estimated_stars(pairs, classes)
    freed(pairs)
    sets = full_sets(documents, likely.select("member").union(likely.select("leader")).distinct())
    stars = confirmed_stars(likely, sets)
    freed(likely, sets)
    roots = components(stars)
    found = open_groups(lists, roots)
    likely = likely_members(found, classes)
    freed(lists, found, classes)
    sets = full_sets(documents, likely.select("member").distinct())
    more = confirmed_members(likely, sets)
    freed(likely, sets)
    if not more.isEmpty():
        roots = components(stars.unionByName(more))
    named_rows = named(rows.drop("sketch"), roots, "turn")
    return named_rows.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
