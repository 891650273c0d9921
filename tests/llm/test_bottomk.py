import random
import re

import numpy as np
import pytest

from logyield.llm import bottomk, dealing
from logyield.llm.jaccard import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, sketch string, turn int, class_key double, member long, _salt string"
EXTRA = ("clash", 1, 0.5, 3, "clash")


def shingles(text):
    own = WORD.findall((text or "").translate(LOWER))
    return {tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))} if own else set()


def brute(rows):
    """(n_shingles, component_id, kept) of every row."""
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for (doc, _), own, g in zip(rows, sets, group):
        ids = [r[0] for r, h in zip(rows, group) if h == g and r[0] is not None]
        component = min(ids, default=None)
        out.append((doc, len(own), component, doc == component))
    return sorted(out, key=repr)


def run(spark, rows):
    table = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
    got = bottomk.near_duplicates(table).collect()
    assert not got or list(got[0].asDict()) == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got), key=repr)


def near_copies(seed, n, longest):
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choices("abcd", k=4)) for _ in range(400)]
    bases = [dice.choices(vocabulary, k=dice.randint(1, longest)) for _ in range(8)]
    passage = dice.choices(vocabulary, k=longest // 2)
    rows = []
    for i in range(n):
        text = list(dice.choice(bases))
        for _ in range(dice.choice([0, 0, 1, 1, 2, 3, 8])):
            text[dice.randrange(len(text))] = dice.choice(vocabulary)
        if dice.random() < 0.3:
            text += passage
        rows.append((i, " ".join(text).upper() if dice.random() < 0.2 else "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed, longest", [(1, 40), (2, 150), (3, 400)])
def test_near_copies(spark, monkeypatch, seed, longest):
    monkeypatch.setattr(bottomk, "COMMON_CLASSES", 3)
    rows = near_copies(seed, 160, longest)
    assert run(spark, rows) == brute(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(dealing, "STAR", 4)
    for name, size in (("BLOCK", 5), ("SET_BLOCK", 3), ("MOST_COMMON", 2), ("COMMON_CLASSES", 2)):
        monkeypatch.setattr(bottomk, name, size)
    rows = near_copies(4, 200, 90)
    assert run(spark, rows) == brute(rows)


def test_star_of_copies_that_only_link_with_their_middle(spark):
    """Copies with a word changed link with the original text, but not with each other."""
    base = [f"w{i}" for i in range(41)]
    rows = [(500, " ".join(base))]
    for i in range(30):
        own = list(base)
        own[i + 5] = f"other{i}"
        rows.append((i, " ".join(own)))
    got = run(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {0}


def test_chain_without_a_middle(spark):
    """Each text links with the next one only; a common passage puts all of them in one list."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{j}" for j in range(6 * i, 6 * i + 30)])) for i in range(25)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "two one"),
        (9, "a b c"), (10, "a b c"), (10, "a b c"), (None, "a b c"), (None, "solo text of nobody else"), (None, None),
        (11, "é É ü"), (12, "é é ü"), (13, "\x00 \x00 \x00"),
    ]
    long = " ".join(f"t{i}" for i in range(60_000))
    rows += [(20, long), (21, long + " end"), (22, "start " + long)]
    rows += [(30, "common line here for all")] * 40
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_estimates_of_whole_sets_are_exact_and_others_let_links_pass():
    dice = random.Random(5)
    for _ in range(300):
        n = dice.choice([3, 20, 50, 54, 55, 64, 65, 200, 1000])
        base = [f"x{dice.random()}" for _ in range(n + 2)]
        other = list(base)
        for _ in range(dice.randint(0, max(1, n // 25))):
            other[dice.randrange(len(other))] = "new"
        a, b = shingle_sets([" ".join(base).encode(), " ".join(other).encode()], 3)
        both = len(np.intersect1d(a, b))
        links = 100 * both >= 85 * (len(a) + len(b) - both)
        sizes = np.array([len(a)]), np.array([len(b)])
        sketches = [a[: bottomk.KEEP]], [b[: bottomk.KEEP]]
        estimate = bottomk.may_link(bottomk.padded(sketches[0]), sizes[0], bottomk.padded(sketches[1]), sizes[1])[0]
        if max(len(a), len(b)) <= bottomk.KEEP:
            assert (estimate > 0) == links
        if links:
            assert estimate > 0
            shared = bottomk.shared_counts(*sketches)[0, 0]
            assert shared == len(np.intersect1d(sketches[0][0], sketches[1][0]))
            assert shared >= max(bottomk.needed(sizes[0])[0], bottomk.needed(sizes[1])[0])
