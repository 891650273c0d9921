import random
import re

import numpy as np
import pytest

from logyield.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    own = WORD.findall((text or "").translate(LOWER))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def brute(rows):
    """Component (as row numbers) of every row."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and linked(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


def near_copies(seed, n=70):
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choices("abcd", k=3)) for _ in range(60)]
    bases = [dice.choices(vocabulary, k=dice.randint(1, 70)) for _ in range(12)]
    passage = dice.choices(vocabulary, k=20)
    rows = []
    for i in range(n):
        text = list(dice.choice(bases))
        for _ in range(dice.choice([0, 0, 1, 2, 3, 6])):
            text[dice.randrange(len(text))] = dice.choice(vocabulary)
        if dice.random() < 0.3:
            text += passage
        rows.append((i, " ".join(text).upper() if dice.random() < 0.2 else dice.choice([" ", "\n", "\t "]).join(text)))
    rows += [(None, None), (None, rows[0][1]), (None, rows[0][1]), (5, ""), (6, " \n"), (7, rows[7][1]), (7, rows[7][1]), (-3, "a b")]
    return rows + [(900, "a B"), (901, "a b c d"), (None, "only null"), (902, "É é"), (903, "É É")]


CLASHING = "doc_id bigint, text string, component_id string, n_shingles int, drop boolean, n int, row_key string"
SETTINGS = [{}, {"COMMON_TEXTS": 4, "LOT_SHINGLES": 400, "BLOCK": 3, "FILTER_BLOCK": 5, "CELLS": 50}]


@pytest.mark.parametrize("settings", SETTINGS)
def test_components(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(len(settings))
    sets, group = brute(rows)
    documents = spark.createDataFrame([(*r, "x", 1, True, 2, "y") for r in rows], CLASHING)
    got = jaccard.near_duplicates(documents.repartition(4)).collect()
    want = []
    for (doc_id, _), own, g in zip(rows, sets, group):
        ids = [r[0] for r, h in zip(rows, group) if h == g and r[0] is not None]
        want.append((doc_id, len(own), (min(ids) if ids else None) if own else doc_id))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)

    kept = jaccard.one_per_component(documents.repartition(2))
    assert kept.columns == documents.columns
    by_group = {}
    for r, own, g in zip(rows, sets, group):
        if own:
            by_group.setdefault(g, []).append(r)
    want = [r for r, own in zip(rows, sets) if not own]
    left = [(r.doc_id, r.text) for r in kept.collect()]
    for members in by_group.values():
        first = min((r[0] for r in members if r[0] is not None), default=None)
        own = [r for r in left if r in members]
        assert len(own) == 1 and own[0][0] == first
        left.remove(own[0])
    assert sorted(left, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("settings", SETTINGS)
def test_all_links(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = [(i, text) for i, (_, text) in enumerate(near_copies(3))]
    rows += [(500 + i, " ".join(f"w{k}" for k in range(60 + i))) for i in range(4)]  # all linked with one another
    sets = [shingles(text) for _, text in rows]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes = jaccard.text_classes(documents.repartition(4))
    members = {}
    for r in classes.where("class_key IS NOT NULL").collect():
        members.setdefault(r.class_key, set()).add(r.doc_id)
    found = jaccard.links(documents, classes).collect()
    assert len(found) == len(set(found)) and all(r.a < r.b for r in found)
    got = {frozenset((i, j)) for r in found for i in members[r.a] for j in members[r.b]}
    ids = [r[0] for r in rows]
    assert got == {
        frozenset((ids[i], ids[j])) for i in range(len(rows)) for j in range(i) if sets[i] != sets[j] and linked(sets[i], sets[j])
    }


def test_trie_join_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = rng.integers(0, 2**62, rng.integers(1, 60)).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(2, 40)):
            own = rng.choice(base, max(1, int(len(base) * rng.uniform(0.5, 1))), replace=False)
            sets.append(np.unique(np.r_[own, rng.integers(0, 2**62, rng.integers(0, 8)).astype(np.uint64)]))
        plain = [set(s.tolist()) for s in sets]
        want = {(i, j) for j in range(len(sets)) for i in range(j) if linked(plain[i], plain[j])}
        a, b = jaccard.trie_join(sets)
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want
        half = len(sets) // 2
        a, b = jaccard.trie_join(sets[:half], sets[half:])
        assert set(zip(a.tolist(), (b + half).tolist())) == {(i, j) for i, j in want if i < half <= j}
        one, other = jaccard.likely_forest(
            np.array([len(s) for s in sets]), [jaccard.parity_map(s) for s in sets], np.arange(len(sets))
        )
        part = list(range(len(sets)))
        for i, j in zip(one.tolist(), other.tolist()):
            assert part[i] != part[j]
            part = [part[i] if p == part[j] else p for p in part]
        assert all(part[i] == part[j] for i, j in want)
        roots = jaccard.forest(len(sets), np.array([i for i, _ in want], np.int64), np.array([j for _, j in want], np.int64))
        assert len(roots) == len({i for p in want for i in p}) - len({r for r, _ in roots})


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a bigint, b bigint")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_prefix_filter_bound():
    for n in range(1, 200):
        overlap = -(-3 * n // 4)
        assert jaccard.prefix_length(n) == n - overlap + 1


def test_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.near_duplicates(documents).collect() == []
    assert jaccard.one_per_component(documents).collect() == []
