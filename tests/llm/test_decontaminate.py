import hashlib
import random
import re

import pytest

from logyield.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def windows(items):
    out = {}
    for key, text in items:
        own = words(text)
        for i in range(max(1, len(own) - 9) if own else 0):
            out.setdefault(tuple(own[i : i + 10]), set()).add("null" if key is None else str(key))
    return out


def expected(text, wanted):
    own = words(text)
    hit, items = set(), set()
    for size in {len(w) for w in wanted}:
        for i in range(len(own) - size + 1):
            found = wanted.get(tuple(own[i : i + size]))
            if found:
                hit.update(range(i, i + size))
                items |= found
    return len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def near(text, wanted, span):
    own, items = words(text), set()
    for i in range(len(own)):
        inside = set(own[i : i + span])
        for window, names in wanted.items():
            if set(window) <= inside:
                items |= names
    return items


def corpus(seed, n=60):
    dice = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma", "Éa", "x9", "the", "of", "ß"]
    items = [(i, " ".join(dice.choices(vocabulary, k=dice.randint(0, 14)))) for i in range(12)]
    items += [(12, items[3][1]), (None, "the of the"), (14, None), (15, "--- ,,,"), (2, "beta of beta")]
    documents = []
    for i in range(n):
        text = dice.choices(vocabulary, k=dice.randint(0, 60))
        if dice.random() < 0.5:
            at = dice.randint(0, len(text))
            text[at:at] = (dice.choice(items)[1] or "").split()
        documents.append((i, dice.choice([" ", ", ", "\n-"]).join(text), "clash", 1))
    documents += [(None, None, "clash", 1), (3, "", "clash", 1), (4, documents[4][1], "clash", 1), (4, documents[4][1], "clash", 1)]
    return documents, items


@pytest.mark.parametrize("block_words", [2_000_000, 20, 11, 1])
def test_report(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rows, items = corpus(block_words % 7)
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, items string, n_words int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontaminate.build_index(documents, shard_bytes=2000)
    got = decontaminate.report(index, benchmark).collect()
    wanted = windows(items)
    key = repr
    want = sorted(((r[0], *expected(r[1], wanted)) for r in rows), key=key)
    assert sorted(((r.id, r.n_words, r.n_hit, len(r.items), r.items_sha256) for r in got), key=key) == want
    want = sorted(((r[0], sorted(near(r[1], wanted, decontaminate.SPAN))) for r in rows), key=key)
    assert sorted(((r.id, sorted(r.near)) for r in got), key=key) == want


def test_matches_name_their_places(spark):
    documents = spark.createDataFrame([(1, "x a b c y c b a"), (2, "a x x b x c"), (3, "c a")], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", "a b c")], "item_id string, text string")
    got = decontaminate.matches(decontaminate.build_index(documents), items, size=3, span=4).collect()
    assert [(r.id, r.first_word, r.n_words) for r in got if r.exact] == [(1, 1, 3)]
    assert sorted({r.id for r in got if not r.exact}) == [1]
    wide = decontaminate.matches(decontaminate.build_index(documents), items, size=3, span=6).collect()
    assert sorted({r.id for r in wide if not r.exact}) == [1, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert decontaminate.report(decontaminate.build_index(none), no_items).collect() == []
    assert decontaminate.report(decontaminate.build_index(none), spark.createDataFrame([(1, "a")], "item_id bigint, text string")).collect() == []
    row = decontaminate.report(decontaminate.build_index(some), no_items).first()
    assert (row.n_words, row.n_hit, row["items"]) == (2, 0, [])


def test_blocks_are_bounded_by_words(spark):
    text = ",".join(f"Wörd{i}" for i in range(95))  # no blank at all
    rows = [(1, text), (2, "a b"), (3, None), (4, "--"), (5, "\n".join("x" * 30)), (6, "c\td")]
    items = spark.createDataFrame(rows, "item_id bigint, text string").coalesce(1)
    for most in (10, 11, 25, 94, 95, 1000):
        blocks = list(decontaminate.blocks_of_items(items, most=most))
        assert all(sum(len(words(t)) for _, t in block) <= most for block in blocks)
        found, wanted = {}, windows(rows)
        for block in blocks:
            for window, keys in windows(block).items():
                found.setdefault(window, set()).update(keys)
        assert found == wanted
        assert sum(len(windows([part])) for b in blocks for part in b if part[0] == 1) == 86
