import itertools
import random
import zlib

import numpy as np
import pytest

from logyield.llm import packing
from logyield.llm.queries import tokenizer_path

ODD = [
    "", " ", "\n\n", "  a  b <|endoftext|> x\n\n\ty ", "it's I'LL 'd  ", "\x1c \x85 a\u00a0 b", "日本語 テキスト\u3000 x", "x \x1f y",
    "a" * 20_000, " " * 3000 + "b", "<|endoftext|>", "tail  ", "word\u2003 next", "é ñ ç " * 700,
]


@pytest.fixture(scope="module")
def encoder():
    return packing.UnitTokenizer(tokenizer_path())


def test_units_give_the_tokenizer_s_ids(encoder):
    dice = random.Random(5)
    words = ["the", "Thre", "'s", "don't", "42", "é", "&&&", "", "\t", "\n", "x<|endoftext|>y", "\u00a0"]
    texts = ODD + [" ".join(dice.choices(words, k=dice.randint(0, 60))) for _ in range(200)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want  # remembered units


def test_units_that_share_a_token_and_bounded_memory(encoder, monkeypatch):
    texts = ["the cat and the dog", "and the cat", " a b", "x"] * 3
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for bound in (0, 5):
        monkeypatch.setattr(packing, "REMEMBERED_IDS", bound)
        assert [[x.tolist() for x in encoder.encode([t.encode()])][0] for t in texts] == want
    other = packing.UnitTokenizer(tokenizer_path())

    class Crossing:
        """Takes the whole text for one token."""

        def encode_to_numpy(self, text, allowed_special):
            other.token_bytes[7] = len(text.encode())
            return np.array([7], np.uint32)

    other.fast = Crossing()
    assert [x.tolist() for x in other.encode([t.encode() for t in texts])] == want


def bins(patterns):
    return sum(n for _, n in patterns)


def best_possible(sizes, capacity):
    """Fewest bins, by trying every assignment."""

    def place(i, rooms, limit):
        if i == len(sizes):
            return True
        for k in sorted({rooms.index(r) for r in rooms if r >= sizes[i]}):
            if place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :], limit):
                return True
        return len(rooms) < limit and place(i + 1, [*rooms, capacity - sizes[i]], limit)

    sizes = sorted(sizes, reverse=True)
    return next(n for n in itertools.count() if place(0, [], n))


def test_patterns_hold_every_item_once_and_reduction_keeps_the_optimum():
    dice = random.Random(9)
    for _ in range(150):
        capacity = dice.choice([7, 10, 12])
        sizes = [dice.randint(1, capacity) for _ in range(dice.randint(0, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
        patterns = packing.solve(counts, capacity)
        used = np.zeros(capacity + 1, np.int64)
        for content, n in patterns:
            assert sum(size * each for size, each in content) <= capacity
            for size, each in content:
                used[size] += n * each
        assert (used == counts).all()
        left = counts.copy()
        fixed = packing.reduce_instance(left, capacity)
        rest = [s for s in range(capacity + 1) for _ in range(left[s])]
        assert bins(fixed) + best_possible(rest, capacity) == best_possible(sizes, capacity)


def test_large_instance_is_near_the_lower_bound():
    counts = np.bincount(np.random.default_rng(1).integers(1, 1025, 100_000), minlength=1025)
    assert bins(packing.solve(counts)) <= 1.003 * -(-int((counts * np.arange(1025)).sum()) // 1024)


def check_packing(rows, got, encoder, capacity):
    ids = [np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in rows]
    want = sorted(
        repr((rows[k][0], p, s, n, zlib.crc32(x[s : s + n].tobytes())))
        for k, x in enumerate(ids)
        for p, (s, n) in enumerate(packing.cut(len(x), capacity))
    )
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == want
    placed = {}
    for r in got:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    return len(placed), -(-total // capacity)


def test_pack(spark, encoder):
    dice = random.Random(2)
    rows = [(i, " ".join(dice.choices(["the", "of", "tion", "éa"], k=dice.randint(0, 90))), "row", 0) for i in range(150)]
    rows += [(None, None, "x", 1), (7, "", "x", 1), (7, "", "x", 1), (500, "abc " * 400, "x", 1), (501, " ".join(ODD[:5]), "x", 2)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string, length int").repartition(3)
    got = packing.pack(documents, tokenizer_path(), capacity=64).collect()
    used, least = check_packing(rows, got, encoder, 64)
    assert used <= least + 3
    assert len({r.row_no for r in got}) == len(rows)


def test_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(documents, tokenizer_path()).collect() == []


def test_cut():
    assert packing.cut(1, 10) == [(0, 1)]
    assert packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]
