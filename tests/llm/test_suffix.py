import hashlib
import random

import numpy as np
import pytest

from logyield.llm import suffix


def removed(rows, length):
    """(n_bytes, covered flags) of every row, by looking up every string."""
    least = {}
    for doc_id, text in rows:
        body = (text or "").encode()
        if doc_id is not None:
            for p in range(len(body) - length + 1):
                own = body[p : p + length]
                least[own] = min(least.get(own, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if doc_id is not None and least[body[p : p + length]] < doc_id:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def passages(seed, n=50):
    dice = random.Random(seed)
    letters = "abcdé \n"
    shared = ["".join(dice.choices(letters, k=dice.randint(40, 130))) for _ in range(6)] + ["x" * 200, "ab" * 60]
    rows = []
    for i in dice.sample(range(1000), n):
        parts = [dice.choice(shared) if dice.random() < 0.5 else "".join(dice.choices(letters, k=dice.randint(0, 90))) for _ in range(4)]
        rows.append((i, "".join(parts)))
    rows += [(None, rows[0][1]), (None, None), (2000, rows[1][1]), (2001, rows[1][1]), (2001, rows[1][1]), (-1, ""), (-2, "short")]
    return rows + [(3000, "short"), (3001, "\x00" * 120), (3002, "\x00" * 70 + "z"), (rows[2][0], shared[0] + "other"), (3003, "x" * 50)]


CLASHING = "doc_id bigint, text string, digest string, n_bytes int, least_id int, cut boolean"


@pytest.mark.parametrize("hot_texts, bucket_bytes", [(4096, 1_200_000), (1, 300)])
def test_removal(spark, monkeypatch, hot_texts, bucket_bytes):
    monkeypatch.setattr(suffix, "HOT_TEXTS", hot_texts)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1500)
    monkeypatch.setattr(suffix, "PIECE", 64)
    rows = passages(hot_texts)
    want = removed(rows, suffix.LENGTH)
    documents = spark.createDataFrame([(*r, "x", 7, 1, True) for r in rows], CLASHING)
    got = suffix.remove_repeats(documents.repartition(3)).collect()
    key = repr
    assert sorted(map(tuple, got), key=key) == sorted((w[:5] for w in want), key=key)

    left = suffix.without_repeats(documents.repartition(2))
    assert left.columns == documents.columns
    expected = [(w[0], w[5].decode("utf-8", "ignore") if w[2] else r[1]) for r, w in zip(rows, want)]
    expected = [(i, t) for (i, t), w in zip(expected, want) if not (w[2] and not t)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted(expected, key=key)


def test_index_marks_what_a_dictionary_marks():
    dice = random.Random(8)
    for _ in range(60):
        length = dice.choice([4, 6, 10, 50])
        base = bytes(dice.choice(b"ab") for _ in range(60))
        contexts, owners = [], []
        for _ in range(dice.randint(1, 40)):
            n = dice.randint(length, 2 * length - suffix.gram_of(length))
            start = dice.randint(0, max(0, 60 - n))
            own = base[start : start + n] if dice.random() < 0.6 and n <= 60 else bytes(dice.choice(b"abc\x00") for _ in range(n))
            contexts.append(own)
            owners.append(dice.randint(0, 9))
        least = {}
        for own, owner in zip(contexts, owners):
            for k in range(len(own) - length + 1):
                least[own[k : k + length]] = min(least.get(own[k : k + length], 99), owner)
        bits = suffix.marked_windows(
            np.frombuffer(b"".join(contexts), np.uint8), np.array([len(c) for c in contexts]), np.array(owners, np.int64), length
        )
        for own, owner, found in zip(contexts, owners, bits.tolist()):
            assert found == sum(1 << k for k in range(len(own) - length + 1) if least[own[k : k + length]] < owner)


def test_matching_statistics_are_longest_matches():
    dice = random.Random(3)
    for _ in range(30):
        contexts = [bytes(dice.choice(b"abc") for _ in range(dice.randint(1, 30))) for _ in range(dice.randint(1, 8))]
        contexts = sorted(set(contexts))
        sizes = np.array([len(c) for c in contexts])
        index = suffix.RunLengthIndex(np.frombuffer(b"".join(contexts), np.uint8), sizes, np.zeros(len(sizes), np.int64), 4)
        text = bytes(max(0, c - 1) for c in index.text)  # ends become 0
        query = bytes(dice.choice(b"abcd") for _ in range(40))
        pointers = index.matching_statistics(np.frombuffer(query, np.uint8), np.array([len(query)]))

        def common(p, i):
            n = 0
            while i + n < len(query) and text[p + n] == query[i + n] and text[p + n]:
                n += 1
            return n

        for i, p in enumerate(pointers.tolist()):
            assert common(p, i) == max(common(q, i) for q in range(len(text)))
        assert len(index.heads) <= len(text)


def test_equal_windows_have_equal_anchors():
    dice = random.Random(6)
    texts = [bytes(dice.choice(b"abcdefgh \n") for _ in range(dice.randint(0, 300))) for _ in range(20)]
    texts += [texts[0][20:] + b"!", b"#" * 7 + texts[1]]
    buffer, starts = suffix.joined(texts)
    found = suffix.anchors(buffer, starts)
    seen = {}
    for h, first, last, text in zip(found.hash, found.first, found.last, found.text):
        for p in range(first, last + 1):
            assert starts[text] <= p and p + 50 <= starts[text + 1] - 1
            seen.setdefault(buffer[p : p + 50].tobytes(), set()).add(int(h))
    windows = [t[p : p + 50] for t in texts for p in range(len(t) - 49)]
    assert set(windows) == set(seen) and all(len(h) == 1 for h in seen.values())


def test_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix.remove_repeats(documents).collect() == []
    assert suffix.without_repeats(documents).collect() == []


def test_rows_of_a_shard_do_not_grow_with_the_buckets(spark, monkeypatch):
    for name, value in (("BUCKET_BYTES", 60), ("SHARD_BYTES", 4000), ("HOT_TEXTS", 2)):
        monkeypatch.setattr(suffix, name, value)
    rows = passages(2)
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(2)
    shards = suffix.distinct_texts(documents, suffix.text_rows(documents), suffix.LENGTH)
    shared = suffix.shared_anchors(shards, 8, suffix.LENGTH)
    groups, split = suffix.dealing(sum(len(r.anchors) for r in shared.collect()) // 8, 8, suffix.LENGTH)
    assert split > 4
    dealt = suffix.contexts(shards, shared, groups, split, suffix.LENGTH).where("length(contexts) > 0").collect()
    assert len(dealt) == len({(r.shard, r.group) for r in dealt})
    parts = [(r.shard, r.group, part) for r in dealt for part in set(np.frombuffer(r.parts, np.uint16) >> 1)]
    assert len(dealt) < len(parts) / 2
