import random
import re

import numpy as np

from logyield.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
    }


def texts():
    dice = random.Random(1)
    good = [" ".join(dice.choices("the of and reading nation éa ñu".split(), k=80)) for _ in range(30)]
    vocabulary = ["".join(dice.choices("abcdefgh", k=5)) for _ in range(400)]
    good += [" ".join(dice.choices(vocabulary, k=120)) + "." for _ in range(40)]
    junk = [" ".join(w + dice.choice(["###", "$$$", "%%%"]) for w in dice.choices(vocabulary, k=90)) for _ in range(10)]
    fixed = [None, "", " \n\t ", "a", "a b c a b c", "x\nx\n\nx y\nx", "\x0b\x0c\r", "A" * 5000, "a b c d\n" * 40, "|<>#*$%&", "\x00 \x1c"]
    return good + junk + fixed


def test_counts_and_verdicts(spark):
    rows = [(i if i % 9 else None, t, 1, "clash") for i, t in enumerate(texts())]
    documents = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, n_words int, kept string").repartition(3)
    got = rules.judge(documents).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted(repr((i, *(naive(t)[n] for n in names))) for i, t, *_ in rows + rows[:3])
    assert sorted(repr((r.doc_id, *(r[n] for n in names))) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_ratio_tells_junk_from_prose(spark):
    dice = random.Random(4)
    vocabulary = ["".join(dice.choices("abcdefgh", k=4)) for _ in range(200)]
    good = [(i, " ".join(dice.choices(vocabulary, k=100))) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in dice.choices(vocabulary, k=100))) for i in range(20)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(good + junk, "doc_id bigint, text string")).collect()}
    assert all(got[i].kept for i, _ in good)
    assert not any(got[i].kept for i, _ in junk)


def test_score_is_the_mean_ratio(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    ratios = rules.log_ratios(*rules.corpus_counts(documents), rules.Params().smoothing)
    for r in rules.judge(documents).collect():
        shape = rules.shape_of([(rows[r.doc_id][1] or "").encode()])
        want = ratios[shape.grams].mean() if len(shape.grams) else 0.0
        assert abs(r.log_ratio - want) < 1e-9
        assert len(shape.grams) == max(0, 2 * r.n_words - 1)


def test_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    assert rules.judge(documents).collect() == []
    assert not rules.log_ratios(np.zeros(4), np.zeros(4), 1.0).any()
