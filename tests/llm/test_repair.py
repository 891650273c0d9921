import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from logyield.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, n bigint, part int, fault string"
EXTRA = ("clash", 7, -1, "t")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        dealt = zlib.crc32(":".join(shown).encode()) % 20
        if dealt == 0:
            continue
        if dealt == 1:
            text = ""
        if dealt == 2:
            text = re.sub("[.!?]", "", text)
        if dealt == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if dealt == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = BLANK.sub("", text)
        out.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Every edit of every row with up to two insertions before each and at the end."""
    best = None
    edits = ["D" if f in ("b", "d") else "KRD" for f in found]
    for inserts in product(["", "I", "II"], repeat=len(rows) + 1):
        for letters in product(*edits):
            for start in ("s", "u"):
                state, cost, lines, fine = start, 0, [], True

                def say(role, text):
                    nonlocal state
                    lines.append(f"{role}:{text}")
                    state = {"s": "u", "u": "a", "a": "u"}[role[0]]

                def insert(count):
                    nonlocal cost
                    for _ in range(count):
                        say("assistant" if state == "a" else "user", "")
                        cost += 2

                if start == "s" and (inserts[0] or "K" not in letters):
                    continue
                for (_, role, text), f, letter, extra in zip(rows, found, letters, inserts):
                    insert(len(extra))
                    if letter == "D":
                        cost += 3
                        continue
                    cost += f == "t"
                    if letter == "K":
                        if not role or role[0] != state:
                            fine = False
                            break
                        say(role, text)
                    else:
                        if state == "s":
                            fine = False
                            break
                        cost += 2
                        say("assistant" if state == "a" else "user", text)
                if not fine:
                    continue
                insert(len(inserts[-1]))
                initials = "".join(x[0] for x in lines)
                if not re.fullmatch("(s?(ua)+)?", initials):
                    continue
                audit = "".join(a + b for a, b in zip(inserts, (*letters, "")))
                if best is None or (cost, audit) < best[:2]:
                    best = (cost, audit, lines)
    return best


def expected(rows, edits=cheapest):
    out = {}
    for conv, mine in after_damage(rows).items():
        found = faults(mine)
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = edits(mine, found) if mine else (0, "", [])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, digest)
    return out


def run(spark, rows, **how):
    table = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    got = [tuple(r) for r in repair.repair(table, **how).collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def stepwise(rows, found):
    """The plain dynamic program over rows and states; held against ``cheapest`` below."""
    legal = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for (state, (cost, audit, lines)), role in product(list(best.items()), "ua"):
                if (state, role) in legal:
                    new = (cost + 2, audit + "I", [*lines, f"{names[role]}:"])
                    if role not in best or new[:2] < best[role][:2]:
                        best[role] = new
        return best

    best = inserted({"0": (0, "", [])})
    for (_, role, text), f in zip(rows, found):
        new = {}

        def offer(state, entry):
            if state not in new or entry[:2] < new[state][:2]:
                new[state] = entry

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 3, audit + "D", lines))
            if f in ("b", "d"):
                continue
            late = f == "t"
            if (state, role[:1]) in legal:
                offer(legal[state, role[:1]], (cost + late, audit + "K", [*lines, f"{role}:{text}"]))
            for other, name in names.items():
                if (state, other) in legal:
                    offer(legal[state, other], (cost + 2 + late, audit + "R", [*lines, f"{name}:{text}"]))
        best = inserted(new)
    return min((best[s] for s in ("0", "a") if s in best), key=lambda e: e[:2])


def small_rows(seed, conversations, longest):
    dice = random.Random(seed)
    texts = ["yes.", "no!", "well", "a. ", "so?\n\t", "  ", "", None, "é.", "long text without end", "x\ny."]
    out = []
    for conv in range(conversations):
        for turn in range(dice.randint(1, longest)):
            role = dice.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            out.append((conv, None if dice.random() < 0.1 else turn, role, dice.choice(texts)))
    return out


def test_insertions_cover_the_states():
    assert repair.INSERTIONS[0][1:] == [None, (2, "I"), (4, "II")]
    assert repair.INSERTIONS[3] == [None, None, (2, "I"), (0, "")]


def test_step_by_step_equals_all_edits():
    for seed in range(40):
        for mine in after_damage(small_rows(seed, 6, 4)).values():
            found = faults(mine)
            if len(mine) <= 4:
                assert stepwise(mine, found) == cheapest(mine, found)


def test_small_conversations(spark):
    rows = small_rows(1, 300, 9)
    rows += [(None, 1, "user", "hi."), (None, 2, "assistant", "ho."), (1000, None, "user", "a."), (1000, None, None, None)]
    assert run(spark, rows) == expected(rows, stepwise)


@pytest.mark.parametrize("chunk_rows", [1, 3, 50])
def test_conversations_of_many_chunks(spark, chunk_rows):
    rows = small_rows(2, 5, 120)
    rows += [(9, 4, "user", "same.")] * 300 + [(9, 5, "assistant", "same.")] * 40 + [(9, t, "user", "same.") for t in range(6, 60)]
    assert run(spark, rows, chunk_rows=chunk_rows) == expected(rows, stepwise)


def test_long_texts_and_repeated_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], ("long " * 300_000) + f"{t}.") for t in range(6)]
    rows += [(2, t, "user", "again.") for t in range(12)] * 3
    assert run(spark, rows) == expected(rows, stepwise)


def test_all_dropped_and_empty(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = run(spark, [(3, turn, "user", "gone.")])
    assert got == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert run(spark, []) == {}


def test_grammar_keeps_sequences():
    grammar = repair.Grammar(["ua", chr(0x100) * 2, "Us"])
    dice = random.Random(4)
    for _ in range(200):
        symbols = "".join(dice.choices("DuaosUAOS", k=dice.randint(0, 40)))
        plain = repair.Grammar()
        assert grammar.walk(repair.BEGIN, symbols) == plain.walk(repair.BEGIN, symbols)
    assert repair.apart(["ua", "au", "ss", "Da"], 9) == ["ua", "ss", "Da"]
