"""Repair of conversations against plain dynamic programming over whole strings."""

import hashlib
import random
from collections import Counter

import pytest

from zonewright.llm.repair import Row, digests, join_spans, repair_conversations, repair_rows, spans

WORDS = ["Hi.", "Who?", "No!", "cut", "", "\t \n", "é😀.", "x. ", " ", "same.", "same."]
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
SCHEMA = "conv_id long, turn long, role string, text string, part string, told int, rows string, n int"


def plain(rows):
    """(counts..., cost, audit, turns) of the cheapest and then least audit, trying every edit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    best = {"": (0, "", ())}
    counts = Counter()
    seen = set()

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, said) in list(out.items()):
                for role in "ua":
                    if (state, role) in GRAMMAR:
                        turn = ({"u": "user", "a": "assistant"}[role], "")
                        put(out, GRAMMAR[state, role], (cost + 5, audit + "I", (*said, turn)))
        return out

    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else ""
        fault = fault or ("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
        counts[fault] += 1
        then = {}
        for state, (cost, audit, said) in inserted(best).items():
            put(then, state, (cost + 2, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            for letter, more, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                if (state, name[:1]) in GRAMMAR and name:
                    value = (cost + more + extra, audit + letter, (*said, (name, text)))
                    put(then, GRAMMAR[state, name[:1]], value)
        best = then
    ends = inserted(best)
    cost, audit, said = min((ends[s] for s in ("", "a") if s in ends), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    faults = (counts["blank"], counts["duplicate"], counts["truncated"])
    return (gaps, *faults, illegal, cost, audit), list(said)


def conversation(rng, most=9):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " "]
    return [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(WORDS) + rng.choice(["", "", "y."]))
            for _ in range(rng.randint(0, most))]


def as_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    out, seen = [], set()
    for turn, role, text in rows:
        if out and (out[-1].turn, out[-1].role, out[-1].text) == (turn, role, text):
            out[-1].n += 1
        else:
            out.append(Row(role, text, 1, turn, (role, text) in seen))
        seen.add((role, text))
    return out


def test_agenda_and_spans():
    rng = random.Random(1)
    for _ in range(1500):
        made = conversation(rng, 14)
        want = plain(made)[0][-2:]
        rows = as_rows(made)
        assert repair_rows(rows) == want
        size = rng.randint(1, 5)
        blocks = [spans(rows[a : a + size]) for a in range(0, len(rows), size)]
        assert join_spans(blocks) == want


@pytest.mark.parametrize("most_rows", [1, 3, 512])
def test_conversations(spark, most_rows):
    rng = random.Random(most_rows)
    chats = {i: conversation(rng) for i in range(60)}
    chats[7] = conversation(rng, 1) * 40 + [(t, "user", "again.") for t in range(300)]  # a hot one
    chats[8] = [(t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(400)]
    chats[None] = conversation(rng) + [(None, "user", "no number."), (3, "assistant", "none here.")]
    data = [(i, *r, "x", 1, "y", 2) for i, rows in chats.items() for r in rows]
    rng.shuffle(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    reports, turns = repair_conversations(df, most_rows=most_rows)
    told = {r.conv: tuple(r)[1:] for r in reports.collect()}
    said, blocks = {}, {}
    for r in sorted(turns.collect(), key=lambda r: (r.part, r.block)):
        said.setdefault(r.conv, []).extend((t.role, t.text) for t in r.turns)
        blocks.setdefault(r.conv, []).append(len(r.turns))
    hashes = {r.conv: r.sha256 for r in digests(turns).collect()}
    for i, rows in chats.items():
        if not rows:
            assert i not in told
            continue
        want, kept = plain(rows)
        assert told[i] == want, i
        assert said[i] == kept
        assert hashes[i] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    if most_rows == 3:
        assert len(blocks[8]) > 100 and max(blocks[8]) <= 3 * 3


def test_a_very_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "long " * 400_000 + ".", "", 0, "", 0), (1, 1, "assistant", "short.", "", 0, "", 0)]
    reports, turns = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert reports.first().audit == "KK"
    assert sum(len(t.text) for r in turns.collect() for t in r.turns) == 2_000_007
    reports, turns = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert reports.count() == turns.count() == digests(turns).count() == 0
