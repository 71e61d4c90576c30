"""The three dedup operators against what their contracts say, word for word."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.helpers import AWKWARD, docs, repeats
from zonewright.llm import repeats as engine
from zonewright.llm.line_dedup import KEY, PerfectHash, dedup_lines
from zonewright.llm.recompression import dedup_passages, word_scheme
from zonewright.llm.suffix_dedup import byte_scheme, dedup_substrings

LAST = 2**63


def order(row):
    return LAST if row[0] is None else row[0]


def window(units, i, width):
    part = units[i : i + width]
    return part if isinstance(part, bytes) else tuple(part)


def covered_by(rows, units, width, earlier):
    """For each row the set of units covered by windows that stand earlier."""
    seen = {}
    for row in rows:
        u = units(row[1])
        for i in range(len(u) - width + 1):
            seen.setdefault(window(u, i, width), set()).add((order(row), i))
    least = {w: min(at) for w, at in seen.items()}
    out = []
    for row in rows:
        u = units(row[1])
        gone = set()
        for i in range(len(u) - width + 1):
            if earlier(least[window(u, i, width)], (order(row), i)):
                gone.update(range(i, i + width))
        out.append((row, u, gone))
    return out


def bytes_brute(rows, width):
    units = lambda t: (t or "").encode()
    for row, u, gone in covered_by(rows, units, width, lambda a, b: a < b):
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(c for i, c in enumerate(u) if i not in gone)
        yield row[0], len(u), len(gone), spans, kept


def words_brute(rows, width):
    units = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for row, u, gone in covered_by(rows, units, width, lambda a, b: a[0] < b[0]):
        yield row[0], len(u), len(gone), " ".join(w for i, w in enumerate(u) if i not in gone)


def lines_brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    first = {}
    for row in rows:
        for x in (row[1] or "").split("\n"):
            first[key(x)] = min(first.get(key(x), LAST + 1), order(row))
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(row)]
        yield row[0], len(lines), len(lines) - len(kept), "\n".join(kept)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("frequent", [16_384, 32])
def test_bytes(spark, seed, frequent, monkeypatch):
    monkeypatch.setattr(engine, "FREQUENT", frequent)
    monkeypatch.setattr(engine, "SAMPLE", 32 if frequent > 32 else 1)
    rows = repeats(seed, vocabulary=12) + AWKWARD
    rows += [(70, "abc" * 500), (71, "z" * 3000), (72, "z" * 99), (73, "é" * 50), (74, "é" * 49)]
    found = dedup_substrings(docs(spark, rows))
    got = [
        (r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect()
    ]
    assert sorted(got, key=repr) == sorted(bytes_brute(rows, 100), key=repr)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("frequent", [16_384, 32])
def test_words(spark, seed, frequent, monkeypatch):
    monkeypatch.setattr(engine, "FREQUENT", frequent)
    monkeypatch.setattr(engine, "SAMPLE", 32 if frequent > 32 else 1)
    rows = repeats(seed, vocabulary=6) + AWKWARD
    rows += [(70, "a b " * 200), (71, "a " * 300), (72, "a\x0bb c " * 20), (73, "a " * 12)]
    got = rows_of(dedup_passages(docs(spark, rows)), "doc_id", "n_words", "n_removed", "text")
    assert got == sorted(words_brute(rows, 13), key=repr)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("scheme", [byte_scheme(100), word_scheme(13)])
def test_keys_do_not_depend_on_how_long_texts_are_cut(monkeypatch, scheme):
    rows = repeats(3, n=20, vocabulary=40)
    ids, texts = [r[0] for r in rows], [r[1] * 3 for r in rows]

    def keys():
        return {
            (of, lo + k): key
            for found, _, _ in engine._cut(scheme, ids, ids, texts)
            for of, lo, n, key in zip(found.of, found.lo, found.n, found.key, strict=True)
            for k in range(n)
        }

    whole = keys()
    monkeypatch.setattr(engine, "CHUNK_UNITS", 150)
    assert keys() == whole and whole


@pytest.mark.parametrize("scheme", [byte_scheme(100), word_scheme(13)])
def test_copies_under_frequent_keys_become_one_row_of_a_task(scheme):
    text = " ".join(f"w{i}" for i in range(200))
    ids = list(range(40))
    batch = pd.DataFrame({"id": ids, "mark": 0, "text": text})
    keys = np.unique(next(engine._cut(scheme, ids, ids, [text] * 40))[0].key)
    packs = pd.concat(engine._pack(scheme, 4, keys)(iter([batch])))
    often = [o for row in packs["often"] for o in row]
    assert {o["id"] for o in often} == {0}
    assert len(often) == len({(o["key"], o["print"], o["n"]) for o in often}) > 10
    assert sorted(g["id"] for row in packs["gone"] for g in row) == ids[1:]


def test_texts_without_a_common_passage_share_few_keys():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.5))}" for _ in range(60_000)]
    texts = [" ".join(words[a : a + 600]) for a in range(0, len(words), 600)]
    windows = [tuple(words[a + i : a + i + 13]) for a in range(0, len(words), 600) for i in range(588)]
    assert len(set(windows)) > 0.99 * len(windows)
    ids = list(range(len(texts)))
    keys = [k for found, _, _ in engine._cut(word_scheme(13), ids, ids, texts) for k in found.key]
    shared = sum(n for n in Counter(keys).values() if n > 1)
    assert shared < 0.05 * len(keys)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rows = [
        (i, t.replace(" ", "\n", 2).replace("w1", "W1 \t")) for i, t in repeats(seed)
    ] + AWKWARD
    rows += [(80, "Ten chars!\nother"), (81, "  TEN chars!\r\nÉother line"), (82, "éother line")]
    got = rows_of(dedup_lines(docs(spark, rows)), "doc_id", "n_lines", "n_dropped", "text")
    assert got == sorted(lines_brute(rows), key=repr)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("dedup", [dedup_substrings, dedup_passages, dedup_lines])
def test_empty_table(spark, dedup):
    assert dedup(docs(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_survives_storage():
    import numpy as np

    raw = np.random.default_rng(1).integers(0, 2**63, 20_000).astype("<u8")
    keys = raw.view(KEY)
    keys["high"][:5] = 1
    perfect = PerfectHash.load(*PerfectHash.build(keys).dump())
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [0, 0, 0]


def test_hash_of_kept_text(spark):
    from pyspark.sql import functions as F

    df = dedup_lines(docs(spark, [(1, "ä")])).select(F.sha2("text", 256).alias("h"))
    assert df.first().h == hashlib.sha256("ä".encode()).hexdigest()
