"""Source divergence against plain counting, and its sort against Python's."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD
from zonewright.llm import divergence
from zonewright.llm.divergence import multikey_quicksort, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value int, p string"


def terms(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return TERM.findall(lower)


def plain(rows, least, most):
    docs, count = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms(text)
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(count[lang, s]) for s in sources}
        q = share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, cut in (("pair", pairs, None), ("term", over, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:cut], 1)]
    return sorted(out)


def table(spark, rows):
    data = [(i, t, lang, s, 1, "x", 2, "y") for i, (lang, s, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def made(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "a", "Äpfel", "äpfel", "中文字", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOPQ", "x1y", "😀", "é"]
    words += ["w" + c * k for c in "abc" for k in (1, 7, 8, 9, 40)]
    glue = [" ", "", "1", "\x00", "\n", "-"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), text))
    rows += [("en", "hot", rows[0][2])] * 60 + [(None, "b", t) for _, t in AWKWARD]
    return rows + [("xx", "alone", "one two"), ("yy", "p", None), ("yy", "q", "")]


@pytest.mark.parametrize(("seed", "size"), [(1, 64), (2, 4 << 20)])
def test_same_as_counting(spark, monkeypatch, seed, size):
    rows = made(seed)
    # the workers are forked, so they see the patched size: texts longer than a slice too
    monkeypatch.setattr(divergence, "SLICE", size)
    monkeypatch.setattr(divergence, "CELLS", 50)
    for least, most in ((30, 50), (3, 2)):
        found = source_divergence(table(spark, rows), least_docs=least, most_terms=most)
        assert sorted(map(tuple, found.collect())) == plain(rows, least, most)


def test_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 3)
    rows = [("en", f"s{i % 17}", f"all of {'x' * (i % 5 + 1)} s{i % 3}") for i in range(200)]
    found = source_divergence(table(spark, rows), least_docs=2)
    assert sorted(map(tuple, found.collect())) == plain(rows, 2, 50)


def test_long_texts_in_slices():
    rng = random.Random(3)
    words = ["aa", "b", "é" * 9, "longer" * 20]
    for size in (1, 2, 5, 100, 10_000):
        divergence.SLICE, before = size, divergence.SLICE
        text = "".join(rng.choice(words) + rng.choice([" ", "1"]) for _ in range(50))
        data = np.frombuffer(text.encode(), np.uint8)
        (batch,) = divergence._long_text(data, ("l", "s"))
        divergence.SLICE = before
        got = {r["term"]: (r["n"], r["docs"]) for r in batch.to_pylist()}
        assert got == {t: (n, 1) for t, n in Counter(terms(text)).items()}


def test_sort(monkeypatch):
    rng = random.Random(4)
    for k in range(400):
        monkeypatch.setattr(divergence, "SMALL", rng.choice([1, 2, 24]))
        letters = rng.choice(["ab", "abcdefgh", "aé中😀"])
        words = ["".join(rng.choices(letters, k=rng.choice([1, 2, 7, 8, 9, 16, 17, 30]))).encode()
                 for _ in range(rng.randint(0, 200) if k else 0)]
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
        order, runs = multikey_quicksort(data, start, size)
        assert order.tolist() == sorted(range(len(words)), key=words.__getitem__)
        in_order = [words[i] for i in order]
        assert runs.tolist() == [i for i, w in enumerate(in_order) if not i or w != in_order[i - 1]]


def test_empty_table(spark):
    assert source_divergence(table(spark, [])).count() == 0
