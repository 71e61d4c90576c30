"""Substring dedup of words by recompression.

A round names runs of equal symbols, then pairs of neighbours (a, b) with a in one half of all
symbols and b in the other. A name is a hash of what it stands for and of the round, and so is
the half, so all tasks give the same names without asking each other, and equal substrings
have equal symbols but near their ends. For each symbol the words on which its naming depends
are known. Of the symbols of the highest round whose words lie all in a window, the one of the
smallest hash is the window's key: equal windows have equal keys. The hash covers the name and
all words on which it depends: the few words a symbol stands for stand together in many texts
that share no window. Shared keys reveal repeats: segments alike in key, print and length are
settled by these hashes, windows under frequent keys too; the rest is verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.repeats import NULL_ID, Scheme, U, covered, marked, mix, prints, settled_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Beyond any place: what lies outside the words at hand is not known.
_FAR = 1 << 40


class _Codes(dict):
    """64-bit codes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


_CODES = _Codes()


def word_codes(text: str) -> np.ndarray:
    words = WORD.findall(text)
    return np.fromiter(map(_CODES.__getitem__, words), U, len(words))


def name_runs(symbols: np.ndarray, first: np.ndarray, last: np.ndarray):
    """One symbol per maximal run. To be maximal it must be seen that its neighbours differ."""
    start = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    end = np.append(start[1:], len(symbols)) - 1
    times = (end - start + 1).astype(U)
    with np.errstate(over="ignore"):
        run = mix(symbols[start] + times * U(0x9E3779B97F4A7C15))
    names = np.where(times > 1, run, symbols[start])
    before = np.concatenate([[-_FAR], first[end[:-1]]])
    after = np.append(last[start[1:]], _FAR)
    return names, np.minimum(before, first[start]), np.maximum(after, last[end])


def name_pairs(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, number: int):
    """One symbol per pair of a left and a right one. A symbol without a partner depends on the
    neighbour that is none."""
    with np.errstate(over="ignore"):
        left = (mix(symbols + U(7919 * number + 13)) >> U(63)) == 0
    opens = np.append(left[:-1] & ~left[1:], False)
    at = np.flatnonzero(~np.concatenate([[False], opens[:-1]]))
    pair, is_left = opens[at], left[at]
    following = np.append(last[1:], _FAR)[at]
    previous = np.concatenate([[-_FAR], first[:-1]])[at]
    with np.errstate(over="ignore"):
        nxt = np.append(symbols[1:], U(0))[at]
        both = mix(mix(symbols[at]) * U(3) + nxt + U(number))
    names = np.where(pair, both, symbols[at])
    first = np.where(~pair & ~is_left, np.minimum(first[at], previous), first[at])
    last = np.where(is_left, np.maximum(last[at], following), last[at])
    return names, first, last


def _counts(values: np.ndarray, n: int) -> np.ndarray:
    """How many values are at most x, for x from 0 to n."""
    return np.cumsum(np.bincount(np.clip(values, 0, n + 1), minlength=n + 2))[: n + 1]


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The minimum of values[a:b] for each pair, which are at most ``most`` apart: of two
    stretches of a power of two that cover the range."""
    stretches, n = [values], 1
    while 2 * n <= most:
        shorter = stretches[-1]
        longer = shorter.copy()
        longer[:-n] = np.minimum(shorter[:-n], shorter[n:])
        stretches.append(longer)
        n *= 2
    power = np.array([0, *(int(x).bit_length() - 1 for x in range(1, most + 1))])[b - a]
    table = np.stack(stretches)
    return np.minimum(table[power, a], table[power, b - (1 << power)])


def word_scheme(width: int, rounds: int = 2) -> Scheme:
    def keys(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = len(units) - width + 1
        out = np.zeros(count, U)
        left = np.ones(count, bool)
        place = np.arange(len(units))
        levels = [(mix(units), place, place + 1)]
        for r in range(rounds):
            levels.append(name_pairs(*name_runs(*levels[-1]), r))
        for level in range(rounds, -1, -1):
            names, first, last = levels[level]
            # a symbol that depends on more than its neighbour does is as good as that one
            first = np.minimum.accumulate(first[::-1])[::-1]
            last = np.maximum.accumulate(last)
            # symbols [a, b) depend on nothing outside the window
            a = _counts(first + 1, len(units))[:count]
            b = _counts(last, len(units))[width : width + count]
            at = np.flatnonzero(left & (a < b))
            words = prints(units, *(np.clip(x, 0, len(units)) for x in (first, last)))
            with np.errstate(over="ignore"):
                hashes = mix(names + words + U(level))
            out[at] = _least(hashes, a[at], b[at], width)
            left[at] = False
            if not left.any():
                break
        return out, np.zeros(count, bool)

    def lead(units: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw = keys(units)[0][at].astype(">u8").tobytes()
        return [raw[i : i + 8] for i in range(0, len(raw), 8)]

    return Scheme(width, word_codes, keys, lead, "<u8", same_doc=False, by_ranges=False)


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13
) -> DataFrame:
    """Remove each word covered by ``width`` consecutive words that also stand, in this order, in
    a document of smaller id. Words are what lies between ASCII white space; passages are
    judged on the input.

    Returns per row the id, ``n_words``, ``n_removed``, ``spans`` (maximal removed runs of words)
    and ``text``, the remaining words joined by one space. A null text has no words; a null id
    is larger than all others; rows with one id never remove each other's words. An empty table
    gives an empty one; other columns are not read.
    """
    rows = marked(docs, id_col, text_col)
    gone = settled_windows(rows, word_scheme(width)).groupBy("id", "mark")
    joined = rows.join(gone.agg(F.collect_list("gone").alias("gone")), ["id", "mark"], "left")

    @F.pandas_udf("n_words long, n_removed long, spans array<struct<begin:long,end:long>>, text string")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, told in batches:
            out = []
            for t, g in zip(text, told, strict=True):
                words = WORD.findall(t)
                spans = covered(g, width).tolist() if g is not None else []
                left, at = [], 0
                for a, b in spans:
                    left += words[at:a]
                    at = b
                left += words[at:]
                told_spans = [{"begin": a, "end": b} for a, b in spans]
                out.append((len(words), len(words) - len(left), told_spans, " ".join(left)))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "spans", "text"])

    found = joined.select("id", remove("text", "gone").alias("r"))
    return found.select(F.nullif("id", F.lit(NULL_ID)).alias(id_col), "r.*")
