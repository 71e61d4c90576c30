"""Substring dedup of bytes on a sparse suffix array.

Of all suffixes only those at chosen places are sorted: where the hash of the next ``GRAM``
bytes is the smallest within a window. Equal windows choose the same place, so a window can
only stand twice if the suffix chosen in it begins with the same bytes twice; the rest is
never sorted. Common bytes of this length stand in many texts that share no window, so the key
goes on to the side of the chosen place where the window is longer: to bytes that it holds, too. Copies alike in key, print and length are settled by these hashes, and so are
windows under frequent keys. What remains is partitioned by ranges of the suffixes' leading bytes, with
splitters that Spark samples, and sorted in each range by multikey quicksort; neighbours are
compared, over the borders of batches too, while equal leads never part between ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.repeats import NULL_ID, Scheme, U, covered, marked, mix, settled_windows

#: Bytes by which suffixes are chosen; a power of two.
GRAM = 32


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _gram_hashes(units: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling."""
    out = mix(units.astype(U) + U(1))
    n = 1
    with np.errstate(over="ignore"):
        while n < GRAM:
            out = out[:-n] * U(0xD6E8FEB86659FD93) ^ (out[n:] + (out[n:] >> U(29)))
            out *= U(0x9E3779B97F4A7C15)
            out ^= out >> U(32)
            n *= 2
    return out


def byte_scheme(width: int) -> Scheme:
    if width < 2 * GRAM:
        raise ValueError(f"windows must have at least {2 * GRAM} bytes")
    choices = width - GRAM + 1
    half = choices // 2

    def places(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at + hashes[at[:, None] + np.arange(choices)].argmin(axis=1)

    def keys(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = _gram_hashes(units)
        least, n = hashes, 1
        while 2 * n <= choices:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if rest := choices - n:
            least = np.minimum(least[:-rest], least[rest:])
        # the first smallest one has been left behind: the window has another place
        passed = hashes[: len(least)] == least
        begins = np.concatenate([[True], passed[:-1]])
        new = begins.copy()
        new[1:] |= least[1:] != least[:-1]
        first = np.flatnonzero(new)
        chosen = places(hashes, first)
        with np.errstate(over="ignore"):
            before = mix(least[first] * U(3) + hashes[np.maximum(chosen - half, 0)])
            after = mix(least[first] * U(5) + hashes[np.minimum(chosen + half, len(hashes) - 1)])
        sizes = np.diff(np.append(first, len(least)))
        late = np.repeat(chosen, sizes) - np.arange(len(least)) >= half
        return np.where(late, np.repeat(before, sizes), np.repeat(after, sizes)), begins

    def lead(units: np.ndarray, at: np.ndarray) -> list[bytes]:
        chosen = places(_gram_hashes(units), at)
        begin = np.where(chosen - at >= half, chosen - half, chosen)
        raw = units.tobytes()
        return [raw[i : i + GRAM + half] for i in begin.tolist()]

    return Scheme(width, _bytes, keys, lead, "u1", same_doc=True, by_ranges=True)


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100
) -> DataFrame:
    """Remove each byte covered by a string of ``width`` bytes that also starts earlier: in a
    document of smaller id, or in the same one before. Strings are judged on the input.

    Returns per row the id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs of bytes)
    and ``kept``, the remaining bytes, which may no longer be valid UTF-8. A null text counts
    as empty; a null id is larger than all others. Of rows with one id, equal ones get equal
    results, and of different texts only the places count: neither of two equal starts is
    earlier. An empty table gives an empty one; other columns are not read.
    """
    rows = marked(docs, id_col, text_col)
    gone = settled_windows(rows, byte_scheme(width)).groupBy("id", "mark")
    joined = rows.join(gone.agg(F.collect_list("gone").alias("gone")), ["id", "mark"], "left")

    @F.pandas_udf("n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, told in batches:
            out = []
            for t, g in zip(text, told, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                spans = covered(g, width).tolist() if g is not None else []
                left, at = [], 0
                for a, b in spans:
                    left.append(raw[at:a])
                    at = b
                kept = b"".join([*left, raw[at:]])
                told_spans = [{"begin": a, "end": b} for a, b in spans]
                out.append((len(raw), len(raw) - len(kept), told_spans, kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept"])

    found = joined.select("id", remove("text", "gone").alias("r"))
    return found.select(F.nullif("id", F.lit(NULL_ID)).alias(id_col), "r.*")
