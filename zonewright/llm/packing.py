"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Items of one length are alike, so a packing is planned over the counts per length, which are
as many as the capacity allows lengths, whatever the number of items. The reduction fixes
sets that some optimal packing holds: with the longest item, the item that fills its sequence
exactly, or the longest that fits if no two or three others can do better. The rest is packed
best-fit, longest first, whole groups of alike sequences at a time. Spark then numbers the
items of each length and looks up the place that the plan has for that number.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import keep

#: Fixed value: how byte-level BPE cuts a text before its merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: From about a million white-space characters in a row ``tiktoken`` refuses a text.
BLANK_RUN = 500_000
_BLANKS = re.compile(rf"\s{{{BLANK_RUN}}}")


def byte_ranks(file: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(rank of each token's bytes, special tokens) of a tokenizer file, if it is plain
    byte-level BPE in which a token's id is its rank among the merges; else None."""
    with open(file, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not told["normalizer"]
        and not any(
            model.get(k)
            for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
        )
        and not model.get("ignore_merges")
        and all(
            t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
            for t in told["added_tokens"]
        )
    )
    if not plain:
        return None
    # The characters by which such files write bytes: printable ones stand for themselves.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [words.get(w) for w in merged] != sorted(i for w, i in words.items() if len(w) > 1):
        return None
    return {bytes(byte_of[c] for c in w): i for w, i in words.items()}, special


class ByteTokenizer:
    """Token ids as little-endian 32-bit numbers, as the library ``tokenizers`` gives them for
    a file. For plain byte-level BPE the same ids come several times faster from its ranks;
    texts with a very long run of white space, or refused for another reason, go to the library."""

    def __init__(self, file: str) -> None:
        self.file = file
        self.slow = self.fast = None
        if ranks := byte_ranks(file):
            import tiktoken

            self.fast = tiktoken.Encoding(
                "ranks", pat_str=PATTERN, mergeable_ranks=ranks[0], special_tokens=ranks[1]
            )

    def encode(self, text: str) -> bytes:
        ids = None
        if self.fast and not (len(text) >= BLANK_RUN and _BLANKS.search(text)):
            try:
                ids = self.fast.encode(text, allowed_special="all")
            except ValueError:  # its pattern ran out of stack
                pass
        if ids is None:
            ids = self._library().encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def _library(self):
        if self.slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
        return self.slow


@lru_cache(maxsize=2)
def _tokenizer(file: str) -> ByteTokenizer:
    return ByteTokenizer(file)


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = 2048,
    end_id: int | None = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Token ids of each text, ``end_id`` after them, cut into pieces of ``capacity``.

    Per piece: the id, ``piece`` from 0, ``start`` (tokens of the text before it), ``length``,
    ``ids`` (little-endian 32-bit; null without ``with_ids``) and ``ids_crc32``. Only the first piece can be shorter.
    A null text counts as empty. A text without tokens and without an end id has no piece.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids:binary,ids_crc32:long>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(tokenizer_file)
        for batch in batches:
            out = []
            for text in batch:
                ids = tokenizer.encode(text) + tail
                first = len(ids) % width or min(width, len(ids))
                ends = range(first, len(ids) + 1, width) if ids else ()
                begin, pieces = 0, []
                for n, end in enumerate(ends):
                    part = ids[begin:end]
                    pieces.append(
                        {
                            "piece": n,
                            "start": begin // 4,
                            "length": len(part) // 4,
                            "ids": part if with_ids else None,
                            "ids_crc32": zlib.crc32(part),
                        }
                    )
                    begin = end
                out.append(pieces)
            yield pd.Series(out)

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias(id_col), F.explode(cut(text)).alias("p"))
    return rows.select(id_col, "p.*")


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How to pack ``counts[w]`` items of each length w: (copies, [(length, times), ...])."""
    left = counts.astype(np.int64).copy()
    out = _reduce(left, capacity)
    open_groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms = np.zeros(capacity + 1, bool)  # whether a group has this much room

    def put(room: int, copies: int, held: list[tuple[int, int]]) -> None:
        if copies:
            open_groups.setdefault(room, []).append((copies, held))
            rooms[room] = True

    for w in range(capacity, 0, -1):
        while left[w]:
            fit = np.flatnonzero(rooms[w:])
            room = w + int(fit[0]) if len(fit) else capacity
            times = min(room // w, int(left[w]))
            full = int(left[w]) // times  # how many sequences take that many
            held: list[tuple[int, int]] = []
            if len(fit):
                copies, held = open_groups[room].pop()
                rooms[room] = bool(open_groups[room])
                full = min(copies, full)
                put(room, copies - full, held)
            put(room - times * w, full, [*held, (w, times)])
            left[w] -= full * times
    return out + [group for groups in open_groups.values() for group in groups]


def _reduce(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Take dominating sets out of ``left`` until there is none with a longest item."""
    out: list[tuple[int, list[tuple[int, int]]]] = []
    again = True
    while again:
        again = False
        for w in range(capacity, 0, -1):
            while left[w]:
                left[w] -= 1
                room = capacity - w
                fits = np.flatnonzero(left[: room + 1])
                if not len(fits):
                    left[w] += 1
                    out.append((int(left[w]), [(w, 1)]))
                    left[w] = 0
                    again = True
                    break
                best = int(fits[-1])
                sure = best == room or _no_better(left, fits, room, best)
                left[w] += 1
                if not sure:
                    break
                copies = int(left[w]) // 2 if best == w else int(min(left[w], left[best]))
                out.append((copies, [(w, 2)] if best == w else [(w, 1), (best, 1)]))
                left[w] -= copies
                left[best] -= copies
                again = True
    return out


def _no_better(left: np.ndarray, fits: np.ndarray, room: int, best: int) -> bool:
    """Whether no two items within ``room`` are longer together than ``best`` is, and no three
    fit: then the one item can take the place of whatever goes there."""
    least = []
    for x in fits[:3].tolist():
        least += [x] * int(min(3, left[x]))
    if len(least) >= 3 and sum(least[:3]) <= room:
        return False
    present = left[: room + 1] > 0
    for x in fits.tolist():
        if 2 * x > room:
            break
        upper = np.flatnonzero(present[x : room - x + 1])
        top = x + int(upper[-1])
        if top == x and left[x] < 2:
            continue
        if x + top > best:
            return False
    return True


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    piece_col: str = "piece",
    length_col: str = "length",
    bucket_rows: int = 50_000,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each at its place in a sequence.

    Lengths must be 1 to ``capacity``. Repeated rows are packed each for itself, null ids like
    others, an empty table gives an empty one. ``pieces`` is read twice, so it should be a
    stored table. Items of one length are numbered in buckets of about ``bucket_rows`` rows,
    so a length that a third of all items have is spread over many tasks.
    """
    spark = pieces.sparkSession
    found = pieces.groupBy(col(length_col).alias("length")).agg(F.count("*").alias("n"))
    rows = found.orderBy("length").limit(capacity + 1).collect()  # a row per length at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        if r["length"] is None or not 1 <= r["length"] <= capacity:
            raise ValueError(f"length {r['length']} is not within 1 and {capacity}")
        counts[r["length"]] = r["n"]
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for copies, held in plan(counts, capacity):
        offset = 0
        for w, times in held:
            places.setdefault(w, []).append((int(taken[w]), sequence, times, offset))
            taken[w] += copies * times
            offset += w * times
        sequence += copies
    shared = spark.sparkContext.broadcast({w: np.array(x, np.int64) for w, x in places.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequences, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for w in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == w)
            spots = shared.value[w]
            spot = spots[np.searchsorted(spots[:, 0], ranks[at], side="right") - 1]
            nth = ranks[at] - spot[:, 0]
            sequences[at] = spot[:, 1] + nth // spot[:, 2]
            offsets[at] = spot[:, 3] + nth % spot[:, 2] * w
        return pd.DataFrame({"sequence_id": sequences, "offset": offsets})

    buckets = max(1, -(-int(counts.sum()) // bucket_rows))
    row = F.struct(*[col(c) for c in pieces.columns])
    numbered = pieces.select(
        row.alias("row"),
        col(length_col).cast("long").alias("w"),
        F.pmod(F.xxhash64(col(id_col), col(piece_col)), F.lit(buckets)).alias("bucket"),
    )
    order = Window.partitionBy("w", "bucket").orderBy(F.col("row")[id_col], F.col("row")[piece_col])
    before = Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("w", "bucket")
        .agg(F.count("*").alias("n"))
        .select("w", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    )
    ranked = numbered.withColumn("nth", F.row_number().over(order) - 1).join(
        offsets, ["w", "bucket"]
    )
    return ranked.select("row", place("w", F.col("earlier") + F.col("nth")).alias("p")).select(
        "row.*", "p.sequence_id", "p.offset"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = 2048,
    end_id: int | None = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of ``docs``, stored once, and where each lies in which sequence."""
    pieces = token_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col, with_ids)
    return pack(keep(pieces if with_ids else pieces.drop("ids")), capacity, id_col)
