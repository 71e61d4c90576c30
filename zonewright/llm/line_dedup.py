"""Line dedup by sharded minimal perfect hashing.

1. Every task reduces its lines to one entry per distinct key hash (smallest document, number
   of documents) and sends the entries, packed, to the shard of the hash. A line that stands
   in a third of all documents reaches its shard once per task and pack.
2. A shard merges the entries and, over the hashes found in two documents or more, builds a
   minimal perfect hash: levels of bit arrays, in which a key takes its bit if no other key
   of the level wants it, its rank being the slot. The slots index arrays of fingerprints,
   counts and smallest documents.
3. Documents probe the arrays: packs of (hash, documents) meet the one row of their shard, and
   a large shard of probes can be split over tasks, as each pack only needs that row. What
   comes back is the list of hashes a document loses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import texts

#: Stripped at both ends of a line for its key.
BLANKS = " \t\n\x0b\x0c\r"
#: Text per shard, in bytes, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 32
#: Lines after which a task sends its packs.
PACK_LINES = 200_000
KEY = np.dtype([("low", "<u8"), ("high", "<u8")])


def line_key(line: str, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is too short to count."""
    key = line.strip(BLANKS)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def wanted(keys: np.ndarray, level: int, n: int) -> np.ndarray:
    """Which of n bits each 128-bit key wants on a level."""
    with np.errstate(over="ignore"):
        both = mix(keys["low"], level) + mix(keys["high"], ~level)
    return (both % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct keys to its own slot below n; any other key to a slot of some
    key or to n."""

    def __init__(self, bits: list[np.ndarray]) -> None:
        self.bits = bits
        self.before = []
        total = 0
        for b in bits:
            counts = np.cumsum(b) - b + total
            self.before.append(counts)
            total += int(b.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, max_levels: int = 64) -> PerfectHash:
        bits = []
        while len(keys):
            if len(bits) == max_levels:
                raise ValueError("keys are not distinct")
            n = max(8, int(gamma * len(keys)))
            at = wanted(keys, len(bits), n)
            own = np.bincount(at, minlength=n) == 1
            bits.append(own)
            keys = keys[~own[at]]
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.size, np.int64)
        left = np.arange(len(keys))
        for level, own in enumerate(self.bits):
            at = wanted(keys[left], level, len(own))
            hit = own[at]
            out[left[hit]] = self.before[level][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        sizes = np.array([len(b) for b in self.bits], "<i8")
        return sizes.tobytes(), b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def load(cls, sizes: bytes, packed: bytes) -> PerfectHash:
        bits, at = [], 0
        for n in np.frombuffer(sizes, "<i8").tolist():
            width = (n + 7) // 8
            part = np.frombuffer(packed, np.uint8, width, at)
            bits.append(np.unpackbits(part, count=n).astype(bool))
            at += width
        return cls(bits)


def _entries(shards: int, min_chars: int, with_docs: bool):
    """Packs of a task: per shard the distinct hashes with their smallest document and count,
    or, ``with_docs``, all the documents of each."""

    def pack(found: dict[bytes, list[int]]) -> Iterator[dict]:
        keys = np.frombuffer(b"".join(found), KEY)
        shard = (keys["high"] % np.uint64(shards)).astype(np.int64)
        docs = list(found.values())
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            mine = [docs[i] for i in at.tolist()]
            sizes = np.fromiter(map(len, mine), "<i4", len(mine))
            if with_docs:
                told = np.fromiter((d for m in mine for d in m), "<i8", int(sizes.sum()))
            else:
                told = np.fromiter(map(min, mine), "<i8", len(mine))
            yield {
                "shard": s,
                "keys": keys[at].tobytes(),
                "docs": told.tobytes(),
                "sizes": sizes.tobytes(),
            }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, list[int]] = {}
        lines = 0
        for batch in batches:
            for doc, text in zip(batch["id"].tolist(), batch["text"], strict=True):
                own = {line_key(x, min_chars) for x in text.split("\n")}
                own.discard(None)
                for key in own:
                    found.setdefault(key, []).append(doc)
                lines += len(own)
                if lines >= PACK_LINES:
                    yield pd.DataFrame(list(pack(found)))
                    found, lines = {}, 0
        if found:
            yield pd.DataFrame(list(pack(found)))

    return run


def _build(part: pd.DataFrame) -> pd.DataFrame:
    keys = np.frombuffer(b"".join(part["keys"]), KEY)
    docs = np.frombuffer(b"".join(part["docs"]), "<i8")
    sizes = np.frombuffer(b"".join(part["sizes"]), "<i4")
    order = np.lexsort((keys["high"], keys["low"]))
    keys, docs, sizes = keys[order], docs[order], sizes[order]
    new = (keys["low"][1:] != keys["low"][:-1]) | (keys["high"][1:] != keys["high"][:-1])
    first = np.flatnonzero(np.concatenate([[True], new]))
    least, most = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
    count = np.add.reduceat(sizes.astype(np.int64), first)
    # more than one document: two in one pack, or other smallest ones in different packs
    repeated = (np.maximum.reduceat(sizes, first) > 1) | (least != most)
    keys = keys[first][repeated]
    perfect = PerfectHash.build(keys)
    slot = perfect.slots(keys)
    table = {name: np.empty(perfect.size, kind) for name, kind in _ARRAYS.items()}
    table["prints"][slot] = keys["low"]
    table["counts"][slot] = count[repeated]
    table["firsts"][slot] = least[repeated]
    levels, bits = perfect.dump()
    return pd.DataFrame(
        [
            {"shard": int(part["shard"].iloc[0]), "levels": levels, "bits": bits}
            | {name: values.tobytes() for name, values in table.items()}
        ]
    )


_ARRAYS = {"prints": "<u8", "counts": "<i8", "firsts": "<i8"}


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shard, perfect, prints, firsts = None, None, None, None
    for batch in batches:
        out: dict[int, list[bytes]] = {}
        for row in batch.itertuples(index=False):
            if row.shard != shard:
                shard, perfect = row.shard, PerfectHash.load(row.levels, row.bits)
                prints = np.append(np.frombuffer(row.prints, "<u8"), np.uint64(0))
                firsts = np.append(np.frombuffer(row.firsts, "<i8"), np.int64(0))
            keys = np.frombuffer(row.keys, KEY)
            slot = perfect.slots(keys)
            known = (slot < perfect.size) & (prints[slot] == keys["low"])
            sizes = np.frombuffer(row.sizes, "<i4")
            docs = np.frombuffer(row.docs, "<i8")
            of = np.repeat(np.arange(len(keys)), sizes)
            lost = np.flatnonzero(known[of] & (docs > firsts[slot[of]]))
            raw = row.keys
            for doc, k in zip(docs[lost].tolist(), of[lost].tolist(), strict=True):
                out.setdefault(doc, []).append(raw[16 * k : 16 * k + 16])
        if out:
            yield pd.DataFrame({"id": list(out), "lost": [b"".join(x) for x in out.values()]})


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Drop each line whose key also stands in a document with a smaller id.

    A line's key is the line without blanks at its ends and with A-Z in lower case; keys of
    fewer than ``min_chars`` characters never count. Returns per row the id, ``n_lines`` before,
    ``n_dropped``, ``text`` after dropping, other lines joined by line feeds, and ``kept``, a
    struct of the columns named in ``keep`` as they were, if there are any.

    A null or empty text is one empty line. Rows with the same id count as one document: they
    never drop each other's lines, and lose the same ones. A null id is larger than all others.
    An empty table gives an empty one. Columns but these are not read.
    """
    more = [F.struct(*[col(c) for c in keep]).alias("kept")] if keep else []
    carried = texts(docs, id_col, text_col, *more).withColumn(
        "id", F.coalesce("id", F.lit(2**63 - 1).cast("long"))
    )
    rows = carried.select("id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    packed = "shard long, keys binary, docs binary, sizes binary"
    built = "shard long, levels binary, bits binary, " + ", ".join(f"{a} binary" for a in _ARRAYS)
    index = (
        rows.mapInPandas(_entries(shards, min_chars, with_docs=False), packed)
        .groupBy("shard")
        .applyInPandas(_build, built)
        .drop("counts")
    )
    probes = rows.mapInPandas(_entries(shards, min_chars, with_docs=True), packed)
    lost = (
        probes.join(index.hint("shuffle_merge"), "shard")
        .mapInPandas(_probe, "id long, lost binary")
        .groupBy("id")
        .agg(F.collect_list("lost").alias("lost"))
    )

    kind = "n_lines long, n_dropped long, text string"

    @F.pandas_udf(kind)
    def drop(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, gone in batches:
            out = []
            for t, g in zip(text, gone, strict=True):
                lines = t.split("\n")
                n = len(lines)
                if g is not None:
                    raw = b"".join(g)
                    known = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                    lines = [x for x in lines if line_key(x, min_chars) not in known]
                    t = "\n".join(lines)
                out.append((n, n - len(lines), t))
            yield pd.DataFrame(out, columns=["n_lines", "n_dropped", "text"])

    kept = ["kept"] if keep else []
    joined = carried.join(lost, "id", "left")
    found = joined.select("id", *kept, drop("text", "lost").alias("d"))
    own = F.nullif("id", F.lit(2**63 - 1)).alias(id_col)
    return found.select(own, "d.n_lines", "d.n_dropped", "d.text", *kept)
