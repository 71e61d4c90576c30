"""Windows of units that stand somewhere else too: what byte and word dedup have in common.

A document is a row of units (bytes, or codes of words). Every window of ``width`` units has a
key that depends on nothing but the window, so equal windows have equal keys, and is chosen so
that neighbouring windows mostly share it. Windows in a row with one key are a segment.

1. A task finds the segments of its texts. Among segments alike in key and content all but the
   earliest are settled: each of their windows stands earlier. The rest go, packed, to the
   bucket of their key, where the same is done for all texts. A key with a single segment
   proves its windows unique (those of one segment differ where that matters). What remains open are the earliest segments of different content
   under one key; a segment's windows may stand in the others only in part.
2. The content of these open segments is read again, partitioned by ``lead``, and all
   their windows are sorted by multikey quicksort: equal ones are neighbours, and of these all
   but the earliest are settled.
3. Settled windows go back to their documents.

Segments whose key a sample of the texts shows to be very frequent would all meet in one bucket.
Of these, too, a task settles all copies but the earliest; only what remains becomes rows, and
their windows are grouped by content, with minima taken before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import keep, texts

#: Units handled at a time, most windows in a segment, segments per flush of a task.
CHUNK_UNITS, MOST_WINDOWS, FLUSH = 1 << 18, 256, 150_000
#: Text per bucket of segments, in bytes, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 32
#: One text in SAMPLE is looked at for keys of more than FREQUENT segments; there are at most
#: 1 / FREQUENT as many of them as segments, so at 100 TB they should be a multiple of that.
SAMPLE, FREQUENT = 32, 16_384
U = np.uint64
NULL_ID = 2**63 - 1


@dataclass(frozen=True)
class Scheme:
    """How texts become units and windows get their keys."""

    width: int
    units: Callable[[str], np.ndarray]  # bytes (uint8) or codes (uint64) of one text
    #: key of the window at each start, and whether a segment must begin there
    keys: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    #: leading tokens of the segments that begin at the given places of concatenated units
    lead: Callable[[np.ndarray, np.ndarray], list[bytes]]
    dtype: str
    same_doc: bool  # whether an earlier start in the same document counts as earlier
    by_ranges: bool  # whether leads are dealt out by ranges or by hash


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_FACTOR = 0xD1342543DE82EF95
_INVERSE = pow(_FACTOR, -1, 2**64)
_powers: list[np.ndarray] = []


def prints(units: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of units[lo:hi], by prefix sums of a polynomial over mixed units."""
    n = len(units)
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_UNITS * 2)
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.concatenate([[U(1)], np.cumprod(np.full(size, U(f)), dtype=U)])
                for f in (_FACTOR, _INVERSE)
            ]
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(mix(units.astype(U) + U(1)) * _powers[0][:n])])
        return mix((sums[hi] - sums[lo]) * _powers[1][lo] + (hi - lo).astype(U))


class Segments:
    """Parallel arrays of segments: document (position in ``ids`` and ``marks``), first window,
    number of windows, key and content."""

    FIELDS = (("of", "<i4"), ("lo", "<i8"), ("n", "<i4"), ("key", "<u8"), ("print", "<u8"))

    def __init__(self, ids: np.ndarray, marks: np.ndarray, **fields: np.ndarray) -> None:
        self.ids, self.marks = ids, marks
        for name, kind in self.FIELDS:
            setattr(self, name, fields[name].astype(kind, copy=False))

    def __len__(self) -> int:
        return len(self.of)

    def take(self, at: np.ndarray) -> Segments:
        return Segments(self.ids, self.marks, **{n: getattr(self, n)[at] for n, _ in self.FIELDS})

    @classmethod
    def joined(cls, parts: list[Segments]) -> Segments:
        base = np.cumsum([0] + [len(p.ids) for p in parts])
        fields = {n: np.concatenate([getattr(p, n) for p in parts]) for n, _ in cls.FIELDS}
        fields["of"] = np.concatenate([p.of + b for p, b in zip(parts, base, strict=False)])
        ids, marks = (np.concatenate([getattr(p, n) for p in parts]) for n in ("ids", "marks"))
        return cls(ids, marks, **fields)

    def dump(self) -> dict:
        """Only the documents that are needed, in the order of the segments."""
        used, of = np.unique(self.of, return_inverse=True)
        out = {n: getattr(self, n).tobytes() for n, _ in self.FIELDS}
        return out | {
            "ids": self.ids[used].tobytes(),
            "marks": self.marks[used].tobytes(),
            "of": of.astype("<i4").tobytes(),
        }

    @classmethod
    def load(cls, row) -> Segments:
        get = lambda n, kind: np.frombuffer(getattr(row, n), kind)
        return cls(
            get("ids", "<i8"), get("marks", "<i8"), **{n: get(n, kind) for n, kind in cls.FIELDS}
        )

    def resolve(self, same_doc: bool) -> tuple[Segments, Segments, np.ndarray]:
        """(earliest of each content, all others, whether the former share their key)."""
        ids = self.ids[self.of]
        order = np.lexsort((self.lo, ids, self.print, self.key))
        s, ids = self.take(order), ids[order]
        if not len(s):
            return s, s, np.zeros(0, bool)
        new = (s.key[1:] != s.key[:-1]) | (s.print[1:] != s.print[:-1]) | (s.n[1:] != s.n[:-1])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], new]), np.arange(len(s)), 0))
        earliest = ids == ids[first]
        if same_doc:
            earliest &= s.lo == s.lo[first]
        kept, content = s.take(np.flatnonzero(earliest)), first[earliest]
        block = np.concatenate([[True], kept.key[1:] != kept.key[:-1]])
        start = np.flatnonzero(block)
        mixed = np.maximum.reduceat(content, start) != np.minimum.reduceat(content, start)
        return kept, s.take(np.flatnonzero(~earliest)), mixed[np.cumsum(block) - 1]


def _cut(scheme: Scheme, ids: list[int], marks: list[int], values: list[str]) -> Iterator[tuple]:
    """(segments, units, base of each document in units) of pieces of about CHUNK_UNITS units.
    A longer text is cut so that every window lies whole in one piece."""
    width = scheme.width
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush():
        units = np.concatenate([u for _, _, u in held])
        sizes = np.array([len(u) for _, _, u in held])
        doc = np.array([i for i, _, _ in held])
        offset = np.array([o for _, o, _ in held])
        return _segments(scheme, units, sizes, doc, offset, ids, marks)

    for i, text in enumerate(values):
        units = scheme.units(text)
        for a in range(0, len(units) - width + 1, CHUNK_UNITS):
            part = units[a : a + CHUNK_UNITS + width - 1]
            held.append((i, a, part))
            size += len(part)
            if size >= CHUNK_UNITS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _segments(scheme, units, sizes, doc, offset, ids, marks) -> tuple[Segments, np.ndarray, np.ndarray]:
    width = scheme.width
    base = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(sizes)), sizes)[: len(units) - width + 1]
    start = np.arange(len(part))
    inside = start + width <= base[part] + sizes[part]
    at, part = start[inside], part[inside]
    key, begins = (x[at] for x in scheme.keys(units))
    new = begins | np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    first = np.flatnonzero(new | (since % MOST_WINDOWS == 0))
    n = np.diff(np.append(first, len(at)))
    lo = at[first]
    found = Segments(
        np.asarray(ids, np.int64),
        np.asarray(marks, np.int64),
        of=doc[part[first]],
        lo=lo - base[part[first]] + offset[part[first]],
        n=n,
        key=key[first],
        print=prints(units, lo, lo + n + width - 1),
    )
    return found, units, lo


def _spans(s: Segments) -> Iterator[tuple[int, int, bytes]]:
    """(id, mark, packed (first window, end)) of each document; touching segments as one."""
    order = np.lexsort((s.lo, s.of))
    of, lo, n = s.of[order], s.lo[order], s.n[order].astype(np.int64)
    if not len(of):
        return
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (lo[1:] != lo[:-1] + n[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1
    pairs = np.stack([lo[first], lo[last] + n[last]], axis=1)
    for doc, part in _by_doc(of[first], pairs):
        yield int(s.ids[doc]), int(s.marks[doc]), part.astype("<i8").tobytes()


def _by_doc(of: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
    for a, part in zip([0, *cuts.tolist()], np.split(rows, cuts), strict=True):
        yield int(of[a]), part


_OFTEN = "key:long,print:long,n:int,id:long,lo:long,mark:long,units:binary"
_PACK = (
    "bucket long, ids binary, marks binary, of binary, lo binary, n binary, key binary, "
    "print binary, gone array<struct<id:long,mark:long,spans:binary>>, "
    f"often array<struct<{_OFTEN}>>"
)
_TOLD = f"id long, mark long, gone binary, open binary, often array<struct<{_OFTEN}>>"


def _pack(scheme: Scheme, buckets: int, frequent: np.ndarray):
    def flush(parts: list[Segments], contents: dict[tuple, bytes]) -> pd.DataFrame:
        kept, gone, _ = Segments.joined(parts).resolve(scheme.same_doc)
        told: dict[int, tuple[list, list]] = {}
        for i, m, x in _spans(gone):
            at = told.setdefault(i % buckets, ([], []))
            at[0].append({"id": i, "mark": m, "spans": x})
        hot = np.isin(kept.key, frequent)
        for row in with_content(kept.take(hot), contents):
            told.setdefault(row["id"] % buckets, ([], []))[1].append(row)
        kept = kept.take(~hot)
        nothing: tuple[list, list] = ([], [])

        def row(k: int, packed: dict) -> dict:
            more = told.pop(k, nothing)
            return {"bucket": k, **packed, "gone": more[0], "often": more[1]}

        bucket = (mix(kept.key) % U(buckets)).astype(np.int64)
        order = np.lexsort((kept.lo, kept.of, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        rows = [
            row(int(bucket[at[0]]), kept.take(at).dump()) for at in np.split(order, cuts) if len(at)
        ]
        none = kept.take(np.empty(0, np.int64)).dump()
        rows += [row(k, none) for k in list(told)]
        return pd.DataFrame(rows)

    def alike(found: Segments) -> Iterator[tuple]:
        key, content = found.key.view(np.int64).tolist(), found.print.view(np.int64).tolist()
        return zip(key, content, found.n.tolist(), strict=True)

    def with_content(found: Segments, contents: dict[tuple, bytes]) -> Iterator[dict]:
        ids, marks = found.ids[found.of].tolist(), found.marks[found.of].tolist()
        for known, i, lo, m in zip(alike(found), ids, found.lo.tolist(), marks, strict=True):
            told = dict(zip(("key", "print", "n"), known, strict=True))
            yield told | {"id": i, "lo": lo, "mark": m, "units": contents[known]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[Segments] = []
        contents: dict[tuple, bytes] = {}  # of segments under frequent keys
        for batch in batches:
            ids, marks = batch["id"].tolist(), batch["mark"].tolist()
            for found, units, begin in _cut(scheme, ids, marks, batch["text"].tolist()):
                parts.append(found)
                hot = np.flatnonzero(np.isin(found.key, frequent))
                end = begin + found.n + scheme.width - 1
                for known, j in zip(alike(found.take(hot)), hot.tolist(), strict=True):
                    if known not in contents:
                        contents[known] = units[begin[j] : end[j]].tobytes()
                if sum(map(len, parts)) + 4 * len(contents) >= FLUSH:
                    yield flush(parts, contents)
                    parts, contents = [], {}
        if parts:
            yield flush(parts, contents)

    return run


def _windows(scheme: Scheme):
    """A row for each window of the segments, with a fingerprint of its content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 4000):
                part = batch.iloc[a : a + 4000]
                units = np.frombuffer(b"".join(part["units"]), scheme.dtype)
                n = part["n"].to_numpy(np.int64)
                sizes = n + scheme.width - 1
                shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(np.cumsum(sizes) - sizes, n) + shift
                told = {c: np.repeat(part[c].to_numpy(np.int64), n) for c in ("key", "id", "mark")}
                content = prints(units, start, start + scheme.width)
                told |= {"print": content.view(np.int64)}
                told |= {"pos": np.repeat(part["lo"].to_numpy(np.int64), n) + shift}
                yield pd.DataFrame(told)[["key", "print", "id", "mark", "pos"]]

    return run


def _settle(scheme: Scheme):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = Segments.joined([Segments.load(r) for r in part.itertuples(index=False)])
        kept, gone, several = found.resolve(scheme.same_doc)
        out = [(i, m, x, None, None) for i, m, x in _spans(gone)]
        out += [(g["id"], g["mark"], g["spans"], None, None) for gs in part["gone"] for g in gs]
        # no NULL here: a column of 64-bit numbers and NULL would become one of floats
        out += [(0, 0, None, None, list(rows)) for rows in part["often"] if len(rows)]
        left = kept.take(np.flatnonzero(several))
        left = left.take(np.lexsort((left.lo, left.of)))
        if len(left):
            rows = np.stack([left.lo, left.n.astype(np.int64)], axis=1)
            for doc, pairs in _by_doc(left.of, rows):
                told = pairs.astype("<i8").tobytes()
                out.append((int(left.ids[doc]), int(left.marks[doc]), None, told, None))
        return pd.DataFrame(out, columns=["id", "mark", "gone", "open", "often"])

    return run


def _read_open(scheme: Scheme):
    """The content of the open segments of each document."""

    def told(rows: list[tuple]) -> pd.DataFrame:
        units = np.concatenate([r[3] for r in rows])
        sizes = np.array([len(r[3]) for r in rows])
        lead = scheme.lead(units, np.cumsum(sizes) - sizes)
        out = [(x, i, m, lo, part.tobytes()) for x, (i, m, lo, part) in zip(lead, rows, strict=True)]
        return pd.DataFrame(out, columns=["lead", "id", "mark", "lo", "units"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                units = scheme.units(row.text)
                pairs = np.frombuffer(b"".join(row.open), "<i8").reshape(-1, 2)
                for lo, n in pairs.tolist():
                    rows.append((row.id, row.mark, lo, units[lo : lo + n + scheme.width - 1].copy()))
                if len(rows) >= 4000:
                    yield told(rows)
                    rows = []
        if rows:
            yield told(rows)

    return run


def multikey_groups(columns: Callable[[int], np.ndarray], depth: int, size: int):
    """Sorts ``size`` strings of ``depth`` tokens and tells which are equal: (order, starts of
    the groups of equal strings). ``columns(j)`` are the j-th tokens of all strings.

    Multikey quicksort, all ties of a depth at a time: what is told apart by the tokens so far
    is done; only groups that are still tied are ordered by their next token.
    """
    order = np.arange(size)
    new = np.zeros(size, bool)
    if size:
        new[0] = True
    for j in range(depth):
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, size))
        tied = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        token = columns(j)[order[at]]
        group = np.repeat(np.arange(len(starts)), sizes)[at]
        rank = np.lexsort((token, group))
        order[at] = order[at][rank]
        token, group = token[rank], group[rank]
        differ = np.concatenate([[False], (token[1:] != token[:-1]) & (group[1:] == group[:-1])])
        new[at[differ]] = True
    return order, np.flatnonzero(new)


def _tokens(units: np.ndarray, at: np.ndarray, width: int) -> tuple[Callable[[int], np.ndarray], int]:
    """Windows as strings of 64-bit tokens: codes as they are, bytes eight at a time."""
    if units.dtype != np.uint8:
        return (lambda j: units[at + j]), width
    wide = units.astype(U)
    n = 1
    while n < 8:  # big-endian words at every byte
        wide = (wide[:-n] << U(8 * n)) | wide[n:]
        n *= 2
    depth = -(-width // 8)
    return (lambda j: wide[at + min(8 * j, width - 8)]), depth


def _compare(scheme: Scheme):
    """Rows in the order of their lead; equal leads never part."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, scheme.dtype) for x in rows["units"]]
        units = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        base = np.cumsum(sizes) - sizes
        n = sizes - scheme.width + 1
        of = np.repeat(np.arange(len(parts)), n)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        columns, depth = _tokens(units, base[of] + shift, scheme.width)
        order, starts = multikey_groups(columns, depth, len(of))
        ids = rows["id"].to_numpy(np.int64)[of][order]
        pos = (rows["lo"].to_numpy(np.int64)[of] + shift)[order]
        sizes = np.diff(np.append(starts, len(order)))
        least = np.repeat(np.minimum.reduceat(ids, starts), sizes)
        later = ids > least
        if scheme.same_doc:
            own = np.where(ids == least, pos, np.iinfo(np.int64).max)
            first = np.repeat(np.minimum.reduceat(own, starts), sizes)
            later |= (ids == least) & (pos > first)
        hit = np.flatnonzero(later)
        if not len(hit):
            return _none_told()
        row = of[order][hit]
        gone = Segments(
            rows["id"].to_numpy(np.int64),
            rows["mark"].to_numpy(np.int64),
            of=row,
            lo=pos[hit],
            n=np.ones(len(hit), np.int32),
            key=np.zeros(len(hit), U),
            print=np.zeros(len(hit), U),
        )
        out = list(_spans(gone))
        return pd.DataFrame(out, columns=["id", "mark", "gone"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # across the border of two batches the last lead may go on
            done = int((held["lead"] != held["lead"].iloc[-1]).sum())
            if done > 2000:
                yield settle(held.iloc[:done])
                held = held.iloc[done:].reset_index(drop=True)
        if held is not None and len(held):
            yield settle(held)

    return run


def _none_told() -> pd.DataFrame:
    return pd.DataFrame({"id": [], "mark": [], "gone": []}).astype({"id": "int64", "mark": "int64"})


def _frequent_keys(scheme: Scheme, docs: DataFrame) -> np.ndarray:
    """Keys that a sample of the texts shows to fill much of a bucket. What it misses only
    makes a bucket larger: results do not depend on it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            none = [0] * len(batch)
            for found, _, _ in _cut(scheme, none, none, batch["text"].tolist()):
                key, n = np.unique(found.key, return_counts=True)
                yield pd.DataFrame({"key": key.view(np.int64), "n": n})

    sample = docs.where(F.pmod(F.xxhash64("mark", "id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = [r["key"] for r in counts.where(F.col("n") >= FREQUENT // SAMPLE).select("key").collect()]
    return np.sort(np.array(keys, np.int64)).view(U)


def settled_windows(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, mark, gone) for ``docs`` (id, mark, text): packed (first, end) of window starts that
    stand earlier, several rows per document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    frequent = _frequent_keys(scheme, docs)
    packs = docs.mapInPandas(_pack(scheme, buckets, frequent), _PACK)
    told = keep(packs.groupBy("bucket").applyInPandas(_settle(scheme), _TOLD))
    opened = told.where("open is not null").groupBy("id", "mark")
    content = docs.join(opened.agg(F.collect_list("open").alias("open")), ["id", "mark"]).mapInPandas(
        _read_open(scheme), "lead binary, id long, mark long, lo long, units binary"
    )
    if scheme.by_ranges:
        # stored, as the splitters are sampled from it in a job of its own
        dealt = keep(content).repartitionByRange("lead")
    else:
        dealt = content.repartition("lead")
    found = (
        dealt.sortWithinPartitions("lead")
        .mapInPandas(_compare(scheme), "id long, mark long, gone binary")
    )
    gone = told.where("gone is not null").select("id", "mark", "gone").unionByName(found)
    if len(frequent):
        often = told.where("often is not null").select(F.explode("often").alias("o"))
        gone = gone.unionByName(_settled_frequent(often.select("o.*"), scheme))
    return gone


def _settled_frequent(segments: DataFrame, scheme: Scheme) -> DataFrame:
    """The same for segments under frequent keys: of each content the earliest is found by a
    minimum that tasks take beforehand, then of each window of these. The minima are stored, so
    that both sides of a join are plain shuffles, whose large partitions Spark can split."""

    def later(at: str, first: str):
        after = F.col("id") > F.col(f"{first}.id")
        if scheme.same_doc:
            after |= (F.col("id") == F.col(f"{first}.id")) & (F.col(at) > F.col(f"{first}.{at}"))
        return after

    alike = ["key", "print", "n"]
    earliest = F.min(F.struct("id", "lo", "mark", "units")).alias("first")
    firsts = keep(segments.groupBy(*alike).agg(earliest))
    known = firsts.select(*alike, F.struct("first.id", "first.lo").alias("first"))
    others = segments.drop("units").join(known, alike)
    copies = others.where(later("lo", "first"))
    # Some texts under one id, or places of one document, are as early as the first one.
    opened = firsts.select(*alike, "first.*")
    if not scheme.same_doc:
        ties = (F.col("id") == F.col("first.id")) & (F.col("lo") > F.col("first.lo"))
    else:
        ties = (F.col("id") == F.col("first.id")) & (F.col("lo") == F.col("first.lo"))
        ties &= F.col("mark") != F.col("first.mark")
    known = firsts.select(*alike, F.col("first").alias("all"))
    same = segments.drop("units").join(known, alike).withColumn("first", F.col("all"))
    same = same.where(ties).select(*alike, "id", "lo", "mark", F.col("all.units").alias("units"))
    opened = opened.unionByName(same)

    windows = opened.mapInPandas(
        _windows(scheme), "key long, print long, id long, mark long, pos long"
    )
    first = keep(windows.groupBy("key", "print").agg(F.min(F.struct("id", "pos")).alias("first")))
    repeated = windows.join(first, ["key", "print"]).where(later("pos", "first"))
    spans = copies.select("id", "mark", "lo", "n").unionByName(
        repeated.select("id", "mark", F.col("pos").alias("lo"), F.lit(1).alias("n"))
    )

    @F.pandas_udf("binary")
    def packed(begins: pd.Series, sizes: pd.Series) -> pd.Series:
        pairs = zip(begins, sizes, strict=True)
        return pd.Series([np.stack([b, b + n], axis=1).astype("<i8").tobytes() for b, n in pairs])

    per_doc = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "n")).alias("s"))
    return per_doc.select("id", "mark", packed("s.lo", "s.n").alias("gone"))


def covered(spans: list[bytes], width: int) -> np.ndarray:
    """Merged (begin, end) in units of the windows that start within packed spans."""
    pairs = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    begin, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + width - 1)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    last = np.append(first[1:], len(begin)) - 1
    return np.stack([begin[first], end[last]], axis=1)


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text); the mark tells apart different texts under one id."""
    rows = texts(docs, id_col, text_col)
    return rows.select(
        F.coalesce("id", F.lit(NULL_ID).cast("long")).alias("id"),
        F.xxhash64("text").alias("mark"),
        "text",
    )
