r"""How the sources of a language differ in the words they use.

1. A task looks at its texts as Arrow buffers: an array of bytes and the offsets of the texts, in
   the order of language and source. Pointers to the first byte of each word are sorted by
   multikey quicksort, slice by slice. A run of equal words gives, per language and source, how
   often it occurs and in how many documents; as pointers of a run stay in the order of the
   buffer, both are differences of neighbours. Words themselves are only cut out once per run.
2. Spark adds these up, first in the tasks, then per word, and keeps the words in enough documents
   of their language. No later step sees a row per occurrence.
3. Shares are exact integers, from decimals. Distances between all sources of a language are
   summed per shard of words, in matrices of a bounded number of words, then over the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import keep

#: Bytes of text whose pointers are sorted at a time; a longer text is cut between two words.
SLICE = 4 << 20
#: Segments up to this size are ordered at once, larger ones around a pivot.
SMALL = 64
#: Cells of a matrix of words by sources that a task holds, and sources whose distances to all
#: others it sums at a time.
CELLS, SOURCES = 1 << 20, 512

# Bytes of words in UTF-8, and A-Z as a-z.
_IN_WORD = np.ones(256, bool)
_IN_WORD[0x00:0x41] = _IN_WORD[0x5B:0x61] = _IN_WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_COUNTS = "lang string, source string, term string, n long, docs long"


def _eight(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number; zeros after ``left`` bytes."""
    words = data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
    spare = (8 * (8 - np.clip(left, 0, 8))).astype(np.uint64)
    # a shift by 64 is not defined, so it is done in two
    half = spare >> np.uint64(1)
    words = (words >> half) >> (spare - half)
    return (words << half) << (spare - half)


def multikey_quicksort(data: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(order, begin of each run of equal words) for the words at ``start`` of ``size`` bytes;
    ``data`` has eight bytes more than they need, and no word holds a zero byte. Equal words stay
    in the order they came in.

    All segments that are still open are parted in one round, each around a pivot of its own into
    smaller, equal and larger. The equal ones go on with their next eight bytes, or are done if
    they end within these. Small segments are ordered without a pivot.
    """
    n = len(start)
    order = np.arange(n)
    begins = np.zeros(n, bool)
    if not n:
        return order, np.flatnonzero(begins)
    begins[0] = True
    rng = np.random.default_rng(n)
    at = np.arange(n)  # places in open segments
    new = begins.copy()  # whether a segment begins there
    depth = np.zeros(n, np.int64)
    token = _eight(data, start, size)
    while len(at):
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        seg = np.repeat(np.arange(len(first)), sizes)
        small = sizes[seg] <= SMALL
        pivot = token[first + rng.integers(0, sizes)][seg]
        side = (token > pivot).astype(np.int8) - (token < pivot)
        to = np.empty(len(at), np.int64)
        base = first.copy()  # where the smaller, equal, larger of each segment go
        for k in (-1, 0, 1):
            hit = side == k
            upto = np.cumsum(hit)
            before = (upto - hit)[first]
            to[hit] = ((base - before)[seg] + upto - 1)[hit]
            base += upto[first + sizes - 1] - before
        tiny = np.flatnonzero(small)
        to[tiny[np.lexsort((token[tiny], seg[tiny]))]] = tiny
        come = np.empty(len(at), np.int64)
        come[to] = np.arange(len(at))
        order[at] = order[at][come]
        token, depth, side = token[come], depth[come], side[come]
        split = new.copy()
        if len(at) > 1:
            apart = np.where(small[1:], token[1:] != token[:-1], side[1:] != side[:-1])
            split[1:] |= apart
        begins[at[split]] = True
        first = np.flatnonzero(split)
        sizes = np.diff(np.append(first, len(at)))
        seg = np.repeat(np.arange(len(first)), sizes)
        alike = small | (side == 0)  # all of the segment have this token
        ended = alike & (token & np.uint64(0xFF) == 0)
        go_on = (sizes[seg] > 1) & ~ended
        at, new, token, depth, alike = (x[go_on] for x in (at, split, token, depth, alike))
        depth = depth + alike
        deeper = np.flatnonzero(alike)
        pointer = order[at[deeper]]
        far = 8 * depth[deeper]
        left = size[pointer] - far
        token[deeper] = _eight(data, np.where(left > 0, start[pointer] + far, 0), left)
    return order, np.flatnonzero(begins)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of each word of texts that lie one behind the other."""
    inside = _IN_WORD[data]
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~head[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~head[1:]
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1 - start


def _runs(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """(term, groups, occurrences, documents) of each run in texts dealt to ascending groups."""
    start, size = _words(data, offsets)
    if not len(start):
        return
    doc = np.searchsorted(offsets, start, side="right") - 1
    padded = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    order, run = multikey_quicksort(padded, start, size)
    doc = doc[order]
    of = group[doc]
    new_run = np.zeros(len(order), bool)
    new_run[run] = True
    part = new_run | np.concatenate([[True], of[1:] != of[:-1]])
    first_in_doc = part | np.concatenate([[True], doc[1:] != doc[:-1]])
    cell = np.flatnonzero(part)
    count = np.diff(np.append(cell, len(order)))
    docs = np.add.reduceat(first_in_doc.astype(np.int64), cell)
    content = padded.tobytes()
    begin, end = start[order[run]], (start + size)[order[run]]
    terms = [content[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    yield terms, np.cumsum(new_run)[cell] - 1, of[cell], count, docs


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the offsets of these."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _table(keys, terms, term_of, group, n, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys]).take(pa.array(group)),
            pa.array([k[1] for k in keys]).take(pa.array(group)),
            pa.array(terms, pa.string()).take(pa.array(term_of)),
            pa.array(n, pa.int64()),
            pa.array(docs, pa.int64()),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def _long_text(data: np.ndarray, key: tuple) -> Iterator[pa.RecordBatch]:
    """A text of more than SLICE bytes, cut where no word is; it is one document all the same."""
    found: dict[str, int] = {}
    gaps = np.flatnonzero(~_IN_WORD[data])
    a = 0
    while a < len(data):
        cut = gaps[np.searchsorted(gaps, a) : np.searchsorted(gaps, a + SLICE)]
        beyond = gaps[np.searchsorted(gaps, a + SLICE) :][:1]
        b = int(cut[-1] if len(cut) else beyond[0] if len(beyond) else len(data) - 1) + 1
        b = len(data) if len(data) - a <= SLICE else b
        for terms, _, _, n, _ in _runs(data[a:b], np.array([0, b - a]), np.zeros(1, np.int64)):
            for term, count in zip(terms, n.tolist(), strict=True):
                found[term] = found.get(term, 0) + count
        a = b
    terms = list(found)
    at = np.arange(len(terms))
    yield _table([key], terms, at, np.zeros(len(at), np.int64), [found[t] for t in terms], at * 0 + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        keys = sorted(set(pairs))
        number = {k: i for i, k in enumerate(keys)}
        group = np.array([number[p] for p in pairs], np.int64)
        order = np.argsort(group, kind="stable")
        group = group[order]
        data, offsets = _buffers(batch.column(2).take(pa.array(order)))
        a = 0
        while a < len(group):
            b = int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1
            if b <= a:
                yield from _long_text(data[offsets[a] : offsets[a + 1]], keys[group[a]])
                a += 1
                continue
            part = data[offsets[a] : offsets[b]]
            for terms, term_of, of, n, docs in _runs(part, offsets[a : b + 1] - offsets[a], group[a:b]):
                yield _table(keys, terms, term_of, of, n, docs)
            a = b


def _distances(cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """The distances of a block of sources from all that come later, over the words of a shard."""
    names = sources.sort_values("source")
    all_names, none, block = names["source"].tolist(), names["none"].to_numpy(), names["block"].to_numpy()
    rows = np.flatnonzero(names["own"].to_numpy() == block)
    place = {s: i for i, s in enumerate(all_names)}
    sums = np.zeros((len(rows), len(all_names)), np.int64)
    term, _ = pd.factorize(cells["term"])
    at = cells["source"].map(place).to_numpy(np.int64)
    order = np.argsort(term, kind="stable")
    term, at, p = term[order], at[order], cells["p"].to_numpy(np.int64)[order]
    step = max(1, CELLS // max(1, len(all_names)))
    for a in range(0, int(term[-1]) + 1 if len(term) else 0, step):
        lo, hi = np.searchsorted(term, [a, a + step])
        width = int(min(step, term[-1] + 1 - a))
        share = np.repeat(none[:, None], width, axis=1)
        share[at[lo:hi], term[lo:hi] - a] = p[lo:hi]
        for i, row in enumerate(rows):
            sums[i] += np.abs(share - share[row]).sum(axis=1)
    i, j = np.nonzero(rows[:, None] < np.arange(len(all_names))[None, :])
    told = {
        "lang": [names["lang"].iloc[0]] * len(i) if len(i) else [],
        "a": [all_names[rows[x]] for x in i],
        "b": [all_names[x] for x in j],
    }
    # as objects: an empty column of text would have no Arrow array
    out = pd.DataFrame({c: np.array(v, object) for c, v in told.items()})
    return out.assign(value=sums[i, j])


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly; null without kept words."""
    tens = lambda x: x.cast("decimal(24,0)")
    above = (tens(count) + 5) * F.lit(10**9).cast("decimal(10,0)")
    below = F.nullif(tens(total) + tens(kept) * 5, F.lit(0).cast("decimal(24,0)"))
    return F.call_function("div", above, below) + 1


def word_counts(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with at least one."""
    texts = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)])
    found = texts.toDF("lang", "source", "text").mapInArrow(_count, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = 30,
    most_terms: int = 50,
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` tells how far each other source of the
    language is, over all words in at least ``least_docs`` documents of it; ``term`` the
    ``most_terms`` words by which a source exceeds its language most.

    Null texts, languages and sources count as ''. Every row is a document, repeated ones too.
    Ties go to the smaller item, in the order of UTF-8 bytes. A language without such words has
    distances of 0 and no terms; one with a single source has no pairs; an empty table gives an
    empty one. Other columns are not read, so their names do not matter. A text may be of any
    length; the distinct words of one must fit a task. The pairs of a language are as many as its
    sources squared, which is what is asked for.
    """
    counts = word_counts(docs, lang_col, source_col, text_col)
    word = Window.partitionBy("lang", "term")
    cells = keep(
        counts.select(
            "lang", "source", "term", "n",
            F.sum("docs").over(word).alias("docs"),
            F.sum("n").over(word).alias("n_lang"),
            (F.row_number().over(word.orderBy("source")) == 1).alias("leads"),
        )
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )
    langs = cells.groupBy("lang").agg(
        F.count_if("leads").alias("kept"), F.sum("n").alias("total_lang")
    )
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    occurring = docs.select(
        *[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    ).distinct()
    groups = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = keep(groups.fillna(0, ["total", "kept", "total_lang"]))

    shares = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term",
        _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q"),
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.where("p > q")
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= most_terms)
    )

    shards = max(1, -(-cells.count() // CELLS))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // SOURCES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = shares.select(
        "lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")
    )
    known = groups.select(
        "lang", "source",
        F.coalesce(_share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0)).alias("none"),
        F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("own"),
    )
    key = ["lang", "shard", "block"]
    parts = (
        dealt.withColumn("block", every(blocks))
        .groupBy(*key)
        .cogroup(known.withColumn("shard", every(shards)).withColumn("block", every(blocks)).groupBy(*key))
        .applyInPandas(_distances, "lang string, a string, b string, value long")
    )
    halves = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
        )
    )
    pairs = halves.select("lang", both.alias("x"), "value").select(
        "lang", "x.source", "x.item", "value"
    )
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return (
        pairs.withColumn("part", F.lit("pair")).select(*columns)
        .unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
    )
