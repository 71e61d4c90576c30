"""N-gram Jaccard join by MinHash banding.

1. Texts with the same n-gram set are one member. A member's MinHash signature is cut into
   bands; rows per band and their number are chosen so that a pair at the threshold is missed
   with at most the given probability.
2. Band hashes are shuffled; members that share one form a bucket. Buckets of at most ``FEW``
   members give their pairs as rows, a bounded number per member. Most of these are there by
   chance, and are verified one by one.
3. Members of larger buckets go into blocks, next to those with the same first member in their
   buckets. Pairs within a block are verified on full n-gram sets, all intersections at once as
   products of incidence matrices. Two blocks meet if they have a bucket in common. A block takes
   in the others one by one and adds up, so it returns a row per member and one per pair of
   groups that are linked, never one per pair of members.
4. A pair that shares a larger bucket counts in step 3, else in step 2. Classes are the components
   of verified links; what only shares a band ties nothing together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import chunks, keep
from zonewright.llm.graph import components
from zonewright.sources.size import fits_broadcast

WORD = re.compile(r"\w+")
#: Members of a bucket that gives its pairs as rows.
FEW = 4
#: How often leaders are passed on to those who share a band.
LEADER_ROUNDS = 2
_NULL_ID = 2**63 - 1


def choose_bands(threshold: float, miss: float, permutations: int) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false candidates, with which a pair
    at the threshold shares no band with at most probability ``miss``."""
    best = (permutations, 1)
    for rows in range(1, permutations + 1):
        bands = permutations // rows
        if (1 - threshold**rows) ** bands <= miss:
            best = (bands, rows)
    if (1 - threshold ** best[1]) ** best[0] > miss:
        raise ValueError("too few permutations for this threshold and recall")
    return best


class WordCodes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


_CODES = WordCodes()


def gram_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of all words if there are fewer."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = codes[: len(codes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out += codes[i : len(codes) - n + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows_of = list(zip(batch["id"].tolist(), batch["row"].tolist(), strict=True))
            for ids, values in chunks(rows_of, batch["text"].tolist(), 1 << 19):
                sets = [gram_hashes(t, n) for t in values]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                band = np.zeros((len(sets), bands), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    every = np.concatenate([sets[i] for i in full.tolist()])
                    start = np.cumsum(sizes[full]) - sizes[full]
                    with np.errstate(over="ignore"):
                        for b in range(bands):
                            mixed = np.full(len(full), b, np.uint64)
                            for r in range(b * rows, (b + 1) * rows):
                                moved = (every * factor[r] + shift[r]) >> np.uint64(16)
                                least = np.minimum.reduceat(moved, start)
                                mixed = (mixed ^ least) * np.uint64(0x9E3779B97F4A7C15)
                                mixed ^= mixed >> np.uint64(29)
                            band[full, b] = mixed
                yield pd.DataFrame(
                    {
                        "id": [i for i, _ in ids],
                        "row": [row for _, row in ids],
                        "key": keys,
                        "n": sizes,
                        "bands": [x.astype(np.int64).tolist() for x in band],
                    }
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [gram_hashes(t, n) for t in batch["text"]]
            out = batch[["member"]].assign(n=[len(s) for s in sets], grams=[s.tobytes() for s in sets])
            yield out

    return run


_PIECE = (
    "leader long, low long, high long, members binary, copies binary, sizes binary, "
    "grams binary, bands array<long>, cuts array<int>"
)
_BLOCK = _PIECE + ", labels binary, degrees binary"


def _cut_pieces(most_elements: int, most_members: int):
    """Members with one leader, packed. ``cuts`` tells how many of ``bands`` each member has."""

    def piece(held: list) -> pd.DataFrame:
        packed = {c: np.array([getattr(r, c) for r in held], "<i8") for c in ("member", "copies", "n")}
        return pd.DataFrame(
            [
                {
                    "leader": held[0].leader,
                    "low": held[0].n,
                    "high": held[-1].n,
                    "members": packed["member"].tobytes(),
                    "copies": packed["copies"].tobytes(),
                    "sizes": packed["n"].tobytes(),
                    "grams": b"".join(r.grams for r in held),
                    "bands": np.concatenate([np.sort(np.asarray(r.bands, np.int64)) for r in held]),
                    "cuts": [len(r.bands) for r in held],
                }
            ]
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        elements = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and (
                    row.leader != held[0].leader
                    or elements + row.n > most_elements
                    or len(held) >= most_members
                ):
                    yield piece(held)
                    held, elements = [], 0
                held.append(row)
                elements += row.n
        if held:
            yield piece(held)

    return run


def _compare_within(threshold: float):
    """Pieces of one leader and group, one behind the other, as a block whose members are compared.
    ``labels`` are the smallest members each is linked with in the block."""

    def block(held: list) -> pd.DataFrame:
        joined = {c: b"".join(getattr(r, c) for r in held) for c in ("members", "copies", "sizes", "grams")}
        members, copies, sizes = (np.frombuffer(joined[c], "<i8") for c in ("members", "copies", "sizes"))
        every, cuts = (np.concatenate([np.asarray(getattr(r, c), np.int64) for r in held]) for c in ("bands", "cuts"))
        sets = np.split(np.frombuffer(joined["grams"], "<u8"), np.cumsum(sizes)[:-1])
        links = _links(threshold, sets, np.split(every, np.cumsum(cuts)[:-1]), sizes)
        return pd.DataFrame(
            [
                {
                    "leader": held[0].leader,
                    "low": min(r.low for r in held),
                    "high": max(r.high for r in held),
                    **joined,
                    "bands": every,
                    "cuts": cuts,
                    "labels": members[_labels(links, members)].astype("<i8").tobytes(),
                    "degrees": (links @ copies).astype("<i8").tobytes(),
                }
            ]
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and (row.leader, row.group) != (held[0].leader, held[0].group):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return run


def _links(threshold: float, sets: list, bands: list, sizes: np.ndarray, other: tuple | None = None) -> np.ndarray:
    """Which pairs share a band and are similar; within one block, or with ``other``."""
    same = other is None
    sets_2, bands_2, sizes_2 = (sets, bands, sizes) if same else other
    both = overlaps(sets, sets_2, same)
    links = both >= threshold * (sizes[:, None] + sizes_2 - both) - 1e-4
    if links.any():
        links &= overlaps(bands, bands_2, same) > 0
    if same:
        np.fill_diagonal(links, False)
    return links


def _labels(links: np.ndarray, members: np.ndarray) -> np.ndarray:
    """For each the place of the smallest member it is connected with."""
    label = np.full(len(members), -1)
    for start in np.argsort(members, kind="stable").tolist():
        if label[start] < 0:
            label[start] = start
            todo = [start]
            while todo:
                near = np.flatnonzero(links[todo.pop()] & (label < 0))
                label[near] = start
                todo += near.tolist()
    return label


def overlaps(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> np.ndarray:
    """Sizes of all intersections but, if ``same``, those of a set with itself. Elements that no
    two sets share cost nothing."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
    every = np.concatenate([*left, *right])
    rows = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    side = np.repeat([0, 1], [int(s.sum()) for s in sizes])
    _, code = np.unique(every, return_inverse=True)
    counts = [np.bincount(code[side == k], minlength=code.max(initial=-1) + 1) for k in (0, 1)]
    shared = np.flatnonzero((counts[0] > int(same)) & (counts[1] > 0))
    place = np.full(len(counts[0]), -1)
    place[shared] = np.arange(len(shared))
    at = place[code]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    rows, side, at = rows[order], side[order], at[order]
    width = 4096
    for a in range(0, len(shared), width):
        lo, hi = np.searchsorted(at, [a, a + width])
        parts = []
        for k, n in ((0, len(left)), (1, len(right))):
            dense = np.zeros((n, width), np.float32)
            mine = side[lo:hi] == k
            dense[rows[lo:hi][mine], at[lo:hi][mine] - a] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


class _Forest:
    """Which of the edges between labels are news, each label in a tree at most once."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = x = self.root.get(up, up)
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[b] = a
        return a != b


def _across(threshold: float):
    """Rows in the order of the left block, itself first: (a, b, links) with the degrees that its
    members gain (a = b), and the edges between labels that are linked."""

    def unpack(row) -> tuple:
        get = lambda name, kind: np.frombuffer(getattr(row, name), kind)
        sizes = get("sizes", "<i8")
        bands = np.split(np.asarray(row.bands, np.int64), np.cumsum(row.cuts)[:-1])
        sets = np.split(get("grams", "<u8"), np.cumsum(sizes)[:-1])
        return (sets, bands, sizes), get("members", "<i8"), get("copies", "<i8"), get("labels", "<i8")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, number = None, None
        gained, edges, forest = np.zeros(0, np.int64), [], _Forest()

        def told() -> pd.DataFrame:
            hit = np.flatnonzero(gained)
            rows = [(int(left[1][i]), int(left[1][i]), int(gained[i])) for i in hit]
            return pd.DataFrame(rows + [(a, b, 0) for a, b in edges], columns=["a", "b", "links"])

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.left != number:
                    if number is not None:
                        yield told()
                    left, number = unpack(row), row.left
                    gained, edges, forest = np.zeros(len(left[1]), np.int64), [], _Forest()
                    continue
                right = unpack(row)
                links = _links(threshold, *left[0], other=right[0])
                gained += links @ right[2]
                if row.right > number:  # the other way round it is told by the other block
                    for i, j in {(int(left[3][i]), int(right[3][j])) for i, j in zip(*np.nonzero(links), strict=True)}:
                        if forest.joins(i, j):
                            edges.append((i, j))
        if number is not None:
            yield told()

    return run


def _pairs(threshold: float):
    """Linked pairs among rows of two sets: the degree of each and the edge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                x, y = np.frombuffer(r.grams, "<u8"), np.frombuffer(r.grams_2, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both) - 1e-4:
                    out += [(r.a, r.a, r.copies_2), (r.b, r.b, r.copies), (r.a, r.b, 0)]
            yield pd.DataFrame(out, columns=["a", "b", "links"])

    return run


_FOUND = "a long, b long, links long"


def _linked(
    base: DataFrame, members: DataFrame, n: int, threshold: float, most_elements: int, most_members: int
) -> DataFrame:
    """(a, b, links): degrees of members, beyond their own copies, and edges that connect them."""
    banded = members.select("member", "copies", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("m"), F.min("member").alias("first"))
    shared = keep(banded.join(buckets.where("m > 1"), "band"))

    big = _leaders(shared.where(F.col("m") > FEW).select("member", "copies", "n", "band", "first"))
    each = F.struct("member", "copies", "n")
    small = shared.where(F.col("m") <= FEW).groupBy("band").agg(F.array_sort(F.collect_list(each)).alias("e"))
    both = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, FEW), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    near = (F.col("p.x.n") >= threshold * F.col("p.y.n")) & (F.col("p.y.n") >= threshold * F.col("p.x.n"))
    pairs = small.select(F.explode(both).alias("p")).where(near).select(
        F.col("p.x.member").alias("a"), F.col("p.y.member").alias("b"),
        F.col("p.x.copies").alias("copies"), F.col("p.y.copies").alias("copies_2"),
    ).distinct()
    of = lambda x: big.select(F.col("member").alias(x), F.col("big").alias(f"big_{x}"))
    together = F.coalesce(F.arrays_overlap("big_a", "big_b"), F.lit(False))
    pairs = keep(
        pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~together)
        .select("a", "b", "copies", "copies_2")
    )
    big = keep(big)

    wanted = big.select("member").unionByName(pairs.select(F.col("a").alias("member")))
    wanted = wanted.unionByName(pairs.select(F.col("b").alias("member"))).distinct()
    wanted = keep(wanted)
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    texts_of = base.select(F.col("row").alias("member"), "text").join(wanted, "member")
    sets = keep(texts_of.mapInPandas(_sets(n), "member long, n long, grams binary"))

    one = pairs.join(sets.select(F.col("member").alias("a"), "grams"), "a")
    two = one.join(sets.select(F.col("member").alias("b"), F.col("grams").alias("grams_2")), "b")
    few = two.mapInPandas(_pairs(threshold), _FOUND)

    total = big.agg(F.sum("n")).first()[0] or 0
    rows = sets.drop("n").join(big, "member").withColumnRenamed("big", "bands")
    # Pieces end where partitions do, however many these are; small ones of a leader make a block.
    pieces = keep(
        rows.repartitionByRange(max(1, -(-total // (8 * most_elements))), "leader", "n", "member")
        .sortWithinPartitions("leader", "n", "member")
        .mapInPandas(_cut_pieces(most_elements, most_members), _PIECE)
        .withColumn("piece", F.monotonically_increasing_id())
    )
    before = Window.partitionBy("leader").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.select("piece", "leader", F.length("grams").alias("g"), F.length("members").alias("m"))
    full = [F.floor(F.coalesce(F.sum(c).over(before), F.lit(0)) / (8 * most))
            for c, most in (("g", most_elements), ("m", most_members))]
    blocks = keep(
        pieces.join(sizes.select("piece", F.greatest(*full).alias("group")), "piece")
        .repartition("leader", "group").sortWithinPartitions("leader", "group", "piece")
        .mapInPandas(_compare_within(threshold), _BLOCK)
        .withColumn("block", F.monotonically_increasing_id())
    )
    told = few.unionByName(blocks.mapInPandas(_inside, _FOUND))

    met = blocks.select("block", "low", "high", F.explode(F.array_distinct("bands")).alias("band"))
    met = met.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("block", "low", "high"))).alias("of"))
    met = met.where(F.size("of") > 1).select("of").distinct()
    low, high, low_2, high_2 = (F.col(c) for c in ("x.low", "x.high", "y.low", "y.high"))
    met = met.select(F.explode("of").alias("x"), "of").select("x", F.explode("of").alias("y")).where(
        (F.col("x.block") != F.col("y.block")) & (low * threshold <= high_2) & (low_2 * threshold <= high)
    )
    met = keep(met.select(F.col("x.block").alias("left"), F.col("y.block").alias("right")).distinct())
    if met.isEmpty():
        return told
    own = met.select("left").distinct().withColumn("right", F.col("left"))
    content = blocks.select(F.col("block").alias("right"), "members", "copies", "sizes", "grams", "bands", "cuts", "labels")
    across = (
        met.unionByName(own).join(content, "right").withColumn("other", F.col("left") != F.col("right"))
        .repartition("left").sortWithinPartitions("left", "other", "right")
    )
    return told.unionByName(across.mapInPandas(_across(threshold), _FOUND))


def _leaders(banded: DataFrame) -> DataFrame:
    """(member, copies, n, leader, big): the bands of each member, and a small member that those
    around it have too. Members with one leader go into blocks together; a group whose members
    found different ones only makes more blocks."""
    banded = keep(banded)
    led = banded.groupBy("member").agg(F.min("first").alias("leader"))
    for _ in range(LEADER_ROUNDS):
        least = banded.select("member", "band").join(led, "member").groupBy("band").agg(F.min("leader").alias("leader"))
        led = keep(banded.select("member", "band").join(least, "band").groupBy("member").agg(F.min("leader").alias("leader")))
    told = banded.groupBy("member").agg(
        F.first("copies").alias("copies"), F.first("n").alias("n"), F.collect_set("band").alias("big")
    )
    return told.join(led, "member")


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What blocks found within."""
    for batch in batches:
        parts = []
        for row in batch.itertuples(index=False):
            members, labels, degrees = (np.frombuffer(getattr(row, c), "<i8") for c in ("members", "labels", "degrees"))
            hit = degrees > 0
            parts.append(pd.DataFrame({"a": members[hit], "b": members[hit], "links": degrees[hit]}))
            hit = members != labels
            parts.append(pd.DataFrame({"a": members[hit], "b": labels[hit], "links": 0}))
        if parts:
            yield pd.concat(parts)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    miss: float = 1e-5,
    permutations: int = 240,
    block_elements: int = 1 << 19,
    block_members: int = 1024,
    keep_columns: Sequence[str] = (),
) -> DataFrame:
    """Per row: the id, ``class_id`` (the smallest id among all rows connected by links) and
    ``n_links``, the number of other rows whose n-gram sets are similar by ``threshold``.

    Words are runs of word characters in lower case; a text with fewer than ``n`` words has
    one n-gram of all of them, one without words, or a null text, has none and no links.
    Repeated rows and equal texts are linked with each other. A null id counts as larger than
    all others. An empty table gives an empty one; other columns are not read. A link is only
    missed, with probability ``miss`` at the threshold and less above it, if no band agrees.
    A block of members to verify holds at most ``block_elements`` n-grams, or one member.

    With ``keep_columns`` the rows of ``docs`` come instead, in a struct ``kept``, with ``first``:
    whether this is the one of its class with the smallest id, the first of these if several rows
    have it.
    """
    bands, rows = choose_bands(threshold, miss, permutations)
    wanted = list(dict.fromkeys([*keep_columns, id_col, text_col]))
    base = keep(
        docs.select(
            F.struct(*[col(c) for c in wanted]).alias("kept"), F.monotonically_increasing_id().alias("row")
        )
    )
    own = F.col("kept").getField(id_col).cast("long")
    base = base.select(
        F.coalesce(own, F.lit(_NULL_ID).cast("long")).alias("id"),
        F.coalesce(F.col("kept").getField(text_col).cast("string"), F.lit("")).alias("text"),
        "row",
        "kept",
    )
    kind = "id long, row long, key binary, n long, bands array<long>"
    signed = keep(base.select("id", "row", "text").mapInPandas(_signatures(n, bands, rows), kind))
    members = keep(
        signed.where("n > 0")
        .groupBy("key")
        .agg(
            F.min(F.struct("row", "n", "bands")).alias("own"),
            F.min(F.struct("id", "row")).alias("least"),
            F.count("*").alias("copies"),
        )
        .select("key", F.col("own.row").alias("member"), "own.n", "own.bands", "least", "copies")
    )
    told = keep(
        _linked(base, members, n, threshold, block_elements, block_members)
        .groupBy("a", "b").agg(F.sum("links").alias("links"))
    )
    classes = components(told.where("a <> b").select("a", "b"))
    degrees = told.where("a = b").select(F.col("a").alias("member"), "links")

    labelled = (
        members.select("key", "member", "least", "copies").join(classes.withColumnRenamed("node", "member"), "member", "left")
        .join(degrees, "member", "left")
        .withColumn("label", F.coalesce("label", "member"))
    )
    firsts = labelled.groupBy("label").agg(F.min("least").alias("class"))
    per_key = labelled.join(firsts, "label").select(
        "key", "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    result = signed.select("id", "row", "key").join(per_key, "key", "left")
    if keep_columns:
        later = result.where(F.col("row") != F.col("class.row")).select("row")
        later = base.select("row", "kept").join(later.withColumn("later", F.lit(True)), "row", "left")
        return later.select("kept", F.col("later").isNull().alias("first"))
    null = F.lit(_NULL_ID)
    return result.select(
        F.nullif("id", null).alias(id_col),
        F.nullif(F.coalesce("class.id", "id"), null).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
