"""Exact top-k search by inner product on an M-tree whose nodes are rows of a table.

The inner product is not a metric, but with one more component sqrt(M - |x|^2) for each vector
(M the largest |x|^2) and 0 for each query, the Euclidean distance is: d^2 = |q|^2 + M - 2 qx,
so the nearest are those of the largest product.

* Equal vectors are one entry with its ``k + 1`` smallest ids; no other copy can be among the
  best ``k``. Every distinct vector is in the tree.
* Routing objects are a bounded sample. An entry goes below its nearest one; the entries of one
  routing object, ordered by their distance to it, are cut into pages. A page has a routing
  object of its own, a covering radius, its distance to the parent and that of each entry.
* A query first visits the pages below its nearest routing objects, which gives a bound on its
  k-th best distance. Then it descends wherever the triangle inequality allows something
  nearer. Pages of a visit are taken best first; a page is left out by the stored distances,
  without computing any, or by its covering radius, and so are entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import keep

#: Queries that are compared with a page at a time.
BLOCK = 512
#: Products below this are exact in floating point.
EXACT = float(2**52)
RESULT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): components floor(scale * x); rows with anything null or not finite left out."""
    x = col(vector_col)
    fine = (
        col(id_col).isNotNull()
        & x.isNotNull()
        & F.forall(
            x,
            lambda c: F.coalesce(
                ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)
            ),
        )
    )
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return vectors.where(fine).select(col(id_col).cast("long").alias("id"), whole.alias("v"))


def matrix(rows, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), dim))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all of ``b``."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Metric:
    """Distances of the space in which the nearest have the largest products."""

    def __init__(self, largest: float) -> None:
        self.largest = largest

    def of_query(self, queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
        own = (queries**2).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(own + self.largest - 2.0 * (queries @ entries.T), 0.0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left, right = (a**2).sum(axis=1), (b**2).sum(axis=1)
        more = np.sqrt(np.maximum(self.largest - left, 0.0))[:, None] - np.sqrt(
            np.maximum(self.largest - right, 0.0)
        )
        square = left[:, None] + right - 2.0 * (a @ b.T) + more**2
        return np.sqrt(np.maximum(square, 0.0))

    def reach(self, queries: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The distance beyond which products are below ``bound``, and a little more: rounding
        must never leave out an entry."""
        own = (queries**2).sum(axis=1)
        far = np.sqrt(np.maximum(own + self.largest - 2.0 * bound, 0.0))
        return far + 1e-6 * (1.0 + np.sqrt(own + self.largest))


def _build_pages(dim: int, pivots: np.ndarray, metric: Metric, page_rows: int):
    def page(number: int, parent: int, rows: pd.DataFrame) -> dict:
        entries = matrix(rows["v"], dim)
        center = int(np.argmin(metric.between(entries, entries.mean(axis=0)[None, :])[:, 0]))
        near = metric.between(entries, entries[center : center + 1])[:, 0]
        sizes = rows["ids"].map(len).to_numpy("<i4")
        return {
            "parent": parent,
            "page": number,
            "center": center,
            "radius": float(near.max()),
            "dist": rows["dist"].to_numpy("<f8").tobytes(),
            "entries": entries.astype("<f8").tobytes(),
            "ids": np.concatenate(rows["ids"].to_list()).astype("<i8").tobytes(),
            "sizes": sizes.tobytes(),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            done = []
            while len(held) > page_rows or (len(held) and held["parent"].iloc[0] != held["parent"].iloc[-1]):
                same = int((held["parent"] == held["parent"].iloc[0]).to_numpy().argmin()) or len(held)
                n = min(page_rows, same)
                done.append(page(number, int(held["parent"].iloc[0]), held.iloc[:n]))
                held, number = held.iloc[n:].reset_index(drop=True), number + 1
            if done:
                yield pd.DataFrame(done)
        if held is not None and len(held):
            yield pd.DataFrame([page(number, int(held["parent"].iloc[0]), held)])

    return run


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best (query position, id, score) of each query."""
    query, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    nth = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[nth < k], ids[nth < k], score[nth < k]


def _visit(dim: int, k: int, metric: Metric):
    """Rows (a page, a block of queries, both below one routing object) to the best of each."""

    def least_distance(row) -> float:
        to_parent = np.frombuffer(row.to_parent, "<f8")
        center = np.frombuffer(row.dist, "<f8")[row.center]
        return float(np.abs(to_parent - center).min()) - row.radius

    def one(row, found: dict) -> None:
        queries = np.frombuffer(row.queries, "<f8").reshape(-1, dim)
        if row.block not in found:
            bound = np.frombuffer(row.bound, "<f8").copy()
            found[row.block] = [np.frombuffer(row.query_ids, "<i8"), bound, None]
        state = found[row.block]
        own_ids, bound, best = state
        to_parent = np.frombuffer(row.to_parent, "<f8")
        reach = metric.reach(queries, bound)
        entries = np.frombuffer(row.entries, "<f8").reshape(-1, dim)
        dist = np.frombuffer(row.dist, "<f8")
        # by stored distances alone: of the page's routing object and of its entries
        short = np.abs(to_parent - dist[row.center]) - row.radius
        short = np.maximum(short, np.maximum(to_parent - dist.max(), dist.min() - to_parent))
        left = np.flatnonzero(short <= reach)
        if len(left):
            to_center = metric.of_query(queries[left], entries[row.center : row.center + 1])[:, 0]
            left = left[to_center - row.radius <= reach[left]]
        if not len(left):
            return
        worth = (dist >= (to_parent - reach)[left].min()) & (dist <= (to_parent + reach)[left].max())
        at = np.flatnonzero(worth)
        if not len(at):
            return
        score = products(queries[left], entries[at])
        least = bound[left]
        if len(at) > k + 1:  # one more, as the query itself may be among them
            least = np.maximum(least, np.partition(score, -(k + 1), axis=1)[:, -(k + 1)])
        q, e = np.nonzero(score >= least[:, None])
        if not len(q):
            return
        sizes = np.frombuffer(row.sizes, "<i4")
        ids = np.frombuffer(row.ids, "<i8")
        first = np.cumsum(sizes) - sizes
        n = sizes[at[e]]
        query = np.repeat(left[q], n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = ids[np.repeat(first[at[e]], n) + inner]
        value = np.repeat(score[q, e], n)
        other = hit != own_ids[query]
        new = (query[other], hit[other], value[other])
        state[2] = best = _best([new] if best is None else [best, new], k)
        full, counts = np.unique(best[0], return_counts=True)
        last = np.searchsorted(best[0], full, side="right") - 1
        whole = counts == k
        bound[full[whole]] = np.maximum(bound[full[whole]], best[2][last[whole]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}

        def told() -> pd.DataFrame:
            parts = [(s[0][s[2][0]], s[2][1], s[2][2]) for s in found.values() if s[2] is not None]
            if not parts:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            q, v, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

        for batch in batches:
            nearest = sorted(batch.itertuples(index=False), key=least_distance)
            for row in nearest:
                one(row, found)
                if len(found) > 64:
                    yield told()
                    found.clear()
        yield told()

    return run


def _blocks(dim: int, pivots: np.ndarray, metric: Metric, nodes: dict, seeds: int | None):
    """Packs of queries for each routing object they have to visit."""
    counts, low, high = nodes["n"], nodes["low"], nodes["high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.iloc[a : a + BLOCK]
                queries = matrix(part["v"], dim)
                far = metric.of_query(queries, pivots)
                if seeds is None:
                    bound = part["bound"].to_numpy("f8")
                    reach = metric.reach(queries, bound)[:, None]
                    go = (far - high <= reach) & (low - far <= reach) & (counts > 0)
                else:
                    bound = np.full(len(part), -np.inf)
                    order = np.argsort(far, axis=1, kind="stable")
                    ahead = np.cumsum(counts[order], axis=1) - counts[order]
                    go = np.zeros(far.shape, bool)
                    np.put_along_axis(go, order, (ahead < seeds) & (counts[order] > 0), axis=1)
                out = []
                for p in np.flatnonzero(go.any(axis=0)).tolist():
                    at = np.flatnonzero(go[:, p])
                    out.append(
                        {
                            "parent": p,
                            "block": number,
                            "query_ids": part["id"].to_numpy("<i8")[at].tobytes(),
                            "queries": queries[at].astype("<f8").tobytes(),
                            "bound": bound[at].astype("<f8").tobytes(),
                            "to_parent": far[at, p].astype("<f8").tobytes(),
                        }
                    )
                    number += 1
                if out:
                    yield pd.DataFrame(out)

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    routing: int = 256,
    page_rows: int = 512,
) -> DataFrame:
    """The ``k`` vectors of the largest inner product for each query, without its own id.

    Components become floor(scale * x). Returns query_id, rank from 1, vec_id and score, ties
    to the smaller vec_id; all that there are if fewer. Vectors, and queries, that are null or
    hold a null or non-finite component, or have a null id, take no part; one that is shorter
    than others counts as filled up with zeros. Repeated rows count once; of an id with several
    vectors the pair with the best score counts. Empty tables give an empty result.
    Other columns are not read. ``routing`` bounds what is broadcast: that many vectors.
    """
    spark = vectors.sparkSession
    once = Window.partitionBy("v").orderBy("id")
    entries = keep(
        quantized(vectors, id_col, vector_col, scale)
        .withColumn("nth", F.dense_rank().over(once))
        .where(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )
    asked = keep(quantized(queries, id_col, vector_col, scale).distinct())
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    widest = [x.agg(F.max(F.size("v")), F.max(square)).first() for x in (entries, asked)]
    dim = max(w[0] or 0 for w in widest)
    sample = entries.orderBy(F.xxhash64("v"), "v").limit(routing).collect()
    if not sample or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    metric, pivots = Metric(float(widest[0][1])), matrix([r["v"] for r in sample], dim)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = metric.between(matrix(batch["v"], dim), pivots)
            batch["parent"] = far.argmin(axis=1)
            batch["dist"] = far.min(axis=1)
            yield batch

    below = entries.mapInPandas(assign, "v array<long>, ids array<long>, parent int, dist double")
    kind = (
        "parent int, page long, center int, radius double, dist binary, entries binary, "
        "ids binary, sizes binary"
    )
    pages = keep(
        below.repartitionByRange("parent", "dist", F.xxhash64("v"))
        .sortWithinPartitions("parent", "dist")
        .mapInPandas(_build_pages(dim, pivots, metric, page_rows), kind)
    )
    nodes = {n: np.zeros(len(pivots)) for n in ("n", "low", "high")}
    summary = below.groupBy("parent").agg(F.count("*"), F.min("dist"), F.max("dist"))
    for parent, n, low, high in summary.collect():  # a row per routing object
        nodes["n"][parent], nodes["low"][parent], nodes["high"][parent] = n, low, high

    block = (
        "parent int, block long, query_ids binary, queries binary, bound binary, to_parent binary"
    )
    visit = _visit(dim, k, metric)

    def search(rows: DataFrame, seeds: int | None) -> DataFrame:
        """The best of each query over what it visits, a row per candidate id."""
        blocks = rows.mapInPandas(_blocks(dim, pivots, metric, nodes, seeds), block)
        met = pages.hint("shuffle_merge").join(blocks, "parent").mapInPandas(visit, RESULT)
        return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    seeded = (
        search(asked, 4 * k)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") == k)
        .select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bound"))
    )
    bounded = asked.join(seeded, "id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("-inf")))
    )
    return (
        search(bounded, None)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
