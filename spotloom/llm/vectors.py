"""Most similar vectors for every vector, by balanced posting lists.

Vectors are dealt to balanced lists (see ``space``), whose centroids each task searches as a graph in memory. A vector is
posted to its nearest centroid's list and, near a boundary, to its neighbours' lists as well; a query looks into the lists
whose centroid's distance is at most so many times the nearest's. All vectors are posted and all are queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.llm.space import CentroidGraph, Rule, matrix, measured, posting_lists, unit
from spotloom.session import durable

#: Vectors that a list should hold.
LIST = 2048
#: Similarities held at once.
CELLS = 4_000_000
#: Decimals to which similarities are rounded before they are ranked.
DECIMALS = 9


def ratio_rule(closure: float, probes: float, slack: float = 0.0) -> Rule:
    """Posted to lists up to (1 + closure) times the nearest centroid's distance; searched are those up to (1 + probes)
    times it, and up to ``slack`` more than it.

    With a slack of twice a radius no neighbour within the radius is missed: it is in the list of its own nearest
    centroid, which is at most that much farther from the query than the query's nearest.
    """

    def rule(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = graph.within(x, lambda least: np.maximum((1 + max(closure, probes)) * least, least + slack))
        least = d.min(1)[:, None]
        return d <= (1 + closure) * least + 1e-9, d <= np.maximum((1 + probes) * least, least + slack) + 1e-9

    return rule


def nearest_vectors(vectors: DataFrame, k: int = 3, min_similarity: float | None = None, key: str = "label", column: str = "vector", closure: float = 0.04, probes: float = 0.25) -> DataFrame:
    """(label_a, label_b, similarity): for each vector (a) its k most similar others (b) by cosine.

    ``vectors``: (label STRING, vector ARRAY<DOUBLE>). Similarities are rounded to nine decimals; equal ones share a
    place, so all ties for the last place come out. Nulls, NaN and missing tails count as 0; a vector of zeros is similar
    to none. A repeated label counts once, with its smallest vector; a null label or vector is left out. Equal vectors
    of different labels are neighbours of similarity 1.

    ``min_similarity`` only keeps neighbours at least so similar; the lists searched then reach far enough that none of
    these is missed. Without it the accuracy hangs on ``closure`` and ``probes``, and is measured in the tests.
    """
    v = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(key).alias("label")).agg(F.min(column).alias("vector"))
    v = durable(v.where(F.exists("vector", lambda e: F.coalesce(e, F.lit(0)) != 0)))
    n, dims, kind = measured(v, "vector")
    if not n:
        return vectors.sparkSession.createDataFrame([], "label_a string, label_b string, similarity double")
    v = v.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    slack = 0.0 if min_similarity is None else 2 * math.sqrt(max(0.0, 2 - 2 * min_similarity)) + 1e-6
    floor = -2.0 if min_similarity is None else min_similarity
    rows = posting_lists(v, "label", "vector", dims, n, ratio_rule(closure, probes, slack), LIST)

    def one_list(t: pa.Table) -> pa.Table:
        u = unit(matrix(t["vector"], dims))
        low = u.astype(np.float32)
        data = np.flatnonzero(t["data"].to_numpy(zero_copy_only=False))
        query = np.flatnonzero(t["query"].to_numpy(zero_copy_only=False))
        kept = low[data].T
        out_a, out_b, out_s = [], [], []
        step = max(1, CELLS // max(1, len(data)))
        for s in range(0, len(query), step):
            q = query[s : s + step]
            rough = low[q] @ kept
            own = np.minimum(np.searchsorted(data, q), max(0, len(data) - 1))
            own_row = np.flatnonzero(data[own] == q) if len(data) else own[:0]
            rough[own_row, own[own_row]] = -np.inf
            i, j = np.nonzero(rough >= np.float32(floor - 1e-5))
            if len(i) > 8 * k * len(q) and rough.shape[1] > k:
                # the k-th best, less the error of single precision, bounds who can have a place
                bound = np.maximum(np.float32(floor - 1e-5), np.partition(rough, -k, axis=1)[:, -k] - 2e-6)
                i, j = np.nonzero(rough >= bound[:, None])
            sim = np.round(np.einsum("nd,nd->n", u[q[i]], u[data[j]]), DECIMALS)
            ok = sim >= floor
            out_a.append(q[i[ok]])
            out_b.append(data[j[ok]])
            out_s.append(sim[ok])
        a, b, sim = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (out_a, out_b, out_s))
        # places: fewer than k strictly more similar
        order = np.lexsort((-sim, a))
        a, b, sim = a[order], b[order], sim[order]
        if len(a):
            new = np.r_[True, a[1:] != a[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            fresh = np.r_[True, (a[1:] != a[:-1]) | (sim[1:] != sim[:-1])]
            above = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0)) - start
            keep = above < k
            a, b, sim = a[keep], b[keep], sim[keep]
        label = t["label"]
        return pa.table({"label_a": label.take(pa.array(a, pa.int64())), "label_b": label.take(pa.array(b, pa.int64())), "similarity": pa.array(sim, pa.float64())})

    found = rows.groupBy("list", "q", "d").applyInArrow(one_list, "label_a string, label_b string, similarity double")
    w = Window.partitionBy("label_a").orderBy(F.desc("similarity"))
    return found.distinct().withColumn("place", F.rank().over(w)).where(F.col("place") <= k).drop("place")


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """(label_a, label_b), smaller label first, once per pair found from either side."""
    return neighbours.select(F.least("label_a", "label_b").alias("label_a"), F.greatest("label_a", "label_b").alias("label_b")).distinct()
