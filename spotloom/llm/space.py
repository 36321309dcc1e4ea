"""Vectors dealt to lists around centroids, for all searches of this subpackage.

Centroids are fitted on a bounded sample, by halving the fullest part until there is one for every ``size`` vectors, up to
CENTROIDS. A list that is still too long is cut again by centroids of its own, fitted on a bounded sample of it, so that the
number of lists follows the number of vectors. All vectors are dealt. A vector may be in several lists, as data that others
look for, as a query that looks for others, or both; the rule of the search decides. Lists that cannot be cut, since their
vectors are alike, are dealt to tasks as parts of queries against parts of data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.session import durable

#: Rows that centroids are fitted on, and centroids of one fit, at most.
SAMPLE = 8192
CENTROIDS = 1024
#: A list of more than so many times its size is cut again; of a list that is still longer one task takes so many rows.
CUT = 4
TASK_ROWS = 16_384
#: Links of a centroid in the graph.
LINKS = 16

#: (graph, unit vectors) -> for each vector and centroid, whether it is data of the list and whether it is a query of it.
Rule = Callable[["CentroidGraph", np.ndarray], tuple[np.ndarray, np.ndarray]]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of number lists as float64 rows; shorter lists end in zeros, nulls are 0, NaN is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dims))
    values = column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.asarray(column.value_lengths().fill_null(0))
    if len(n) and (n == dims).all():
        out = values.reshape(-1, dims)
    else:
        out[np.arange(dims) < n[:, None]] = values
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0))


def bounded_sample(vectors: DataFrame, key: str, column: str, dims: int, rows: int = SAMPLE) -> np.ndarray:
    """At most ``rows`` vectors, those of the smallest hashes of their keys: the same whatever the partitions."""
    got = vectors.select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(column).alias("v")).orderBy("h", "k").limit(rows).select("v").toArrow()
    return matrix(got["v"], dims)


def measured(vectors: DataFrame, column: str) -> tuple[int, int, str]:
    """(rows, dimensions, type): the type is the narrowest that holds all numbers of a column of lists exactly, in which
    they then travel."""
    kept = lambda kind: F.bool_and(F.forall(column, lambda e: e.isNull() | F.coalesce(e.try_cast(kind).cast("double") == e, F.lit(False))))
    whole = vectors.schema[column].dataType.elementType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    n, dims, short, single = vectors.agg(F.count(F.lit(1)), F.max(F.size(column)), kept("smallint"), F.lit(False) if whole else kept("float")).first()
    return n, dims or 0, "smallint" if short else vectors.schema[column].dataType.elementType.simpleString() if whole else "float" if single else "double"


def balanced_parts(x: np.ndarray, k: int, rounds: int = 6) -> list[np.ndarray]:
    """Rows in at most k parts: the fullest is halved by two-means until there are k, none far above its share."""
    parts = [np.arange(len(x))]
    done: list[np.ndarray] = []
    rng = np.random.default_rng(7)
    while parts and len(parts) + len(done) < k:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 4:
            done.append(own)
            continue
        v = x[own]
        a = v[rng.integers(len(v))]
        b = v[np.argmax(((v - a) ** 2).sum(1))]
        for _ in range(rounds):
            lean = ((v - a) ** 2).sum(1) - ((v - b) ** 2).sum(1)
            near = lean < 0
            if not near.any() or near.all():
                break
            a, b = v[near].mean(0), v[~near].mean(0)
        if not near.any() or near.all():
            done.append(own)
            continue
        parts += [own[near], own[~near]]
    return parts + done


def balanced_centroids(x: np.ndarray, k: int) -> np.ndarray:
    return np.stack([x[p].mean(0) for p in balanced_parts(x, k)]).astype(np.float64)


class CentroidGraph:
    """Centroids in memory, each linked to its nearest. They are grouped, and a search enters the graph at a member in the
    middle of each group; so it reaches groups that are far from all others."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        k = len(centroids)
        self.between = distances(centroids, centroids)
        self.links = np.argsort(self.between, axis=1, kind="stable")[:, 1 : LINKS + 1]
        self.groups = balanced_parts(centroids, max(1, k // 8))
        self.entries = np.array([g[np.argmin(distances(centroids[g], centroids[g].mean(0)[None])[:, 0])] for g in self.groups])
        self.reach = np.array([self.between[e, g].max() for e, g in zip(self.entries, self.groups, strict=True)])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Distances of each row to the centroids that a greedy search of the graph meets; infinite to all others."""
        n = len(x)
        d = np.full((n, len(self.c)), np.inf)
        d[:, self.entries] = distances(x, self.c[self.entries])
        spent = np.zeros(d.shape, bool)
        rows = np.arange(n)
        while len(rows) and self.links.shape[1]:
            at = np.argmin(d[rows], axis=1)
            new = ~spent[rows, at]
            rows, at = rows[new], at[new]
            spent[rows, at] = True
            to = self.links[at]
            v = x[rows]
            far = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (self.c * self.c).sum(1)[to] - 2 * np.einsum("nd,nkd->nk", v, self.c[to]), 0))
            d[rows[:, None], to] = far
        return d

    def within(self, x: np.ndarray, reach: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Distances of each row to all centroids up to ``reach`` of its nearest distance; infinite to others.

        The graph gives the nearest, or nearly so. Then the groups that the distance to their entry does not rule out are
        gone through, so that nothing within reach is missed, however the graph is linked.
        """
        d = self.nearest(x)
        enter = d[:, self.entries].copy()
        for g in range(len(self.groups)):
            rows = np.flatnonzero(enter[:, g] - self.reach[g] <= reach(d.min(1)) + 1e-9)
            own = self.groups[g]
            d[np.ix_(rows, own)] = distances(x[rows], self.c[own])
        return np.where(d <= reach(d.min(1))[:, None] + 1e-9, d, np.inf)


def _fit(x: np.ndarray, n: int, size: int) -> CentroidGraph:
    return CentroidGraph(balanced_centroids(x, max(1, min(CENTROIDS, len(x) // 8, math.ceil(n / size)))))


def _flags(rule: Rule, graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, flags): flags are 1 for data and 2 for a query, added."""
    data, query = rule(graph, x)
    row, at = np.nonzero(data | query)
    return row, at, data[row, at].astype(np.int8) + 2 * query[row, at].astype(np.int8)


def posting_lists(vectors: DataFrame, key: str, column: str, dims: int, n: int, rule: Rule, size: int) -> DataFrame:
    """(key, column, list, q, d, data, query): every vector in each list that the rule deals it to.

    ``vectors``: (key STRING, column ARRAY of numbers), ``n`` rows. A group of equal (list, q, d) is what one task compares:
    its queries with its data; where lists had to be dealt, each query meets each data row of its list in one such group.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[column].dataType.simpleString()
    graph = _fit(unit(bounded_sample(vectors, key, column, dims)), n, size)
    shared = spark.sparkContext.broadcast(graph)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                row, to, flags = _flags(rule, shared.value, unit(matrix(p.column(1), dims)))
                ends = pa.array(np.searchsorted(row, np.arange(p.num_rows + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(to, pa.int64()), pa.array(flags, pa.int8())], ["list", "flags"]))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), lists], ["k", "x", "lists"])

    dealt = vectors.select(F.col(key).alias("k"), F.col(column).alias("x")).mapInArrow(deal, f"k string, x {kind}, lists array<struct<list:bigint,flags:tinyint>>")
    dealt = durable(dealt)
    rows = dealt.select("k", "x", F.explode("lists").alias("l")).select("k", "x", "l.list", "l.flags")
    full = lambda r: r.groupBy("list").agg(F.count_if(F.col("flags").bitwiseAND(1) > 0).alias("n_data"), F.count_if(F.col("flags") > 1).alias("n_query"))
    counts = [tuple(r) for r in full(dealt.select(F.explode("lists").alias("l")).select("l.list", "l.flags")).collect()]  # at most CENTROIDS rows
    long = {i: a + b for i, a, b in counts if max(a, b) > CUT * size}
    if long and n > size * len(graph.c):
        rows = durable(rows.where(~F.col("list").isin(list(long))).unionByName(_cut(rows, long, dims, kind, rule, size)))
        # lists that one task should not take whole: few rows, which Spark broadcasts if they are as small as that
        heavy = durable(full(rows).where(f"n_data > {TASK_ROWS} or n_query > {TASK_ROWS}"))
        heavy = None if heavy.isEmpty() else heavy
    else:
        counts = [c for c in counts if max(c[1:]) > TASK_ROWS]
        heavy = spark.createDataFrame(counts, "list bigint, n_data bigint, n_query bigint") if counts else None
    rows = rows.select("k", "x", "list", (F.col("flags").bitwiseAND(1) > 0).alias("data"), (F.col("flags") > 1).alias("query"))
    return dealt_parts(rows, heavy).withColumnsRenamed({"k": key, "x": column})


def dealt_parts(rows: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """(k, x, list, q, d, data, query): the rows (k, x, list, data, query) with the part of their list that a task takes.
    ``heavy``: (list, n_data, n_query) of the lists that one task should not take whole."""
    one = F.lit(0).alias("q"), F.lit(0).alias("d")
    if heavy is None:
        return rows.select("k", "x", "list", *one, "data", "query")
    h = lambda c: F.pmod(F.xxhash64("k"), F.col(c)).cast("int")
    parts = lambda c: F.greatest(F.ceil(F.col(c) / TASK_ROWS).cast("int"), F.lit(1))
    heavy = heavy.select("list", parts("n_query").alias("nq"), parts("n_data").alias("nd"))
    rows = rows.join(heavy, "list", "left").na.fill(1, ["nq", "nd"]).withColumns({"hq": h("nq"), "hd": h("nd")})
    cell = lambda q, d, data, query: F.struct(q.alias("q"), d.alias("d"), data.alias("data"), query.alias("query"))
    own = F.array(cell(F.col("hq"), F.col("hd"), F.col("data"), F.col("query")))
    other_q = F.filter(F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: cell(q, F.col("hd"), F.col("data"), F.lit(False))), lambda c: (c["q"] != F.col("hq")) & F.col("data"))
    other_d = F.filter(F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda d: cell(F.col("hq"), d, F.lit(False), F.col("query"))), lambda c: (c["d"] != F.col("hd")) & F.col("query"))
    rows = rows.select("k", "x", "list", F.explode(F.concat(own, other_q, other_d)).alias("c"))
    return rows.select("k", "x", "list", "c.q", "c.d", "c.data", "c.query")


def _cut(rows: DataFrame, long: dict[int, int], dims: int, kind: str, rule: Rule, size: int) -> DataFrame:
    """The rows of long lists in lists of their own centroids. Each is fitted by one task on a bounded sample; the rows are
    dealt by many, to each of which only the centroids of its list are sent."""
    n = F.create_map(*[F.lit(x) for i, c in long.items() for x in (i, c)])
    own = rows.where(F.col("list").isin(list(long))).withColumn("n", F.try_element_at(n, F.col("list")).cast("bigint"))
    h = F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1_000_000)) / 1_000_000.0
    picked = own.where(h < F.lit(1.2 * SAMPLE) / F.col("n")).select("list", "n", F.xxhash64("k", F.lit(5)).alias("h"), "x")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("h").slice(0, SAMPLE)
        c = balanced_centroids(unit(matrix(t["x"], dims)), max(1, min(CENTROIDS, t.num_rows // 8, math.ceil(t["n"][0].as_py() / size))))
        return pa.table({"list": t["list"].slice(0, 1), "n": t["n"].slice(0, 1), "c": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

    centroids = durable(picked.groupBy("list").applyInArrow(fit, "list bigint, n bigint, c array<double>"))
    salts = F.ceil(F.col("n") / (4 * TASK_ROWS)).cast("int")
    left = own.withColumn("salt", F.pmod(F.xxhash64("k", F.lit(6)), salts).cast("int")).drop("n")
    right = centroids.select("list", "c", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

    def again(t: pa.Table, c: pa.Table) -> pa.Table:
        graph = CentroidGraph(np.array(c["c"][0].as_py()).reshape(-1, dims)) if c.num_rows else None
        out = []
        for at in range(0, t.num_rows, 2048):
            p = t.slice(at, 2048)
            had = p["flags"].to_numpy()
            row, to, flags = _flags(rule, graph, unit(matrix(p["x"], dims)))
            flags = flags & had[row]
            row, to, flags = row[flags > 0], to[flags > 0], flags[flags > 0]
            pick = pa.array(row, pa.int64())
            lists = (p["list"].to_numpy()[row] + 1) * 1_048_576 + to
            out.append(pa.table({"k": p["k"].take(pick), "x": p["x"].take(pick), "list": pa.array(lists, pa.int64()), "flags": pa.array(flags, pa.int8())}))
        return pa.concat_tables(out) if out else pa.table({"k": pa.array([], pa.string()), "x": t["x"].slice(0, 0), "list": pa.array([], pa.int64()), "flags": pa.array([], pa.int8())})

    both = left.groupBy("list", "salt").cogroup(right.groupBy("list", "salt"))
    return both.applyInArrow(again, f"k string, x {kind}, list bigint, flags tinyint")
