"""Clusters of mutually similar count profiles, with their size and most typical members.

Density clustering on unit vectors: cells are near if their distance is at most ``eps`` (the chord of the least cosine); a
cell with enough near cells, itself included, is a core; cores that are near are in one cluster, and a cell that is no core
joins the cluster of a core it is near to. Space is partitioned twice. Dense places are balls of diameter ``eps`` around
centres fitted on a bounded sample: all cells of a ball are near each other, so they are cores of one local cluster without
comparing any two. A cell in a ball's margin of width ``eps`` is compared with those of the ball's cells that lie far
enough out, and as a shared core merges the local clusters. The cells outside all dense balls are dealt to lists, around
centroids, each also to every list in whose margin it lies, or by names that near cells have in common, whichever is less
work; in each list they form local clusters, merged through the cores that lists share. Merging is by a
distributed star contraction. No link depends on chance.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from spotloom.llm import space
from spotloom.llm.space import CentroidGraph, bounded_sample, dealt_parts, distances, matrix, measured, posting_lists, unit
from spotloom.session import durable

#: Rows that the balls are fitted on: so many, or one of SHARE up to ten times as many; lone rows in a row after which no more
#: balls are looked for.
SAMPLE = 6000
SHARE = 16
ALONE = 4096
#: Cells of a ball, and cells in its margin, that one task compares.
MEMBERS = 20_000
#: Cells outside all balls that a list should hold.
BLOCK = 4096
#: Cells outside all balls up to which lists around centroids are taken unasked; beyond, what costs less.
LISTED = 16_384
#: Comparisons that take as long as one more row of a list.
ROW = 3000
#: Names of a cell, at most.
NAMES = 4096
#: Near cells, itself included, that make a cell a core.
CORE = 3
#: Links between local clusters that one task joins, at most.
EDGES = 500_000


class Balls:
    """Centres of dense places of the sample."""

    def __init__(self, x: np.ndarray, similarity: float):
        self.eps = math.sqrt(2 - 2 * similarity)
        self.similarity = similarity
        left = x.astype(np.float32)
        centres, alone, at = [], 0, 0
        free = np.ones(len(left), bool)
        while at < len(left) and alone < ALONE:
            if not free[at]:
                at += 1
                continue
            near = free & (left @ left[at] >= similarity)
            if near.sum() > 1:
                alone = 0
                # two steps towards the middle, so that the ball holds as much of its surroundings as it can
                c = left[at]
                for _ in range(2):
                    own = left[(left @ c) / max(np.linalg.norm(c), 1e-30) >= similarity]
                    c = own.mean(0) if len(own) else c
                c = c.astype(np.float64)
                centres.append(c / max(np.linalg.norm(c), 1e-300))
            else:
                alone += 1
            free &= ~near
            free[at] = False
            if free.sum() < 0.7 * len(left):
                left = left[free]
                free, at = np.ones(len(left), bool), 0
        dims = x.shape[1] if x.ndim == 2 else 1
        self.centres = np.stack(centres) if centres else np.zeros((0, dims))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per row: its ball or -1, and the distance to its centre. Then the rows' other balls as (row, ball, distance, inside):
        those that hold it too, and those in whose margin it lies."""
        n = len(x)
        home, r = np.full(n, -1), np.full(n, np.inf)
        rows, balls = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        centres, own = self.centres.astype(np.float32), x.astype(np.float32)
        step = max(32, 2_000_000 // max(1, len(centres)))
        for s in range(0, n if len(centres) else 0, step):
            # single precision only chooses what is measured
            i, j = np.nonzero(own[s : s + step] @ centres.T >= 1 - (1.5 * self.eps) ** 2 / 2 - 1e-5)
            rows.append(i + s)
            balls.append(j)
        row, ball = np.concatenate(rows), np.concatenate(balls)
        d = np.empty(len(row))
        for s in range(0, len(row), 20_000):
            d[s : s + 20_000] = np.sqrt(np.maximum(((x[row[s : s + 20_000]] - self.centres[ball[s : s + 20_000]]) ** 2).sum(1), 0))
        order = np.lexsort((ball, d, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
        held = first[d[first] <= self.eps / 2]
        home[row[held]], r[row[held]] = ball[held], d[held]
        kept = (d <= 1.5 * self.eps + 1e-9) & (ball != home[row])
        return home, r, row[kept], ball[kept], d[kept], d[kept] <= self.eps / 2


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes of the edges (a, b).

    Up to EDGES links are joined by one task. More are contracted by large and small stars in turn: every node hands its
    larger, then its smaller neighbours to the least it knows, until every edge ends in a root. Each step is an aggregation
    and a join by node, written to the shared folder.
    """
    e, (n, _) = _written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if n <= EDGES:
        return e.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_join_links, "node string, root string")
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", "a", "b")
        e, sign = _written(small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges in the shared folder, and (number, sum of hashes) of them, counted as they are written."""
    seen = Observation()
    e = durable(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
    return e, (seen.get["n"], seen.get["h"])


def _join_links(t: pa.Table) -> pa.Table:
    names, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]).astype(str), return_inverse=True)
    root = np.arange(len(names))
    a, b = at[: t.num_rows], at[t.num_rows :]
    while True:
        # each link pulls the greater of its ends' roots to the lesser, then paths are halved
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return pa.table({"node": pa.array(names.tolist(), pa.string()), "root": pa.array(names[root].tolist(), pa.string())})


def _near_balls(placed: DataFrame, sizes: DataFrame, eps: float, dims: int) -> DataFrame:
    """(node, cell, ball, n): a cell that lies in a dense ball's margin and is near to n > 0 of its cells. A ball with very
    many cells, or very many in its margin, is dealt to tasks as parts of the one against parts of the other.

    ``sizes``: (ball, n, r), the cells of each dense ball and the greatest distance of them to its centre. A cell of the margin
    is only near to cells whose distance to the centre is at most ``eps`` less than its own.
    """
    slack = eps + 1e-5
    asking = placed.select("node", "cell_id", "x", F.explode("others").alias("o")).where("not o.inside").select("node", "cell_id", "x", "o.ball", "o.far")
    asking = asking.join(F.broadcast(sizes), "ball").where(F.col("far") <= F.col("r") + slack).drop("n", "r")
    asked = asking.groupBy("ball").agg(F.count(F.lit(1)).alias("n_asking"), F.min("far").alias("least"))
    held = placed.join(F.broadcast(asked.select(F.col("ball").alias("home"), "least")), "home").where(F.col("r") >= F.col("least") - slack).groupBy(F.col("home").alias("ball")).agg(F.count(F.lit(1)).alias("n_held"))
    asked = durable(asked.join(held, "ball").select("ball", "least", *[F.ceil(F.col(f"n_{c}") / MEMBERS).cast("int").alias(c) for c in ("asking", "held")]))  # at most one row per ball
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("cell_id"), F.col(n)).cast("int")
    members = placed.join(F.broadcast(asked.withColumnRenamed("ball", "home")), "home").where(F.col("r") >= F.col("least") - slack)
    members = members.select(F.col("home").alias("ball"), salt("held").alias("m"), spread("asking").alias("a"), F.lit(True).alias("member"), "cell_id", "node", "x")
    asking = asking.join(F.broadcast(asked), "ball").select("ball", spread("held").alias("m"), salt("asking").alias("a"), F.lit(False).alias("member"), "cell_id", "node", "x")

    def compare(t: pa.Table) -> pa.Table:
        u = unit(matrix(t["x"], dims)).astype(np.float32)
        member = t["member"].to_numpy(zero_copy_only=False)
        rows, cells = np.flatnonzero(~member), u[member]
        n = np.zeros(len(rows), np.int64)
        step = max(1, 4_000_000 // max(1, len(cells)))
        for s in range(0, len(rows), step):
            n[s : s + step] = (u[rows[s : s + step]] @ cells.T >= 1 - eps * eps / 2 - 1e-6).sum(1)
        hit = pa.array(rows[n > 0], pa.int64())
        return pa.table({"node": t["node"].take(hit), "cell": t["cell_id"].take(hit), "ball": t["ball"].take(hit), "n": pa.array(n[n > 0], pa.int64())})

    return members.unionByName(asking).groupBy("ball", "m", "a").applyInArrow(compare, "node string, cell string, ball int, n bigint")


def _margin_rule(eps: float):
    """A query looks into its nearest list; a cell is data of every list that may hold a query near to it: unless the
    plane half-way between the list's centroid and its own nearest is farther away than ``eps``."""

    def rule(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(x, graph.c)
        near = np.argmin(d, axis=1)
        query = np.zeros(d.shape, bool)
        query[np.arange(len(d)), near] = True
        return (d * d - d[np.arange(len(d)), near][:, None] ** 2 <= 2 * (eps + 1e-5) * graph.between[near] + 1e-9) | query, query

    return rule


class Keys:
    """Lists without centroids, for cells that lie alone: near cells share a name made of ``share`` dimensions.

    Of a unit vector the least coordinates are left out up to the length ``small``, the others are put in order, dimensions
    that few vectors have first. A prefix is as long as it takes that what is behind it, with the ``share`` - 1 largest in it,
    is too short for a product of the least similarity with any unit vector. So of two near vectors the prefixes have
    ``share`` dimensions in common: of both, no dimension up to the end of the shorter prefix is outside. Names are all
    choices of ``share`` dimensions of the prefix; a pair counts under the first it has in common. Vectors with too few
    dimensions for that, or with too many names, are short: they and what they meet have single dimensions as names.
    """

    def __init__(self, x: np.ndarray, similarity: float, share: int, small: float):
        self.floor, self.share, self.small = similarity - 3e-6, share, small
        self.order = np.argsort((self._large(x)[0] > 0).sum(0), kind="stable")
        self.dims = len(self.order)

    def _large(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squares of the coordinates that are not left out, and the length of what is."""
        v = u * u
        by = np.argsort(v, axis=1, kind="stable")
        rising = np.cumsum(np.take_along_axis(v, by, 1), 1)
        out = np.zeros(v.shape, bool)
        np.put_along_axis(out, by, rising <= self.small**2, 1)
        return np.where(out, 0, v), np.sqrt(np.where(out, v, 0).sum(1))

    def prefixes(self, u: np.ndarray, share: int) -> np.ndarray:
        """Per row and rank of a dimension, whether it is in the prefix; none of a short row's is."""
        w, out = self._large(u)
        w = w[:, self.order]
        behind = w.sum(1)[:, None] - np.cumsum(w, 1) + (share - 1) * np.maximum.accumulate(w, 1)
        end = np.sqrt(np.maximum(behind, 0)) + (out + self.small)[:, None] < self.floor
        inside = (np.arange(self.dims) <= np.argmax(end, 1)[:, None]) & (w > 0) & end.any(1)[:, None]
        if share > 1:
            most = next(p for p in itertools.count(share) if math.comb(p + 1, share) > NAMES)
            inside &= (inside.sum(1) <= most)[:, None]
        return inside

    def names(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, name), rows rising; a row that has none is short."""
        inside = self.prefixes(u, self.share)
        size = inside.sum(1)
        rows, names = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == p)
            ranks = np.nonzero(inside[own])[1].reshape(-1, p)
            picks = np.array(list(itertools.combinations(range(p), self.share)))
            name = np.zeros((len(own), len(picks)), np.int64)
            for k in range(self.share):
                name = name * self.dims + ranks[:, picks[:, k]]
            rows.append(np.repeat(own, len(picks)))
            names.append(name.ravel())
        row, name = np.concatenate(rows), np.concatenate(names)
        by = np.argsort(row, kind="stable")
        return row[by], name[by]

    def meet_first(self, u: np.ndarray, i: np.ndarray, j: np.ndarray, name: int) -> np.ndarray:
        """Of pairs of rows in the list ``name``, those that have no earlier name in common."""
        share, last = (1, (-name - 1) // 2) if name < 0 else (self.share, name % self.dims)
        some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        inside = self.prefixes(u[some], share)[:, : last + 1]
        out = np.empty(len(i), bool)
        for s in range(0, len(i), 100_000):
            out[s : s + 100_000] = (inside[at[: len(i)][s : s + 100_000]] & inside[at[len(i) :][s : s + 100_000]]).sum(1) == share
        return out


def _cheapest(rest: DataFrame, n: int, dims: int, balls: Balls) -> Keys | None:
    """How ``n`` cells meet with the least work, judged by a bounded sample: by names, or (None) in lists around centroids."""
    x = unit(bounded_sample(rest, "cell_id", "x", dims))
    if n <= LISTED or dims >= 4096:
        return None
    more = n / len(x)
    data, query = _margin_rule(balls.eps)(space._fit(x, n, BLOCK), x)
    least, best = more * ROW * data.sum() + more**2 * (data.sum(0) * query.sum(0)).sum(), None
    for share, small in itertools.product((1, 2, 3, 4), (0.02, 0.04, 0.06, 0.08)):
        if 4 * small >= balls.similarity:
            continue
        keys = Keys(x, balls.similarity, share, small)
        size = keys.prefixes(x, share).sum(1)
        if more * ROW * sum(math.comb(p, share) for p in size.tolist()) >= least:
            continue
        row, name = keys.names(x)
        held = np.unique(name, return_counts=True)[1].astype(float)
        cost = more * ROW * len(row) + more**2 * (held * held - held).sum()
        short = len(x) - len(np.unique(row))
        if short:
            one = keys.prefixes(x, 1).sum(0).astype(float)
            cost += more * ROW * 2 * one.sum() + 2 * more**2 * short / len(x) * (one * one).sum()
        if cost < least:
            least, best = cost, keys
    return best


def _named_lists(rest: DataFrame, keys: Keys, dims: int) -> DataFrame:
    """(cell_id, x, list, q, d, data, query, bucket): each cell in the lists of its names. Of a short cell's names there are two
    lists: one in which short cells look for all, one in which others look for short ones."""
    spark = rest.sparkSession
    kind = rest.schema["x"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(keys)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                p = b.slice(at, 1024)
                u = unit(matrix(p.column(1), dims))
                row, to = shared.value.names(u)
                n = np.bincount(row, minlength=p.num_rows)
                one, rank = np.nonzero(shared.value.prefixes(u, 1))
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(p.num_rows + 1)), pa.int32()), pa.array(v, pa.int64())) for r, v in ((row, to), (one, rank))]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), *lists, pa.array(n == 0)], ["k", "x", "names", "single", "short"])

    dealt = durable(rest.select(F.col("cell_id").alias("k"), "x").mapInArrow(name, f"k string, x {kind}, names array<bigint>, single array<bigint>, short boolean"))
    rows = dealt.select("k", "x", F.explode("names").alias("list"), F.lit(True).alias("data"), F.lit(True).alias("query"))
    singles = [r[0] for r in dealt.where("short").select(F.explode("single").alias("r")).distinct().collect()]  # at most one per dimension
    if singles:
        one = dealt.select("k", "x", "short", F.explode("single").alias("r")).where(F.col("r").isin(singles))
        rows = rows.unionByName(one.select("k", "x", (-2 * F.col("r") - 1).alias("list"), F.lit(True).alias("data"), F.col("short").alias("query")))
        rows = rows.unionByName(one.select("k", "x", (-2 * F.col("r") - 2).alias("list"), F.col("short").alias("data"), (~F.col("short")).alias("query")))
    held = durable(rows.groupBy("list").agg(F.count_if("data").alias("n_data"), F.count_if("query").alias("n_query"), F.count(F.lit(1)).alias("n")))
    # a cell that is alone under a name meets nobody there
    total = held.where("n > 1").agg(F.sum("n")).first()[0] or 0
    rows = rows.join(held.where("n > 1").select("list"), "list", "left_semi")
    heavy = held.where(f"n_data > {space.TASK_ROWS} or n_query > {space.TASK_ROWS}").drop("n")
    rows = dealt_parts(rows, None if heavy.isEmpty() else heavy).withColumnRenamed("k", "cell_id")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("list", "q", "d"), F.lit(max(1, math.ceil(total / (2 * BLOCK))))))


def _each_run(lists: DataFrame, work: Callable[[pa.Table, int], pa.Table], schema: str) -> DataFrame:
    """``work(rows, list)`` on each group of equal (list, q, d); where there is a column ``bucket``, a task takes all groups of one."""
    if "bucket" not in lists.columns:
        return lists.groupBy("list", "q", "d").applyInArrow(lambda t: work(t, t["list"][0].as_py()), schema)

    def all_runs(t: pa.Table) -> pa.Table:
        t = t.sort_by([("list", "ascending"), ("q", "ascending"), ("d", "ascending")]).combine_chunks()
        by = np.stack([t[c].to_numpy() for c in ("list", "q", "d")])
        ends = np.flatnonzero(np.r_[True, (by[:, 1:] != by[:, :-1]).any(0), True])
        return pa.concat_tables([work(t.slice(i, j - i), int(by[0, i])) for i, j in zip(ends[:-1], ends[1:], strict=True) if j - i > 1] or [work(t.slice(0, 0), 0)])

    return lists.groupBy("bucket").applyInArrow(all_runs, schema)


def _near_counts(lists: DataFrame, eps: float, dims: int, keys: Keys | None = None) -> DataFrame:
    """(cell, n): how many cells of the lists, itself included, are near to each. With ``keys``, pairs that meet in several
    lists count in one, and cells are not counted as near to themselves."""

    def count(t: pa.Table, name: int) -> pa.Table:
        u = unit(matrix(t["x"], dims))
        low = u.astype(np.float32)
        data, query = (np.flatnonzero(t[c].to_numpy(zero_copy_only=False)) for c in ("data", "query"))
        n = np.zeros(len(query), np.int64)
        for s in range(0, len(query), 1024):
            near = low[query[s : s + 1024]] @ low[data].T >= 1 - eps * eps / 2 - 1e-6
            if keys is None:
                n[s : s + 1024] = near.sum(1)
                continue
            i, j = np.nonzero(near)
            i, j = query[s + i], data[j]
            i, j = i[i != j], j[i != j]
            if len(i):
                np.add.at(n, np.searchsorted(query, i[keys.meet_first(u, i, j, name)]), 1)
        some = np.flatnonzero(n > 0) if keys is not None else np.arange(len(n))
        return pa.table({"cell": t["cell_id"].take(pa.array(query[some], pa.int64())), "n": pa.array(n[some], pa.int64())})

    return _each_run(lists, count, "cell string, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _local_clusters(lists: DataFrame, cores: DataFrame, eps: float, dims: int) -> DataFrame:
    """(a, b, core): in each list, cores tied to their local cluster by as few links as it takes, and a cell that is no core
    tied to the least core it is near to.

    ``cores``: (cell, core BOOLEAN); a cell that is not in it is near to none.
    """
    known = lists.join(cores.withColumnRenamed("cell", "cell_id"), "cell_id")

    def tie(t: pa.Table, name: int) -> pa.Table:
        t = t.sort_by("cell_id")
        u = unit(matrix(t["x"], dims)).astype(np.float32)
        data, query, core = (t[c].to_numpy(zero_copy_only=False) for c in ("data", "query", "core"))
        to = np.flatnonzero(data & core)
        group = np.arange(len(u))
        a, b, kept = [], [], []
        asking = np.flatnonzero(query)
        for s in range(0, len(asking), 1024):
            near = u[asking[s : s + 1024]] @ u[to].T >= 1 - eps * eps / 2 - 1e-6
            for i, row in zip(asking[s : s + 1024].tolist(), near, strict=True):
                hit = to[np.flatnonzero(row)]
                if core[i]:
                    # a cell is tied to those it is near to that are not yet in its group
                    hit = hit[group[hit] != group[i]]
                    group[hit] = group[i]
                else:
                    hit = hit[:1]
                a += [i] * len(hit)
                b += hit.tolist()
                kept += [bool(core[i])] * len(hit)
        c = t["cell_id"]
        return pa.table({"a": c.take(pa.array(a, pa.int64())), "b": c.take(pa.array(b, pa.int64())), "core": pa.array(kept, pa.bool_())})

    return _each_run(known, tie, "a string, b string, core boolean")


def similarity_groups(cells: DataFrame, similarity: float = 0.85, key: str = "cell_id", counts: str = "x", least: int = CORE) -> DataFrame:
    """(cell_id, node, root, x): every distinct cell with counts, and its cluster's root; a cell in no cluster is its own.

    ``cells``: (cell_id STRING, x ARRAY of numbers); ``least``: near cells, itself included, that make a core. A repeated
    cell counts once, with its smallest vector. Null ids and null vectors are left out; nulls inside a vector count as 0; a
    vector of zeros is similar to none and left out. A cell that is no core, near to cores of several clusters, joins one.
    """
    spark = cells.sparkSession
    c = cells.where(F.col(key).isNotNull() & F.col(counts).isNotNull()).groupBy(F.col(key).alias("cell_id")).agg(F.min(counts).alias("x"))
    c = durable(c.where(F.exists("x", lambda e: F.coalesce(e, F.lit(0)) != 0)))
    n, dims, kind = measured(c, "x")
    kind = f"array<{kind}>"
    if not n:
        return spark.createDataFrame([], f"cell_id string, node string, root string, x {kind}")
    c = c.withColumn("x", F.col("x").cast(kind))
    balls = Balls(unit(bounded_sample(c, "cell_id", "x", dims, max(SAMPLE, min(10 * SAMPLE, n // SHARE)))), similarity)
    shared = spark.sparkContext.broadcast(balls)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                home, r, row, ball, far, inside = shared.value.place(unit(matrix(p.column(1), dims)))
                ends = pa.array(np.searchsorted(row, np.arange(p.num_rows + 1)), pa.int32())
                by = np.argsort(row, kind="stable")
                others = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(ball[by], pa.int32()), pa.array(far[by]), pa.array(inside[by])], ["ball", "far", "inside"]))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(home, pa.int32()), pa.array(r), others], ["cell_id", "x", "home", "r", "others"])

    placed = durable(c.mapInArrow(place, f"cell_id string, x {kind}, home int, r double, others array<struct<ball:int,far:double,inside:boolean>>"))
    sizes = durable(placed.where("home >= 0").groupBy(F.col("home").alias("ball")).agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).where(F.col("n") >= least))  # at most one row per ball
    rest = n - (sizes.agg(F.sum("n")).first()[0] or 0)
    ball = lambda b: F.concat(F.lit("b"), b.cast("string"))
    dense = sizes.select(F.col("ball").alias("home"), F.lit(True).alias("dense"))
    placed = placed.join(F.broadcast(dense), "home", "left").withColumn("node", F.when(F.col("dense"), ball(F.col("home"))).otherwise(F.concat(F.lit("c"), "cell_id"))).drop("dense")
    # a cell inside a ball is near to all its cells; one in its margin is compared
    inside = placed.select("node", F.col("cell_id").alias("cell"), F.explode("others").alias("o")).where("o.inside").select("node", "cell", "o.ball").join(F.broadcast(sizes), "ball").select("node", "cell", "ball", "n")
    near = durable(inside.unionByName(_near_balls(placed, sizes, balls.eps, dims)))
    merge = near.where(F.col("node").startswith("b")).select(F.col("node").alias("a"), ball(F.col("ball")).alias("b")).distinct()
    border = None
    if rest:
        alone = placed.where(F.col("node").startswith("c")).select("cell_id", "x")
        keys = _cheapest(alone, rest, dims, balls)
        lists = posting_lists(alone, "cell_id", "x", dims, rest, _margin_rule(balls.eps), BLOCK) if keys is None else _named_lists(alone, keys, dims)
        counted = _near_counts(lists, balls.eps, dims, keys).unionByName(near.where(F.col("node").startswith("c")).select("cell", "n"))
        if keys is not None:
            counted = counted.unionByName(alone.select(F.col("cell_id").alias("cell"), F.lit(1).cast("bigint").alias("n")))
        counted = counted.groupBy("cell").agg(F.sum("n").alias("n"))
        cores = durable(counted.where("n > 1").select("cell", (F.col("n") >= least).alias("core")))
        local = durable(_local_clusters(lists, cores, balls.eps, dims))
        to_ball = near.where(F.col("node").startswith("c")).join(cores, "cell").select(F.col("node").alias("a"), ball(F.col("ball")).alias("b"), "core").distinct()
        named = local.select(F.concat(F.lit("c"), "a").alias("a"), F.concat(F.lit("c"), "b").alias("b"), "core").unionByName(to_ball)
        merge = merge.unionByName(named.where("core").select("a", "b"))
        border = named.where("not core").groupBy("a").agg(F.min("b").alias("b"))
    roots = components(merge)
    if border is not None:
        joined = border.join(roots.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root"))
        roots = roots.unionByName(joined)
    return placed.select("cell_id", "node", "x").join(roots, "node", "left").select("cell_id", "node", F.coalesce("root", "node").alias("root"), "x")


def group_members(groups: DataFrame, least: int = 3) -> DataFrame:
    """(cell_id, first_cell_id) of the cells in groups of at least ``least`` cells."""
    named = groups.groupBy("root").agg(F.min("cell_id").alias("first_cell_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return groups.select("cell_id", "root").join(named, "root").select("cell_id", "first_cell_id")


def describe_groups(groups: DataFrame, least: int = 3, typical: int = 3) -> DataFrame:
    """(first_cell_id, n_cells, place, cell_id, similarity): each group's size and its most typical cells.

    Typical are the cells most similar to the group's mean direction, ties by id. The means are summed per task, then
    per group, and joined back by group; nothing gathers a group's cells.
    """
    g = durable(groups.select("cell_id", "root", "x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + F.coalesce(e, F.lit(0.0)) ** 2))
    u = g.withColumn("l", length).select("cell_id", "root", F.expr("transform(x, e -> coalesce(e, 0D) / l)").alias("u"))
    sums = u.select("root", F.posexplode("u").alias("d", "v")).where("v <> 0").groupBy("root", "d").agg(F.sum("v").alias("v"))
    mean = sums.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") ** 2)).alias("ml"))
    named = g.groupBy("root").agg(F.min("cell_id").alias("first_cell_id"), F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= least)
    mean = named.join(mean, "root").select("root", "first_cell_id", "n_cells", "ml", F.expr("transform(sequence(0, array_max(map_keys(m))), i -> coalesce(try_element_at(m, i), 0D))").alias("m"))
    sim = u.join(mean, "root").select("first_cell_id", "n_cells", "cell_id", F.expr("round(aggregate(zip_with(u, m, (a, b) -> coalesce(a, 0D) * coalesce(b, 0D)), 0D, (s, e) -> s + e) / ml, 9)").alias("similarity"))
    w = Window.partitionBy("first_cell_id").orderBy(F.desc("similarity"), "cell_id")
    return sim.withColumn("place", F.row_number().over(w)).where(F.col("place") <= typical).select("first_cell_id", "n_cells", "place", "cell_id", "similarity")
