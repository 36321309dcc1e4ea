import math
import random

import numpy as np
import pytest

from spotloom.llm import clusters, sketch, space, vectors


# percentiles


def exact(values, q):
    v = sorted(values)
    return v[max(0, math.ceil(len(v) * q - 1e-9) - 1)]


def test_percentiles_are_within_the_error_and_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [(str(g), d, float(x)) for g in range(3) for d in range(2) for x in rng.normal(0, 10.0 ** rng.integers(-2, 5), 500)]
    rows += [("z", 0, 0.0), ("z", 0, 1e-12), ("z", 0, None), ("z", 0, float("nan")), ("z", 0, float("inf")), (None, 0, 4.0), ("t", 0, 7.0), ("t", 1, 7.0), ("e", 0, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    daily = sketch.build_sketch(df, ["g", "day"], "v")
    shares = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): (r.value, r.n) for r in sketch.percentiles(sketch.merge_sketches(daily, ["g"]), ["g"], shares).collect()}
    assert {g for g, _ in got} == {"0", "1", "2", "z", None, "t"}
    for (g, q), (value, n) in got.items():
        own = [v for h, _, v in rows if h == g and v is not None and math.isfinite(v)]
        assert n == len(own)
        want = exact(own, q)
        assert abs(value - want) <= sketch.ERROR * 1.001 * abs(want) + sketch.TINY
    once = {(r.g, r.share): r.value for r in sketch.percentiles(sketch.build_sketch(df.repartition(7), ["g"], "v"), ["g"], shares).collect()}
    assert once == {k: v[0] for k, v in got.items()}
    assert sketch.percentiles(sketch.build_sketch(df.limit(0), ["g"], "v"), ["g"], shares).count() == 0


def test_infinite_values_count(spark, tmp_path):
    from spotloom.llm import queries

    inf = float("inf")
    at = "timestamp'2024-05-01 10:00:00'"
    area = [("a", v) for v in (1.0, 2.0, inf, inf, inf)] + [("b", v) for v in (1.0, 2.0, 3.0, inf, -inf, float("nan"))]
    score = [("a", 0.1)] * 9 + [("b", 0.1)] * 8 + [("b", inf)] * 2 + [("a", -inf)]
    for name, column, day, rows in (("cell_metadata", "nuclei_area_um", "segmented_at", area), ("transcript_table", "confidence_score", "recorded_at", score)):
        spark.createDataFrame(rows, f"sample_id string, {column} double").selectExpr("*", f"{at} as {day}").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert got == {("cell_metadata", "a", "2024-05-01"), ("transcript_table", "a", "2024-05-01")}
    df = spark.createDataFrame([("g", v) for v in (-inf, 1.0, inf)], "g string, v double")
    p = {r.share: r.value for r in sketch.percentiles(sketch.build_sketch(df, ["g"], "v", infinite=True), ["g"], [0.0, 1.0]).collect()}
    assert p == {0.0: -inf, 1.0: inf}


# nearest vectors


def table(spark, m, labels=None):
    rows = [(labels[i] if labels else f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "label string, vector array<double>")


def brute(m, labels, k, least=-2.0):
    n = np.linalg.norm(m, axis=1)
    u = m / np.maximum(n, 1e-300)[:, None]
    s = np.round(u @ u.T, 9)
    out = set()
    for i in range(len(m)):
        if n[i]:
            own = [(s[i, j], labels[j]) for j in range(len(m)) if j != i and n[j]]
            out |= {(labels[i], b) for x, b in own if x >= least and sum(y > x for y, _ in own) < k}
    return out


def clumps(seed, n=600, dims=24):
    rng = np.random.default_rng(seed)
    c = rng.gamma(0.3, 10, (12, dims))
    m = rng.poisson(c[rng.integers(0, 12, n)] * 20).astype(float)
    m[50] = 0
    m[60:64] = m[59]
    m[70] = m[69] * 3
    m[80] = m[79] + np.r_[0.01, np.zeros(dims - 1)]
    return m


def small_lists(monkeypatch, size, centroids=1024, task_rows=16_384, sample=8192):
    for name, v in (("CENTROIDS", centroids), ("TASK_ROWS", task_rows), ("SAMPLE", sample)):
        monkeypatch.setattr(space, name, v)
    monkeypatch.setattr(vectors, "LIST", size)


@pytest.mark.parametrize("size,centroids,task_rows", [(2048, 1024, 16_384), (20, 1024, 16_384), (40, 1024, 7), (10, 4, 16_384), (10, 3, 9)])
def test_close_vectors_are_all_found(spark, monkeypatch, size, centroids, task_rows):
    """Also with many small lists, with lists dealt to several tasks, and with lists cut again."""
    small_lists(monkeypatch, size, centroids, task_rows)
    m = clumps(2)
    labels = [f"v{i:04d}" for i in range(len(m))]
    for least in (0.9995, 0.99):
        got = [(r.label_a, r.label_b) for r in vectors.nearest_vectors(table(spark, m), 3, least, probes=0.04).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(m, labels, 3, least)


def far_copies(seed=12, rows=200):
    """Vectors of 16 gene-permuted copies, which are far from each other, and 960 centroids of them."""
    rng = np.random.default_rng(seed)
    main = rng.gamma(0.3, 1, 130)
    one = main * rng.lognormal(0, 1, (60, 130))
    genes = [rng.permutation(130) for _ in range(16)]
    c = space.unit(np.concatenate([one[:, g] for g in genes]))
    x = space.unit(np.concatenate([(one[rng.integers(0, 60, rows)] * rng.lognormal(0, 1, (rows, 130)))[:, g] for g in genes]))
    return c, x, rng


def test_close_vectors_share_a_list_with_many_centroids():
    c, x, rng = far_copies()
    y = space.unit(x * rng.lognormal(0, 0.02, x.shape))
    graph, radius = space.CentroidGraph(c), math.sqrt(2 - 2 * 0.9995) + 1e-6
    rule = vectors.ratio_rule(0.04, 0.04, 2 * radius)
    (post, look), (post_y, look_y) = rule(graph, x), rule(graph, y)
    close = np.flatnonzero((x * y).sum(1) >= 0.9995)
    assert len(close) > 1000 and (look & post_y)[close].any(1).all() and (look_y & post)[close].any(1).all()
    assert look.sum(1).mean() < 100  # of 960: most are ruled out


def test_close_pairs_against_brute_force_with_many_centroids(spark, monkeypatch):
    small_lists(monkeypatch, 10)
    rng = np.random.default_rng(13)
    base = np.kron(np.eye(24), rng.gamma(0.5, 40, (1, 5)))[rng.integers(0, 24, 700)]
    m = np.repeat(rng.poisson(base + rng.gamma(0.3, 2, base.shape)) + 0.0, 2, 0)
    m[1::2] *= 3
    m[1::2, 0] += rng.integers(0, 3, 700)
    labels = [f"v{i:04d}" for i in range(len(m))]
    got = {(r.label_a, r.label_b) for r in vectors.nearest_vectors(table(spark, m), 3, 0.9995).collect()}
    assert got == brute(m, labels, 3, 0.9995)


@pytest.mark.parametrize("size,centroids,sample", [(40, 1024, 8192), (40, 3, 8192), (40, 3, 100)])
def test_lists_hold_every_vector(spark, monkeypatch, size, centroids, sample):
    """Every vector is data and query of some list, cut again or not; lists then follow the number of vectors."""
    small_lists(monkeypatch, size, centroids, sample=sample)
    m = clumps(4)
    m[50] = 1
    rows = space.posting_lists(table(spark, m), "label", "vector", m.shape[1], len(m), vectors.ratio_rule(0.04, 0.1), size).collect()
    for flag in ("data", "query"):
        assert {r["label"] for r in rows if r[flag]} == {f"v{i:04d}" for i in range(len(m))}
    per_list = {}
    for r in rows:
        per_list.setdefault(r["list"], []).append(r["label"])
    assert max(map(len, per_list.values())) < 0.6 * len(m) and len(per_list) > 6


def test_alike_vectors_are_dealt_to_tasks(spark, monkeypatch):
    """A third of all vectors are one, so no centroid cuts their list; its queries meet all its data in parts."""
    small_lists(monkeypatch, 40, task_rows=25)
    m = clumps(6, 300)
    m[100:200] = m[100]
    rows = space.posting_lists(table(spark, m), "label", "vector", m.shape[1], len(m), vectors.ratio_rule(0.04, 0.1), 40).collect()
    per_task = {}
    for r in rows:
        t = per_task.setdefault((r["list"], r["q"], r["d"]), [[], []])
        for i, flag in enumerate(("data", "query")):
            if r[flag]:
                t[i].append(r["label"])
    assert max(len(t[0]) for t in per_task.values()) < 80 and max(len(t[1]) for t in per_task.values()) < 80
    hot = {f"v{i:04d}" for i in range(100, 200)}
    met = {(a, b) for d, q in per_task.values() for a in q if a in hot for b in d if b in hot}
    assert len(met) == 100 * 100


@pytest.mark.parametrize("centroids", [1024, 4])
def test_recall_without_a_radius(spark, monkeypatch, centroids):
    small_lists(monkeypatch, 40, centroids)
    m = clumps(3)
    labels = [f"v{i:04d}" for i in range(len(m))]
    want = brute(m, labels, 3)
    got = {(r.label_a, r.label_b) for r in vectors.nearest_vectors(table(spark, m)).collect()}
    assert len(got & want) / len(want) >= 0.95


def test_graph_finds_nearest_centroids():
    rng = np.random.default_rng(5)
    for c, x in ((space.unit(rng.normal(size=(500, 16))), space.unit(rng.normal(size=(300, 16)))), far_copies()[:2]):
        graph, true = space.CentroidGraph(c), space.distances(x, c)
        met = graph.nearest(x)
        assert np.mean(met.min(1) <= 1.2 * true.min(1)) >= 0.9 and np.isfinite(met).mean() < 0.5
        d = graph.within(x, lambda least: 1.2 * least)
        near = true <= 1.2 * true.min(1)[:, None]
        assert (np.isfinite(d) == near).all() and np.allclose(d[near], true[near])
    one = space.CentroidGraph(c[:1])
    assert one.within(x, lambda least: least).shape == (len(x), 1)


def test_odd_vectors(spark):
    rows = [("a", [1.0, 2.0, None]), ("a", [1.0, 2.0, None]), ("b", [2.0, 4.0, 0.0]), ("c", [float("nan"), 0.0, 0.0]), ("d", None), (None, [1.0, 1.0, 1.0]), ("e", [0.0, 0.0, 0.0]), ("f", [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "label string, vector array<double>, list int")
    got = {tuple(r) for r in vectors.nearest_vectors(df, 3, 0.9).collect()}
    assert got == {(a, b, 1.0) for a in "abf" for b in "abf" if a != b}
    assert vectors.nearest_vectors(df.limit(0)).count() == 0
    assert vectors.nearest_vectors(df.where("label = 'a'"), 3, 0.9).count() == 0


# clusters


def profiles(seed, sizes, dims=60):
    """Groups on their own genes, so that all pairs within are similar and none between are."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(sizes):
        mean = np.full(dims, 0.2)
        mean[(np.arange(5) + 5 * g) % dims] = 60
        for _ in range(n):
            rows.append((f"c{len(rows):05d}", rng.poisson(mean * rng.uniform(0.6, 2)).tolist(), g))
    rng.shuffle(rows)
    return [(a, b, int(g)) for a, b, g in rows]


def expected(rows, least=3):
    by = {}
    for a, _, g in rows:
        by.setdefault(g, set()).add(a)
    return {(a, min(by[g])) for a, _, g in rows if len(by[g]) >= least}


@pytest.mark.parametrize("sample,members", [(6000, 20_000), (40, 50), (2, 20_000)])
def test_groups(spark, monkeypatch, sample, members):
    """Also with a sample that sees few of the groups, and with balls dealt to several tasks."""
    monkeypatch.setattr(clusters, "SAMPLE", sample)
    monkeypatch.setattr(clusters, "MEMBERS", members)
    rows = profiles(1, [400, 120, 60, 30, 10, 5, 3, 2, 1, 1])
    df = spark.createDataFrame(rows, "cell_id string, x array<int>, root int")
    assert {tuple(r) for r in clusters.group_members(clusters.similarity_groups(df)).collect()} == expected(rows)


def test_groups_of_odd_rows(spark):
    rows = profiles(2, [6, 3])
    odd = [("null", None, 0), (None, [1] * 60, 0), ("zero", [0] * 60, 0), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, "cell_id string, x array<int>, node int")
    groups = clusters.similarity_groups(df)
    assert {tuple(r) for r in clusters.group_members(groups).collect()} == expected(rows)
    d = clusters.describe_groups(groups).collect()
    assert {(r.n_cells, r.place) for r in d} == {(n, p) for n in (6, 3) for p in (1, 2, 3)} and all(0.85 < r.similarity <= 1 for r in d)
    assert clusters.similarity_groups(df.limit(0)).count() == 0


def test_links_reach_across_balls(spark):
    """A chain of cells, each near the next: one cluster, whatever its length."""
    t = np.linspace(0, 1.5, 60)
    rows = [(f"c{i:03d}", [1000 * math.cos(a), 1000 * math.sin(a), 1.0]) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "cell_id string, x array<double>")
    assert {r.first_cell_id for r in clusters.group_members(clusters.similarity_groups(df)).collect()} == {"c000"}


def density_by_force(rows, similarity=0.85, least=3):
    """(clusters of cores, cell -> the clusters that it may join)."""
    u = space.unit(np.array([x for _, x in rows], float)).astype(np.float32)
    near = u @ u.T >= similarity - 1e-6
    core = near.sum(1) >= least
    left, out, may = set(np.flatnonzero(core).tolist()), [], {}
    while left:
        own, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            own.add(i)
            new = set(np.flatnonzero(near[i] & core).tolist()) & left
            left -= new
            todo += new
        out.append(own)
    for i in np.flatnonzero(~core).tolist():
        may[rows[i][0]] = {k for k, own in enumerate(out) if any(near[i, j] for j in own)}
    return [{rows[i][0] for i in own} for own in out], may


@pytest.mark.parametrize("sample,members,block,centroids,task_rows", [(6000, 20_000, 4096, 1024, 16_384), (2, 20_000, 4096, 1024, 16_384), (60, 15, 40, 1024, 16_384), (2, 20_000, 30, 3, 16_384), (30, 20_000, 30, 1024, 20)])
def test_density_clusters_against_brute_force(spark, monkeypatch, sample, members, block, centroids, task_rows):
    """Clouds that run into each other, bridges, pairs and lone cells; with and without balls, many lists, lists cut again and
    dealt to tasks."""
    for where, name, v in ((clusters, "SAMPLE", sample), (clusters, "MEMBERS", members), (clusters, "BLOCK", block), (space, "CENTROIDS", centroids), (space, "TASK_ROWS", task_rows)):
        monkeypatch.setattr(where, name, v)
    rng = np.random.default_rng(21)
    centres = rng.gamma(0.4, 1, (25, 40))
    x = np.concatenate([c * rng.lognormal(0, s, (n, 40)) for c, s, n in zip(centres, rng.uniform(0.1, 0.9, 25), rng.integers(1, 60, 25), strict=True)])
    rows = [(f"c{i:04d}", v.tolist()) for i, v in enumerate(x)]
    got = {r.cell_id: r.root for r in clusters.similarity_groups(spark.createDataFrame(rows, "cell_id string, x array<double>")).collect()}
    want, may = density_by_force(rows)
    assert len(want) > 3 and sum(bool(v) for v in may.values()) > 5
    root = [{got[c] for c in own} for own in want]
    assert all(len(r) == 1 for r in root) and len(set.union(*root)) == len(want)
    for c, ks in may.items():
        assert got[c] in set().union(*[root[k] for k in ks]) if ks else got[c] == f"c{c}" or sum(v == got[c] for v in got.values()) == 1


@pytest.mark.parametrize("edges_of_one_task", [0, 500_000])
def test_components(spark, monkeypatch, edges_of_one_task):
    monkeypatch.setattr(clusters, "EDGES", edges_of_one_task)
    rng = random.Random(6)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"m{rng.randrange(50)}", f"m{rng.randrange(50)}") for _ in range(45)] + [("hub", f"s{i}") for i in range(300)] + [("x", "x")]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in clusters.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in list(root)}
    assert clusters.components(spark.createDataFrame([("x", "x")], "a string, b string")).count() == 0


@pytest.mark.parametrize("block", [4096, 300])
def test_loose_triples_outside_all_balls_are_found(spark, monkeypatch, block):
    """Triples at a cosine just over the least, which no sampled ball holds; also in many lists."""
    monkeypatch.setattr(clusters, "SAMPLE", 2)
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(1000):
        base, v, w = np.linalg.qr(rng.standard_normal((130, 3)))[0].T
        side = math.sqrt(1 - 0.851**2)
        rows += [(f"c{g:04d}-{i}", x.tolist()) for i, x in enumerate((base, 0.851 * base + side * v, 0.851 * base + side * w))]
    df = spark.createDataFrame(rows, "cell_id string, x array<double>")
    got = {tuple(r) for r in clusters.group_members(clusters.similarity_groups(df)).collect()}
    assert got == {(c, f"{c[:5]}-0") for c, _ in rows}
