"""Names by which lone vectors meet, against brute force."""

import numpy as np
import pytest

from spotloom.llm import clusters, space
from tests.llm.test_numbers import density_by_force


@pytest.mark.parametrize("share,small,task_rows", [(1, 0.02, 16_384), (2, 0.06, 20), (3, 0.08, 16_384), (4, 0.04, 20)])
def test_named_lists_find_all_near_cells(spark, monkeypatch, share, small, task_rows):
    """Clouds, pairs and lone cells, some with one or two dimensions only or with very many names."""
    monkeypatch.setattr(clusters, "SAMPLE", 2)
    monkeypatch.setattr(space, "TASK_ROWS", task_rows)
    monkeypatch.setattr(clusters, "NAMES", 500)
    monkeypatch.setattr(clusters, "_cheapest", lambda rest, n, dims, balls: clusters.Keys(space.unit(space.bounded_sample(rest, "cell_id", "x", dims)), balls.similarity, share, small))
    rng = np.random.default_rng(21)
    x = [c * rng.lognormal(0, s, (n, 40)) for c, s, n in zip(rng.gamma(0.25, 1, (20, 40)), rng.uniform(0.1, 0.6, 20), rng.integers(1, 20, 20), strict=True)]
    single = np.zeros((6, 40))
    single[[0, 1, 2, 3, 4, 5], [3, 3, 3, 7, 7, 9]] = 5
    single[1, 4] = single[5, 8] = 2
    x = np.concatenate([*x, single, -single, rng.gamma(0.1, 1, (80, 40)) + 1e-3, rng.uniform(0.5, 1, (4, 40))])
    rows = [(f"c{i:04d}", v.tolist()) for i, v in enumerate(x)]
    got = {r.cell_id: r.root for r in clusters.similarity_groups(spark.createDataFrame(rows, "cell_id string, x array<double>")).collect()}
    want, may = density_by_force(rows)
    assert len(want) > 3
    root = [{got[c] for c in own} for own in want]
    assert all(len(r) == 1 for r in root) and len(set.union(*root)) == len(want)
    for c, ks in may.items():
        assert got[c] in set().union(*[root[k] for k in ks]) if ks else sum(v == got[c] for v in got.values()) == 1


def test_lone_cells_do_not_meet_all_others(spark):
    """Of 20,000 cells with ten dimensions each that are near to no other, few meet."""
    rng = np.random.default_rng(5)
    x = np.zeros((20_000, 130))
    np.put_along_axis(x, np.argsort(rng.random(x.shape), 1)[:, :10], 100, 1)
    rows = [(f"c{i:05d}", v.tolist()) for i, v in enumerate(np.asarray(x + rng.poisson(0.1, x.shape), int))]
    cells = spark.createDataFrame(rows, "cell_id string, x array<int>")
    balls = clusters.Balls(space.unit(x[:500]), 0.85)
    keys = clusters._cheapest(cells, len(rows), 130, balls)
    lists = clusters._named_lists(cells, keys, 130)
    meet = lists.groupBy("list").count().selectExpr("sum(count * count)").first()[0]
    assert meet < len(rows) ** 2 / 4
    assert clusters.group_members(clusters.similarity_groups(cells)).count() == 0
