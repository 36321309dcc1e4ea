"""The general data problems on small made-up tables."""

import datetime as dt
import json
import random

import numpy as np
import pytest

from spotloom.operators import drift, nearby, orphans
from spotloom.plans import problems

T0 = dt.datetime(2024, 3, 1)
H = dt.timedelta(hours=1)
REFS = "ref_table string, ref_row bigint, key string, at timestamp_ntz, words string"
PARENTS = "key string, since timestamp_ntz, until timestamp_ntz, block int"


def found(spark, refs, parents):
    r = spark.createDataFrame([("t", i, *x, "extra") for i, x in enumerate(refs)], REFS)
    p = spark.createDataFrame([(*x, 1) for x in parents], PARENTS)
    return {x.ref_row: x.reason for x in orphans.orphan_references(r, p).collect()}


@pytest.mark.parametrize("rows", [20_000, 0])
def test_reasons(spark, monkeypatch, rows):
    """By either kind of exact join."""
    monkeypatch.setattr(orphans, "BROADCAST_ROWS", rows)
    parents = [("A", T0, None), ("B", T0, T0 + 5 * H), ("b ", T0 + 5 * H, T0 + 9 * H), ("C", T0 + 3 * H, None), ("D", T0, T0 + H), ("D", T0 + 4 * H, None), (None, T0, None), ("E", None, None), ("A", T0, None)]
    refs = [(" a\t", T0), ("x", T0), (None, T0), ("undetermined ", T0), ("B", T0 + 7 * H), ("B", T0 + 9 * H), ("c", T0), ("d", T0 + 2 * H), ("D", T0 + 4 * H), ("a", T0 - H), ("", T0), ("A", None), ("e", T0), ("C", T0 + 3 * H)]
    assert found(spark, refs, parents) == {1: "missing", 5: "deleted", 6: "late", 7: "deleted", 9: "late", 10: "missing", 11: "deleted", 12: "deleted"}


def test_no_parents_and_no_references(spark):
    assert found(spark, [("a", T0), (None, T0)], []) == {0: "missing"}
    assert found(spark, [], [("a", T0, None)]) == {}


def test_filter_never_denies_a_parent(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(orphans, "MAX_BLOCKS", 2)  # more blocks than are broadcast: the filter stays distributed
    monkeypatch.setattr(orphans, "BROADCAST_ROWS", 0)
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    b = orphans.bloom_filter(df, "key", 8)
    got = df.withColumn("block", orphans._block(F.col("key"), 8)).join(b, "block", "left").select(F.bool_and(orphans.might_contain(F.col("words"), F.col("key")))).first()[0]
    assert got
    refs = [(rng.choice(keys) if i % 3 else f"x{i}", T0 + H) for i in range(500)]
    want = {i: "missing" for i in range(0, 500, 3)}
    assert found(spark, refs, [(k, T0, None) for k in keys]) == want


def test_a_third_of_references_to_one_key(spark):
    refs = [("hot", T0 + i * H) for i in range(400)] + [(f"k{i}", T0) for i in range(800)]
    parents = [("hot", T0 + 2 * i * H, T0 + (2 * i + 1) * H) for i in range(200)] + [(f"K{i} ", T0 - H, None) for i in range(800)]
    assert found(spark, refs, parents) == {i: "deleted" for i in range(1, 400, 2)}


# points


def polygon_oracle(px, py, ring):
    inside = False
    n = len(ring) // 2
    for i in range(n):
        x0, y0, x1, y1 = *ring[2 * i : 2 * i + 2], *ring[2 * ((i + 1) % n) : 2 * ((i + 1) % n) + 2]
        if (y0 > py) != (y1 > py) and px < (x1 - x0) * (py - y0) / (y1 - y0) + x0:
            inside = not inside
    return inside


def nearby_oracle(points, rings, r):
    ok = [p for p in points if p[0] is not None and None not in p[2:4] and all(v >= 0 and np.isfinite(v) for v in p[2:4])]
    out = set()
    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if a[0] == b[0] and a[4] != b[4] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= r * r:
                out.add(("near", min(a[1], b[1]), max(a[1], b[1])))
        held = min((lab for s, lab, ring in rings if s == a[0] and ring and len(ring) >= 6 and None not in ring and polygon_oracle(a[2], a[3], ring)), default=0)
        if a[5] is not None and a[5] != held:
            out.add(("region", a[1], held))
    return out


def made_up_points(rng, n, side, crowd=0):
    pts = []
    for i in range(n):
        x, y = (rng.uniform(0, side) for _ in "xy")
        if rng.random() < 0.3:
            x, y = 256 + rng.uniform(-3, 3), rng.uniform(0, side)  # along the border of a tile
        pts.append((rng.choice("ab"), i, x, y, f"o{rng.randint(0, n)}", rng.choice([None, 0, 1, 2])))
    pts += [("a", n + i, 30 + rng.uniform(0, 20), 30 + rng.uniform(0, 20), f"c{i}", 1) for i in range(crowd)]
    k = len(pts)
    pts += [("a", k, None, 1.0, "z", 1), ("a", k + 1, float("nan"), 1.0, "z", 1), ("a", k + 2, -1.0, 1.0, "z", 1), (None, k + 3, 1.0, 1.0, "z", 1), ("a", k + 4, 5.0, 5.0, "same", 0), ("a", k + 5, 5.0, 5.0, "same", 0), ("a", k + 6, 5.0, 5.0, "other", 0)]
    return pts


RINGS = [("a", 1, [10, 10, 60, 10, 60, 60, 10, 60, 10, 10]), ("a", 2, [200, 0, 300, 0, 300, 300, 200, 300]), ("b", 2, [0, 0, 0, 500, 500, 500, 500, 0, 0, 0]), ("a", 3, [1, 2, 3]), ("a", 4, None)]


@pytest.mark.parametrize("full", [200_000, 60, 8])
def test_points_against_brute_force(spark, monkeypatch, full):
    """Also with tiles that count as too full, and cells of them dealt to several tasks."""
    monkeypatch.setattr(nearby, "FULL", full)
    pts = made_up_points(random.Random(3), 400, 520, crowd=150)
    p = spark.createDataFrame([(*x, 0) for x in pts], "sample_id string, row_id bigint, x double, y double, origin string, label int, g int")
    r = spark.createDataFrame(RINGS, "sample_id string, label int, ring array<int>")
    got = [tuple(x) for x in nearby.near_and_regions(p, r, 2.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == nearby_oracle(pts, RINGS, 2.0)


def test_points_of_empty_tables(spark):
    p = spark.createDataFrame([], "sample_id string, row_id bigint, x double, y double, origin string, label int")
    r = spark.createDataFrame([], "sample_id string, label int, ring array<int>")
    assert nearby.near_and_regions(p, r, 2.0).count() == 0
    one = spark.createDataFrame([("a", 1, 1.0, 1.0, None, 5)], p.schema)
    assert [tuple(x) for x in nearby.near_and_regions(one, r, 2.0).collect()] == [("region", 1, 0)]


# drifting schemas


def records(spark, files):
    rows = [(no, i, r if isinstance(r, str) or r is None else json.dumps(r)) for no, rs in files.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "file_no bigint, line_no int, record string")


def log(spark, order):
    return spark.createDataFrame([(no, "d", "s", T0 + i * H, "x") for i, no in enumerate(order)], "file_no bigint, dataset string, sample_id string, produced_at timestamp_ntz, field string")


def test_changes_between_files(spark):
    rng = random.Random(2)
    genes = [f"Gene{i}" for i in range(30)]
    base = [{"id": f"r{i}_{i % 6}", "gene": rng.choice(genes), "score": round(rng.uniform(0.4, 1), 4), "x": round(rng.uniform(0, 1800), 3), "flag": rng.random() < 0.5} for i in range(80)]
    second = [{"id": r["id"], "Gene": r["gene"], "score": f"{r['score'] * 100:.2f}%", "x": [r["x"]], "temp": 20 + rng.random()} for r in base]
    second[3]["x"] = "oops"
    second += ["not json", None, "[1]", second[0]]
    third = [{"quality": float(r["score"][:-1]) / 100, "pos_x": r["x"][0] if isinstance(r["x"], list) else None, "id": r["id"], "symbol": r["Gene"], "temp": None} for r in second[:80]]
    files = {5: base, 2: second, 9: third}
    u = drift.field_unions(records(spark, files))
    got = {tuple(r) for r in drift.schema_changes(u, log(spark, [5, 2, 9])).collect()}
    assert got == {
        (2, "renamed", "gene", "Gene"), (2, "removed", "flag", ""), (2, "added", "", "temp"), (2, "type_changed", "score", "score"), (2, "type_changed", "x", "x"),
        (9, "renamed", "Gene", "symbol"), (9, "renamed", "score", "quality"), (9, "renamed", "x", "pos_x"),
    }
    lineage = drift.field_lineage(drift.schema_changes(u, log(spark, [5, 2, 9])), log(spark, [5, 2, 9]))
    t = drift.unified(records(spark, files), lineage, ["id", "gene", "score", "x"]).collect()
    assert len(t) == len(base) + len(second) + len(third)
    by = {(r.file_no, r.line_no): r for r in t}
    for i in range(5, 80):
        a, b, c = by[5, i], by[2, i], by[9, i]
        assert a.gene == b.gene == c.gene and a.id == b.id == c.id
        assert abs(a.score_number - b.score_number) < 1e-4 and abs(a.x_number - c.x_number) < 1e-9 and a.x_number == b.x_number
    assert (by[5, 0].x_kind, by[2, 0].x_kind, by[2, 0].score_kind) == ("decimal", "array", "string")
    assert by[2, 80].gene is None and by[2, 80].other == {}


def test_unions_do_not_depend_on_the_partitions(spark):
    rows = {1: [{"a": i % 200, "b": f"t{i % 150}"} for i in range(2000)]}
    r = records(spark, rows)
    one, many = (sorted((x["field"], x["n_whole"], tuple(x["sample"])) for x in drift.field_unions(r.repartition(n)).collect()) for n in (1, 13))
    assert one == many and all(drift.SAMPLE * 0.7 < len(s[2]) <= drift.SAMPLE for s in one)


def test_long_values_are_compared_whole(spark):
    """Two fields whose values share their first 300 signs are not the same content."""
    head = "The quick brown fox " * 15
    files = {1: [{"a": f"{head}{i % 7} one"} for i in range(60)], 2: [{"b": f"{head}{i % 7} other, and longer " + "x y " * 200} for i in range(60)], 3: [{"c": f"{head}{i % 7} other, and longer " + "x y " * 200} for i in range(60)]}
    u = drift.field_unions(records(spark, files))
    got = {tuple(r) for r in drift.schema_changes(u, log(spark, [1, 2, 3])).collect()}
    assert got == {(2, "removed", "a", ""), (2, "added", "", "b"), (3, "renamed", "b", "c")}


def test_truth_values_need_a_like_name(spark):
    t = lambda name, n: [{name: i < n, "k": i} for i in range(100)]
    files = {1: t("is_control", 40), 2: t("passed_filter", 40), 3: t("filter_passed", 41), 4: t("filterPassedTwice", 95)}
    u = drift.field_unions(records(spark, files))
    got = {tuple(r) for r in drift.schema_changes(u, log(spark, [1, 2, 3, 4])).collect()}
    assert got == {(2, "removed", "is_control", ""), (2, "added", "", "passed_filter"), (3, "renamed", "passed_filter", "filter_passed"), (4, "removed", "filter_passed", ""), (4, "added", "", "filterPassedTwice")}


def test_paths_alternatives_and_unreadable_records(spark):
    files = {
        1: [{"a": 1, "b": {"c": [1, "x"], "d": None}}, {"a": 2}, "nope", None, "[1]", '{"a": 1, "a": 2}'],
        2: [{"a": 1.5, "b": {"c": []}}, {"a": True, "b": 12345678901234567890123}, {"a": 3}],
    }
    r = records(spark, files)
    assert {tuple(x) for x in drift.unreadable_records(r).collect()} == {(1, 6, 4), (2, 3, 0)}
    p = {(x.file_no, x.path): x for x in drift.path_unions(r).collect()}
    assert set(p) == {(1, "a"), (1, "b"), (1, "b.c"), (1, "b.c[]"), (1, "b.d"), (2, "a"), (2, "b"), (2, "b.c")}
    assert (p[1, "b.c[]"].n_whole, p[1, "b.c[]"].n_string, p[1, "b.d"].nulls, p[2, "a"].n_decimal, p[2, "a"].n_boolean, p[2, "b"].n_whole) == (1, 1, 1, 1, 1, 1)
    a = {tuple(x) for x in drift.alternatives(drift.path_unions(r), log(spark, [1, 2]), "path").collect()}
    assert a == {(2, "a", "decimal", "appeared", 1), (2, "a", "boolean", "appeared", 1), (2, "b", "whole", "appeared", 1)}
    lineage = drift.field_lineage(drift.schema_changes(drift.field_unions(r), log(spark, [1, 2])), log(spark, [1, 2]))
    t = {(x.file_no, x.line_no): x for x in drift.unified(r, lineage, ["a"]).collect()}
    assert (t[2, 1].a_boolean, t[2, 1].a_number, t[2, 0].a_number, t[2, 0].a_boolean, t[1, 2].a) == (True, None, 1.5, None, None)


@pytest.mark.parametrize("levels", [2, 8])
def test_alternatives_are_reported_at_all_levels(spark, tmp_path, monkeypatch, levels):
    """Whatever number of levels is worked off at a time; a name with a dot reads like a path."""
    monkeypatch.setattr(drift, "LEVELS", levels)
    deep = lambda v: {"a": {"b": [{"c": v}], "d": {}}, "e": [], "a.b": 1}
    for _ in range(4):
        deep = lambda v, inner=deep: {"f": [inner(v), 'x"]'], "g": 1}
    r = records(spark, {1: [deep(1), deep(2)], 2: [deep("x"), deep(3), deep([1.5])]})
    r.write.parquet(f"{tmp_path}/raw_feature_files.parquet")
    r.limit(0).write.parquet(f"{tmp_path}/transcript_panel_files.parquet")
    log(spark, [1, 2]).write.parquet(f"{tmp_path}/file_log.parquet")
    at = "f[]." * 4 + "a.b[].c"
    got = {tuple(x) for x in problems.p1_alternatives(spark, str(tmp_path)).collect()}
    assert got == {(2, at, "string", "appeared", 1), (2, at, "array", "appeared", 1)}
    u = {(x.file_no, x.path): x for x in drift.all_path_unions(r).collect()}
    both = u[2, "f[]." * 4 + "a.b"]
    assert (both.present, both.n_array, both.n_whole, u[2, at + "[]"].n_decimal) == (6, 3, 3, 1)


def test_files_without_records_or_log(spark):
    u = drift.field_unions(records(spark, {1: [{"a": 1}], 7: [{"z": 1}]}))
    got = {tuple(r) for r in drift.schema_changes(u, log(spark, [1, 3])).collect()}
    assert got == {(3, "removed", "a", "")}  # file 3 has no records, file 7 is not in the log
    assert drift.schema_changes(u.limit(0), log(spark, [1])).count() == 0
