"""What a user plugs in, and detectors looked at again: against plain versions on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.operators import folds, grids
from dwellgrid.operators import rolling as ro
from dwellgrid.operators.neighbours import nearest_neighbours
from dwellgrid.plans import evaluation
from dwellgrid.sources import scanner

RNG = np.random.default_rng(11)


@pytest.mark.parametrize("fan", [2, 7, 4096])
def test_a_fold_has_the_result_of_its_values(spark, fan):
    values = {"a": RNG.normal(size=200).tolist(), "b": [1.0, 2.0, 4.0], "c": [3.0], "d": [None, 5.0, 6.0, 7.0, None], None: [1.0, 1.0, 1.0, 9.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.value for r in folds.folded(df, ["k"], F.col("v"), folds.trimmed_mean(), fan=fan).collect()}
    for k, vs in values.items():
        vs = sorted(v for v in vs if v is not None)
        assert got[k] is None if len(vs) < 3 else np.isclose(got[k], np.mean(vs[1:-1]))
    assert folds.folded(df.limit(0), ["k"], F.col("v"), folds.trimmed_mean()).count() == 0


@pytest.mark.parametrize("small", [grids.SMALL_GRID, 0])
def test_sampler_reads_nodes_between_and_across_the_wrap(spark, small):
    grid = RNG.normal(size=(8, 4))
    nodes = [(i, j, float(grid[i, j])) for i in range(8) for j in range(4) if (i, j) != (5, 3)]
    df = spark.createDataFrame(nodes, "i int, j int, v double")
    read = grids.sampler(df, "i", "j", "v", around=8, first=-10.0, step=10.0, count=4, small=small)
    points = [(45.0 * i, -10.0 + 10 * j) for i in range(8) for j in range(4)] + [(337.5, 5.0), (-22.5, 5.0), (350.0, 19.0), (720.0, 0.0), (100.0, 20.0), (10.0, -10.1), (10.0, 20.1), (None, 0.0), (10.0, None), (230.0, 15.0)]
    rows = [(n, a, e) for n, (a, e) in enumerate(points)]
    got = {r.n: r.sample for r in grids.sampled(spark.createDataFrame(rows, "n int, az double, el double"), F.col("az"), F.col("el"), read).collect()}

    def plain(a, e):
        if a is None or e is None or not -10 <= e <= 20:
            return None
        u, v = a % 360 / 45, (e + 10) / 10
        i, j = int(u), min(int(v), 2)
        x, y, total = u - i, v - j, 0.0
        for p, q, w in ((0, 0, (1 - x) * (1 - y)), (1, 0, x * (1 - y)), (0, 1, (1 - x) * y), (1, 1, x * y)):
            at = ((i + p) % 8, j + q)
            if w and at == (5, 3):
                return None
            total += w * grid[at]
        return total

    for n, (a, e) in enumerate(points):
        want = plain(a, e)
        assert got[n] is None if want is None else np.isclose(got[n], want), (a, e)


def test_scanner_reads_the_lines_of_any_cut(spark, tmp_path):
    rows = [{"id": i, "x": i / 4, "s": "é" * (i % 5) + "\\n", "f": i % 2 == 0} for i in range(300)]
    lines = [json.dumps(r, ensure_ascii=False) for r in rows]
    lines[7:7] = ["", "   ", '{"provenance": "me"}', "no json", "[1]"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:100]), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[100:]) + "\n", encoding="utf-8")
    (tmp_path / "_hidden").write_text("x")
    ddl = "id bigint, x double, s string, f boolean"
    want = sorted((r["id"], float(r["x"]), r["s"], r["f"]) for r in rows)
    for split in (331, 1000, 1 << 20):
        got = scanner.scan(spark, str(tmp_path), ddl, scanner.lines_scanner("provenance", split)).collect()
        assert sorted(tuple(r) for r in got if r.id is not None) == want and sum(r.id is None for r in got) == 2
    built_in = scanner.scan(spark, str(tmp_path), "id bigint, s string").collect()
    assert sorted((r.id, r.s) for r in built_in if r.id is not None) == sorted((r["id"], r["s"]) for r in rows)
    assert scanner.scan(spark, f"{tmp_path}/a.jsonl", "f boolean", scanner.lines_scanner()).columns == ["f"]
    own = lambda spark, path, ddl: spark.range(3).withColumn("file", F.lit(path))
    assert scanner.scan(spark, "here", "file string", own).distinct().collect()[0].file == "here"
    with pytest.raises(KeyError):
        scanner.scan(spark, "here", "file string, row bigint", own)


def test_smooth_injection_judges_as_a_whole_run_does(spark):
    x = RNG.normal(100, 1, (30, 6))
    x[9, 2] = 120
    shape = np.zeros((30, 6))
    shape[10:14] = np.exp(-((np.arange(6) - 3) ** 2) / 2)
    df = spark.createDataFrame([(i, c, float(x[i, c]), float(shape[i, c])) for i in range(30) for c in range(6)], "i int, c int, v double, k double")

    def off(a, scale):
        mid = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(a, ((2, 2), (0, 0)), mode="edge"), 5, axis=0), axis=2)
        return abs(a - mid) > 3 * scale, mid

    mid = off(x, 1)[1]
    scale = 1.4826 * np.median(abs(x - mid - np.median(x - mid, axis=0)), axis=0)
    before = off(x, scale)[0]
    near = np.array([shape[max(0, i - 2):i + 3].max(axis=0) != 0 for i in range(30)])
    for limit in (1_000_000, 40):
        got = {r.depth: r for r in evaluation.smooth_injection(df, ["c"], ["i"], "v", F.col("k"), [0.0, 0.05, 0.4], half=2, clip=3.0, limit=limit).collect()}
        for depth, r in got.items():
            after = off(x * (1 - depth * shape), scale)[0]
            assert (after == before)[~near].all(), "cells elsewhere can't change"
            assert (r.n, r.before, r.after) == (near.sum(), (before & near).sum(), (after & near).sum())
            assert np.isclose(r.newly_flagged, (after & ~before)[near].mean())


def test_mean_flagger_reads_the_flags_of_the_pass_before(spark):
    n, noise = 20, 3.0
    x = RNG.normal(100, 1, (6, n))
    x[0, 5], x[0, 6], x[1, 0], x[2, 19], x[3, 9] = 300, 180, 10, 400, 0
    rows = [(r, c, float(x[r, c])) for r in range(6) for c in range(n)] + [(6, c, None if c % 2 else 5.0) for c in range(n)]
    got = {(r.r, r.c): r.flag for r in ro.mean_flagger(spark.createDataFrame(rows, "r int, c int, v double").repartition(3), ["r"], "c", "v", F.lit(noise), 5.0).collect()}
    for r in range(6):
        w = np.ones(n)
        for k in (3, 4, 5):
            at = np.pad(np.arange(n), k, mode="symmetric")
            new = np.ones(n)
            for c in range(n):
                near = np.delete(at[c:c + 2 * k + 1], k)
                m = (x[r][near] * w[near]).sum() / w[near].sum()
                new[c] = not (x[r, c] and abs(x[r, c] - m) > abs(m) * noise / x[r, c] * 5)
            w = new
        assert [got[r, c] for c in range(n)] == (w == 0).tolist()
    assert got[0, 5] and got[2, 19] and not any(got[6, c] for c in range(n))


def test_a_leaf_that_all_ask_is_dealt(spark):
    az, el = np.r_[RNG.uniform(0, 6.28, 150), np.full(90, 2.0)], np.r_[RNG.uniform(-1, 1, 150), np.full(90, 0.1)]
    df = spark.createDataFrame([(i, float(a), float(e), 0.0) for i, (a, e) in enumerate(zip(az, el))], "i bigint, az double, el double, v double")
    found = [{r.i: (np.round(r.d, 9).tolist(), r.n) for r in nearest_neighbours(df, "i", F.col("az"), F.col("el"), F.col("v"), 4, 16, portion).collect()} for portion in (4096, 8)]
    assert found[0] == found[1] and len(found[0]) == 240
