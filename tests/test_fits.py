"""Operators without SQL against plain numpy on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from dwellgrid.operators import basis, fits
from dwellgrid.operators import rolling as ro
from dwellgrid.operators import solve
from dwellgrid.plans import flagging, series

RNG = np.random.default_rng(7)


def arrays(spark, *blocks, names):
    rows = [(i, *[b[i].tolist() for b in blocks]) for i in range(len(blocks[0]))]
    kinds = ", ".join(f"{n} array<{'boolean' if b.dtype == bool else 'double'}>" for n, b in zip(names, blocks))
    return spark.createDataFrame(rows, f"i int, {kinds}")


def got(df, name, key="i"):
    return np.array([[np.nan if v is None else v for v in r[name]] for r in df.orderBy(key).collect()], float)


def test_iterative_clip(spark):
    x = RNG.normal(10, 0.1, 60)
    x[20:24], x[40], x[50] = 30.0, -1.0, 25.0
    measured = np.zeros(60, bool)
    measured[50] = True
    df = spark.createDataFrame([(i, float(v), bool(m)) for i, (v, m) in enumerate(zip(x, measured))], "i int, x double, m boolean")
    flagged = np.zeros(60, bool)
    for _ in range(5):
        base = np.where(flagged, np.nan, x)
        roll = lambda a: np.nanmedian(np.lib.stride_tricks.sliding_window_view(np.pad(a, 5, mode="edge"), 11), axis=1)
        mid = roll(base)
        sigma = np.maximum(1.4826 * roll(np.abs(base - mid)), 1e-30)
        res = np.abs(x - mid)
        new = ~measured & (((res > 7 * sigma) & (res > 0.3 * np.abs(mid))) | (x < 0))
        if (new == flagged).all():
            break
        flagged = new
    for limit in (1_000_000, 30):
        out = ro.iterative_clip(df, [], ["i"], "x", "m", 11, limit=limit).orderBy("i").collect()
        assert [r.outlier for r in out] == flagged.tolist()


def test_group_triggers_light_a_band(spark):
    z = RNG.normal(0, 1, (30, 64))
    z[12, 16:24] += 4.0  # a tile too weak for the point cut
    z[20, 3] = 50.0
    rows = [(0, i, c, 50.0 + 2.0 * c, float(z[i, c]), 0.0, True, True) for i in range(30) for c in range(64)]
    df = spark.createDataFrame(rows, "s int, i int, c int, f double, z double, x double, v boolean, r boolean")
    out = flagging.group_triggers(df, ["s"], "i", "c", "f", "z", "x", "v", "r")
    band = {(r.i, r.c) for r in out.where("band_group_trigger").collect()}
    point = {(r.i, r.c) for r in out.where("positive_auto_excess").collect()}
    # brute force of the tiles: score over the reference rows, in robust units
    center = np.median(z, axis=0)
    scale = np.maximum(1.4826 * np.median(np.abs(z - center), axis=0), 1)
    # channels with the spike leave it out of their reference
    ref = z.copy()
    ref[20, 3] = np.nan
    center, scale = np.nanmedian(ref, axis=0), np.maximum(1.4826 * np.nanmedian(np.abs(ref - np.nanmedian(ref, axis=0)), axis=0), 1)
    std, f, want = (z - center) / scale, 50.0 + 2.0 * np.arange(64), set()
    for lo, hi in flagging.REPORT_BANDS.values():
        idx = np.flatnonzero((f >= lo) & (f < hi))
        for sel in [idx] + [idx[k:k + 8] for k in range(0, len(idx), 8)]:
            if len(sel) < 3:
                continue
            raw = np.clip(std[:, sel], -3, 6).sum(1) / np.sqrt(len(sel))
            sigma = max(1.0, 1.4826 * np.median(np.abs(raw - np.median(raw))))
            on = ((raw - np.median(raw)) / sigma > 6) & ((std[:, sel] > 2).mean(1) >= 0.35)
            want |= {(int(i), int(c)) for i in np.flatnonzero(on) for c in sel}
    assert band == want and want
    assert (20, 3) in point


def test_pixel_solve_recovers_a_known_field(spark):
    u = np.array([1 + 2j, -0.5j, 0.3])
    rows = []
    for i in range(30):
        a, b, c = RNG.normal(size=(3, 3))
        u0 = u - c * (c @ u) / (c @ c)  # the design's third row is zero on it
        ex, ey = a @ u0, b @ u0
        rows.append((i, i, *map(float, [*a, *b, *c]), float(ex.real), float(ex.imag), float(ey.real), float(ey.imag)))
    names = [f"{k}{j}" for k in "abc" for j in range(3)]
    df = spark.createDataFrame(rows, "i int, pix int, " + ", ".join(f"{n} double" for n in names) + ", xr double, xi double, yr double, yi double")
    from dwellgrid.functions.complexnum import cplx
    cols = lambda k: [F.col(f"{k}{j}") for j in range(3)]
    df = df.select("i", "pix", *names, cplx(F.col("xr"), F.col("xi")).alias("ex"), cplx(F.col("yr"), F.col("yi")).alias("ey"))
    df = df.select("*", *solve.sample_products(cols("a"), cols("b"), cols("c"), F.col("ex"), F.col("ey")))
    for r in solve.pixel_solve(df, "pix", max_cond=1e9).collect():
        d = rows[r.pix]
        A = np.array(d[2:11]).reshape(3, 3)
        want, *_ = np.linalg.lstsq(A.astype(complex), np.array([d[11] + 1j * d[12], d[13] + 1j * d[14], 0]), rcond=None)
        cond = np.linalg.cond(A)
        assert np.isclose(r.cond, cond, rtol=1e-3 if cond < 1e3 else 1)
        if cond < 100:
            assert np.allclose([r.ure0 + 1j * r.uim0, r.ure1 + 1j * r.uim1, r.ure2 + 1j * r.uim2], want, rtol=1e-6, atol=1e-8)


def test_plane_angle_follows_the_motor(spark):
    el = np.linspace(-150, 170, 80)
    a, b = np.linalg.qr(RNG.normal(size=(3, 2)))[0].T
    g = np.cos(np.radians(el))[:, None] * a + np.sin(np.radians(el))[:, None] * b
    rows = [(i, *map(float, v), float(e)) for i, (v, e) in enumerate(zip(g, el))] + [(80, None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double, z double, m double")
    out = solve.principal_plane_angle(df, ["i"], ["x", "y", "z"], "m").orderBy("i").collect()
    assert np.allclose([r.angle for r in out[:-1]], el, atol=1e-6) and out[-1].angle is None


def test_cos2_peak_is_exact_on_its_own_law(spark):
    az = np.linspace(0, 300, 12)
    rows = [(c, float(a), float(2 + (c + 5 - 2) * np.cos(np.radians(a - 30)) ** 2)) for c in range(4) for a in az]
    df = spark.createDataFrame(rows, "chan int, az double, p double")
    peaks = solve.cos2_peak(df, "chan", F.col("az"), F.col("p"))
    assert np.allclose([r.peak for r in peaks.orderBy("chan").collect()], [5, 6, 7, 8])
    assert [round(r.scale, 9) for r in solve.arm_scale(peaks, "chan").orderBy("chan").collect()] == [1.0, round(7 / 8, 9)]


def _noisy(spark, inputs):
    rows = []
    for k, level in enumerate(inputs):
        y = 1e6 * (1 + 0.1 * np.sin(np.arange(40) / 15))[:, None] * (1 + 0.2 * np.cos(np.arange(48) / 30))[None, :]
        y = y * (1 + np.random.default_rng(k).normal(0, level, y.shape))
        y[20, 30] *= 1.5
        rows += [(k, 0, i, c, 40 + 2.0 * c, float(y[i, c]), i != 3, 0.0) for i in range(40) for c in range(48)]
    return spark.createDataFrame(rows, "input int, segment int, i int, c int, f double, p double, sky boolean, x double")


def test_segment_flags_find_a_spike_guard_it_and_keep_inputs_apart(spark):
    flags = lambda df: {(r.input, r.i, r.c): r.flags for r in flagging.segment_flags(df, ["input", "segment"], "i", "c", "f", "p", F.lit(0.001), F.col("sky"), "x").collect()}
    df = _noisy(spark, [0.001, 0.02])
    both = flags(df)
    assert both == {**flags(df.where("input = 0")), **flags(df.where("input = 1"))} and len(both) == 2 * 40 * 48
    assert both[0, 20, 30] & 4 and both[0, 19, 30] == 256 and both[0, 21, 30] == 256
    assert both[0, 3, 5] & 1 and both[0, 2, 5] == 256 and both[0, 10, 10] == 0


def _plain_peel(s, good, teeth, spacing, reach, least):
    kept, dropped = list(teeth), []

    def look(t):
        near = sorted([u for u in kept if u != t and (u // spacing - t // spacing) % 2 == 0 and abs(u - t) <= reach], key=lambda u: (abs(u - t), u))[:2]
        ok = good[t] & np.all([good[u] for u in near], axis=0) if near else np.zeros(len(s[t]), bool)
        if ok.sum() < 3:
            return -1.0
        low = 1e-3 * s[t].max()
        return np.corrcoef(np.log(np.maximum(s[t][ok], low)), np.log(np.maximum(np.mean([s[u][ok] for u in near], axis=0), low)))[0, 1]

    while kept:
        now = {t: look(t) for t in kept}
        worst = min(kept, key=lambda t: (now[t], t))
        if now[worst] >= least:
            break
        kept.remove(worst)
        dropped.append(worst)
    return kept, dropped


def test_dropping_a_series_saves_its_neighbours(spark):
    teeth, shape = [0, 4, 8, 12, 16, 24, 32], np.exp(RNG.normal(0, 1, 120))
    s = {t: np.abs(shape * (1 + 0.05 * RNG.normal(size=120))) for t in teeth}
    s[16] = np.exp(RNG.normal(0, 3, 120))  # out of step, and loud: its neighbours' mean follows it
    good = {t: RNG.random(120) > 0.1 for t in teeth}
    comb = series.Comb(teeth, spacing=4, reach=20)
    df = spark.createDataFrame([(k, i, t, float(s[t][i]), bool(good[t][i])) for k in "ab" for t in teeth for i in range(120)], "k string, i int, c int, s double, g boolean")
    found = series.coherences(df, ["k"], "i", "c", F.col("s"), F.col("g"), comb)
    out = series.prune(found, ["k"], "c", comb, 0.9).collect()
    kept, dropped = _plain_peel(s, good, teeth, 4, 20, 0.9)
    for k in "ab":
        mine = {r.c: r for r in out if r.k == k}
        assert sorted(t for t in mine if mine[t].kept) == kept and sorted((t for t in mine if mine[t].drop_round), key=lambda t: mine[t].drop_round) == dropped
    saved = [r.c for r in out if r.k == "a" and r.kept and (r.first_pass or -1) < 0.9]
    assert 16 in dropped and saved, "a tone below the limit at first stays once its neighbour is gone"


def test_series_without_rows_or_candidates(spark):
    comb = series.Comb([0, 4, 8], spacing=4, reach=8)
    df = spark.createDataFrame([(i, c, 1.0) for i in range(5) for c in (0, 4, 8)], "i int, c int, s double")
    found = series.coherences(df, [], "i", "c", F.col("s"), F.lit(True), comb)
    out = {r.c: r for r in series.prune(found, [], "c", comb).collect()}
    assert not any(r.kept for r in out.values()) and [out[c].drop_round for c in (0, 4, 8)] == [1, 2, 3]  # no scatter, no coherence
    assert not any(r.kept or r.drop_round for r in series.prune(found, [], "c", comb, candidates=df.limit(0)).collect())
    assert series.prune(series.coherences(df.limit(0), [], "i", "c", F.col("s"), F.lit(True), comb), [], "c", comb).count() == 0


def _spectra_frame(spark, spectra):
    return spark.createDataFrame([(i, c, None if v is None else float(v)) for i, row in enumerate(spectra) for c, v in enumerate(row)], "i int, c int, v double").repartition(3)


def test_row_model_is_the_ridge_fit_with_one_clip(spark):
    u = np.linspace(-1, 1, 40)
    A = np.stack([u**k for k in range(4)], axis=1)
    rows = np.exp(A @ RNG.normal(size=(4, 5))).T * np.exp(RNG.normal(0, 0.01, (5, 40)))
    rows[0, 7] *= 3
    rows[1, 5:] = -1.0  # five cells are left
    rows[2, 9], mask = 0.0, np.arange(40) % 8 != 3
    columns = [F.pow(2 * F.col("c") / 39 - 1, F.lit(k)) for k in range(4)]
    got = {(r.i, r.c): r.model for r in basis.robust_row_model(_spectra_frame(spark, rows), ["i"], "v", F.col("c") % 8 != 3, columns).collect()}
    for i, y in enumerate(rows):
        ok = mask & (y > 0)
        if ok.sum() < 6:
            assert all(got[i, c] is None for c in range(40))
            continue
        z, solve_ = np.log(np.maximum(y[ok], np.percentile(y[ok], 1))), lambda a, b: np.linalg.solve(a.T @ a + 1e-6 * np.eye(4), a.T @ b)
        r = z - A[ok] @ solve_(A[ok], z)
        keep = r <= np.median(r) + 3 * (1.4826 * np.median(abs(r - np.median(r))) + 1e-8)
        assert i or not keep[np.flatnonzero(ok) == 7][0]
        assert np.allclose([got[i, c] for c in range(40)], np.exp(A @ solve_(A[ok][keep], z[keep])), rtol=1e-8)


def test_comb_background_clips_in_rounds(spark):
    n, teeth = 64, list(range(8, 60, 8))
    rows = 100 + 0.5 * np.arange(n) + RNG.normal(0, 0.2, (4, n))
    rows[:, teeth] += 50
    rows[0, 21], rows[0, 22], rows[1, 35] = 400, 130, 60  # a strong outlier beside a tone hides a weaker one at first
    rows[3, 2:] = -1
    got = {(r.i, r.tooth): r for r in basis.comb_background(_spectra_frame(spark, rows), ["i"], "c", "v", teeth, 0, n - 1, lambda u: [F.lit(1.0), u, u * u], 3, width=24.0, step=12.0).collect()}
    centres = basis.windows(0, n - 1, 24.0, 12.0)
    masked = np.abs((np.arange(n) + 4) % 8 - 4) <= 1
    changed = 0
    for i, row in enumerate(rows):
        for t in teeth:
            at = centres[int(np.argmin([abs(t - c) for c in centres]))]
            idx = np.flatnonzero((np.arange(n) >= at - 12) & (np.arange(n) < at + 12))
            u = (idx - at) / 12
            A, base = np.stack([u**0, u, u**2], axis=1), ~masked[idx] & (row[idx] > 0)
            if base.sum() < 8:
                assert got[i, t].background is None
                continue
            scale, use, seen = np.median(row[idx][base]), base.copy(), []
            y = row[idx] / scale
            for _ in range(6):
                coef = np.linalg.lstsq(A[use], y[use], rcond=None)[0]
                r, seen = y - A @ coef, [*seen, use]
                new = base & (abs(r) <= 4 * 1.4826 * np.median(abs(r[use])))
                if (new == use).all():
                    break
                use = new
            changed = max(changed, len(seen))
            fit = A @ coef
            near = np.isin(idx - t, [-4, -3, -2, 2, 3, 4])
            assert np.isclose(got[i, t].background, (fit * scale)[idx == t][0]) and np.isclose(got[i, t].residual_rms, np.sqrt(np.mean((y[near] / fit[near] - 1) ** 2)))
    assert changed > 2, "the second outlier is found only once the first is out"


def test_interleaved_fill_keeps_what_is_measured(spark):
    n = 24
    rows = RNG.normal(10, 1, (4, n))
    rows[:, ::2] = 5 + 0.25 * np.arange(0, n, 2)
    rows[:, 1::2] = 9 - 0.125 * np.arange(1, n, 2)
    flags = np.zeros((4, n), bool)
    flags[0, [4, 9]] = True
    flags[1, : n // 2] = True  # more than the allowed share
    flags[2, 8:24:2] = True  # even: only the lower end is left
    line = lambda m, k: [[1.0, 2 * i / (m - 1) - 1] for i in range(m)]
    classes = {name: (F.col("c") % 2 == p, fits.class_basis(list(range(p, n, 2)), list(range(n)), 2, line), F.lit(True)) for name, p in (("even", 0), ("odd", 1))}
    df = spark.createDataFrame([(i, c, float(rows[i, c]), bool(flags[i, c])) for i in range(4) for c in range(n)], "i int, c int, v double, f boolean")
    for most, blocked in ((None, False), (2.0, True)):
        got = {(r.i, r.c): r for r in fits.interleaved_fill(df, ["i"], "c", "v", "f", classes, max_cond=most).collect()}
        assert all(got[1, c].bad and got[1, c].even is None and got[1, c].odd is None for c in range(n))
        for c in range(n):
            assert np.isclose(got[3, c].even, 5 + 0.25 * c) and np.isclose(got[3, c].odd, 9 - 0.125 * c)
        assert got[0, 4].even is None and got[0, 9].odd is None and np.isclose(got[0, 4].odd, 9 - 0.5) and np.isclose(got[0, 9].even, 5 + 2.25)
        assert (got[2, 11].even is None) == blocked and np.isclose(got[2, 0].even, 5) and np.isclose(got[2, 10].odd, 9 - 1.25)
    design = np.array([[1.0, 2 * i / 11 - 1] for i in range(12) if not flags[2, 2 * i]])
    assert np.isclose(got[2, 0].even_cond, np.linalg.cond(design))


def test_class_basis_reads_between_trusted_channels():
    made = fits.class_basis([2, 4, 10], list(range(12)), 2, lambda n, k: [[1.0, 0.0], [3.0, 1.0], [0.0, 7.0]])
    assert made[4] == [3.0, 1.0] and made[3] == [2.0, 0.5] and made[7] == [1.5, 4.0] and made[0] == [-1.0, -1.0] and np.allclose(made[11], [-0.5, 8.0])


def test_segments_without_support_are_never_filled(spark):
    level, gain = 100 + 10 * np.arange(12.0), 1 + 0.1 * np.sin(np.arange(20))
    rows = []
    for seg in range(4):
        for i in range(20):
            for c in range(12):
                v = level[c] * gain[i] * (1 + 0.001 * RNG.normal())
                if seg == 3 and c == 5 and i not in (0, 1):
                    v = None  # two rows are left on this channel: weak support
                if (seg, i, c) == (0, 7, 3):
                    v *= 2.0
                ref = {0: i != 9, 1: False, 2: i == 4, 3: True}[seg]
                rows.append((seg, i, c, float(v) if v and (i, c) != (2, 2) else None, ref))
    df = spark.createDataFrame(rows, "s int, i int, c int, v double, r boolean").repartition(4)
    got = {(r.s, r.i, r.c): r for r in fits.segment_background(df, ["s"], "i", "c", "v", F.lit(0.01), F.col("r"), max_inflation=1.7).collect()}
    assert len(got) == 4 * 20 * 12
    assert all(got[s, i, c].model is None for s in (1, 2) for i in range(20) for c in range(12)), "no reference rows, or no more cells than coefficients"
    assert all(abs(got[0, i, c].model / (level[c] * gain[i]) - 1) < 0.005 for i in range(20) for c in range(12)), "a spike, a gap and a row of another state are filled"
    assert all(abs(got[3, i, 4].model / (level[4] * gain[i]) - 1) < 0.01 for i in range(20))
    assert all(got[3, i, 5].model is None and got[3, i, 5].inflation > 1.7 > got[3, i, 4].inflation for i in range(20))


def test_states_are_all_counted(spark):
    from dwellgrid.operators.aggregates import state_counts
    assert state_counts(spark.range(40).selectExpr("id % 13 AS s"), "s").count() == 13


def test_in_intervals_left_is_one_join_at_every_size(spark):
    from dwellgrid.operators.rangejoins import in_intervals
    rows = spark.createDataFrame([(float(t),) for t in (-5, 0, 3, 3, 900, 2e9)], "t double")
    spans = spark.createDataFrame([(0.0, 0.0, "a"), (-1.0, 1e9, "b"), (2.5, 4.0, "c"), (9.0, 8.0, "d")], "lo double, hi double, n string")
    got = [sorted((r.t, r.n or "") for r in in_intervals(rows, "t", spans, "lo", "hi", "left", size).collect()) for size in (10_000, 0)]
    assert got[0] == got[1] == [(-5.0, ""), (0.0, "a"), (0.0, "b"), (3.0, "b"), (3.0, "b"), (3.0, "c"), (3.0, "c"), (900.0, "b"), (2e9, "")]


def test_triggers_window_their_cells_once(spark):
    df = _noisy(spark, [0.01]).withColumn("z", F.col("p") / 1e6 - 1)
    out = flagging.group_triggers(df, ["input", "segment"], "i", "c", "f", "z", "x", "sky", "sky")
    # what is left reads cells with their residuals from the checkpoint; only the bands' scores are windowed
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2
