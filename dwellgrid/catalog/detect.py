"""Queries over fits, series selection and the segment detector."""

from pyspark.sql import functions as F

from dwellgrid.catalog.aggregates import rounded
from dwellgrid.catalog.registry import query
from dwellgrid.catalog.rolling import _roll, padded
from dwellgrid.catalog.views import CELLS, SPECTRA, cells, r6, spectra
from dwellgrid.functions import bits
from dwellgrid.operators import basis, fits
from dwellgrid.plans import flagging, series

TEETH = list(range(8, 60, 8))


def gauss(name: str, source: str, keys: str, k: int, y: str, use: str, ridge: float = 0.0) -> str:
    """CTEs of a least-squares fit on b0 .. per group: <name> has the keys and c0 .., by elimination."""
    made = ", ".join([f"sum(CASE WHEN {use} THEN b{i}*b{j} END)+{ridge if i == j else 0.0} AS a{i}_{j}" for i in range(k) for j in range(i, k)]
                     + [f"sum(CASE WHEN {use} THEN b{i}*{y} END) AS r{i}" for i in range(k)])
    out = [f"{name}0 AS MATERIALIZED (SELECT {keys}, {made} FROM {source} GROUP BY ALL)"]
    for t in range(k - 1):
        part = lambda i: f"a{t}_{i}/a{t}_{t}"  # noqa: B023, E731
        step = [f"a{i}_{j}-{part(i)}*a{t}_{j} AS a{i}_{j}" for i in range(t + 1, k) for j in range(i, k)] + [f"r{i}-{part(i)}*r{t} AS r{i}" for i in range(t + 1, k)]
        out.append(f"{name}{t + 1} AS (SELECT * REPLACE ({', '.join(step)}) FROM {name}{t})")
    last = f"{name}{k - 1}"
    for i in range(k - 1, -1, -1):
        known = "".join(f"-a{i}_{j}*c{j}" for j in range(i + 1, k))
        to = name if i == 0 else f"{name}c{i}"
        out.append(f"{to} AS MATERIALIZED (SELECT *, (r{i}{known})/a{i}_{i} AS c{i} FROM {last})")
        last = to
    return ", ".join(out)


def _read(k: int) -> str:
    return "+".join(f"c{i}*b{i}" for i in range(k))


_ROW_BASIS = 6


@query("robust_row_model", f"""WITH {CELLS}, a AS (SELECT row_no, chan, p, chan%8<>3 AND p>0 AND NOT (row_no%50=7 AND chan>6) AS ok, {', '.join(f'cos(pi()*{i}*chan/63) AS b{i}' for i in range(_ROW_BASIS))} FROM cells),
f AS (SELECT row_no, quantile_cont(p, 0.01) AS fl FROM a WHERE ok GROUP BY 1), s AS MATERIALIZED (SELECT a.*, CASE WHEN ok THEN ln(greatest(p, fl)) END AS y FROM a LEFT JOIN f USING (row_no)),
{gauss('g', 's', 'row_no', _ROW_BASIS, 'y', 'ok', 1e-6)}, r AS MATERIALIZED (SELECT s.*, y-({_read(_ROW_BASIS)}) AS r FROM s JOIN g USING (row_no)), m AS (SELECT row_no, median(r) AS m FROM r GROUP BY 1),
d AS (SELECT row_no, m, median(abs(r-m)) AS d FROM r JOIN m USING (row_no) GROUP BY 1, 2), t AS MATERIALIZED (SELECT r.*, ok AND NOT coalesce(r>m+3*(1.4826*d+1e-8), false) AS kept FROM r JOIN d USING (row_no)),
{gauss('h', 't', 'row_no', _ROW_BASIS, 'y', 'kept', 1e-6)}, n AS (SELECT row_no, count_if(kept) AS n FROM t GROUP BY 1)
SELECT row_no, chan, round(CASE WHEN n>={_ROW_BASIS + 2} THEN exp({_read(_ROW_BASIS)}) END, 4) AS model FROM t JOIN h USING (row_no) JOIN n USING (row_no)""")
def robust_row_model(spark, folder):
    """Six cosines per spectrum; rows with too few cells stay NULL."""
    columns = [F.cos(F.pi() * i * F.col("chan") / 63) for i in range(_ROW_BASIS)]
    admitted = (F.col("chan") % 8 != 3) & ~((F.col("row_no") % 50 == 7) & (F.col("chan") > 6))
    return rounded(basis.robust_row_model(cells(spark, folder), ["row_no"], "p", admitted, columns).select("row_no", "chan", "model"), 4)


def _classes():
    """Even and odd channels, each on a straight line over its trusted channels, counted in order."""
    def line(n, k):
        return [[1.0, 2 * i / (n - 1) - 1] for i in range(n)]

    trusted = {name: [c for c in range(64) if c % 2 == parity and not 20 <= c < 28] for name, parity in (("even", 0), ("odd", 1))}
    return {name: (t, fits.class_basis(t, list(range(64)), 2, line)) for name, t in trusted.items()}


def class_sql(name: str, parity: int, most: float, made=None, tag: str = "", value: str = "p") -> str:
    """CTEs of one class filled from w (row_no, chan, the value, f, bad): o<tag><name>."""
    trusted, table = (made or _classes())[name]
    column, name = name, tag + name
    values = ", ".join(f"({c}, {v[0]!r}::DOUBLE, {v[1]!r}::DOUBLE)" for c, v in table.items())
    use = f"chan IN ({', '.join(map(str, trusted))}) AND NOT f"
    return f"""v{name} AS (SELECT * FROM (VALUES {values}) t(chan, b0, b1)), s{name} AS (SELECT c.*, b0, b1 FROM w c JOIN v{name} USING (chan)), {gauss('g' + name, 's' + name, 'row_no', 2, value, use)},
e{name} AS (SELECT g.row_no, c0, c1, n, sqrt((t+sqrt(t*t-4*d))/(t-sqrt(t*t-4*d))) AS cond FROM g{name} g JOIN (SELECT row_no, a0_0+a1_1 AS t, a0_0*a1_1-a0_1*a0_1 AS d FROM g{name}0) USING (row_no) JOIN (SELECT row_no, count_if({use}) AS n FROM s{name} GROUP BY 1) USING (row_no)),
o{name} AS (SELECT row_no, chan, CASE WHEN bad THEN NULL WHEN chan%2={parity} THEN CASE WHEN NOT f THEN {value} END WHEN n>=4 AND cond<={most} THEN c0*b0+c1*b1 END AS {column}, CASE WHEN NOT bad AND n>=4 THEN cond END AS {column}_cond FROM s{name} JOIN e{name} USING (row_no))"""


_MOST = 1.9


@query("interleaved_fill", f"""WITH {CELLS}, w AS MATERIALIZED (SELECT row_no, chan, p, f, avg(f::INT) OVER (PARTITION BY row_no)>0.35 AS bad FROM (SELECT *, x>0.1 OR (row_no%9=4 AND chan BETWEEN 12 AND 51 AND chan%4<>1) AS f FROM cells)),
{class_sql('even', 0, _MOST)}, {class_sql('odd', 1, _MOST)}
SELECT row_no, chan, bad, round(even,4) AS even, round(odd,4) AS odd, round(even_cond,5) AS even_cond, round(odd_cond,5) AS odd_cond FROM w JOIN oeven USING (row_no, chan) JOIN oodd USING (row_no, chan)""")
def interleaved_fill(spark, folder):
    """Two classes on straight lines; ill-conditioned spectra keep their measured cells alone."""
    c = F.col("chan")
    flag = (F.col("x") > 0.1) | ((F.col("row_no") % 9 == 4) & c.between(12, 51) & (c % 4 != 1))
    classes = {name: (c % 2 == parity, _classes()[name][1], c.isin(_classes()[name][0])) for name, parity in (("even", 0), ("odd", 1))}
    out = fits.interleaved_fill(cells(spark, folder).withColumn("f", flag), ["row_no"], "chan", "p", "f", classes, max_cond=_MOST)
    return out.select("row_no", "chan", "bad", *[r6(n, 4).alias(n) for n in ("even", "odd")], *[r6(n, 5).alias(n) for n in ("even_cond", "odd_cond")])


def _comb_sql(k: int = 3, rounds: int = 6) -> str:
    centres = basis.windows(0, 63, 24.0, 12.0)
    own = {t: min(range(len(centres)), key=lambda n: (abs(t - centres[n]), n)) for t in TEETH}
    steps = [f"""w AS (SELECT * FROM (VALUES {', '.join(f'({n}, {centres[n]}::DOUBLE)' for n in sorted(set(own.values())))}) t(win, mid)), o AS (SELECT * FROM (VALUES {', '.join(f'({t}, {n})' for t, n in own.items())}) t(tooth, win)),
a AS (SELECT row_no, win, chan, p, abs((chan+4)%8-4)>1 AND p>0 AND NOT chan BETWEEN 40 AND 42 AS base, 1.0::DOUBLE AS b0, (chan-mid)/12 AS b1, pow((chan-mid)/12,2) AS b2 FROM cells JOIN w ON chan>=mid-12 AND chan<mid+12),
u0 AS MATERIALIZED (SELECT a.*, p/s AS y, s, base AS use, nb FROM a JOIN (SELECT row_no, win, median(p) FILTER (base) AS s, count_if(base) AS nb FROM a GROUP BY 1, 2) USING (row_no, win))"""]
    for n in range(rounds):
        steps.append(gauss(f"g{n}_", f"u{n}", "row_no, win", k, "y", "use"))
        steps.append(f"z{n} AS MATERIALIZED (SELECT u.*, {_read(k)} AS fit FROM u{n} u JOIN g{n}_ USING (row_no, win))")
        steps.append(f"u{n + 1} AS MATERIALIZED (SELECT z.* EXCLUDE (use, fit), base AND abs(y-fit)<=4*d AS use FROM z{n} z JOIN (SELECT row_no, win, 1.4826*median(abs(y-fit)) FILTER (use) AS d FROM z{n} GROUP BY 1, 2) USING (row_no, win))")
    last = f"z{rounds - 1}"
    return f"""WITH {CELLS}, {', '.join(steps)} SELECT z.row_no, tooth, round(CASE WHEN nb>={k + 5} THEN fit*s END,5) AS background, round(CASE WHEN nb>={k + 5} THEN rms END,5) AS residual_rms
FROM {last} z JOIN o ON z.win=o.win AND z.chan=tooth JOIN (SELECT z.row_no, tooth AS t, sqrt(avg(pow(y/fit-1,2))) AS rms FROM {last} z JOIN o ON z.win=o.win AND abs(z.chan-tooth) BETWEEN 2 AND 4 GROUP BY 1, 2) r ON r.row_no=z.row_no AND r.t=tooth"""


@query("comb_background", _comb_sql())
def comb_background(spark, folder):
    """Parabolas in half-overlapping windows, six rounds of clipping."""
    out = basis.comb_background(cells(spark, folder), ["row_no"], "chan", "p", TEETH, 0, 63, lambda u: [F.lit(1.0), u, u * u], 3, width=24.0, step=12.0, exclude=F.col("chan").between(40, 42))
    return rounded(out, 5)


_VOTE = CELLS + ", c AS (SELECT * FROM cells WHERE chan%8=3), " + padded("", "c", "label, chan", "row_no", "row_no, x, p", 4, "a")


@query("vote_mask", f"""WITH {_VOTE}, b AS (SELECT label, chan, row_no, rn, cn, x-median(x) OVER {_roll('label, chan', 4)} AS rx, p-median(p) OVER {_roll('label, chan', 4)} AS rp FROM a),
r AS (SELECT * FROM b WHERE rn BETWEEN 1 AND cn), m AS (SELECT label, chan, median(rx) AS mx, median(rp) AS mp FROM r GROUP BY 1,2),
s AS (SELECT label, chan, 1.4826*median(abs(rx-mx)) AS sx, 1.4826*median(abs(rp-mp)) AS sp FROM r JOIN m USING (label, chan) GROUP BY 1,2),
v AS (SELECT label, row_no, sum((sx>=1e-12 AND abs(rx)>4*sx)::INT + (sp>=1e-12 AND abs(rp)>4*sp)::INT)::BIGINT AS votes FROM r JOIN s USING (label, chan) GROUP BY 1,2)
SELECT *, votes<1 AS clean FROM v""")
def vote_mask(spark, folder):
    return fits.vote_mask(cells(spark, folder), "label", "row_no", "chan", ["x", "p"], F.col("chan") % 8 == 3, clip=4.0)


_NOISE, _CLIP, _INFLATION = 0.06, 3.0, 1.12


def _segment_sql(rounds: int = 3) -> str:
    """CTEs up to seg: cells with model and inflation, the rounds unrolled."""
    steps = ["s AS MATERIALIZED (SELECT *, row_no%2 AS input, CAST(floor(row_no/200) AS BIGINT) AS segment, label<>9 AND NOT (row_no%2=1 AND row_no<200 AND row_no>2) AS ref FROM cells)",
             "c0 AS (SELECT input, segment, chan, avg(p) AS c FROM s WHERE ref AND p>0 GROUP BY ALL)"]
    for n in range(rounds + 1):
        at = f"k{n}"
        steps.append(f"{at} AS MATERIALIZED (SELECT s.*, c, p>0 AND c>0 AS on0 FROM s JOIN c{n} USING (input, segment, chan))")
        for g in (0, 1):
            steps.append(f"{at}g{g} AS (SELECT input, segment, row_no, CASE WHEN sum(p*c) FILTER (on{g})>0 THEN sum(p*c) FILTER (on{g})/sum(c*c) FILTER (on{g}) END AS g FROM {at}{'m' * g} GROUP BY ALL)")
            steps.append(f"{at}{'m' * (g + 1)} AS MATERIALIZED (SELECT k.* {'EXCLUDE (g)' if g else ''}, g.g, coalesce(on0 AND (p/(c*g.g)-1)/{_NOISE}<{_CLIP}, false) AS on{g + 1} FROM {at}{'m' * g} k JOIN {at}g{g} g USING (input, segment, row_no))")
        if n < rounds:
            steps.append(f"c{n + 1} AS (SELECT input, segment, chan, sum(p*g)/sum(g*g) AS c FROM {at}mm WHERE on2 AND ref GROUP BY ALL)")
    steps += [f"i AS (SELECT input, segment, chan, sum(g*g) FILTER (on2) AS kept, sum(g*g) AS everything, count_if(on2) AS n FROM {at}mm WHERE ref AND on0 GROUP BY ALL)",
              f"e AS (SELECT input, segment, sum(n)>count(*)+any_value(r) AS fitted FROM i JOIN (SELECT input, segment, count(DISTINCT row_no) AS r FROM {at}mm WHERE ref AND on0 GROUP BY ALL) USING (input, segment) GROUP BY ALL)",
              f"t AS (SELECT input, segment, row_no, sum(c*c) FILTER (on2) AS own, sum(c*c) FILTER (on0) AS whole FROM {at}mm GROUP BY ALL)",
              f"y AS (SELECT k.input, k.segment, k.row_no, k.chan, c*g AS m, fitted, sqrt((c*c/own+g*g/kept)/(c*c/whole+g*g/everything)) AS inflation FROM {at}mm k LEFT JOIN i USING (input, segment, chan) LEFT JOIN e USING (input, segment) JOIN t USING (input, segment, row_no))",
              f"seg AS MATERIALIZED (SELECT s.*, CASE WHEN fitted AND inflation<={_INFLATION} AND m>0 THEN m END AS model, inflation FROM s LEFT JOIN y USING (input, segment, row_no, chan))"]
    return CELLS + ", " + ", ".join(steps)


def _segments(spark, folder):
    return cells(spark, folder).withColumns({"input": F.col("row_no") % 2, "segment": F.floor(F.col("row_no") / 200), "freq": 35.0 + 3.125 * F.col("chan")})


def _reference():
    """Segment 0 of input 1 has too few reference rows for a fit."""
    return (F.col("label") != 9) & ~((F.col("row_no") % 2 == 1) & (F.col("row_no") < 200) & (F.col("row_no") > 2))


@query("segment_background", f"WITH {_segment_sql()} SELECT input, segment, row_no, chan, round(model,5) AS model, round(inflation,6) AS inflation FROM seg")
def segment_background(spark, folder):
    """Levels and gains in turn; cells of weak support and whole segments without enough rows are NULL."""
    out = fits.segment_background(_segments(spark, folder), ["input", "segment"], "row_no", "chan", "p", F.lit(_NOISE), _reference(), clip=_CLIP, max_inflation=_INFLATION)
    return out.select("input", "segment", "row_no", "chan", r6("model", 5).alias("model"), r6("inflation").alias("inflation"))


@query("segment_flags")
def segment_flags(spark, folder):
    c = _segments(spark, folder).withColumn("cross_score", 40 * F.abs("x"))
    return flagging.segment_flags(c, ["input", "segment"], "row_no", "chan", "freq", "p", F.lit(0.02), F.col("label") != 9, "cross_score")


@query("group_triggers")
def group_triggers(spark, folder):
    c = _segments(spark, folder).withColumns({"z": 30 * F.col("x"), "cross_score": 40 * F.abs("x"), "valid": F.col("label") != 9, "ref": F.col("label") != 9})
    cuts = flagging.Cuts(group=2.0, group_fraction=0.3, comb=3.0, comb_min_teeth=5, regions=((35.0, 235.0),))
    out = flagging.group_triggers(c, ["input", "segment"], "row_no", "chan", "freq", "z", "cross_score", "valid", "ref", cuts)
    return out.select("row_no", "chan", *[n for n in bits.REASON_BITS if n in out.columns])


#: Tones that rise with the label follow each other; a fifth of them doesn't.
_SIGNAL = "p-700+40*label*(chan//4%5<4)::INT"


def _signal():
    return F.col("p") - 700 + 40 * F.col("label") * (F.floor(F.col("chan") / 4) % 5 < 4).cast("int")


_COMB = series.Comb(list(range(0, 64, 4)), spacing=4, reach=24)


def _prune_sql(start: str, signal: str, least: float) -> str:
    """CTEs up to rounds (a round's dropped channel) and firsts, beginning with the channels that ``start`` selects."""
    nearest = "list_transform(list_sort(list_transform(list_filter(kept, lambda u: u<>t AND (u//4-t//4)%2=0 AND abs(u-t)<=24), lambda u: abs(u-t)*1000+u)), lambda z: z%1000)[1:2]"
    at = f"""(SELECT r, t, c FROM (SELECT r, t, {nearest} AS nb FROM (SELECT r, kept, unnest(kept) AS t FROM FROM_HERE)) n LEFT JOIN pair ON pair.i=t AND pair.j IS NOT DISTINCT FROM list_min(nb) AND pair.k IS NOT DISTINCT FROM CASE WHEN len(nb)=2 THEN list_max(nb) END)"""
    return f"""sig AS MATERIALIZED (SELECT row_no, chan, {signal} AS v, label<8 AS g FROM cells WHERE chan%4=0), fl AS (SELECT chan AS i, max(v)*1e-3 AS fl FROM sig GROUP BY 1), th AS (SELECT unnest({_COMB.teeth}) AS t),
ch AS (SELECT a.t AS i, b.t AS j, c.t AS k FROM th a JOIN th b ON a.t<>b.t AND (a.t//4-b.t//4)%2=0 AND abs(a.t-b.t)<=24 JOIN th c ON c.t>b.t AND a.t<>c.t AND (a.t//4-c.t//4)%2=0 AND abs(a.t-c.t)<=24 UNION ALL SELECT a.t, b.t, NULL FROM th a JOIN th b ON a.t<>b.t AND (a.t//4-b.t//4)%2=0 AND abs(a.t-b.t)<=24),
pair AS MATERIALIZED (SELECT i, j, k, CASE WHEN count(*)>=3 THEN corr(ln(greatest(a.v,fl)), ln(greatest((b.v+coalesce(c.v,b.v))/2,fl))) END AS c FROM ch JOIN fl USING (i) JOIN sig a ON a.chan=i AND a.g JOIN sig b ON b.chan=j AND b.row_no=a.row_no AND b.g LEFT JOIN sig c ON c.chan=k AND c.row_no=a.row_no WHERE k IS NULL OR c.g GROUP BY 1, 2, 3),
begun AS (SELECT 0 AS r, list(chan ORDER BY chan) AS kept FROM ({start})),
rounds AS (SELECT 0 AS r, kept, NULL::INT AS chan, NULL::DOUBLE AS c FROM begun UNION ALL SELECT r+1, list_filter(kept, lambda t: t<>w.t), w.t, CASE WHEN w.c>-1 THEN w.c END FROM (
  SELECT o.r, any_value(o.kept) AS kept, min({{'c': coalesce(x.c,-1.0), 't': x.t}}) AS w FROM rounds o JOIN {at.replace('FROM_HERE', 'rounds')} x ON x.r=o.r GROUP BY o.r) WHERE w.c<{least}),
firsts AS (SELECT t AS chan, c AS first_pass FROM {at.replace('FROM_HERE', 'begun')}),
pruned AS (SELECT t AS chan, first_pass, rounds.c AS at_drop, CAST(rounds.r AS BIGINT) AS drop_round, f.chan IS NOT NULL AND rounds.r IS NULL AS kept FROM th LEFT JOIN firsts f ON f.chan=t LEFT JOIN rounds ON rounds.chan=t)"""


@query("coherence_prune", f"""WITH RECURSIVE {CELLS}, {_prune_sql('SELECT t AS chan FROM th', _SIGNAL, 0.3)}
SELECT chan, round(first_pass,7) AS first_pass, round(at_drop,7) AS at_drop, drop_round, kept FROM pruned""")
def coherence_prune(spark, folder):
    """Tones dropped one by one until all that remain follow their neighbours."""
    found = series.coherences(cells(spark, folder), [], "row_no", "chan", _signal(), F.col("label") < 8, _COMB)
    return rounded(series.prune(found, [], "chan", _COMB, 0.3), 7)


@query("select_series", f"""WITH RECURSIVE {CELLS}, e AS (SELECT chan, 0.001+stddev_pop(x)/10 AS e, avg((label<8)::INT) AS good_fraction, quantile_cont(CASE WHEN label<8 THEN ({_SIGNAL})/1000 END,0.9) AS s FROM cells WHERE chan%4=0 GROUP BY 1),
q AS (SELECT chan, good_fraction, s/e AS isolation FROM e), {_prune_sql('SELECT chan FROM q WHERE good_fraction>=0.5 AND isolation>=40', _SIGNAL, 0.3)}
SELECT q.chan, round(good_fraction,7) AS good_fraction, round(isolation,7) AS isolation, round(first_pass,7) AS first_pass, round(at_drop,7) AS at_drop,
CASE WHEN good_fraction<0.5 THEN 'good_fraction' WHEN coalesce(isolation,-2)<40 THEN 'isolation' WHEN NOT kept THEN 'coherence' ELSE 'selected' END AS reason FROM q JOIN pruned USING (chan)""")
def select_series(spark, folder):
    c = cells(spark, folder)
    error = c.groupBy("chan").agg((0.001 + F.stddev_pop("x") / 10).alias("error"))
    out = series.select_series(c, "row_no", "chan", _signal() + 1000, F.lit(1000.0), F.col("label") < 8, error, _COMB, isolation_min=40.0, coherence_min=0.3)
    return rounded(out, 7)


@query("knn_residual", f"""WITH {SPECTRA}, g AS (SELECT row_no, 3*spec[1] AS az, 2*spec[2] AS el, spec[3] AS res FROM spectra WHERE label<>9),
p AS (SELECT a.row_no, b.res, row_number() OVER (PARTITION BY a.row_no ORDER BY pow(cos(a.az)-cos(b.az),2)+pow(sin(a.az)-sin(b.az),2)+pow(cos(a.el)-cos(b.el),2)+pow(sin(a.el)-sin(b.el),2), b.row_no) AS rn FROM g a JOIN g b ON a.row_no<>b.row_no),
l AS (SELECT row_no, median(res) AS m FROM p WHERE rn<=12 GROUP BY 1), h AS (SELECT row_no, res-m AS h FROM g JOIN l USING (row_no)), c AS (SELECT median(h) AS c FROM h), s AS (SELECT 1.4826*median(abs(h-c)) AS s FROM h, c)
SELECT spectra.row_no, coalesce(abs(h-c)>2.5*s, false) AS outlier FROM spectra LEFT JOIN h USING (row_no), c, s""")
def knn_residual(spark, folder):
    """Residuals against their twelve nearest directions, over whole spectra."""
    from dwellgrid.operators.neighbours import isolated_outliers
    e = F.col("spec")
    s = spectra(spark, folder).select("row_no", "label", (3 * e[0]).alias("az"), (2 * e[1]).alias("el"), e[2].alias("res"))
    out = isolated_outliers(s, "row_no", F.col("az"), F.col("el"), F.col("res"), F.col("label") != 9, 2.5)
    return out.select("row_no", "outlier")
