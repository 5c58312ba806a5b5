"""Queries over moving medians, neighbours and flags."""

from pyspark.sql import functions as F

from dwellgrid.catalog.aggregates import rounded
from dwellgrid.catalog.registry import query
from dwellgrid.catalog.views import CELLS, NODES, SAMPLES, cells, nodes, r6, samples, spectra
from dwellgrid.functions import arrays as A
from dwellgrid.operators import rolling as op


def padded(cte: str, source: str, keys: str, order: str, cols: str, half: int, name: str) -> str:
    """CTE ``name``: rows of ``source`` numbered per key with their end rows repeated."""
    k = f"PARTITION BY {keys}" if keys else ""
    return f"""{name}0 AS (SELECT {keys + ',' if keys else ''} {cols}, row_number() OVER ({k} ORDER BY {order}) AS rn, count(*) OVER ({k.replace('ORDER','')}) AS cn FROM {source}),
{name} AS (SELECT * FROM {name}0 UNION ALL SELECT * EXCLUDE (j) REPLACE (1-j AS rn) FROM {name}0, (SELECT unnest(range(1,{half + 1})) AS j) WHERE rn=1
 UNION ALL SELECT * EXCLUDE (j) REPLACE (cn+j AS rn) FROM {name}0, (SELECT unnest(range(1,{half + 1})) AS j) WHERE rn=cn)"""


def _roll(keys, half):
    k = f"PARTITION BY {keys}" if keys else ""
    return f"({k} ORDER BY rn ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"


_RM = (CELLS + ", " + padded("", "cells", "chan", "row_no", "row_no, x", 4, "a") + f""",
b AS (SELECT chan, row_no, x, rn, cn, x-median(x) OVER {_roll('chan', 4)} AS r FROM a), b1 AS (SELECT * FROM b WHERE rn BETWEEN 1 AND cn),
""" + padded("", "b1", "chan", "row_no", "row_no, x, r", 4, "c") + f""",
d AS (SELECT chan, row_no, x, r, rn, cn, median(abs(r)) OVER {_roll('chan', 4)} AS lm FROM c), d1 AS (SELECT * FROM d WHERE rn BETWEEN 1 AND cn)""")
_GM = """, m AS (SELECT chan, median(x) AS m FROM cells GROUP BY 1), g AS (SELECT chan, 1.4826*median(abs(x-m)) AS s FROM cells JOIN m USING (chan) GROUP BY 1)"""


@query("rolling_median_flag", f"""WITH {_RM}{_GM} SELECT chan, row_no, r > 2.5*greatest(1.4826*lm, 0.05*s) AS flag FROM d1 JOIN g USING (chan)""")
def rolling_median_flag(spark, folder):
    return op.rolling_median_flag(cells(spark, folder), ["chan"], ["row_no"], "x", 8, 2.5).select("chan", "row_no", "flag")


@query("rolling_mad", f"""WITH {_RM} SELECT chan, row_no, round(1.4826*lm,9) AS local_mad FROM d1""")
def rolling_mad(spark, folder):
    return rounded(op.rolling_mad(cells(spark, folder), ["chan"], ["row_no"], "x", 4).select("chan", "row_no", "local_mad"))


_TT = (CELLS + ", v AS (SELECT * FROM cells WHERE label<>1), " + padded("", "v", "chan", "row_no", "row_no, x", 4, "a") + f""",
b AS (SELECT chan, row_no, rn, cn, x-median(x) OVER {_roll('chan', 4)} AS r FROM a), b1 AS (SELECT * FROM b WHERE rn BETWEEN 1 AND cn),
m AS (SELECT chan, median(r) AS m FROM b1 GROUP BY 1), s AS (SELECT chan, 1.4826*median(abs(r-m)) AS s FROM b1 JOIN m USING (chan) GROUP BY 1),
tt AS (SELECT chan, row_no, abs(r)>2.5*s AS transient FROM b1 JOIN s USING (chan) UNION ALL SELECT chan, row_no, false FROM cells WHERE label=1)""")


@query("transient_track", f"WITH {_TT} SELECT chan, row_no, transient FROM tt")
def transient_track(spark, folder):
    return op.transient_track(cells(spark, folder), "chan", ["row_no"], "x", F.col("label") != 1, clip=2.5).select("chan", "row_no", "transient")


_PT = (CELLS + ", md AS (SELECT label, chan, median(x) AS med, count(*) AS n FROM cells WHERE row_no%5<>0 GROUP BY 1,2), " + padded("", "md", "label", "chan", "chan, med, n", 15, "a") + f""",
b AS (SELECT label, chan, n, rn, cn, med-median(med) OVER {_roll('label', 15)} AS resid FROM a), b1 AS (SELECT * FROM b WHERE rn BETWEEN 1 AND cn),
m AS (SELECT label, median(resid) AS m FROM b1 WHERE chan BETWEEN 8 AND 58 GROUP BY 1), s AS (SELECT label, 1.4826*median(abs(resid-m)) AS s FROM b1 JOIN m USING (label) WHERE chan BETWEEN 8 AND 58 GROUP BY 1)""")


@query("persistent_track", f"WITH {_PT} SELECT label, chan, round(resid,9) AS resid, chan BETWEEN 8 AND 58 AND n>=4 AND resid>1.5*s AS persistent FROM b1 JOIN s USING (label)")
def persistent_track(spark, folder):
    out = op.persistent_track(cells(spark, folder), ["label"], "chan", "x", F.col("row_no") % 5 != 0, F.col("chan").between(8, 58), clip=1.5)
    return rounded(out.select("label", "chan", "resid", "persistent"))


# mirrored copies of the five cells at each end, then a plain frame of 11
_MIRROR = CELLS + """, e AS (SELECT row_no, label, chan, x, chan AS pos FROM cells UNION ALL SELECT row_no, label, chan, x, -chan FROM cells WHERE chan BETWEEN 1 AND 5
 UNION ALL SELECT row_no, label, chan, x, 126-chan FROM cells WHERE chan BETWEEN 58 AND 62),
md AS (SELECT row_no, label, chan, pos, x-median(x) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS r FROM e),
rs AS (SELECT * FROM md WHERE pos=chan)"""


@query("median_flagger", f"""WITH {_MIRROR}, s AS (SELECT label, median(CASE WHEN r<>0 THEN abs(r) END) AS s FROM rs GROUP BY 1)
SELECT row_no, chan, CASE WHEN r=0 THEN false ELSE abs(r)>3*1.4826*s END AS flag FROM rs JOIN s USING (label)""")
def median_flagger(spark, folder):
    out = op.median_flagger(spectra(spark, folder), ["label"], "spec", 3.0)
    return out.select("row_no", F.posexplode("flags").alias("chan", "flag"))


def _mean_pass(src, k, out):
    return f"""{out}e AS (SELECT row_no, chan, p, w, chan AS pos FROM {src} UNION ALL SELECT row_no, chan, p, w, -1-chan FROM {src} WHERE chan<{k} UNION ALL SELECT row_no, chan, p, w, 127-chan FROM {src} WHERE chan>=64-{k}),
{out}f AS (SELECT row_no, chan, pos, p, w, sum(p*w) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)-p*w AS sp, sum(w) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)-w AS sw FROM {out}e),
{out} AS (SELECT row_no, chan, p, CASE WHEN sw>0 AND abs(p-sp/sw)>abs(sp/sw)*(30/p)*5 THEN 0.0 ELSE 1.0 END AS w FROM {out}f WHERE pos=chan)"""


@query("mean_flagger", f"""WITH {CELLS}, w0 AS (SELECT row_no, chan, p, 1.0 AS w FROM cells), {_mean_pass('w0', 3, 'w3')}, {_mean_pass('w3', 4, 'w4')}, {_mean_pass('w4', 5, 'w5')} SELECT row_no, chan, w=0 AS flag FROM w5""")
def mean_flagger(spark, folder):
    return op.mean_flagger(cells(spark, folder).select("row_no", "chan", "p"), ["row_no"], "chan", "p", F.lit(30.0), 5.0).select("row_no", "chan", "flag")


def clip_round(before: str, out: str, may: str = "chan%2=1", carry: str = "") -> str:
    """CTEs of one pass: median and scatter of the cells not flagged before, then the cells far off, of those that ``may`` be."""
    return (padded("", before, "chan", "row_no", f"row_no, p, f{carry}, CASE WHEN NOT f THEN p END AS v", 4, f"{out}a") + f""",
{out}b AS (SELECT chan, row_no, p, f{carry}, v, rn, cn, median(v) OVER {_roll('chan', 4)} AS m FROM {out}a), {out}c AS (SELECT chan, row_no, p, f{carry}, v, m FROM {out}b WHERE rn BETWEEN 1 AND cn),
""" + padded("", f"{out}c", "chan", "row_no", f"row_no, p, m{carry}, abs(v-m) AS a", 4, f"{out}d") + f""",
{out}e AS (SELECT chan, row_no, p, m{carry}, rn, cn, median(a) OVER {_roll('chan', 4)} AS d FROM {out}d),
{out} AS (SELECT chan, row_no, p{carry}, coalesce({may} AND m IS NOT NULL AND (p<0 OR abs(p-m)>3*greatest(1.4826*coalesce(d,0),1e-30) AND abs(p-m)>0.2*abs(m)),false) AS f FROM {out}e WHERE rn BETWEEN 1 AND cn)""")


@query("iterative_rolling_clip", f"""WITH {CELLS}, k0 AS (SELECT chan, row_no, p, false AS f FROM cells), {', '.join(clip_round(f'k{i}', f'k{i + 1}') for i in range(5))} SELECT chan, row_no, f AS outlier FROM k5""")
def iterative_rolling_clip(spark, folder):
    c = cells(spark, folder).withColumn("measured", F.col("chan") % 2 == 0)
    return op.iterative_clip(c, ["chan"], ["row_no"], "p", "measured", 9, 3.0, 0.2).select("chan", "row_no", "outlier")


_AC = (CELLS + ", ca AS (SELECT *, row_no*2+chan%2 AS ra FROM cells), " + padded("", "ca", "ra", "chan", "row_no, chan, p", 4, "a") + f""",
b AS (SELECT ra, row_no, chan, p, rn, cn, p-median(p) OVER {_roll('ra', 4)} AS r FROM a), b1 AS (SELECT * FROM b WHERE rn BETWEEN 1 AND cn),
""" + padded("", "b1", "ra", "chan", "row_no, chan, p, r", 4, "c") + f""",
d AS (SELECT ra, row_no, chan, p, r, rn, cn, median(abs(r)) OVER {_roll('ra', 4)} AS lm FROM c), m AS (SELECT ra, median(p) AS m FROM ca GROUP BY 1), g AS (SELECT ra, 1.4826*median(abs(p-m)) AS s FROM ca JOIN m USING (ra) GROUP BY 1),
h AS (SELECT row_no, chan, p, r>3*greatest(1.4826*lm,0.05*s) AS f FROM d JOIN g USING (ra) WHERE rn BETWEEN 1 AND cn), mc AS (SELECT chan, median(p) AS mc FROM cells GROUP BY 1),
fr AS (SELECT chan, avg(f::INT)>0.05 AND NOT bool_or(p>1.4*mc) AS ex FROM h JOIN mc USING (chan) GROUP BY 1)""")


@query("rolling_flag_across", f"WITH {_AC} SELECT row_no, chan, f AND NOT ex AS flag FROM h JOIN fr USING (chan)")
def rolling_flag_across(spark, folder):
    return op.rolling_flag_across(cells(spark, folder), "row_no", "chan", "p", 9, 3.0, 0.05, 0.05, 1.4).select("row_no", "chan", "flag")


@query("unbracketed_fills", f"""WITH {CELLS}, a AS (SELECT row_no, chan, x>-0.1 AS m, x>-0.1 AND chan BETWEEN 5 AND 60 AS an FROM cells)
SELECT row_no, chan, NOT m AND NOT (coalesce(lag(an) OVER w,false) AND coalesce(lead(an) OVER w,false)) AS unbracketed FROM a WINDOW w AS (PARTITION BY row_no ORDER BY chan)""")
def unbracketed_fills(spark, folder):
    c = cells(spark, folder).withColumn("m", F.col("x") > -0.1)
    return op.unbracketed(c, "row_no", "chan", "m", F.col("chan").between(5, 60)).select("row_no", "chan", "unbracketed")


_GROW = """WITH {cte}, f AS (SELECT row_no, chan, x>0.35 AS f FROM cells), a AS (SELECT *, bool_or(f) OVER (PARTITION BY chan ORDER BY row_no ROWS BETWEEN {t} PRECEDING AND {t} FOLLOWING) AS t FROM f)
SELECT row_no, chan, t OR bool_or({src}) OVER (PARTITION BY row_no ORDER BY chan ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS grown FROM a"""


@query("grow_flags", _GROW.format(cte=CELLS, t=1, k=1, src="f"))
def grow_flags(spark, folder):
    return op.grow_flags(cells(spark, folder).withColumn("f", F.col("x") > 0.35), "row_no", "chan", "f").select("row_no", "chan", "grown")


@query("guard_box", _GROW.format(cte=CELLS, t=2, k=1, src="t"))
def guard_box(spark, folder):
    return op.grow_flags(cells(spark, folder).withColumn("f", F.col("x") > 0.35), "row_no", "chan", "f", 2, 1, cross=False).select("row_no", "chan", "grown")


@query("second_difference", f"""WITH {CELLS} SELECT row_no, chan, round(x-(lag(x) OVER w+lead(x) OVER w)/2,9) AS d FROM cells WINDOW w AS (PARTITION BY row_no ORDER BY chan)""")
def second_difference(spark, folder):
    s = spectra(spark, folder)
    return rounded(s.select("row_no", F.posexplode(A.second_difference(F.col("spec"))).alias("chan", "d")))


@query("second_difference_cells", f"""WITH {CELLS} SELECT row_no, chan, round(x-(lag(x) OVER w+lead(x) OVER w)/2,9) AS d FROM cells WINDOW w AS (PARTITION BY row_no ORDER BY chan)""")
def second_difference_cells(spark, folder):
    return rounded(op.second_difference(cells(spark, folder).select("row_no", "chan", "x"), ["row_no"], "chan", "x", "d").drop("x"))


_RATE = """WITH {cte}, r AS (SELECT event_id, state, t, power AS v, lag(t) OVER w AS t0, lag(power) OVER w AS v0, lead(t) OVER w AS t1, lead(power) OVER w AS v1 FROM ev WINDOW w AS (PARTITION BY state ORDER BY t)),
d AS (SELECT event_id, 60*coalesce(((t1-t)*(v-v0)/(t-t0)+(t-t0)*(v1-v)/(t1-t))/(t1-t0),(v-v0)/(t-t0),(v1-v)/(t1-t)) AS rate FROM r)
SELECT event_id, round(rate,6) AS rate, CASE WHEN abs(rate)<0.5 THEN 'steady' WHEN rate>0 THEN 'heating' ELSE 'cooling' END AS kind FROM d"""


@query("classify_rate", _RATE.format(cte=SAMPLES))
def classify_rate(spark, folder):
    # its SQL orders by time alone, which leaves rows of one time as they are stored
    ev = samples(spark, folder, placed=True).select("event_id", "state", "t", "power", "source", "place")
    out = op.classify_rate(ev, ["state"], "t", "power", 0.5, ties=["source", "place"])
    return out.select("event_id", r6("rate").alias("rate"), "kind")


@query("neighbour_outliers", f"""WITH {CELLS}, n AS (SELECT row_no, chan, p, label, list_filter([CASE WHEN lag(label,2) OVER w=label THEN lag(p,2) OVER w END, CASE WHEN lag(label) OVER w=label THEN lag(p) OVER w END,
 CASE WHEN lead(label) OVER w=label THEN lead(p) OVER w END, CASE WHEN lead(label,2) OVER w=label THEN lead(p,2) OVER w END], lambda q: q IS NOT NULL) AS nb FROM (SELECT row_no, chan, p, CAST(row_no//5 AS INT)%2 AS label FROM cells) WINDOW w AS (PARTITION BY chan ORDER BY row_no))
SELECT row_no, count(*) FILTER (WHERE len(nb)>=2 AND abs(p/list_median(nb)-1)>0.2) AS off, count(*) FILTER (WHERE len(nb)>=2 AND abs(p/list_median(nb)-1)>0.2)>12 AS drop FROM n GROUP BY 1""")
def neighbour_outliers(spark, folder):
    c = cells(spark, folder).withColumn("lab", F.floor(F.col("row_no") / 5) % 2)
    return op.neighbour_outliers(c, "row_no", "lab", "chan", "p", 0.2, 12)


@query("interpolation_loo", f"""WITH {NODES}, l AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0, lag(label) OVER w AS l0, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lead(label) OVER w AS l1 FROM nodes WINDOW w AS (ORDER BY t)),
e AS (SELECT abs(((1-(t-t0)/(t1-t0))*v0+(t-t0)/(t1-t0)*v1)/v-1) AS a, abs(CASE WHEN (t-t0)/(t1-t0)<=0.5 THEN v0 ELSE v1 END/v-1) AS b FROM l WHERE l0=label AND l1=label AND t1-t0<=172800)
SELECT count(*) AS n, round(median(a),9) AS median_linear, round(median(b),9) AS median_nearest, round(avg((a<b)::INT),9) AS linear_better FROM e""")
def interpolation_loo(spark, folder):
    return rounded(op.interpolation_loo(nodes(spark, folder), [], "t", "label", "v", 172800.0))


@query("gap_background", f"""WITH {CELLS}, a AS (SELECT row_no, chan, CASE WHEN chan%8<>3 THEN p END AS v FROM cells), b AS (SELECT row_no, chan, lag(v,4) OVER w AS lo, lead(v,4) OVER w AS hi FROM a WINDOW w AS (PARTITION BY row_no ORDER BY chan))
SELECT row_no, chan, round(coalesce((lo+hi)/2,lo,hi),6) AS background, round(abs(lo-hi)/(lo+hi),9) AS asymmetry FROM b""")
def gap_background(spark, folder):
    out = op.gap_background(cells(spark, folder), "row_no", "chan", "p", F.col("chan") % 8 == 3, 4)
    return out.select("row_no", "chan", r6("background").alias("background"), r6("asymmetry", 9).alias("asymmetry"))


@query("row_fraction_events", f"""WITH {CELLS} SELECT row_no, avg(CASE WHEN chan BETWEEN 10 AND 50 THEN (x>0.1)::INT END)>0.25 AS broadband,
 avg(CASE WHEN chan BETWEEN 22 AND 27 THEN (x>0.1)::INT END)>0.1 AND avg(CASE WHEN chan BETWEEN 13 AND 21 THEN (x>0.1)::INT END)>0.1 AS scatter FROM cells GROUP BY 1""")
def row_fraction_events(spark, folder):
    c, ch = cells(spark, folder).withColumn("f", F.col("x") > 0.1), F.col("chan")
    return op.row_events(c, "row_no", "f", ch.between(10, 50), ch.between(22, 27), ch.between(13, 21), 0.25, 0.1)
