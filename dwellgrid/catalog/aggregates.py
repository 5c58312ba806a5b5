"""Queries over aggregates."""

from pyspark.sql import functions as F

from dwellgrid.catalog.registry import query
from dwellgrid.catalog.timejoins import POLICY_SQL, policy_rows
from dwellgrid.catalog.views import CELLS, INTEG, SAMPLES, cells, r6, samples, spectra, table
from dwellgrid.operators import aggregates as op
from dwellgrid.operators import segments as sg


def rounded(df, digits=9, skip=()):
    """Round every double column."""
    kinds = dict(df.dtypes)
    return df.select(*[r6(c, digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns])


@query("rows_per_file", f"""WITH {SAMPLES} SELECT file, count(*) AS rows FROM ev GROUP BY 1""")
def rows_per_file(spark, folder):
    return op.rows_per_file(samples(spark, folder), "file", ["t"])


@query("state_counts", f"""WITH {SAMPLES} SELECT state, count(*) AS n FROM ev GROUP BY 1""")
def state_counts(spark, folder):
    return op.state_counts(samples(spark, folder), "state")


@query("block_average", f"""WITH {INTEG} SELECT file, CAST(floor(row_no/5) AS BIGINT) AS block, round(avg(t),2) AS t, round(avg(power),7) AS power, arg_min(state,row_no) AS state
FROM integ GROUP BY 1,2 HAVING count(*)=5""")
def block_average(spark, folder):
    out = op.block_average(samples(spark, folder), "file", ["t", "event_id"], 5, ["t", "power"], ["state"])
    return out.select("file", "block", r6("t", 2).alias("t"), r6("power", 7).alias("power"), "state")


@query("block_remainder", f"""WITH {SAMPLES} SELECT file, count(*)%5 AS dropped FROM ev GROUP BY 1""")
def block_remainder(spark, folder):
    return op.block_remainder(samples(spark, folder), "file", 5)


@query("mean_spectrum", f"""WITH {CELLS} SELECT label, chan, round(avg(x),9) AS x FROM cells GROUP BY 1,2""")
def mean_spectrum(spark, folder):
    m = op.mean_spectrum(spectra(spark, folder), ["label"], "spec")
    return m.select("label", F.posexplode("spec").alias("chan", "x")).select("label", "chan", r6("x", 9).alias("x"))


@query("weighted_mean", """SELECT l_suppkey, round(sum(CASE WHEN l_discount>0 THEN l_extendedprice*l_discount END)/nullif(sum(CASE WHEN l_discount>0 THEN l_discount END),0),5) AS mean,
 round(sum(CASE WHEN l_discount>0 AND l_returnflag<>'R' AND l_extendedprice>=0 THEN l_extendedprice*l_discount END)/nullif(sum(CASE WHEN l_discount>0 AND l_returnflag<>'R' AND l_extendedprice>=0 THEN l_discount END),0),5) AS masked FROM lineitem GROUP BY 1""")
def weighted_mean(spark, folder):
    x, w = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        r6(op.weighted_mean(x, w), 5).alias("mean"), r6(op.masked_mean(x, w, F.col("l_returnflag") == "R"), 5).alias("masked"))


# dwells over the cell table: rows of a label less than 15 row numbers apart
_DWELL = CELLS + """, rws AS (SELECT DISTINCT row_no, label FROM cells), dl AS (SELECT *, row_no-lag(row_no) OVER (PARTITION BY label ORDER BY row_no) AS g FROM rws),
dw AS (SELECT row_no, label, sum(CASE WHEN g>15 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY row_no) AS dwell FROM dl),
dp AS (SELECT *, row_number() OVER (PARTITION BY label,dwell ORDER BY row_no)-1 AS pos, 1.0+row_no%3 AS w FROM dw)"""


def _dwells(spark, folder):
    s = spectra(spark, folder).withColumn("t", F.col("row_no").cast("double"))
    d = sg.dwells(s, "label", "t", [], 15.0)
    return d.withColumn("w", 1.0 + F.col("row_no") % 3)


@query("dwell_means", f"""WITH {_DWELL} SELECT label, CAST(dwell AS BIGINT) AS dwell, chan, round(sum(CASE WHEN x>=0 THEN x*w END)/nullif(sum(CASE WHEN x>=0 THEN w END),0),9) AS mean
FROM cells JOIN dp USING (row_no,label) WHERE pos>=1 GROUP BY 1,2,3""")
def dwell_means(spark, folder):
    c = _dwells(spark, folder).select("label", "dwell", "pos_in_dwell", "w", F.posexplode("spec").alias("chan", "x"))
    out = op.dwell_means(c, ["label", "dwell"], "chan", "x", "w", "pos_in_dwell", F.col("x") < 0, F.lit(False), 1)
    return rounded(out)


@query("dwell_rows", f"""WITH {_DWELL} SELECT label, CAST(dwell AS BIGINT) AS dwell, round(sum(row_no*w)/sum(w),9) AS t, count(*) AS n FROM dp WHERE pos>=1 GROUP BY 1,2""")
def dwell_rows(spark, folder):
    return rounded(op.dwell_rows(_dwells(spark, folder), ["label", "dwell"], "t", "w", "pos_in_dwell", 1, []))


@query("block_stats", f"""WITH {CELLS} SELECT label, chan, round(median(x),9) AS value FROM cells WHERE x>-0.3 GROUP BY 1,2""")
def block_stats(spark, folder):
    return rounded(op.block_stats(cells(spark, folder).where("x > -0.3"), ["label"], "chan", "x"))


@query("block_stats_mean", f"""WITH {CELLS} SELECT label, chan, round(avg(x),9) AS value FROM cells WHERE x>-0.3 GROUP BY 1,2""")
def block_stats_mean(spark, folder):
    return rounded(op.block_stats(cells(spark, folder).where("x > -0.3"), ["label"], "chan", "x", stat="mean"))


@query("visit_blocks", f"""WITH {SAMPLES}, l AS (SELECT *, lag(state) OVER w AS ps, t-lag(t) OVER w AS g FROM ev WINDOW w AS (ORDER BY t,event_id)),
b AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps<>state OR g>600 THEN 1 ELSE 0 END) OVER (ORDER BY t,event_id)-1 AS block FROM l)
SELECT CAST(block AS BIGINT) AS block, state, round(avg(t)/7.3,3) AS t, min(t) AS t_start, max(t) AS t_stop, count(*) AS n, round(avg(power),7) AS t_load FROM b WHERE power>2 GROUP BY 1,2""")
def visit_blocks(spark, folder):
    b = sg.switch_blocks(samples(spark, folder), "state", "t", ["event_id"], 600.0)
    out = op.block_times(b.where("power > 2"), ["block", "state"], "t", "power")
    return out.select("block", "state", r6(F.col("t") / 7.3, 3).alias("t"), "t_start", "t_stop", "n", r6("t_load", 7).alias("t_load"))


@query("visit_log", """WITH v AS (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS regime FROM orders GROUP BY 1)
SELECT count(*) AS found, count(*) FILTER (WHERE n<8) AS dropped_partial, count(*) FILTER (WHERE n>=8 AND regime NOT IN ('1-URGENT','2-HIGH')) AS dropped_regime, count(*) FILTER (WHERE n>=8 AND regime IN ('1-URGENT','2-HIGH')) AS kept FROM v""")
def visit_log(spark, folder):
    v = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("regime"))
    return op.visit_log(v, "n", "regime", 8, ["1-URGENT", "2-HIGH"])


_MAD = """WITH {cte}, m AS (SELECT {k} median(x) AS m FROM cells {g}), d AS (SELECT {k} m, median(abs(x-m)) AS s FROM cells {j} GROUP BY {gk} m)
SELECT {k} round(m,9) AS center, round(1.4826*s,9) AS scale FROM d"""


def _mad(spark, folder, keys):
    from dwellgrid.operators.quantiles import with_mad
    return rounded(with_mad(cells(spark, folder), keys, F.col("x"), "center", "scale").select(*keys, "center", "scale").distinct())


@query("mad_time", _MAD.format(cte=CELLS, k="chan,", g="GROUP BY chan", j="JOIN m USING (chan)", gk="chan,"))
def mad_time(spark, folder):
    return _mad(spark, folder, ["chan"])


@query("state_quartiles_sliced", f"""WITH {SAMPLES} SELECT state, count(*) AS n, round(quantile_cont(power,0.25),9) AS lower, round(median(power),9) AS middle, round(quantile_cont(power,0.75),9) AS upper FROM ev GROUP BY 1""")
def state_quartiles_sliced(spark, folder):
    """By brackets and counts, the way of groups beyond the limit."""
    from dwellgrid.operators.quantiles import quantiles
    return rounded(quantiles(samples(spark, folder), ["state"], F.col("power"), {"lower": 0.25, "middle": 0.5, "upper": 0.75}, limit=100))


@query("mad_channel", _MAD.format(cte=CELLS, k="row_no,", g="GROUP BY row_no", j="JOIN m USING (row_no)", gk="row_no,"))
def mad_channel(spark, folder):
    return _mad(spark, folder, ["row_no"])


@query("mad_all", _MAD.format(cte=CELLS, k="", g="", j="CROSS JOIN m", gk=""))
def mad_all(spark, folder):
    return _mad(spark, folder, [])


@query("center_scale_floor", f"""WITH {CELLS}, c AS (SELECT chan, CASE WHEN label<>chan%10 THEN 10*x END AS z FROM cells), m AS (SELECT chan, median(z) AS m FROM c GROUP BY 1),
d AS (SELECT chan, m, median(abs(z-m)) AS s FROM c JOIN m USING (chan) GROUP BY 1,2) SELECT chan, round(coalesce(m,0),9) AS center, round(greatest(coalesce(1.4826*s,1),1),9) AS scale FROM d""")
def center_scale_floor(spark, folder):
    z = F.when(F.col("label") != F.col("chan") % 10, 10 * F.col("x"))
    return rounded(op.mad_scale(cells(spark, folder), ["chan"], z).select("chan", "center", "scale").distinct())


@query("waterfall_stats", f"""WITH {CELLS}, c AS (SELECT label, row_no, chan, CASE WHEN abs(x)<0.02 OR label=3 AND row_no%2=0 THEN 0 ELSE abs(x) END AS m, abs(x)>0.3 AS f FROM cells),
r AS (SELECT label, count(*) AS ntimes, count(*) FILTER (WHERE mx=0) AS n_zero_rows FROM (SELECT label,row_no,max(m) AS mx FROM c GROUP BY 1,2) GROUP BY 1),
p AS (SELECT label, count(*) AS nchan, arg_max(chan,(mm,-chan)) AS peak_chan FROM (SELECT label,chan,avg(m) AS mm FROM c GROUP BY 1,2) GROUP BY 1),
a AS (SELECT label, avg(CASE WHEN m=0 THEN 1.0 ELSE 0.0 END) AS zero_frac, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) AS flag_frac, max(m) AS max_power, median(CASE WHEN m>0 THEN m END) AS med FROM c GROUP BY 1)
SELECT label, ntimes, nchan, n_zero_rows, peak_chan, round(zero_frac,9) AS zero_frac, round(flag_frac,9) AS flag_frac, round(max_power,9) AS max_power, round(med,9) AS med_power, round(10*log10(max_power/med),9) AS dyn_range_db
FROM a JOIN r USING (label) JOIN p USING (label)""")
def waterfall_stats(spark, folder):
    zero = (F.abs("x") < 0.02) | ((F.col("label") == 3) & (F.col("row_no") % 2 == 0))
    c = cells(spark, folder).withColumn("m", F.when(zero, 0.0).otherwise(F.abs("x")))
    return rounded(op.waterfall_stats(c, ["label"], "row_no", "chan", "m", F.abs("x") > 0.3))


@query("occupancy_broadcast", f"""WITH {CELLS}, f AS (SELECT row_no, chan, abs(x)>0.2 AS f FROM cells), a AS (SELECT *, avg(f::INT) OVER (PARTITION BY chan) AS c, avg(f::INT) OVER (PARTITION BY row_no) AS r FROM f)
SELECT row_no, chan, f OR c>0.12 OR r>0.2 AS flag FROM a""")
def occupancy_broadcast(spark, folder):
    c = cells(spark, folder).withColumn("flag", F.abs("x") > 0.2)
    return op.occupancy_broadcast(c, "row_no", "chan", "flag", 0.2, 0.12).select("row_no", "chan", "flag")


FLAGGED = CELLS + """, fl AS (SELECT row_no, label, chan, x, 4.0*chan AS f, CASE WHEN label=0 THEN 1 ELSE 0 END | CASE WHEN x<-0.35 THEN 128 WHEN x>0.3 AND chan BETWEEN 22 AND 27 THEN 8
 WHEN x>0.3 AND chan%8=0 THEN 4 WHEN x>0.3 AND row_no%7=0 THEN 16 WHEN x>0.3 AND chan=34 THEN 32 WHEN x>0.25 THEN 64 ELSE 0 END AS flags,
 CASE WHEN chan<13 THEN 'low' WHEN chan<23 THEN 'dtv' WHEN chan<27 THEN 'fm' ELSE 'high' END AS band FROM cells)"""


def flagged(spark, folder):
    c, x, ch = cells(spark, folder), F.col("x"), F.col("chan")
    bit = (F.when(x < -0.35, 128).when((x > 0.3) & ch.between(22, 27), 8).when((x > 0.3) & (ch % 8 == 0), 4)
           .when((x > 0.3) & (F.col("row_no") % 7 == 0), 16).when((x > 0.3) & (ch == 34), 32).when(x > 0.25, 64).otherwise(0))
    band = F.when(ch < 13, "low").when(ch < 23, "dtv").when(ch < 27, "fm").otherwise("high")
    return c.withColumn("flags", bit.bitwiseOR(F.when(F.col("label") == 0, 1).otherwise(0))).withColumn("band", band)


_SUMS = ", ".join(f"round(count(*) FILTER (WHERE flags&129=0 AND flags&{m}<>0)/greatest(count(*) FILTER (WHERE flags&129=0),1),9) AS frac_{n}"
                  for n, m in {"rfi": 124, "self": 4, "ms": 8, "airplane": 16, "orbcomm": 32, "unknown": 64}.items())


@query("flag_summary", f"""WITH {FLAGGED} SELECT label, CAST(row_no%3 AS BIGINT) AS input, CASE WHEN grouping(band)=1 THEN 'all' ELSE band END AS band, count(*) FILTER (WHERE flags&129=0) AS n_sky,
 count(*) FILTER (WHERE flags&1<>0) AS n_cal, count(*) FILTER (WHERE flags&128<>0) AS n_overflow, {_SUMS} FROM fl GROUP BY GROUPING SETS ((label,row_no%3),(label,row_no%3,band))""")
def flag_summary(spark, folder):
    f = flagged(spark, folder).withColumn("input", F.col("row_no") % 3)
    return rounded(op.flag_summary(f, "label", "input", "band", "flags"))


@query("comb_phase", f"""WITH {CELLS}, s AS (SELECT row_no, chan%8 AS ph, median(abs(x)) AS s FROM cells GROUP BY 1,2), b AS (SELECT row_no, median(CASE WHEN abs(x)>0 THEN abs(x) END) AS b FROM cells GROUP BY 1),
t AS (SELECT row_no, arg_max(ph,(s,-ph)) AS ph, max(s) AS s FROM s GROUP BY 1) SELECT row_no, coalesce(CASE WHEN s/b>=1.6 THEN ph END,-1)::INT AS phase, round(s/b,9) AS excess FROM t JOIN b USING (row_no)""")
def comb_phase(spark, folder):
    out = op.comb_phase(cells(spark, folder), ["row_no"], "chan", "x", 8, 1.6)
    return rounded(out.withColumn("phase", F.coalesce("phase", F.lit(-1))))


@query("normalize_by_mean", f"""WITH {CELLS}, m AS (SELECT chan, avg(CASE WHEN label<>2 THEN p END) AS m FROM cells GROUP BY 1) SELECT row_no, chan, round(p/m,9) AS p FROM cells JOIN m USING (chan)""")
def normalize_by_mean(spark, folder):
    return rounded(op.normalize_by_mean(cells(spark, folder), "chan", "p", F.col("label") != 2).select("row_no", "chan", "p"))


@query("score_splits", f"""WITH {CELLS}, d AS (SELECT chan, CASE label%3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, p AS d, 1000+900*x AS m FROM cells WHERE x>-0.4)
SELECT chan, CASE WHEN grouping(split)=1 THEN 'all' ELSE split END AS split, count(*) AS n, round(sqrt(sum((d-m)*(d-m))/sum(d*d)),9) AS fractional_rms,
 round(1-sum((d-m)*(d-m))/(count(*)*var_pop(d)),9) AS r_squared, round(avg(d-m),6) AS mean_residual FROM d GROUP BY GROUPING SETS ((chan,split),(chan))""")
def score_splits(spark, folder):
    k = F.col("label") % 3
    c = cells(spark, folder).withColumn("split", F.when(k == 0, "train").when(k == 1, "validation").otherwise("test")).withColumn("m", 1000 + 900 * F.col("x"))
    out = op.score_splits(c, "chan", "split", "p", "m", F.col("x") > -0.4)
    return out.select("chan", "split", "n", r6("fractional_rms", 9).alias("fractional_rms"), r6("r_squared", 9).alias("r_squared"), r6("mean_residual").alias("mean_residual"))


@query("nonneg_gain", f"""WITH {CELLS} SELECT chan, round(greatest(sum(CASE WHEN label<6 THEN x*(x+0.01*label-0.2) END)/greatest(sum(CASE WHEN label<6 THEN x*x END),1e-30),0),9) AS gain FROM cells GROUP BY 1""")
def nonneg_gain(spark, folder):
    x = F.col("x")
    return rounded(cells(spark, folder).groupBy("chan").agg(op.nonneg_gain(x, x + 0.01 * F.col("label") - 0.2, F.col("label") < 6).alias("gain")))


@query("isolation", f"""WITH {CELLS}, e AS (SELECT chan, 0.01+stddev_pop(x) AS e FROM cells GROUP BY 1), s AS (SELECT chan, count(CASE WHEN label<8 THEN 1 END) AS n, quantile_cont(CASE WHEN label<8 THEN (p-1000)/1000 END,0.9) AS s FROM cells GROUP BY 1)
SELECT chan, n, round(s,9) AS signal, round(s/e,7) AS isolation FROM s JOIN e USING (chan)""")
def isolation(spark, folder):
    c = cells(spark, folder)
    error = c.groupBy("chan").agg((0.01 + F.stddev_pop("x")).alias("error"))
    out = op.isolation(c, "chan", F.col("p"), F.lit(1000.0), F.col("label") < 8, error)
    return out.select("chan", "n", r6("signal", 9).alias("signal"), r6("isolation", 7).alias("isolation"))


@query("residual_audit", f"""WITH {CELLS}, c AS (SELECT row_no, p-(1000+10*label) AS r, abs(p-(1000+10*label))>0.2*abs(1000+10*label) AS off FROM cells), r AS (SELECT row_no, median(r) AS m, count(*) FILTER (WHERE off) AS k, count(*) AS n FROM c GROUP BY 1)
SELECT count(*) AS rows, round(sum(k)/sum(n),9) AS fraction_off, count(*) FILTER (WHERE k>9) AS rows_off, round(median(m),6) AS median, round(quantile_cont(abs(m),0.95),6) AS p95_abs, round(max(abs(m)),6) AS max_abs FROM r""")
def residual_audit(spark, folder):
    out = op.residual_audit(cells(spark, folder), "row_no", 1000 + 10 * F.col("label"), F.col("p"), 0.2, 9)
    return out.select("rows", r6("fraction_off", 9).alias("fraction_off"), "rows_off", *[r6(c).alias(c) for c in ("median", "p95_abs", "max_abs")])


@query("coverage", f"""WITH {CELLS}, r AS (SELECT row_no, count(*) AS n, count(*) FILTER (WHERE abs(x)<0.3) AS k FROM cells GROUP BY 1)
SELECT count(*) AS rows, round(sum(k)/sum(n),9) AS cell_fraction, count(*) FILTER (WHERE k/n>=0.99) AS rows_calibrated FROM r""")
def coverage(spark, folder):
    return rounded(op.coverage(cells(spark, folder), "row_no", F.abs("x") < 0.3))


@query("gross_excursions", f"""WITH {CELLS}, r AS (SELECT chan, quantile_cont(CASE WHEN label<>5 AND x>0 THEN x END,0.99) AS a, quantile_cont(CASE WHEN label<>5 THEN abs(x) END,0.99) AS b FROM cells GROUP BY 1)
SELECT row_no, bool_or(label<>5 AND (x>1.2*coalesce(a,b) OR x<-1.1*coalesce(a,b))) AS flagged FROM cells JOIN r USING (chan) GROUP BY 1""")
def gross_excursions(spark, folder):
    return op.gross_excursions(cells(spark, folder), "row_no", "chan", "x", F.col("label") != 5, 1.2, 1.1)


@query("fuse_angles", """WITH a AS (SELECT event_id, CASE WHEN event_type<>'error' THEN value-360*floor(value/360) END AS a, CASE WHEN event_type<>'signup' THEN value+20-360*floor((value+20)/360) END AS b FROM events)
SELECT event_id, round(coalesce(degrees(atan2(0.7*sin(radians(a))+0.3*sin(radians(b)),0.7*cos(radians(a))+0.3*cos(radians(b)))),a,b),6) AS az FROM a""")
def fuse_angles(spark, folder):
    ev = table(spark, folder, "events")
    a = F.when(F.col("event_type") != "error", F.pmod("value", F.lit(360.0)))
    b = F.when(F.col("event_type") != "signup", F.pmod(F.col("value") + 20, F.lit(360.0)))
    return ev.select("event_id", r6(op.fused_angle(a, b, 0.7)).alias("az"))


@query("slip", """SELECT user_id, round(median(value-event_id%50),6) AS slip FROM events GROUP BY 1""")
def slip(spark, folder):
    from dwellgrid.operators.quantiles import quantiles
    ev = table(spark, folder, "events")
    return quantiles(ev, ["user_id"], F.col("value") - F.col("event_id") % 50, {"slip": 0.5}).select("user_id", r6("slip").alias("slip"))


@query("reject_summary", f"""WITH {POLICY_SQL}, f AS (SELECT rule, file, count(*) AS n FROM policy WHERE status='reject' GROUP BY 1,2) SELECT rule, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, min(file) AS first_file FROM f GROUP BY 1""")
def reject_summary(spark, folder):
    return op.reject_summary(policy_rows(spark, folder), "file", "rule", "status")


@query("run_totals", f"""WITH {FLAGGED} SELECT label, count(*) AS cells, round(count(*) FILTER (WHERE flags&32255<>0)/count(*),9) AS excluded, round(count(*) FILTER (WHERE flags&12404<>0)/count(*),9) AS interference, round(count(*) FILTER (WHERE x>-0.2)/count(*),9) AS supported FROM fl GROUP BY 1""")
def run_totals(spark, folder):
    return rounded(op.run_totals(flagged(spark, folder), ["label"], "flags", F.col("x") > -0.2))


@query("negative_fraction", f"""WITH {CELLS} SELECT chan, round(count(*) FILTER (WHERE x<0)/count(*),9) AS negative FROM cells GROUP BY 1""")
def negative_fraction(spark, folder):
    return rounded(op.negative_fraction(cells(spark, folder), "chan", "x"))


@query("overflow_top_channels", f"""WITH {CELLS} SELECT chan::VARCHAR AS chan, CAST(sum(CAST(round(-10*x) AS BIGINT)) AS BIGINT) AS wrapped FROM cells WHERE x<-0.3 AND label IN (1,2,4) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def overflow_top_channels(spark, folder):
    s = spectra(spark, folder).where("label IN (1,2,4)")
    entries = F.filter(F.transform("spec", lambda x, i: F.struct(i.cast("string").alias("k"), F.round(-10 * x).cast("bigint").alias("v"), x.alias("x"))), lambda e: e["x"] < -0.3)
    return op.overflow_top(s.select(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["v"]))).alias("m")), "m")


@query("tooth_contrast", f"""WITH {CELLS}, r AS (SELECT label, chan, median(x) AS r FROM cells GROUP BY 1,2), m AS (SELECT label, median(r) AS m FROM r GROUP BY 1), s AS (SELECT label, 1.4826*median(abs(r-m)) AS s FROM r JOIN m USING (label) GROUP BY 1),
p AS (SELECT label, ph, median(CASE WHEN chan%4=ph THEN r END) AS a, median(CASE WHEN chan%4<>ph THEN r END) AS b FROM r, (SELECT unnest(range(0,4)) AS ph) GROUP BY 1,2), c AS (SELECT label, ph, (a-b)/s AS c FROM p JOIN s USING (label))
SELECT label, round(max(c),9) AS contrast, arg_max(ph,(c,-ph))::DOUBLE AS phase FROM c GROUP BY 1""")
def tooth_contrast(spark, folder):
    r = op.block_stats(cells(spark, folder), ["label"], "chan", "x")
    return rounded(op.tooth_contrast(r, ["label"], "value", op.locked_teeth(F.col("chan"), 4)))


@query("comb_present", f"""WITH {CELLS}, d AS (SELECT row_no, chan, x-(lag(x) OVER w+lead(x) OVER w)/2 AS d FROM cells WINDOW w AS (PARTITION BY row_no ORDER BY chan)), b AS (SELECT * FROM d WHERE chan>=4 AND chan<60),
m AS (SELECT row_no, median(d) AS m FROM b GROUP BY 1), s AS (SELECT row_no, 1.4826*median(abs(d-m)) AS s FROM b JOIN m USING (row_no) GROUP BY 1)
SELECT row_no, count(*) FILTER (WHERE d>1.5*s) AS tones, count(*) FILTER (WHERE d>1.5*s)>=4 AS present FROM b JOIN s USING (row_no) GROUP BY 1""")
def comb_present(spark, folder):
    return op.comb_present(cells(spark, folder), ["row_no"], "chan", "x", 4, 60, 1.5, 4)


@query("line_fit_per_channel", f"""WITH {CELLS}, d AS (SELECT chan, row_no/100.0 AS xx, p AS yy, 100.0 AS s FROM cells WHERE label<7),
f AS (SELECT chan, count(*) AS n, regr_slope(yy,xx) AS b, regr_intercept(yy,xx) AS a, regr_sxx(yy,xx) AS sxx, regr_syy(yy,xx) AS syy, regr_sxy(yy,xx) AS sxy, avg(s*s) AS ss FROM d GROUP BY 1)
SELECT chan, n, round(a,5) AS a, round(b,5) AS b, round(sqrt(greatest(syy-b*sxy,0)/(n-2)/sxx),6) AS b_error, round(greatest(syy-b*sxy,0)/n/ss,6) AS chi2 FROM f""")
def line_fit_per_channel(spark, folder):
    out = op.line_fit(cells(spark, folder), ["chan"], F.col("row_no") / 100.0, F.col("p"), F.lit(100.0), F.col("label") < 7)
    return out.select("chan", "n", r6("a", 5).alias("a"), r6("b", 5).alias("b"), r6("b_error").alias("b_error"), r6("chi2").alias("chi2"))
