"""Queries over visits, dwells, blocks, batches and other runs."""

from pyspark.sql import functions as F

from dwellgrid.catalog.registry import query
from dwellgrid.catalog.views import CELLS, SAMPLES, cells, r6, samples, table
from dwellgrid.operators import segments as op

_TIMED = SAMPLES + """, tv AS (SELECT event_id, CASE WHEN power>=1 THEN t END AS t, state, power FROM ev)"""


def _timed(spark, folder):
    return samples(spark, folder).select("event_id", F.when(F.col("power") >= 1, F.col("t")).alias("t"), "state", "power")


_VISITS = f"""WITH {_TIMED}, l AS (SELECT *, t-lag(t) OVER (ORDER BY t,event_id) AS g FROM tv WHERE t IS NOT NULL)
SELECT event_id, CAST(sum(CASE WHEN g>300 THEN 1 ELSE 0 END) OVER (ORDER BY t,event_id) AS BIGINT) AS visit FROM l
UNION ALL SELECT event_id, -1 FROM tv WHERE t IS NULL"""


@query("visits", _VISITS)
def visits(spark, folder):
    return op.visits(_timed(spark, folder), "t", ["event_id"], 300.0).select("event_id", "visit")


@query("visits_sliced", _VISITS)
def visits_sliced(spark, folder):
    """The same by slices, the way of groups beyond the limit."""
    return op.visits(_timed(spark, folder), "t", ["event_id"], 300.0, limit=100).select("event_id", "visit")


@query("dwells", f"""WITH {_TIMED}, l AS (SELECT *, t-lag(t) OVER (PARTITION BY state ORDER BY t,event_id) AS g FROM tv WHERE t IS NOT NULL),
d AS (SELECT event_id, state, t, CAST(sum(CASE WHEN g>900 THEN 1 ELSE 0 END) OVER (PARTITION BY state ORDER BY t,event_id) AS BIGINT) AS dwell FROM l
UNION ALL SELECT event_id, state, t, -1 FROM tv WHERE t IS NULL)
SELECT event_id, dwell, CAST(row_number() OVER (PARTITION BY state,dwell ORDER BY t NULLS FIRST,event_id)-1 AS BIGINT) AS pos_in_dwell FROM d""")
def dwells(spark, folder):
    return op.dwells(_timed(spark, folder), "state", "t", ["event_id"], 900.0).select("event_id", "dwell", "pos_in_dwell")


@query("switch_blocks", f"""WITH {SAMPLES}, l AS (SELECT *, lag(state) OVER w AS ps, t-lag(t) OVER w AS g FROM ev WINDOW w AS (ORDER BY t,event_id))
SELECT event_id, CAST(sum(CASE WHEN ps IS NULL OR ps<>state OR g>600 THEN 1 ELSE 0 END) OVER (ORDER BY t,event_id)-1 AS BIGINT) AS block FROM l""")
def switch_blocks(spark, folder):
    return op.switch_blocks(samples(spark, folder), "state", "t", ["event_id"], 600.0).select("event_id", "block")


_SWEEPS = """sw0 AS (SELECT t, event_id, t-lag(t) OVER (ORDER BY t,event_id) AS g FROM ev WHERE state LIKE 'VNA%'),
sw1 AS (SELECT t, sum(CASE WHEN g>600 THEN 1 ELSE 0 END) OVER (ORDER BY t,event_id) AS sweep FROM sw0),
sweeps AS (SELECT CAST(sweep AS BIGINT) AS sweep, min(t) AS start, max(t) AS stop FROM sw1 GROUP BY 1)"""


@query("sweep_spans", f"""WITH {SAMPLES}, {_SWEEPS} SELECT sweep, round(start,6) AS start, round(stop,6) AS stop FROM sweeps""")
def sweep_spans(spark, folder):
    out = op.sweep_spans(samples(spark, folder), "state", "t", ["event_id"], "VNA", 600.0)
    return out.select("sweep", F.col("start"), F.col("stop"))


_DT = "CASE WHEN user_id<75 THEN 120.0::DOUBLE ELSE 240.0::DOUBLE END"


@query("segments", f"""WITH {SAMPLES}, x AS (SELECT event_id, t, {_DT} AS dt FROM ev),
l AS (SELECT *, t-lag(t) OVER w AS g, lag(dt) OVER w AS pdt FROM x WINDOW w AS (ORDER BY t,event_id))
SELECT event_id, CAST(sum(CASE WHEN g IS NULL OR g>2.5*pdt OR abs(dt-pdt)>1e-8+1e-5*pdt THEN 1 ELSE 0 END) OVER (ORDER BY t,event_id)-1 AS BIGINT) AS segment FROM l""")
def segments(spark, folder):
    x = samples(spark, folder).select("event_id", "t", F.when(F.col("user_id") < 75, 120.0).otherwise(240.0).alias("dt"))
    return op.segments(x, "t", "dt", ["event_id"], 2.5).select("event_id", "segment")


def hourly(spark, folder):
    """Hourly files with day, phase and integration time."""
    s = samples(spark, folder)
    ts = F.timestamp_micros(F.round(F.col("t") * 1e6).cast("bigint"))
    h = F.date_format(ts, "yyyyMMddHH")
    return s.withColumn("file", F.concat(F.lit("corr_"), h)).withColumn("day", F.substring(h, 1, 8)).withColumn(
        "phase", F.when(F.substring(h, 9, 2).cast("int") % 10 < 7, "A").otherwise("B")).withColumn("dt", F.lit(0.5))


HOURLY = SAMPLES + """, hr AS (SELECT *, 'corr_'||strftime(to_timestamp(t) AT TIME ZONE 'UTC','%Y%m%d%H') AS hfile FROM ev),
hourly AS (SELECT *, substr(hfile,6,8) AS day, CASE WHEN CAST(substr(hfile,14,2) AS INT)%10<7 THEN 'A' ELSE 'B' END AS phase, 0.5::DOUBLE AS dt FROM hr)"""

BATCHES = HOURLY + """, fl AS (SELECT hfile AS file, count(*) AS n, min(t) AS ft, max(t) AS lt, min(day) AS day, min(phase) AS phase FROM hourly GROUP BY 1),
fb AS (SELECT *, CASE WHEN lag(ft) OVER w IS NULL OR ft-lag(lt) OVER w>600 OR day<>lag(day) OVER w OR phase<>lag(phase) OVER w THEN 1 ELSE 0 END AS b FROM fl WINDOW w AS (ORDER BY ft,file)),
fc AS (SELECT *, sum(b) OVER (ORDER BY ft,file)-1 AS block FROM fb),
fd AS (SELECT *, floor((row_number() OVER (PARTITION BY block ORDER BY ft,file)-1)/3) AS ch FROM fc),
fe AS (SELECT block, ch, count(*) AS files, sum(n) AS rows, min(ft) AS start, max(lt) AS stop, min(day) AS day, min(phase) AS phase FROM fd GROUP BY 1,2),
batches AS (SELECT CAST(row_number() OVER (ORDER BY block,ch)-1 AS BIGINT) AS batch, CAST(block AS BIGINT) AS block, files, CAST(rows AS BIGINT) AS rows, start, stop, day, phase FROM fe)"""


@query("batches", f"""WITH {BATCHES} SELECT * FROM batches""")
def batches(spark, folder):
    return op.batches(hourly(spark, folder), file="file", time="t", dt="dt", same=["day", "phase"], per_batch=3)


@query("dwell_clusters", """WITH l AS (SELECT user_id, event_id, event_id-lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
SELECT event_id, user_id, CAST(sum(CASE WHEN g>100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS cluster FROM l""")
def dwell_clusters(spark, folder):
    return op.dwell_clusters(table(spark, folder, "events").select("event_id", "user_id"), ["user_id"], "event_id", 100)


@query("dedup_first", """SELECT epoch_us(o_orderdate)/1e6 AS t, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1""")
def dedup_first(spark, folder):
    from dwellgrid.functions.clock import unix_seconds
    o = table(spark, folder, "orders").withColumn("t", unix_seconds(F.col("o_orderdate")))
    return op.dedup_first(o, "t", "o_totalprice", ["o_orderkey"])


@query("unwrap", f"""WITH {CELLS}, a AS (SELECT row_no, chan, x*2000-360*floor(x*2000/360) AS a FROM cells),
l AS (SELECT *, a-lag(a) OVER (PARTITION BY row_no ORDER BY chan) AS d FROM a),
m AS (SELECT *, CASE WHEN abs(d)<180 THEN 0 ELSE coalesce((d+180)-360*floor((d+180)/360)-180-d, 0) END AS c FROM l)
SELECT row_no, chan, round(a+sum(c) OVER (PARTITION BY row_no ORDER BY chan),4) AS angle FROM m""")
def unwrap(spark, folder):
    c = cells(spark, folder).select("row_no", "chan", F.pmod(F.col("x") * 2000, F.lit(360.0)).alias("a"))
    return op.unwrapped(c, ["row_no"], ["chan"], "a", 360.0, "angle").select("row_no", "chan", r6("angle", 4).alias("angle"))


@query("plateau_clean", f"""WITH {CELLS}, s AS (SELECT row_no, chan, CASE WHEN NOT (chan BETWEEN 26 AND 59 AND label=2) THEN x END AS x, CASE WHEN chan<20 THEN 0 WHEN chan<26 THEN chan WHEN chan<60 THEN 100 ELSE 200 END AS step FROM cells),
r AS (SELECT *, sum(b) OVER (PARTITION BY row_no ORDER BY chan) AS run FROM (SELECT *, CASE WHEN step IS NOT DISTINCT FROM lag(step) OVER (PARTITION BY row_no ORDER BY chan) THEN 0 ELSE 1 END AS b FROM s)),
ru AS (SELECT row_no, run, min(chan) AS st, max(chan)+1 AS en FROM r GROUP BY 1,2),
md AS (SELECT row_no, run, median(x) AS med FROM r JOIN ru USING (row_no,run) WHERE en-st>=10 AND chan>=least(st+3,en-1) GROUP BY 1,2),
rr AS (SELECT ru.*, md.med, en-st>=10 AND md.med IS NULL AS dropped FROM ru LEFT JOIN md USING (row_no,run)),
pn AS (SELECT *, last_value(CASE WHEN med IS NOT NULL THEN {{'en':en,'v':med}} END IGNORE NULLS) OVER (PARTITION BY row_no ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
 first_value(CASE WHEN med IS NOT NULL THEN {{'st':st,'v':med}} END IGNORE NULLS) OVER (PARTITION BY row_no ORDER BY run ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM rr)
SELECT row_no, chan, round(CASE WHEN dropped THEN NULL WHEN med IS NOT NULL THEN med ELSE coalesce(p.v+(n.v-p.v)*(chan-p.en+1)/(n.st-p.en+1), n.v, p.v, x) END,9) AS clean FROM r JOIN pn USING (row_no,run)""")
def plateau_clean(spark, folder):
    ch = F.col("chan")
    step = F.when(ch < 20, 0).when(ch < 26, ch).when(ch < 60, 100).otherwise(200)
    c = cells(spark, folder).select("row_no", "chan", F.when(~(ch.between(26, 59) & (F.col("label") == 2)), F.col("x")).alias("x"), step.alias("step"))
    return op.plateau_clean(c, ["chan"], "x", "step", keys=["row_no"]).select("row_no", "chan", r6("clean", 9).alias("clean"))
