"""Queries over joins: exact, nearest, bracketing, interval, rule."""

from pyspark.sql import functions as F

from dwellgrid.catalog.registry import query
from dwellgrid.catalog.segments import _SWEEPS
from dwellgrid.catalog.views import CELLS, INTEG, NODES, SAMPLES, SHIPPED, SPECTRA, cells, integrations, nodes, r6, samples, shipped, spectra, table
from dwellgrid.functions.clock import unix_seconds
from dwellgrid.operators import rangejoins as rj
from dwellgrid.operators import segments as sg
from dwellgrid.operators import timejoins as op

# rows at an odd time so that some nodes are hit exactly and ties occur (12 h)
_AROUND = NODES + ", " + SHIPPED + """, pn AS (SELECT s.flag, s.t, s.x, a.t AS pt, a.label AS pl, a.v AS pv, b.t AS nt, b.label AS nl, b.v AS nv
 FROM shipped s ASOF LEFT JOIN nodes a ON s.t>=a.t ASOF LEFT JOIN nodes b ON s.t<=b.t),
nr AS (SELECT *, CASE WHEN pt IS NULL OR nt-t<t-pt THEN nt ELSE pt END AS ct, CASE WHEN pt IS NULL OR nt-t<t-pt THEN nv ELSE pv END AS cv FROM pn)"""


_NEAREST = f"""WITH {_AROUND} SELECT flag, t, CASE WHEN abs(t-ct)<=43200 THEN t-ct END AS near_dt, round(CASE WHEN abs(t-ct)<=43200 THEN cv END/pi(),6) AS near_v FROM nr"""


@query("join_nearest", _NEAREST)
def join_nearest(spark, folder):
    out = op.nearest(shipped(spark, folder), "t", nodes(spark, folder), "t", ["v"], tolerance_s=43200.0)
    return out.select("flag", "t", "near_dt", r6(F.col("near_v") / F.pi()).alias("near_v"))


@query("join_nearest_sliced", _NEAREST)
def join_nearest_sliced(spark, folder):
    """The same by slices, the way of groups beyond the limit."""
    out = op.nearest(shipped(spark, folder), "t", nodes(spark, folder), "t", ["v"], tolerance_s=43200.0, limit=100)
    return out.select("flag", "t", "near_dt", r6(F.col("near_v") / F.pi()).alias("near_v"))


@query("nearest_with_age", f"""WITH {_AROUND} SELECT flag, t, abs(t-ct) AS age, round(cv/pi(),6) AS v FROM nr""")
def nearest_with_age(spark, folder):
    out = op.nearest(shipped(spark, folder), "t", nodes(spark, folder), "t", ["v"])
    return out.select("flag", "t", F.abs("near_dt").alias("age"), r6(F.col("near_v") / F.pi()).alias("v"))


@query("join_bracket", f"""WITH {_AROUND} SELECT flag, t,
 round(CASE WHEN pt=t THEN pv WHEN pl=nl AND nt-pt<=90000 THEN (1-(t-pt)/(nt-pt))*pv+(t-pt)/(nt-pt)*nv END/pi(),6) AS v,
 CASE WHEN pt=t THEN 0.0::DOUBLE WHEN pl=nl AND nt-pt<=90000 THEN nt-pt END AS width FROM nr""")
def join_bracket(spark, folder):
    out = op.bracket(shipped(spark, folder), "t", nodes(spark, folder), "t", ["v"], "label", max_gap_s=90000.0)
    return out.select("flag", "t", r6(F.col("v") / F.pi()).alias("v"), "width")


@query("join_bracket_or_hold", f"""WITH {_AROUND} SELECT flag, t,
 round(CASE WHEN pt=t THEN pv WHEN pl=nl AND nt-pt<=90000 THEN (1-(t-pt)/(nt-pt))*pv+(t-pt)/(nt-pt)*nv WHEN abs(t-ct)<=21600 THEN cv END/pi(),6) AS v,
 CASE WHEN pt=t OR (pl=nl AND nt-pt<=90000) OR abs(t-ct)<=21600 THEN abs(t-ct) END AS dt FROM nr""")
def join_bracket_or_hold(spark, folder):
    out = op.bracket(shipped(spark, folder), "t", nodes(spark, folder), "t", ["v"], "label", max_gap_s=90000.0, hold_s=21600.0)
    return out.select("flag", "t", r6(F.col("v") / F.pi()).alias("v"), "dt")


@query("interp_hold_ends", f"""WITH {_AROUND} SELECT flag, t, round(CASE WHEN pt=nt THEN pv ELSE coalesce((1-(t-pt)/(nt-pt))*pv+(t-pt)/(nt-pt)*nv, pv, nv) END/pi(),6) AS v FROM nr""")
def interp_hold_ends(spark, folder):
    return op.hold_ends(shipped(spark, folder), "t", nodes(spark, folder), "t", "v").select("flag", "t", r6(F.col("v") / F.pi()).alias("v"))


@query("window_mean_or_nearest", f"""WITH {SAMPLES}, d AS (SELECT t AS st, event_id, t+600 AS en FROM ev WHERE state='RFANT'),
th AS (SELECT t, power FROM ev WHERE state='RFAMB'),
m AS (SELECT event_id, count(th.t) AS n, avg(th.power) AS v FROM d LEFT JOIN th ON th.t BETWEEN d.st AND d.en GROUP BY 1),
p AS (SELECT d.event_id, d.st, a.t AS pt, a.power AS pv, b.t AS nt, b.power AS nv FROM d ASOF LEFT JOIN th a ON d.st>=a.t ASOF LEFT JOIN th b ON d.st<=b.t),
c AS (SELECT *, CASE WHEN pt IS NULL OR nt-st<st-pt THEN nt ELSE pt END AS ct, CASE WHEN pt IS NULL OR nt-st<st-pt THEN nv ELSE pv END AS cv FROM p)
SELECT event_id, n, round(CASE WHEN n>0 THEN v WHEN abs(st-ct)<=300 THEN cv END,6) AS power, round(abs(st-ct),5) AS dt FROM c JOIN m USING (event_id)""")
def window_mean_or_nearest(spark, folder):
    s = samples(spark, folder)
    rows = s.where("state='RFANT'").select("event_id", "t", (F.col("t") + 600).alias("t_stop"))
    out = op.window_mean_or_nearest(rows, ["event_id"], "t", "t", "t_stop", s.where("state='RFAMB'").select("t", "power"), "t", "power", 300.0)
    return out.select("event_id", "n", r6("power").alias("power"), r6("dt", 5).alias("dt"))


@query("join_row_exact", f"""WITH {INTEG}, p AS (SELECT file, row_no, power*2 AS az FROM integ WHERE state<>'UNKNOWN' AND file<>'corr_20240103_235959Z.h5')
SELECT i.file, i.row_no, round(p.az,6) AS point_az FROM integ i LEFT JOIN p USING (file,row_no)""")
def join_row_exact(spark, folder):
    i = integrations(spark, folder)
    p = i.where("state<>'UNKNOWN' AND file<>'corr_20240103_235959Z.h5'").select("file", "row_no", (F.col("power") * 2).alias("az"))
    return rj.join_exact(i.select("file", "row_no"), p, ["file", "row_no"], "point_").select("file", "row_no", r6("point_az").alias("point_az"))


@query("skipped_files", f"""WITH {SAMPLES} SELECT file, count(*) AS rows FROM ev WHERE file IN ('corr_20240103_235959Z.h5','corr_20240117_235959Z.h5') GROUP BY 1""")
def skipped_files(spark, folder):
    s = samples(spark, folder)
    return rj.skipped_files(s, s.where(~F.col("file").isin("corr_20240103_235959Z.h5", "corr_20240117_235959Z.h5")), "file")


@query("join_cube", f"""WITH {SPECTRA} SELECT event_id, coalesce(len(spec[23:28]),0)::INT AS n, round(list_sum(spec[23:28]),9) AS s FROM events LEFT JOIN spectra ON event_id=row_no""")
def join_cube(spark, folder):
    from dwellgrid.catalog.filters import FREQS
    from dwellgrid.operators.filters import band_of
    base = table(spark, folder, "events").select(F.col("event_id").alias("row_no"))
    out = rj.join_exact(base, spectra(spark, folder).select("row_no", "spec"), ["row_no"], "m_")
    cutout = band_of(F.col("m_spec"), FREQS, 88.0, 108.0)
    return out.select(F.col("row_no").alias("event_id"), F.when(F.col("m_spec").isNotNull(), F.size(cutout)).otherwise(0).alias("n"),
                      r6(F.aggregate(cutout, F.lit(0.0), lambda a, b: a + b), 9).alias("s"))


# intervals: every order date of one status opens a window of some days; the
# rank is the priority text and date, so mandatory (urgent) masks come first
_IV = """iv AS (SELECT epoch_us(o_orderdate)/1e6 AS a, epoch_us(o_orderdate)/1e6 + 43200*(1+o_orderkey%3) AS b, o_orderkey AS rank, o_orderpriority AS reason
 FROM orders WHERE o_orderstatus='P' AND o_totalprice>300000)"""


def _intervals(spark, folder):
    o = table(spark, folder, "orders").where("o_orderstatus='P' AND o_totalprice>300000")
    a = unix_seconds(F.col("o_orderdate"))
    return o.select(a.alias("a"), (a + 43200 * (1 + F.col("o_orderkey") % 3)).alias("b"), F.col("o_orderkey").alias("rank"),
                    F.col("o_orderpriority").alias("reason"))


@query("interval_masks", f"""WITH {SHIPPED}, {_IV}, h AS (SELECT flag, t, arg_min(reason, rank) AS reason FROM shipped JOIN iv ON t BETWEEN a AND b GROUP BY 1,2)
SELECT s.flag, s.t, h.reason FROM shipped s LEFT JOIN h USING (flag,t)""")
def interval_masks(spark, folder):
    return rj.first_interval(shipped(spark, folder).select("flag", "t"), ["flag", "t"], "t", _intervals(spark, folder), "a", "b", "rank", "reason")


_RANGES = """rg AS (SELECT 'Customer#'||lpad(CAST(s_suppkey*13 AS VARCHAR),9,'0') AS f, 'Customer#'||lpad(CAST(s_suppkey*13+s_nationkey AS VARCHAR),9,'0') AS l, s_suppkey AS num, 'S'||s_nationkey AS label FROM supplier)"""


def _ranges(spark, folder):
    s, k = table(spark, folder, "supplier"), F.col("s_suppkey")
    name = lambda n: F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0"))
    return s.select(name(k * 13).alias("f"), name(k * 13 + F.col("s_nationkey")).alias("l"), k.alias("num"),
                    F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("label"))


@query("filename_range_join", f"""WITH {_RANGES}, h AS (SELECT c_name, arg_min(label,num) AS label FROM customer JOIN rg ON c_name BETWEEN f AND l GROUP BY 1)
SELECT c.c_custkey, coalesce(h.label,'') AS label FROM customer c LEFT JOIN h USING (c_name)""")
def filename_range_join(spark, folder):
    c = table(spark, folder, "customer")
    return rj.name_ranges(c, "c_name", _ranges(spark, folder), "f", "l", "num", "label").select("c_custkey", "label")


@query("filename_range_last", f"""WITH {_RANGES}, h AS (SELECT c_name, arg_max(label,num) AS label FROM customer JOIN rg ON c_name BETWEEN f AND l
 WHERE f IN (SELECT c_name FROM customer) AND l IN (SELECT c_name FROM customer) GROUP BY 1)
SELECT c.c_custkey, coalesce(h.label,'') AS label FROM customer c LEFT JOIN h USING (c_name)""")
def filename_range_last(spark, folder):
    c = table(spark, folder, "customer")
    return rj.name_ranges(c, "c_name", _ranges(spark, folder), "f", "l", "num", "label", wins="last", by_position=True).select("c_custkey", "label")


RULES = [
    {"name": "A", "match": {"state": "UNKNOWN"}, "status": "reject", "reason": "state unknown"},
    {"name": "B1", "match": {"state": "RFANT", "low": True}, "status": "use"},
    {"name": "B2", "match": {"state": "RFANT", "low": False}, "status": "reject", "reason": "too bright"},
    {"name": "C", "match": {"sky": False}, "status": "use"},
]
POLICY_SQL = SAMPLES + """, pol AS (SELECT event_id, file, CASE WHEN state='UNKNOWN' THEN 'A' WHEN state='RFANT' AND power<=100 THEN 'B1' WHEN state='RFANT' THEN 'B2' ELSE 'C' END AS rule FROM ev),
policy AS (SELECT *, CASE WHEN rule IN ('A','B2') THEN 'reject' ELSE 'use' END AS status, CASE rule WHEN 'A' THEN 'state unknown' WHEN 'B2' THEN 'too bright' ELSE '' END AS reason FROM pol)"""


def policy_rows(spark, folder):
    s = samples(spark, folder).withColumn("low", F.col("power") <= 100).withColumn("sky", F.col("state").isin("RFANT", "UNKNOWN"))
    return rj.policy_match(s, RULES)


@query("policy_match", f"""WITH {POLICY_SQL} SELECT event_id, rule, status, reason FROM policy""")
def policy_match(spark, folder):
    return policy_rows(spark, folder).select("event_id", "rule", "status", "reason")


_MAPS = """mp AS (SELECT o_orderkey AS file, list_sort(list_distinct([CAST(o_custkey%6 AS VARCHAR), CAST(o_orderkey%6 AS VARCHAR)])) AS ins FROM orders)"""


def _maps(spark, folder):
    """A wiring map per file: two inputs carry box-a, the rest box-b."""
    o = table(spark, folder, "orders")
    a, b = (F.col("o_custkey") % 6).cast("string"), (F.col("o_orderkey") % 6).cast("string")
    keys = F.array(*[F.lit(str(i)) for i in range(6)])
    mapping = F.map_from_arrays(keys, F.transform(keys, lambda k: F.when((k == a) | (k == b), "box-a").otherwise("box-b")))
    crosses = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(5)), lambda j: F.concat(i.cast("string"), j.cast("string")))))
    return o.select(F.col("o_orderkey").alias("file"), mapping.alias("m"), F.concat(keys, crosses).alias("have"))


@query("resolve_key", f"""WITH {_MAPS}, u AS (SELECT file, unnest(ins) AS k FROM mp) SELECT file, arg_min(k, (CAST(k AS INT)%2, CAST(k AS INT))) AS key FROM u GROUP BY 1""")
def resolve_key(spark, folder):
    return rj.resolve_key(_maps(spark, folder), "file", "m", "box-a", "have")


@query("resolve_cross", f"""WITH {_MAPS}, a AS (SELECT file, ins, unnest(ins) AS k FROM mp), a1 AS (SELECT file, any_value(ins) AS ins, arg_min(k, (CAST(k AS INT)%2, CAST(k AS INT))) AS ia FROM a GROUP BY 1),
b AS (SELECT file, ia, CAST(unnest(range(0,6)) AS VARCHAR) AS ib, ins FROM a1), b1 AS (SELECT file, ia, arg_min(ib, (CAST(ib AS INT)%2, CAST(ib AS INT))) AS ib FROM b WHERE NOT list_contains(ins, ib) GROUP BY 1,2)
SELECT file, least(ia,ib)||greatest(ia,ib) AS key, ia>ib AS conjugated FROM b1""")
def resolve_cross(spark, folder):
    return rj.resolve_cross(_maps(spark, folder), "file", "m", ("box-a", "box-b"), "have")


@query("assert_aligned", """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus='F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus<>'F' GROUP BY 1)
SELECT coalesce(a.k,b.k) AS k, CASE WHEN b.k IS NULL THEN 'right missing' WHEN a.k IS NULL THEN 'left missing' ELSE 'axis differs' END AS problem FROM a FULL JOIN b ON a.k=b.k WHERE a.n IS DISTINCT FROM b.n""")
def assert_aligned(spark, folder):
    o = table(spark, folder, "orders")
    one = lambda s: o.where(s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rj.misaligned(one("o_orderstatus = 'F'"), one("o_orderstatus <> 'F'"), ["k"], ["n"])


@query("locate_axis", f"""WITH {CELLS}, a AS (SELECT chan, max(4.0*chan)::DOUBLE AS f FROM cells GROUP BY 1), p AS (SELECT a.chan AS pos FROM a JOIN (SELECT f FROM a WHERE chan BETWEEN 10 AND 40) USING (f))
SELECT (SELECT min(pos) FROM p) AS first, (SELECT count(*) FROM p) AS n, (SELECT max(pos)-min(pos)+1=count(*) FROM p) AS contiguous, count(*) AS axis_n, arg_min(f,chan) AS axis_first, arg_max(f,chan) AS axis_last FROM a""")
def locate_axis(spark, folder):
    axis = cells(spark, folder).groupBy("chan").agg(F.max(4.0 * F.col("chan")).alias("f"))
    product = axis.where("chan BETWEEN 10 AND 40").select((F.col("chan") - 10).alias("chan"), F.col("f"))
    where = rj.locate_axis(axis, product, "chan", "f")
    mark = rj.axis_fingerprint(axis, "f")
    return where.join(F.broadcast(mark.select(*[F.col(c).alias(f"axis_{c}") for c in mark.columns])))


@query("pending_files", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F' AND o_totalprice>200000)""")
def pending_files(spark, folder):
    want = table(spark, folder, "customer").select("c_custkey", F.lit("p1").alias("parameters"))
    done = table(spark, folder, "orders").where("o_orderstatus='F' AND o_totalprice>200000").select(
        F.col("o_custkey").alias("c_custkey"), F.lit("p1").alias("parameters"))
    return rj.pending(want, done, ["c_custkey"], ["parameters"]).select("c_custkey")


@query("assemble_cycles", f"""WITH {SAMPLES}, s AS (SELECT t, event_id, lead(t) OVER (ORDER BY t) AS nx FROM ev WHERE state='RFANT'),
j AS (SELECT s.t, s.event_id, s.nx, a.t AS ta, a.event_id AS ea, b.t AS tb, b.event_id AS eb FROM s
 ASOF JOIN (SELECT * FROM ev WHERE state='RFAMB') a ON s.t<a.t ASOF JOIN (SELECT * FROM ev WHERE state='RFNON') b ON s.t<b.t)
SELECT event_id AS i_ant, ea AS i_amb, eb AS i_non FROM j WHERE (nx IS NULL OR (ta<nx AND tb<nx)) AND ta-t<1800 AND tb-t<1800""")
def assemble_cycles(spark, folder):
    out = op.assemble_cycles(samples(spark, folder), "t", "state", ["RFANT", "RFAMB", "RFNON"], ["event_id"], 1800.0)
    return out.select(F.col("RFANT.event_id").alias("i_ant"), F.col("RFAMB.event_id").alias("i_amb"), F.col("RFNON.event_id").alias("i_non"))


_STATE_NEAR = """nn AS (SELECT l.event_id, l.t, l.power, a.t AS pt, a.power AS pv, b.t AS nt, b.power AS nv FROM (SELECT * FROM ev WHERE state='{a}') l
 ASOF LEFT JOIN (SELECT * FROM ev WHERE state='{b}') a ON l.t>=a.t ASOF LEFT JOIN (SELECT * FROM ev WHERE state='{b}') b ON l.t<=b.t),
nc AS (SELECT *, CASE WHEN pt IS NULL OR nt-t<t-pt THEN nt ELSE pt END AS ct, CASE WHEN pt IS NULL OR nt-t<t-pt THEN nv ELSE pv END AS cv FROM nn)"""


@query("pair_cycles", f"""WITH {SAMPLES}, {_STATE_NEAR.format(a='RFNON', b='RFAMB')} SELECT event_id, round(power-cv,6) AS gain FROM nc WHERE abs(t-ct)<300""")
def pair_cycles(spark, folder):
    s = samples(spark, folder)
    amb = s.where("state='RFAMB'").select("t", F.col("power").alias("p"))
    out = op.nearest(s.where("state='RFNON'"), "t", amb, "t", ["p"], tolerance_s=300.0, strict=True)
    return out.where("near_p IS NOT NULL").select("event_id", r6(F.col("power") - F.col("near_p")).alias("gain"))


@query("guard_band", f"""WITH {SAMPLES}, {_SWEEPS} SELECT event_id, EXISTS (SELECT 1 FROM sweeps w WHERE ev.t>w.start-60 AND ev.t<w.stop+30) AS near_sweep FROM ev""")
def guard_band(spark, folder):
    s = samples(spark, folder)
    return op.near_sweep(s, "t", sg.sweep_spans(s, "state", "t", ["event_id"], "VNA", 600.0), (60.0, 30.0)).select("event_id", "near_sweep")


@query("borrow_valid", f"""WITH {SAMPLES}, v AS (SELECT * FROM ev WHERE power>5), j AS (SELECT l.event_id, l.t, l.power, a.t AS pt, a.power AS pv, b.t AS nt, b.power AS nv FROM ev l
 ASOF LEFT JOIN v a ON l.state=a.state AND l.t>=a.t ASOF LEFT JOIN v b ON l.state=b.state AND l.t<=b.t)
SELECT event_id, round(CASE WHEN power>5 THEN power WHEN pt IS NULL OR nt-t<t-pt THEN nv ELSE pv END,6) AS used,
 CASE WHEN power>5 THEN 'own' WHEN pt IS NULL AND nt IS NULL THEN 'none' ELSE 'borrowed' END AS status FROM j""")
def borrow_valid(spark, folder):
    s = samples(spark, folder).withColumn("valid", F.col("power") > 5).select("event_id", "t", "state", "power", "valid")
    return op.borrow_valid(s, "t", "state", "power", "valid").select("event_id", r6("used").alias("used"), "status")


@query("bracket_errors", f"""WITH {NODES}, p AS (SELECT t, v, row_number() OVER (ORDER BY t)-1 AS i FROM nodes), ms AS (SELECT unnest([2,3,4,5,7]) AS m),
e AS (SELECT a.m, abs((1-(k.t-a.t)/(b.t-a.t))*a.v+(k.t-a.t)/(b.t-a.t)*b.v-k.v)/k.v AS e FROM (SELECT p.*, ms.m, unnest(range(1,ms.m)) AS j FROM p, ms) a JOIN p b ON b.i=a.i+a.m JOIN p k ON k.i=a.i+a.j)
SELECT CAST(m AS INT) AS m, count(*) AS n, round(median(e),9) AS median, round(quantile_cont(e,0.95),9) AS p95, round(max(e),9) AS max FROM e GROUP BY m""")
def bracket_errors(spark, folder):
    from dwellgrid.operators.aggregates import robust_summary
    out = op.bracket_errors(nodes(spark, folder), "t", "v", [2, 3, 4, 5, 7])
    s = robust_summary(out, ["m"], F.col("error"))
    return s.select("m", "n", *[r6(c, 9).alias(c) for c in ("median", "p95", "max")])


@query("across_gap", f"""WITH {SAMPLES}, n AS (SELECT t, power AS v FROM ev WHERE state='RFNON'), l AS (SELECT *, lead(t) OVER (ORDER BY t) AS t1, lead(v) OVER (ORDER BY t) AS v1 FROM n),
g AS (SELECT t AS before, t1 AS after, abs(v1/v-1) AS change FROM l WHERE t1 IS NOT NULL ORDER BY t1-t DESC, t LIMIT 1),
e AS (SELECT n.t, n.v, n.t+after-before AS tg, before FROM n, g WHERE n.t<=before),
m AS (SELECT e.*, a.t AS pt, a.v AS pv, b.t AS nt, b.v AS nv FROM e ASOF LEFT JOIN n a ON e.tg>=a.t ASOF LEFT JOIN n b ON e.tg<=b.t),
c AS (SELECT *, CASE WHEN pt IS NULL OR nt-tg<tg-pt THEN nt ELSE pt END AS ct, CASE WHEN pt IS NULL OR nt-tg<tg-pt THEN nv ELSE pv END AS cv FROM m)
SELECT g.before, g.after, round(g.change,9) AS change, s.n_elsewhere, s.median_elsewhere FROM g, (SELECT count(*) AS n_elsewhere, round(median(abs(cv/v-1)),9) AS median_elsewhere FROM c WHERE abs(tg-ct)<600 AND ct<=before) s""")
def across_gap(spark, folder):
    n = samples(spark, folder).where("state='RFNON'").select("t", F.col("power").alias("v"))
    out = op.across_gap(n, "t", "v", 600.0)
    return out.select("before", "after", r6("change", 9).alias("change"), "n_elsewhere", r6("median_elsewhere", 9).alias("median_elsewhere"))
