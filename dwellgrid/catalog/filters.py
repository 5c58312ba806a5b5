"""Queries over filters, sorts, limits and set operations."""

from pyspark.sql import functions as F

from dwellgrid.catalog.registry import query
from dwellgrid.catalog.views import CELLS, INTEG, SAMPLES, SPECTRA, cells, integrations, r6, samples, spectra, table
from dwellgrid.operators import filters as op
from dwellgrid.sources import checked


def _index(spark, folder, **pushed):
    return samples(spark, folder, **pushed).withColumn("time_best", F.when(F.col("power") != 0.5, F.col("t")))


@query("select_rows", f"""WITH {SAMPLES} SELECT event_id, t, state, input FROM ev
WHERE state IN ('RFANT','RFAMB') AND input=2 AND t>=1704412800 AND t<1705276800 AND power>5""")
def select_rows(spark, folder):
    pushed = _index(spark, folder, window=(1704412800.0, 1705276800.0), states=["RFANT", "RFAMB"])
    out = op.select_rows(pushed, time=(1704412800.0, 1705276800.0), state=["RFANT", "RFAMB"], input=2,
                         where=F.col("power") > 5)
    return out.select("event_id", "t", "state", "input")


@query("files_match", """SELECT file, g, rng FROM (SELECT DISTINCT 'corr_'||strftime(ts,'%Y%m%d')||'_235959Z.h5' AS file,
 strftime(ts,'%Y%m%d') LIKE '2024010_' OR strftime(ts,'%Y%m%d') IN ('20240112','20240113') AS g,
 strftime(ts,'%Y%m%d') BETWEEN '20240105' AND '20240111' AS rng FROM events)""")
def files_match(spark, folder):
    names = samples(spark, folder).select("file").distinct()
    f = F.col("file")
    return names.select("file", op.files_match(f, ["corr_2024010?_*", "corr_202401[1][23]_*.h5"]).alias("g"),
                        op.files_match(f, ("corr_20240105", "corr_20240111_235959Z.h5")).alias("rng"))


@query("filter_funnel", f"""WITH {SAMPLES}, c AS (SELECT count(*) AS c0, count(*) FILTER (WHERE f) AS c1,
 count(*) FILTER (WHERE f AND s) AS c2, count(*) FILTER (WHERE f AND s AND p) AS c3 FROM
 (SELECT substr(file,6,8) BETWEEN '20240105' AND '20240120' AS f, state='RFANT' AS s, power>20 AS p FROM ev))
SELECT 0::INT AS position, 'files' AS step, c0 AS before, c1 AS after FROM c UNION ALL
SELECT 1, 'state', c1, c2 FROM c UNION ALL SELECT 2, 'where', c2, c3 FROM c""")
def filter_funnel(spark, folder):
    df = _index(spark, folder)
    steps = op.conditions(df, files=("corr_20240105", "corr_20240120_235959Z.h5"), state="RFANT")
    return op.filter_funnel(df, [*steps, ("where", F.col("power") > 20)])


@query("select_span", f"""WITH {SAMPLES} SELECT event_id FROM ev WHERE t>=1704412800 AND t<1705276800
 AND file>='corr_20240106' AND file<='corr_20240112_235959Z.h5'""")
def select_span(spark, folder):
    span = (1704412800.0, 1705276800.0)
    return op.select_rows(samples(spark, folder, window=span), time=span, time_column="t",
                          files=("corr_20240106", "corr_20240112_235959Z.h5")).select("event_id")


FREQS = [4.0 * c for c in range(64)]  # the channel axis of the test spectra, MHz


@query("band_filter", f"""WITH {SPECTRA} SELECT row_no, len(spec[23:28])::INT AS n_closed, len(spec[23:27])::INT AS n_open,
 round(list_sum(spec[23:28]),9) AS s_closed, round(list_sum(spec[23:27]),9) AS s_open FROM spectra""")
def band_filter(spark, folder):
    s = spectra(spark, folder)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    a = op.band_of(F.col("spec"), FREQS, 88.0, 108.0)
    b = op.band_of(F.col("spec"), FREQS, 88.0, 108.0, closed=False)
    return s.select("row_no", F.size(a).alias("n_closed"), F.size(b).alias("n_open"),
                    r6(total(a), 9).alias("s_closed"), r6(total(b), 9).alias("s_open"))


@query("frequency_trust", f"""WITH {CELLS} SELECT chan, 4.0::DOUBLE*chan AS f, bool_and(4*chan BETWEEN 40 AND 220 AND NOT 4*chan BETWEEN 88 AND 108 AND NOT 4*chan BETWEEN 136 AND 138.5) AS trusted, count(*) AS n
FROM cells GROUP BY chan""")
def frequency_trust(spark, folder):
    c = cells(spark, folder).withColumn("f", 4.0 * F.col("chan"))
    ok = op.frequency_trust(F.col("f"), 40.0, 220.0, [(88.0, 108.0), (136.0, 138.5)])
    return c.groupBy("chan", "f").agg(F.bool_and(ok).alias("trusted"), F.count(F.lit(1)).alias("n"))


@query("fit_channel_mask", f"""WITH {CELLS} SELECT row_no, chan, x FROM cells WHERE 4*chan BETWEEN 40 AND 220 AND NOT 4*chan BETWEEN 88 AND 108
 AND chan>=0 AND chan<=60 AND NOT (chan%16 IN (2,3,4))""")
def fit_channel_mask(spark, folder):
    trust = op.frequency_trust(4.0 * F.col("chan"), 40.0, 220.0, [(88.0, 108.0)])
    keep = op.fit_channels(F.col("chan"), trust, 0, 60, [3, 19, 35, 51], 1)
    return cells(spark, folder).where(keep).select("row_no", "chan", "x")


@query("state_gate", """WITH e AS (SELECT event_id, strftime(ts,'%Y%m%d%H') AS file, CASE event_type WHEN 'click' THEN 'RFANT' WHEN 'view' THEN 'RFAMB' ELSE 'MISSING' END AS state FROM events),
b AS (SELECT file, bool_and(state='MISSING') AS blank FROM e GROUP BY file)
SELECT event_id, (CASE WHEN blank THEN 'RFANT' ELSE state END)='RFANT' AS in_state FROM e JOIN b USING (file)""")
def state_gate(spark, folder):
    state = (F.when(F.col("event_type") == "click", "RFANT").when(F.col("event_type") == "view", "RFAMB").otherwise("MISSING"))
    e = table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyyMMddHH").alias("file"), state.alias("state"))
    return op.state_gate(e, "file", "state", "RFANT", "RFANT").select("event_id", "in_state")


@query("mode_filter", """SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY','SMALL') AND CAST(p_size AS VARCHAR) IN ('5','11','28')""")
def mode_filter(spark, folder):
    return table(spark, folder, "part").where(op.mode_filter({"p_type": ["ECONOMY", "SMALL"], "p_size": [5, "11", 28]})).select("p_partkey")


@query("channel_validity", f"""WITH {CELLS} SELECT row_no, chan, x > -0.1 AND label > 0 AND x*x > 0 AND label<>4 AS ok FROM cells""")
def channel_validity(spark, folder):
    ok = op.channel_validity(F.col("x"), F.col("label"), F.col("x") * F.col("x"), -0.1, F.col("label") == 4)
    return cells(spark, folder).select("row_no", "chan", ok.alias("ok"))


@query("comb_channels", f"""WITH {CELLS}, d AS (SELECT row_no, chan, 0.244140625*chan AS f FROM cells)
SELECT chan, count(*) AS n, bool_or(chan%16=8) AS stride, bool_or(abs(chan-5)<=1 OR abs(chan-63)<=1) AS tone,
 bool_or(abs(f-round_even(f,0))<0.15) AS whole, bool_or(abs(f-0.1-round_even((f-0.1)/1.25,0)*1.25)<=0.25) AS comb,
 max(CAST(floor(chan/8)%2 AS INT)) AS arm, bool_or(chan%16=9) AS monitor FROM d GROUP BY chan""")
def comb_channels(spark, folder):
    c, f = F.col("chan"), 0.244140625 * F.col("chan")
    return cells(spark, folder).groupBy("chan").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(op.on_stride(c, 16, 8)).alias("stride"),
        F.bool_or(op.near_tone(c, [5, 63], 1)).alias("tone"), F.bool_or(op.near_integer(f, 0.15)).alias("whole"),
        F.bool_or(op.near_comb(f, 1.25, 0.1, 0.25)).alias("comb"), F.max(op.comb_arm(c, 8)).alias("arm"),
        F.bool_or(op.on_stride(c, 16, 9)).alias("monitor"))


@query("row_slice", f"""WITH {INTEG} SELECT file, row_no, event_id FROM integ WHERE row_no>=10 AND row_no<20""")
def row_slice(spark, folder):
    i = integrations(spark, folder)
    return op.row_slice(i, ["row_no"], 10, 20, ["file"]).select("file", "row_no", "event_id")


@query("version_guard", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority='1-URGENT'""")
def version_guard(spark, folder):
    o = checked.require_columns(table(spark, folder, "orders"), ["o_orderkey", "o_orderpriority"], "orders")
    return checked.require_version(o, "o_orderpriority", "1-URGENT").select("o_orderkey", "o_totalprice")


_ABSURD = """WITH {cte}, m AS (SELECT {k} median(CASE WHEN x>0 THEN x END) AS m FROM cells {g}),
s AS (SELECT {ck} median(abs(x-m)) AS s FROM cells {jm} WHERE x>0 {cg})
SELECT row_no, chan, x<0 OR x>m+3*1.4826*s AS absurd FROM cells {jm} {js}"""


@query("absurd_cells", _ABSURD.format(cte=CELLS, k="chan,", g="GROUP BY chan", ck="chan,", cg="GROUP BY chan", jm="JOIN m USING (chan)", js="JOIN s USING (chan)"))
def absurd_cells(spark, folder):
    return op.absurd_cells(cells(spark, folder), ["chan"], "x", 3.0).select("row_no", "chan", "absurd")


@query("absurd_cells_global", _ABSURD.format(cte=CELLS, k="", g="", ck="", cg="", jm="CROSS JOIN m", js="CROSS JOIN s"))
def absurd_cells_global(spark, folder):
    return op.absurd_cells(cells(spark, folder), [], "x", 3.0).select("row_no", "chan", "absurd")


@query("steady_rows", """SELECT o_orderkey FROM orders WHERE o_orderstatus='F' AND o_totalprice < 100000""")
def steady_rows(spark, folder):
    kind = F.when(F.col("o_orderstatus") == "F", "steady").otherwise("moving")
    return op.steady_rows(table(spark, folder, "orders").withColumn("kind", kind), "kind", "o_totalprice", 100000.0).select("o_orderkey")


@query("order_rows", f"""WITH {INTEG} SELECT event_id, file, row_no FROM integ ORDER BY t NULLS LAST, file, row_no""")
def order_rows(spark, folder):
    i = integrations(spark, folder)
    return i.orderBy(F.col("t").asc_nulls_last(), "file", "row_no").select("event_id", "file", "row_no")


@query("restore_row_order", f"""WITH {INTEG} SELECT file, row_no, power FROM integ""")
def restore_row_order(spark, folder):
    i = integrations(spark, folder).select("file", "row_no", "power")
    return i.repartitionByRange("file", "row_no").sortWithinPartitions("file", "row_no")


@query("top_k", """SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 8""")
def top_k(spark, folder):
    n = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "l_suppkey").limit(8)


@query("arg_extreme", f"""WITH {CELLS} SELECT row_no, arg_min(chan, (x, chan)) AS chan_min, arg_max(chan, (x, -chan)) AS chan_max FROM cells GROUP BY row_no""")
def arg_extreme(spark, folder):
    return cells(spark, folder).groupBy("row_no").agg(
        F.min_by("chan", F.struct("x", "chan")).alias("chan_min"), F.max_by("chan", F.struct(F.col("x"), -F.col("chan"))).alias("chan_max"))


@query("every_nth", f"""WITH {SAMPLES}, p AS (SELECT event_id, t, row_number() OVER (ORDER BY t, event_id)-1 AS p FROM ev) SELECT event_id, t FROM p WHERE p%7=0""")
def every_nth(spark, folder):
    return op.every_nth(samples(spark, folder).select("event_id", "t"), ["t", "event_id"], 7)


@query("keys_in_all", """SELECT l_linenumber AS item FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey)=(SELECT count(DISTINCT l_suppkey) FROM lineitem)""")
def keys_in_all(spark, folder):
    return op.keys_in_all(table(spark, folder, "lineitem"), "l_suppkey", "l_linenumber").select(F.col("l_linenumber").alias("item"))


@query("missing_keys", """SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P'""")
def missing_keys(spark, folder):
    have = table(spark, folder, "orders").where("o_orderstatus='P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").exceptAll(have.distinct()).distinct()


@query("stream_union", """SELECT event_id, list_sort(list_distinct(list_concat([event_type],['click','view'])))[1] AS first_stream,
 len(list_distinct(list_concat([event_type],['click','view'])))::INT AS n_union, event_type IN ('click','view') AS covered FROM events""")
def stream_union(spark, folder):
    have, want = F.array(F.lit("click"), F.lit("view")), F.array("event_type")
    union = F.array_sort(F.array_union(want, have))
    return table(spark, folder, "events").select(
        "event_id", union[0].alias("first_stream"), F.size(union).alias("n_union"),
        (F.size(F.array_except(want, have)) == 0).alias("covered"))


@query("coverage_equality", """WITH a AS (SELECT DISTINCT o_orderdate AS k FROM orders), b AS (SELECT DISTINCT l_shipdate AS k FROM lineitem)
SELECT coalesce(a.k,b.k) AS k, CASE WHEN a.k IS NULL THEN 'not labelled' ELSE 'not covered' END AS problem FROM a FULL JOIN b ON a.k=b.k WHERE a.k IS NULL OR b.k IS NULL""")
def coverage_equality(spark, folder):
    """Days with orders against days with lines shipped, whatever their flag: whole tables on both sides."""
    days = table(spark, folder, "orders").select(F.col("o_orderdate").alias("k")).distinct()
    shipped = table(spark, folder, "lineitem").select(F.col("l_shipdate").alias("k"), "l_returnflag")
    return op.coverage_gaps(days, shipped.where("l_returnflag='N'"), shipped.where("l_returnflag<>'N'"), "k")


@query("first_seen_order", f"""WITH {SAMPLES} SELECT user_id, min(t) AS t FROM ev GROUP BY user_id""")
def first_seen_order(spark, folder):
    return op.first_seen(samples(spark, folder), "user_id", ["t"])
