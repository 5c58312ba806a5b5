"""Queries over scans, sources and sinks."""

from pyspark.sql import functions as F

from dwellgrid.catalog.registry import query
from dwellgrid.catalog.views import INTEG, SPECTRA, integrations, r6, samples, spectra, table
from dwellgrid.functions.clock import file_day, file_time
from dwellgrid.session import cut
from dwellgrid.sources import checked, scan, sinks

# one "file" per embedding row: 64 header times counted back from the stamp,
# with a clock offset that makes some files disagree with their names
_FILES_SQL = """files AS (SELECT vec_id AS file, label, 1000.0*vec_id AS stamp,
  CASE WHEN label = 7 THEN NULL ELSE 'h'||label END AS head_tag, 'root' AS root_tag,
  CASE WHEN label < 5 THEN 0.5 ELSE 0.25 END AS dt, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
rowsx AS (SELECT *, unnest(e) AS ev, generate_subscripts(e,1)-1 AS row_no, len(e) AS n, e[len(e)] AS el FROM files),
timed AS (SELECT *, stamp - (n-1-row_no)*dt + ev + CASE WHEN label=3 THEN -4665600.0 WHEN label=4 THEN 3600.0 ELSE 0.0 END AS time,
  stamp + el + CASE WHEN label=3 THEN -4665600.0 WHEN label=4 THEN 3600.0 ELSE 0.0 END AS lastt FROM rowsx),
fixed AS (SELECT *, abs(stamp-lastt) <= 3600 AS sync_consistent, stamp-(n-1-row_no)*dt AS time_fname,
  time - row_no*dt AS sync_recovered FROM timed)"""


def _files(spark, folder):
    e = table(spark, folder, "embeddings")
    off = F.when(F.col("label") == 3, -4665600.0).when(F.col("label") == 4, 3600.0).otherwise(0.0)
    arr = F.col("embedding").cast("array<double>")
    f = e.select(
        F.col("vec_id").alias("file"), "label", (F.lit(1000.0) * F.col("vec_id")).alias("stamp"),
        F.when(F.col("label") != 7, F.concat(F.lit("h"), F.col("label").cast("string"))).alias("head_tag"),
        F.lit("root").alias("root_tag"), F.when(F.col("label") < 5, 0.5).otherwise(0.25).alias("dt"),
        arr.alias("e"), off.alias("off"))
    times = F.transform("e", lambda v, i: F.col("stamp") - (F.size("e") - 1 - i) * F.col("dt") + v + F.col("off"))
    return f.withColumn("times", times).withColumn("acc_cnt", F.transform("e", lambda v, i: i.cast("bigint")))


@query("scan_integrations", f"""WITH {_FILES_SQL}
SELECT file, CAST(row_no AS INT) AS row_no, round(time,4) AS time, dt AS integration_time,
  coalesce(head_tag, root_tag) AS tag, round(sync_recovered,4) AS sync_recovered FROM fixed""")
def scan_integrations(spark, folder):
    files = _files(spark, folder).withColumn("tag", scan.override(F.col("head_tag"), F.col("root_tag")))
    out = scan.scan_integrations(files, "stamp", "dt", keep=("file", "tag"))
    return out.select("file", "row_no", r6("time", 4).alias("time"), "integration_time", "tag",
                      r6("sync_recovered", 4).alias("sync_recovered"))


@query("time_best", f"""WITH {_FILES_SQL}
SELECT file, CAST(row_no AS INT) AS row_no, sync_consistent, round(time_fname,4) AS time_fname,
  round(CASE WHEN sync_consistent THEN time ELSE time_fname END,4) AS time_best FROM fixed""")
def time_best(spark, folder):
    out = scan.scan_integrations(_files(spark, folder), "stamp", "dt", keep=("file",))
    return out.select("file", "row_no", "sync_consistent", r6("time_fname", 4).alias("time_fname"),
                      r6("time_best", 4).alias("time_best"))


_STREAM_SQL = """st AS (SELECT event_id, CASE event_type WHEN 'click' THEN props
  WHEN 'view' THEN NULL WHEN 'purchase' THEN 'null' WHEN 'signup' THEN '{"k": null, "on": true, "name": "s'||user_id||'"}'
  ELSE replace(props, '}', ', "status": "error"}') END AS txt FROM events)"""


def _streams(spark, folder):
    ev = table(spark, folder, "events")
    txt = (F.when(F.col("event_type") == "click", F.col("props"))
           .when(F.col("event_type") == "view", F.lit(None).cast("string"))
           .when(F.col("event_type") == "purchase", F.lit("null"))
           .when(F.col("event_type") == "signup",
                 F.concat(F.lit('{"k": null, "on": true, "name": "s'), F.col("user_id").cast("string"), F.lit('"}')))
           .otherwise(F.replace("props", F.lit("}"), F.lit(', "status": "error"}'))))
    return ev.select("event_id", txt.alias("txt"))


_FIELDS = {"k": "double", "on": "boolean", "name": "string"}


@query("flatten_metadata", f"""WITH {_STREAM_SQL}
SELECT event_id, CAST(json_extract_string(txt,'$.k') AS DOUBLE) AS motor_k,
  CASE json_extract_string(txt,'$.on') WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.0::DOUBLE END AS motor_on,
  coalesce(json_extract_string(txt,'$.name'),'MISSING') AS motor_name,
  coalesce(txt IS NOT NULL AND trim(txt) <> 'null' AND coalesce(json_extract_string(txt,'$.status'),'') <> 'error', false) AS motor_ok
FROM st""")
def flatten_metadata(spark, folder):
    return scan.flatten_stream(_streams(spark, folder), "txt", "motor", _FIELDS).drop("txt")


@query("stream_columns", f"""WITH {_STREAM_SQL}
SELECT event_id, CAST(NULL AS DOUBLE) AS imu_x, 'MISSING' AS imu_name, false AS imu_ok,
  CAST(json_extract_string(txt,'$.k') AS DOUBLE) AS motor_k,
  CASE json_extract_string(txt,'$.on') WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.0::DOUBLE END AS motor_on,
  coalesce(json_extract_string(txt,'$.name'),'MISSING') AS motor_name,
  coalesce(txt IS NOT NULL AND trim(txt) <> 'null' AND coalesce(json_extract_string(txt,'$.status'),'') <> 'error', false) AS motor_ok
FROM st""")
def stream_columns(spark, folder):
    flat = scan.flatten_stream(_streams(spark, folder), "txt", "motor", _FIELDS)
    catalog = {"motor": _FIELDS, "imu": {"x": "double", "name": "string"}, "therm": {"t": "double"}}
    return scan.stream_columns(flat, ["motor", "imu"], catalog, ["event_id"])


@query("quarantine_scan", """WITH st AS (SELECT strftime(ts,'%Y%m%d') AS day,
  CASE WHEN value < 10 THEN substr(props,1,length(props)-1) ELSE props END AS txt FROM events)
SELECT day, count(*) AS n_rows, CAST(sum(CASE WHEN json_valid(txt) THEN 0 ELSE 1 END) AS BIGINT) AS n_lost,
  CAST(sum(CASE WHEN json_valid(txt) THEN CAST(json_extract(txt,'$.k') AS BIGINT) END) AS BIGINT) AS sum_k FROM st GROUP BY day""")
def quarantine_scan(spark, folder):
    ev = table(spark, folder, "events")
    txt = F.when(F.col("value") < 10, F.expr("substr(props, 1, length(props)-1)")).otherwise(F.col("props"))
    rows = ev.select(F.date_format("ts", "yyyyMMdd").alias("day"), txt.alias("txt"))
    good, _ = scan.quarantine(rows, "txt", "k bigint")
    return good.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("stream_lost").cast("bigint")).alias("n_lost"), F.sum("k").alias("sum_k"))


@query("finalise_union", """
SELECT event_id, epoch_us(ts)/1e6 AS t, CASE WHEN event_type='click' THEN 'c'||user_id ELSE 'MISSING' END AS tag,
  CASE WHEN event_type='view' THEN value END AS el, event_type='view' AND value > 50 AS motor_ok
FROM events""")
def finalise_union(spark, folder):
    ev = samples(spark, folder)
    a = ev.where("state = 'RFANT'").select("event_id", "t", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("tag"))
    b = ev.where("state = 'RFAMB'").select("event_id", "t", F.col("power").alias("el"), (F.col("power") > 50).alias("motor_ok"))
    c = ev.where("state NOT IN ('RFANT', 'RFAMB')").select("event_id", "t")
    return scan.finalise_union([a, b, c], ["t", "event_id"])


@query("manifest_changes", """WITH o AS (SELECT o_custkey AS name, count(*) AS size, max(o_orderdate) AS mtime FROM orders WHERE o_orderstatus='F' GROUP BY 1),
n AS (SELECT o_custkey AS name, count(*) AS size, max(o_orderdate) AS mtime FROM orders WHERE o_orderstatus<>'F' GROUP BY 1)
SELECT coalesce(o.name,n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed'
 WHEN o.size=n.size AND o.mtime=n.mtime THEN 'same' ELSE 'changed' END AS change FROM o FULL OUTER JOIN n ON o.name=n.name""")
def manifest_changes(spark, folder):
    o = table(spark, folder, "orders")

    def manifest(rows):
        return o.where(rows).groupBy(F.col("o_custkey").alias("name")).agg(
            F.count(F.lit(1)).alias("size"), F.max("o_orderdate").alias("mtime"))

    return scan.manifest_changes(manifest("o_orderstatus = 'F'"), manifest("o_orderstatus <> 'F'"), "name", ["size", "mtime"])


@query("decode_complex", f"""WITH {SPECTRA}, k AS (SELECT row_no, spec, unnest(range(0,32)) AS k FROM spectra)
SELECT row_no, CAST(k AS INT) AS chan, spec[2*k+1] AS re, spec[2*k+2] AS im FROM k""")
def decode_complex(spark, folder):
    s = spectra(spark, folder)
    pairs = F.transform(F.sequence(F.lit(1), F.size("spec"), F.lit(2)), lambda i: F.slice("spec", i, 2))
    return s.select("row_no", F.posexplode(scan.decode_complex(pairs)).alias("chan", "z")).select("row_no", "chan", "z.re", "z.im")


@query("load_spectra", """WITH q AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS v FROM lineitem GROUP BY 1,2),
w AS (SELECT l_orderkey, max(CASE WHEN l_returnflag='A' THEN v END) AS "A", max(CASE WHEN l_returnflag='N' THEN v END) AS "N",
 max(CASE WHEN l_returnflag='R' THEN v END) AS "R" FROM q GROUP BY 1)
SELECT o_orderkey AS l_orderkey, "A", "N", "R" FROM orders LEFT JOIN w ON o_orderkey=l_orderkey WHERE o_orderstatus='F'""")
def load_spectra(spark, folder):
    cube = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    chosen = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return scan.load_spectra(cube, chosen, ["l_orderkey"], "l_returnflag", "v", keys=["A", "N", "R", "A"])


@query("load_spectra_default_keys", """SELECT label, row_no, CAST(i AS INT) AS i, 4 AS n_columns, spec[41+i] AS k5, spec[49+i] AS k6 FROM (SELECT vec_id AS row_no, label, CAST(embedding AS DOUBLE[]) AS spec FROM embeddings), (SELECT unnest(range(8)) AS i)""")
def load_spectra_default_keys(spark, folder):
    """Eight bands as keys, of which two are in every file."""
    s = spectra(spark, folder)
    bands = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.struct(F.concat(F.lit("k"), j.cast("string")).alias("key"), F.slice("spec", 8 * j + 1, F.lit(8)).alias("v")))
    there = F.filter(bands, lambda b: (b["key"] != F.concat(F.lit("k"), (F.col("label") % 5).cast("string"))) & ((b["key"] != "k7") | (F.col("label") > 0)))
    cube = s.select("label", "row_no", F.explode(there).alias("b")).select("label", "row_no", "b.*")
    out = scan.load_spectra(cube, s.select("label", "row_no"), ["label", "row_no"], "key", "v")
    each = F.posexplode(F.arrays_zip("k5", "k6")).alias("i", "b")
    return out.select("label", "row_no", F.lit(len(out.columns)).alias("n_columns"), each).select("label", "row_no", "i", "n_columns", "b.*")


@query("null_block", """SELECT event_id, vec_id IS NOT NULL AS present, CAST(64 AS INT) AS n_chan,
  CASE WHEN vec_id IS NULL THEN 64 ELSE 0 END::INT AS n_null FROM events LEFT JOIN embeddings ON event_id=vec_id""")
def null_block(spark, folder):
    base = table(spark, folder, "events").select(F.col("event_id").alias("row_no"))
    out = scan.null_block(base, spectra(spark, folder), ["row_no"], "spec", 64)
    return out.select(F.col("row_no").alias("event_id"), "present", F.size("spec").alias("n_chan"),
                      F.size(F.filter("spec", lambda x: x.isNull())).alias("n_null"))


@query("load_jsonl_checked", """SELECT event_id AS id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, value > 10 AS flag
FROM events WHERE event_type NOT IN ('error','signup')""")
def load_jsonl_checked(spark, folder):
    ev = table(spark, folder, "events")
    line = (F.when(F.col("event_type") == "error", F.lit("  "))
            .when(F.col("event_type") == "signup", F.lit('{"provenance": "made by a scan"}'))
            .otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                                          (F.col("value") > 10).alias("flag")))))
    rows = checked.parse_lines(ev.select(line.alias("line")), "line", "id bigint, k bigint, flag boolean", "provenance")
    return checked.require_unique(rows, ["id"])


@query("read_product", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderpriority='2-HIGH' AND strftime(o_orderdate,'%Y')='1996' AND o_orderstatus='O'""")
def read_product(spark, folder):
    """Written by (version, day) folders, then read back: both predicates prune folders."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderpriority").alias("version"), F.date_format("o_orderdate", "yyyy").alias("day"))
    path = _folder(spark)
    o.write.partitionBy("version", "day").parquet(path)
    kept = spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string, version string, day string").parquet(path)
    out = checked.read_product(kept, "2-HIGH", F.col("day"), "1996", ("o_orderstatus", "O"))
    return out.select("o_orderkey", "o_totalprice")


@query("write_product", f"""WITH {INTEG} SELECT file, row_no, power, substr(file,6,8) AS day, 'v1' AS version FROM integ""")
def write_product(spark, folder):
    raw = integrations(spark, folder).select("file", "row_no", "power", file_day(F.col("file")).alias("day"))
    path = _folder(spark)
    sinks.write_product(raw, raw, path, version="v1", file="file", row="row_no", day="day")
    back = spark.read.schema("file string, row_no bigint, power double, version string, day string").parquet(path)
    return back


def _folder(spark):
    """A fresh folder beside the checkpoints (shared by all executors)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        cut(spark.range(1))
    return f"{sc.getCheckpointDir()}/tables-{spark.sql('select uuid()').first()[0]}"


@query("write_day_masks", f"""WITH {INTEG} SELECT substr(file,6,8) AS day, CAST(count(*) AS BIGINT) AS n,
 CAST(sum(CASE WHEN power > 100 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM integ GROUP BY 1""")
def write_day_masks(spark, folder):
    m = samples(spark, folder).select(file_day(F.col("file")).alias("day"), "file", "t", (F.col("power") > 100).cast("int").alias("flags"))
    log = m.groupBy("day", "file").agg(F.sum("flags").alias("flagged"))
    path = _folder(spark)
    sinks.write_day_tables(m, log, {"excess": 0}, path, "day")
    back = spark.read.schema("file string, t double, flags int, day string").parquet(f"{path}/masks")
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("flags").alias("flagged"))


@query("write_solutions", f"""WITH {SPECTRA}, c AS (SELECT label, unnest(spec) AS x, generate_subscripts(spec,1)-1 AS chan FROM spectra)
SELECT CAST(chan AS INT) AS chan, round(avg(CASE WHEN label>=5 THEN x END)-avg(CASE WHEN label<5 THEN x END),9) AS excess FROM c GROUP BY 1""")
def write_solutions(spark, folder):
    c = spectra(spark, folder).select("label", F.posexplode("spec").alias("chan", "x"))
    on = c.groupBy("chan").agg(F.avg(F.when(F.col("label") >= 5, F.col("x"))).alias("on"),
                               F.avg(F.when(F.col("label") < 5, F.col("x"))).alias("off"))
    path = _folder(spark)
    sinks.write_solutions(on, path, "v1")
    return sinks.load_solutions(spark, path, "v1", 64).select("chan", r6("excess", 9).alias("excess"))


@query("scan_window", """SELECT event_id, epoch_us(ts)/1e6 AS t FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09 12:00:00'""")
def scan_window(spark, folder):
    s = samples(spark, folder, window=(1704434400.0, 1704801600.0))
    out = scan.scan_window(s, file_time(F.col("file")), F.col("t"), 1704434400.0, 1704801600.0, margin_s=86400.0)
    return out.select("event_id", "t")


@query("manifest_hash", """SELECT c_custkey, sha256(c_name||'|'||c_mktsegment) AS digest FROM customer""")
def manifest_hash(spark, folder):
    c = table(spark, folder, "customer")
    return c.select("c_custkey", checked.content_hash(F.concat_ws("|", "c_name", "c_mktsegment")).alias("digest"))
