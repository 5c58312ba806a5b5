"""Queries over what a user plugs in: a scanner, a reduction, a sampler."""

from pyspark.sql import functions as F

from dwellgrid.catalog.aggregates import rounded
from dwellgrid.catalog.registry import query
from dwellgrid.catalog.scan import _folder
from dwellgrid.catalog.views import CELLS, cells, spectra, table
from dwellgrid.operators import aggregates as ag
from dwellgrid.operators import folds, grids
from dwellgrid.sources import scanner


@query("scan_by_scanner", """SELECT event_id AS id, value, value > 10 AS flag FROM events WHERE event_type NOT IN ('error','signup')""")
def scan_by_scanner(spark, folder):
    """All events as JSON lines, read back in ranges of bytes; a field that isn't asked for isn't made."""
    ev = table(spark, folder, "events")
    line = (F.when(F.col("event_type") == "error", F.lit("  ")).when(F.col("event_type") == "signup", F.lit('{"provenance": "made by a scan"}'))
            .otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), "props", "value", (F.col("value") > 10).alias("flag")))))
    path = _folder(spark)
    ev.select(line.alias("value")).write.text(path)
    return scanner.scan(spark, path, "id bigint, value double, flag boolean", scanner.lines_scanner("provenance", split_bytes=1 << 20))


@query("block_stats_trimmed", f"""WITH {CELLS} SELECT label, chan, round(CASE WHEN count(*)>2 THEN (sum(x)-min(x)-max(x))/(count(*)-2) END, 9) AS value FROM cells WHERE x>-0.3 GROUP BY 1,2""")
def block_stats_trimmed(spark, folder):
    """A mean without its extremes, from partial states."""
    return rounded(ag.block_stats(cells(spark, folder).where("x > -0.3"), ["label"], "chan", "x", stat=folds.trimmed_mean()))


_AT = "1000*spec[1] AS az, 30+300*spec[2] AS el"


@query("sample_grid", f"""WITH {CELLS}, g AS (SELECT chan AS i, label AS j, avg(x) AS v FROM cells GROUP BY 1,2),
p AS (SELECT row_no, {_AT} FROM spectra UNION ALL SELECT row_no+1000000000, row_no%64*5.625, row_no%10*10.0 FROM spectra UNION ALL SELECT row_no+2000000000, 354.375+5.625*(row_no%8)/8, 45.0 FROM spectra),
q AS (SELECT row_no, (az-360*floor(az/360))*64/360 AS u, el/10 AS v FROM p), c AS (SELECT *, CAST(floor(u) AS INT)%64 AS ci, u-floor(u) AS x, CAST(least(floor(v),8) AS INT) AS cj, v-least(floor(v),8) AS y FROM q WHERE v BETWEEN 0 AND 9)
SELECT q.row_no, round((1-x)*(1-y)*a.v+x*(1-y)*b.v+(1-x)*y*d.v+x*y*e.v, 8) AS sample FROM q LEFT JOIN c USING (row_no) LEFT JOIN g a ON a.i=ci AND a.j=cj LEFT JOIN g b ON b.i=(ci+1)%64 AND b.j=cj LEFT JOIN g d ON d.i=ci AND d.j=cj+1 LEFT JOIN g e ON e.i=(ci+1)%64 AND e.j=cj+1""")
def sample_grid(spark, folder):
    """A field over 64 angles and ten heights read at directions between nodes, at nodes and across the wrap."""
    field = cells(spark, folder).groupBy("chan", "label").agg(F.avg("x").alias("v"))
    read = grids.sampler(field, "chan", "label", "v", around=64, first=0.0, step=10.0, count=10)
    s, n = spectra(spark, folder), F.col("row_no")
    at = lambda add, az, el: s.select((n + add).alias("row_no"), az.alias("az"), el.alias("el"))
    points = (at(0, 1000 * F.col("spec")[0], 30 + 300 * F.col("spec")[1]).unionByName(at(1_000_000_000, n % 64 * 5.625, n % 10 * 10.0))
              .unionByName(at(2_000_000_000, 354.375 + 5.625 * (n % 8) / 8, F.lit(45.0))))
    return rounded(grids.sampled(points, F.col("az"), F.col("el"), read).select("row_no", "sample"), 8)
