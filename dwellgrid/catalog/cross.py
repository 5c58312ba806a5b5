"""The query over cross products, on pairs of embedding entries as complex channels."""

from pyspark.sql import functions as F

from dwellgrid.catalog.aggregates import rounded
from dwellgrid.catalog.detect import class_sql
from dwellgrid.catalog.registry import query
from dwellgrid.catalog.rolling import clip_round
from dwellgrid.catalog.views import SPECTRA, spectra
from dwellgrid.operators import fits
from dwellgrid.plans import cross

_TONES = 14


def _bases():
    """Both classes on straight lines over their tones, all trusted."""
    def line(n, k):
        return [[1.0, 2 * i / (n - 1) - 1] for i in range(n)]

    own = {name: [t for t in range(_TONES) if t % 2 == parity] for parity, name in enumerate(cross.CLASSES)}
    return {name: (t, fits.class_basis(t, list(range(_TONES)), 2, line)) for name, t in own.items()}


def _sql(rounds: int = 5) -> str:
    fills = ", ".join(class_sql(name, parity, 2.2, _bases(), tag, value) for tag, value in (("r", "p"), ("i", "q")) for parity, name in enumerate(cross.CLASSES))
    arms = " UNION ALL ".join(f"SELECT w.row_no, w.chan, {parity} AS class, r.{name} AS re, i.{name} AS im, NOT f AND NOT bad AND w.chan%2={parity} AS measured, bad FROM w JOIN or{name} r USING (row_no, chan) JOIN oi{name} i USING (row_no, chan)"
                              for parity, name in enumerate(cross.CLASSES))
    clips = ", ".join(clip_round(f"k{i}", f"k{i + 1}", "NOT measured", ", measured") for i in range(rounds))
    return f"""WITH {SPECTRA}, z AS (SELECT row_no, CAST(c AS INT) AS chan, spec[2*c+1] AS re, spec[2*c+2] AS im FROM spectra, (SELECT unnest(range(32)) AS c)),
b AS (SELECT row_no, chan, (chan-1)//2 AS n, re-(lag(re) OVER w+lead(re) OVER w)/2 AS re, im-(lag(im) OVER w+lead(im) OVER w)/2 AS im FROM z WINDOW w AS (PARTITION BY row_no ORDER BY chan)),
t AS (SELECT row_no, n-1 AS m, re*g AS re, im*g AS im, (row_no*7+n*13)%11=0 OR (row_no%23=4 AND n%3=0) AS f FROM (SELECT *, CASE WHEN n%2=1 THEN sqrt(1+chan/10) ELSE 1 END AS g FROM b) WHERE chan%2=1 AND chan BETWEEN 3 AND 29),
w AS MATERIALIZED (SELECT row_no, m AS chan, re*cos(0.3*m)+im*sin(0.3*m) AS p, im*cos(0.3*m)-re*sin(0.3*m) AS q, f, avg(f::INT) OVER (PARTITION BY row_no)>0.35 AS bad FROM t),
{fills}, a AS MATERIALIZED ({arms}), k0 AS (SELECT class*100+chan AS chan, row_no, sqrt(re*re+im*im) AS p, measured, false AS f FROM a), {clips},
u AS (SELECT *, NOT measured AND NOT (coalesce(lag(measured) OVER w,false) AND coalesce(lead(measured) OVER w,false)) AS un FROM a WINDOW w AS (PARTITION BY row_no, class ORDER BY chan)),
x AS (SELECT u.row_no, u.chan AS tone, class, u.measured, bad, CASE WHEN NOT un AND NOT k.f THEN re END AS re, CASE WHEN NOT un AND NOT k.f THEN im END AS im FROM u JOIN k{rounds} k ON k.row_no=u.row_no AND k.chan=class*100+u.chan)
SELECT row_no, tone, class, measured, bad, round(re*cos(0.3*tone)-im*sin(0.3*tone),7) AS re, round(re*sin(0.3*tone)+im*cos(0.3*tone),7) AS im FROM x"""


@query("reduce_cross", _sql())
def reduce_cross(spark, folder):
    """Fourteen tones of two classes, one leading tone dropped."""
    s = spectra(spark, folder)
    pairs = s.select("row_no", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda c: F.struct(c.alias("chan"), F.get("spec", 2 * c).alias("re"), F.get("spec", 2 * c + 1).alias("im")))).alias("c")).select("row_no", "c.*")
    c, n = F.col("chan"), F.floor((F.col("chan") - 1) / 2)
    flag = ((F.col("row_no") * 7 + n * 13) % 11 == 0) | ((F.col("row_no") % 23 == 4) & (n % 3 == 0))
    out = cross.reduce_cross(pairs, "row_no", "chan", "re", "im", F.when((c % 2 == 1) & c.between(3, 29), n - 1), flag, F.when(n % 2 == 1, F.sqrt(1 + c / 10)).otherwise(1.0), 0.3 * F.col("_tone"),
                             {name: b for name, (_, b) in _bases().items()}, max_cond=2.2, window=9, sigma=3.0, rel_floor=0.2)
    return rounded(out, 7)
