"""Queries over small least-squares problems."""

from pyspark.sql import functions as F

from dwellgrid.catalog.aggregates import rounded
from dwellgrid.catalog.registry import query
from dwellgrid.catalog.views import CELLS, SPECTRA, cells, r6, spectra
from dwellgrid.functions import complexnum as C
from dwellgrid.operators import solve as op

E1, E2, RH = ["a0", "a1", "a2"], ["b0", "b1", "b2"], ["c0", "c1", "c2"]

# design rows from entries 1-9 of a spectrum, data from 10-13, pixel = label
_S = SPECTRA + """, s AS (SELECT row_no, label AS pix, spec[1] AS a0, spec[2] AS a1, spec[3] AS a2, spec[4] AS b0, spec[5] AS b1, spec[6] AS b2, spec[7] AS c0, spec[8] AS c1, spec[9] AS c2,
 spec[10] AS xr, spec[11] AS xi, spec[12] AS yr, spec[13] AS yi FROM spectra),
pr AS (SELECT row_no, pix, a0,a1,a2,b0,b1,b2, a0*a0+b0*b0+c0*c0 AS n00, a0*a1+b0*b1+c0*c1 AS n01, a0*a2+b0*b2+c0*c2 AS n02, a1*a1+b1*b1+c1*c1 AS n11, a1*a2+b1*b2+c1*c2 AS n12, a2*a2+b2*b2+c2*c2 AS n22,
 a0*xr+b0*yr AS re0, a1*xr+b1*yr AS re1, a2*xr+b2*yr AS re2, a0*xi+b0*yi AS im0, a1*xi+b1*yi AS im1, a2*xi+b2*yi AS im2, xr*xr+xi*xi+yr*yr+yi*yi AS bb, 1 AS cnt FROM s)"""
_N = ["n00", "n01", "n02", "n11", "n12", "n22", "re0", "re1", "re2", "im0", "im1", "im2", "bb", "cnt"]
_AGG = ", ".join(f"sum({c}) AS {c}" for c in _N)


def _solved(src: str, name: str) -> str:
    return f"""{name}d AS (SELECT *, n00*(n11*n22-n12*n12)-n01*(n01*n22-n12*n02)+n02*(n01*n12-n11*n02) AS det, (n00+n11+n22)/3 AS q FROM {src}),
{name}e AS (SELECT *, sqrt(((n00-q)*(n00-q)+(n11-q)*(n11-q)+(n22-q)*(n22-q)+2*(n01*n01+n02*n02+n12*n12))/6) AS p FROM {name}d),
{name}f AS (SELECT *, acos(least(greatest(((n00-q)*((n11-q)*(n22-q)-n12*n12)-n01*(n01*(n22-q)-n12*n02)+n02*(n01*n12-(n11-q)*n02))/(2*p*p*p),-1),1))/3 AS phi FROM {name}e),
{name} AS (SELECT *, sqrt((q+2*p*cos(phi))/(q+2*p*cos(phi+2*pi()/3))) AS cond,
 """ + ", ".join(f"((n11*n22-n12*n12)*{t}0+(n02*n12-n01*n22)*{t}1+(n01*n12-n02*n11)*{t}2)/det AS u{t}0, ((n02*n12-n01*n22)*{t}0+(n00*n22-n02*n02)*{t}1+(n01*n02-n00*n12)*{t}2)/det AS u{t}1, ((n01*n12-n02*n11)*{t}0+(n01*n02-n00*n12)*{t}1+(n00*n11-n01*n01)*{t}2)/det AS u{t}2" for t in ("re", "im")) + f" FROM {name}f)"


def samples3(spark, folder):
    e = F.col("spec")
    s = spectra(spark, folder).select("row_no", F.col("label").alias("pix"), *[e[i].alias(n) for i, n in enumerate([*E1, *E2, *RH])],
                                      C.cplx(e[9], e[10]).alias("ex"), C.cplx(e[11], e[12]).alias("ey"))
    cols = lambda names: [F.col(n) for n in names]
    return s.select("*", *op.sample_products(cols(E1), cols(E2), cols(RH), F.col("ex"), F.col("ey")))


@query("pixel_solve", f"""WITH {_S}, t AS (SELECT pix, {_AGG} FROM pr GROUP BY 1), {_solved('t', 'u')}
SELECT pix, CAST(cnt AS BIGINT) AS n_visits, round(ure0,7) AS ure0, round(ure1,7) AS ure1, round(ure2,7) AS ure2, round(uim0,7) AS uim0, round(uim1,7) AS uim1, round(uim2,7) AS uim2, round(cond,7) AS cond,
 round(sqrt(greatest(bb-(re0*ure0+re1*ure1+re2*ure2+im0*uim0+im1*uim1+im2*uim2),0))/sqrt(bb),7) AS resid_frac FROM u WHERE cond<=30""")
def pixel_solve(spark, folder):
    return rounded(op.pixel_solve(samples3(spark, folder), "pix"), 7)


_PRED = "round(a0*ure0+a1*ure1+a2*ure2,7) AS ex_re, round(a0*uim0+a1*uim1+a2*uim2,7) AS ex_im, round(b0*ure0+b1*ure1+b2*ure2,7) AS ey_re, round(b0*uim0+b1*uim1+b2*uim2,7) AS ey_im"


@query("held_out_predictions", f"""WITH {_S}, t AS (SELECT pix, {_AGG} FROM pr GROUP BY 1), o AS (SELECT pr.row_no, pr.pix, a0,a1,a2,b0,b1,b2, {', '.join(f't.{c}-pr.{c} AS {c}' for c in _N)} FROM pr JOIN t ON pr.pix=t.pix), {_solved('o', 'u')}
SELECT row_no, pix, {_PRED} FROM u WHERE cond<=30""")
def held_out_predictions(spark, folder):
    return rounded(op.leave_one_out(samples3(spark, folder), ["row_no"], "pix", E1, E2), 7)


_CL = """lg AS (SELECT *, row_no-lag(row_no) OVER (PARTITION BY pix ORDER BY row_no) AS g FROM pr), cl AS (SELECT *, sum(CASE WHEN g>20 THEN 1 ELSE 0 END) OVER (PARTITION BY pix ORDER BY row_no) AS cluster FROM lg)"""


@query("predict_other_dwells", f"""WITH {_S}, {_CL}, w AS (SELECT pix, cluster, {_AGG} FROM cl GROUP BY 1,2), t AS (SELECT pix, {_AGG} FROM pr GROUP BY 1), o AS (SELECT w.pix, w.cluster, {', '.join(f't.{c}-w.{c} AS {c}' for c in _N)} FROM w JOIN t ON w.pix=t.pix),
oo AS (SELECT * FROM o WHERE cnt>0), {_solved('oo', 'u')} SELECT cl.row_no, cl.pix, {_PRED} FROM cl JOIN u ON cl.pix=u.pix AND cl.cluster=u.cluster WHERE cond<=30""")
def predict_other_dwells(spark, folder):
    return rounded(op.predict_other_dwells(samples3(spark, folder), ["row_no"], "pix", "row_no", E1, E2), 7)


@query("split_half", f"""WITH {_S}, {_CL}, w AS (SELECT pix, cluster%2 AS h, {_AGG} FROM cl GROUP BY 1,2), {_solved('w', 'u')}, d AS (SELECT pix, count(DISTINCT cluster) AS n FROM cl GROUP BY 1)
SELECT a.pix, n AS n_dwells, round(a.ure0,7) AS ure0_a, round(b.ure0,7) AS ure0_b, round(a.uim2,7) AS uim2_a, round(b.uim2,7) AS uim2_b FROM u a JOIN u b ON a.pix=b.pix AND a.h=0 AND b.h=1 JOIN d ON a.pix=d.pix WHERE a.cond<=30 AND b.cond<=30 AND n>=2""")
def split_half(spark, folder):
    out = op.split_half(samples3(spark, folder), "pix", "row_no")
    return rounded(out.select("pix", "n_dwells", "ure0_a", "ure0_b", "uim2_a", "uim2_b"), 7)


@query("block_phase", f"""WITH {SPECTRA}, z AS (SELECT row_no, row_number() OVER (ORDER BY row_no)-1 AS p, CASE WHEN label<>9 THEN spec[1]*spec[3]+spec[2]*spec[4] END AS re, CASE WHEN label<>9 THEN spec[2]*spec[3]-spec[1]*spec[4] END AS im FROM spectra)
SELECT row_no, round(CASE WHEN count(re) OVER w>=3 THEN atan2(sum(im) OVER w, sum(re) OVER w) END,8) AS phase FROM z WINDOW w AS (PARTITION BY p//20)""")
def block_phase(spark, folder):
    e = F.col("spec")
    s = spectra(spark, folder).select("row_no", F.when(F.col("label") != 9, C.cplx(e[0], e[1])).alias("d"), C.cplx(e[2], e[3]).alias("p"))
    return rounded(op.block_phase(s, ["row_no"], F.col("d"), F.col("p")).select("row_no", "phase"), 8)


@query("align_and_correlate", f"""WITH {SPECTRA}, v AS (SELECT spec[1] AS ar,spec[2] AS ai,spec[3] AS br,spec[4] AS bi,spec[5] AS cr,spec[6] AS ci, spec[1]+spec[7] AS xr,spec[2]+spec[8] AS xi,spec[3]+spec[9] AS yr,spec[4]+spec[10] AS yi,spec[5]+spec[11] AS zr,spec[6]+spec[12] AS zi FROM spectra),
h AS (SELECT *, ar*ar+ai*ai+br*br+bi*bi+cr*cr+ci*ci AS h, xr*xr+xi*xi+yr*yr+yi*yi+zr*zr+zi*zi AS t FROM v), m AS (SELECT median(h) AS m FROM h WHERE h>0), d AS (SELECT m, median(abs(h-m)) AS s FROM h, m WHERE h>0 GROUP BY 1), k AS (SELECT h.*, h>m+3*1.4826*s AS bad FROM h, d)
SELECT count(*) FILTER (WHERE NOT bad) AS n, count(*) FILTER (WHERE bad) AS n_absurd, round(sum(ar*xr+ai*xi+br*yr+bi*yi+cr*zr+ci*zi) FILTER (WHERE NOT bad)/sum(h) FILTER (WHERE NOT bad),8) AS scale_re,
 round(sum(ar*xi-ai*xr+br*yi-bi*yr+cr*zi-ci*zr) FILTER (WHERE NOT bad)/sum(h) FILTER (WHERE NOT bad),8) AS scale_im, round(corr(h,t) FILTER (WHERE NOT bad),8) AS power,
 round(corr(ar*ar+ai*ai,xr*xr+xi*xi) FILTER (WHERE NOT bad),8) AS x, round(corr(br*br+bi*bi,yr*yr+yi*yi) FILTER (WHERE NOT bad),8) AS y, round(corr(cr*cr+ci*ci,zr*zr+zi*zi) FILTER (WHERE NOT bad),8) AS z FROM k""")
def align_and_correlate(spark, folder):
    e = F.col("spec")
    s = spectra(spark, folder).select(*[C.cplx(e[2 * i], e[2 * i + 1]).alias(f"h{i}") for i in range(3)],
                                      *[C.cplx(e[2 * i] + e[2 * i + 6], e[2 * i + 1] + e[2 * i + 7]).alias(f"t{i}") for i in range(3)])
    return rounded(op.align_and_correlate(s, ["h0", "h1", "h2"], ["t0", "t1", "t2"], 3.0), 8)


@query("nnls_per_pixel", f"""WITH {CELLS}, s AS (SELECT chan, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS byy FROM (SELECT chan, p/1000 AS a, 1+label/10.0 AS b, x+0.02*(chan-30)*(label-4) AS y FROM cells) GROUP BY 1),
f AS (SELECT *, (bb*ay-ab*byy)/(aa*bb-ab*ab) AS f1, (aa*byy-ab*ay)/(aa*bb-ab*ab) AS f2, greatest(ay/aa,0) AS o1, greatest(byy/bb,0) AS o2 FROM s)
SELECT chan, round(CASE WHEN f1>=0 AND f2>=0 THEN f1 WHEN o1*ay>=o2*byy THEN o1 ELSE 0 END,7) AS g1, round(CASE WHEN f1>=0 AND f2>=0 THEN f2 WHEN o1*ay>=o2*byy THEN 0 ELSE o2 END,7) AS g2 FROM f""")
def nnls_per_pixel(spark, folder):
    y = F.col("x") + 0.02 * (F.col("chan") - 30) * (F.col("label") - 4)
    return rounded(op.nnls2(cells(spark, folder), ["chan"], F.col("p") / 1000, 1 + F.col("label") / 10.0, y), 7)


@query("weighted_ls", f"""WITH {CELLS}, d AS (SELECT row_no, chan/64.0 AS f, x, 1.0+chan%3 AS w FROM cells WHERE x>-0.3), s AS (SELECT row_no, count(*) AS n, sum(w) AS sw, sum(w*f) AS sf, sum(w*f*f) AS sff, sum(w*x) AS sx, sum(w*f*x) AS sfx FROM d GROUP BY 1)
SELECT row_no, n, round((sff*sx-sf*sfx)/(sw*sff-sf*sf),7) AS c0, round((sw*sfx-sf*sx)/(sw*sff-sf*sf),7) AS c1 FROM s""")
def weighted_ls(spark, folder):
    c = cells(spark, folder).where("x > -0.3")
    fit = op.weighted_ls(c, ["row_no"], [F.lit(1.0), F.col("chan") / 64.0], F.col("x"), 1.0 + F.col("chan") % 3)
    return rounded(fit.select("row_no", "n", F.col("coef")[0].alias("c0"), F.col("coef")[1].alias("c1")), 7)


@query("block_cv", f"""WITH {CELLS}, d AS (SELECT row_no, CAST(chan AS DOUBLE) AS f, x, chan//8 AS b FROM cells), o AS (SELECT row_no, b, count(*) AS n, sum(f) AS sf, sum(f*f) AS sff, sum(x) AS sx, sum(f*x) AS sfx FROM d GROUP BY 1,2),
t AS (SELECT row_no, sum(n) AS n, sum(sf) AS sf, sum(sff) AS sff, sum(sx) AS sx, sum(sfx) AS sfx FROM o GROUP BY 1), r AS (SELECT o.row_no, o.b, t.n-o.n AS n, t.sf-o.sf AS sf, t.sff-o.sff AS sff, t.sx-o.sx AS sx, t.sfx-o.sfx AS sfx FROM o JOIN t USING (row_no) WHERE b BETWEEN 1 AND 6),
c AS (SELECT row_no, b, (sff*sx-sf*sfx)/(n*sff-sf*sf) AS c0, (n*sfx-sf*sx)/(n*sff-sf*sf) AS c1 FROM r), h AS (SELECT d.row_no, d.b, sum((x-c0-c1*f)*(x-c0-c1*f)) AS ss, count(*) AS n FROM d JOIN c ON d.row_no=c.row_no AND d.b=c.b GROUP BY 1,2)
SELECT row_no, round(sqrt(sum(ss)/sum(n)),7) AS rms, round(stddev_samp(ss/n)/sqrt(count(*))/(2*sqrt(sum(ss)/sum(n))),7) AS rms_se, round(sum(ss/0.01)/sum(n),6) AS chi2, CAST(sum(n) AS BIGINT) AS n, count(*) AS nblock FROM h GROUP BY 1""")
def block_cv(spark, folder):
    c = cells(spark, folder).withColumn("f", F.col("chan").cast("double"))
    out = op.block_cv(c, ["row_no"], "f", 8.0, [F.lit(1.0), F.col("f")], F.col("x"), F.lit(0.1))
    return out.select("row_no", r6("rms", 7).alias("rms"), r6("rms_se", 7).alias("rms_se"), r6("chi2").alias("chi2"), "n", "nblock")


@query("principal_plane_angle")
def principal_plane_angle(spark, folder):
    e = F.col("spec")
    s = spectra(spark, folder).select("row_no", *[F.when(F.col("label") != 6, e[i]).alias(n) for i, n in enumerate("xyz")], (F.col("row_no") % 90).cast("double").alias("motor"))
    return op.principal_plane_angle(s, ["row_no"], ["x", "y", "z"], "motor").select("row_no", r6("angle", 5).alias("angle"))


@query("cos2_peak", f"""WITH {CELLS}, z AS (SELECT row_no, 30*spec[1] AS e, 180*spec[2] AS a, lead(30*spec[1]) OVER w AS e1, lead(180*spec[2]) OVER w AS a1, lead(row_no) OVER w AS r1 FROM spectra WINDOW w AS (ORDER BY row_no)),
x AS (SELECT row_no AS r0, r1, -e/(e1-e) AS w, 2*radians(a+(-e/(e1-e))*(a1-a)) AS b FROM z WHERE sign(e)<>sign(e1) AND abs(e)<10),
y AS (SELECT c0.chan, cos(b) AS c, sin(b) AS s, c0.p+w*(c1.p-c0.p) AS y FROM x JOIN cells c0 ON c0.row_no=r0 JOIN cells c1 ON c1.row_no=r1 AND c1.chan=c0.chan),
m AS (SELECT chan, count(*) AS n, avg(c) AS mc, avg(s) AS ms, avg(y) AS my, covar_pop(c,c) AS cc, covar_pop(s,s) AS ss, covar_pop(c,s) AS cs, covar_pop(c,y) AS cy, covar_pop(s,y) AS sy FROM y GROUP BY 1),
l AS (SELECT *, (cy*ss-sy*cs)/(cc*ss-cs*cs) AS u, (sy*cc-cy*cs)/(cc*ss-cs*cs) AS v FROM m), k AS (SELECT chan, CASE WHEN n>=4 THEN my-u*mc-v*ms+sqrt(u*u+v*v) END AS peak FROM l)
SELECT k.chan, round(k.peak,6) AS peak, round((coalesce(a.peak,b.peak)+coalesce(b.peak,a.peak))/2/k.peak,6) AS scale FROM k LEFT JOIN k a ON a.chan=k.chan-1 LEFT JOIN k b ON b.chan=k.chan+1 WHERE k.chan%2=1""")
def cos2_peak(spark, folder):
    s = spectra(spark, folder).select("row_no", (30 * F.col("spec")[0]).alias("el"), (180 * F.col("spec")[1]).alias("az"))
    x = op.zero_crossings(s, ["row_no"], "el", "az")
    c = cells(spark, folder).select("row_no", "chan", "p")
    at = lambda side: c.select(F.col("row_no").alias(f"row_no_{side}"), "chan", F.col("p").alias(f"p{side}"))
    both = x.join(at(0), "row_no_0").join(at(1), ["row_no_1", "chan"])
    peaks = op.cos2_peak(both.withColumn("pw", F.col("p0") + F.col("w") * (F.col("p1") - F.col("p0"))), "chan", F.col("az"), F.col("pw"))
    return rounded(op.arm_scale(peaks, "chan"), 6)


@query("grid_search", f"""WITH {CELLS}, g AS (SELECT p::DOUBLE AS p, q::DOUBLE AS q FROM (SELECT unnest([-1.0,0.0,1.0]) AS p), (SELECT unnest([-0.5,0.0,0.5]) AS q)), c1 AS (SELECT g.p, g.q, avg(pow(cells.x-g.p*0.1-g.q*chan/64.0,2)) AS cost FROM cells, g GROUP BY 1,2),
b AS (SELECT p, q FROM c1 ORDER BY cost, p, q LIMIT 1), g2 AS (SELECT b.p+dp AS p, b.q+dq AS q FROM b, (SELECT unnest([-1.0,-0.5,0.0,0.5,1.0]) AS dp), (SELECT unnest([-0.5,0.0,0.5]) AS dq)),
c2 AS (SELECT g2.p, g2.q, avg(pow(cells.x-g2.p*0.1-g2.q*chan/64.0,2)) AS cost FROM cells, g2 GROUP BY 1,2) SELECT p::DOUBLE AS p, q::DOUBLE AS q, round(cost,9) AS cost FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2)""")
def grid_search(spark, folder):
    cost = lambda p, q: F.pow(F.col("x") - p * 0.1 - q * F.col("chan") / 64.0, 2)
    return rounded(op.grid_search(cells(spark, folder), cost, [-1.0, 0.0, 1.0], [-0.5, 0.0, 0.5], 0.5))
