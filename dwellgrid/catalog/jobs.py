"""Queries over composite jobs: flagging, calibration, campaign, evaluation."""

from pyspark.sql import functions as F

from dwellgrid.catalog.aggregates import rounded
from dwellgrid.catalog.registry import query
from dwellgrid.catalog.rolling import _roll, padded
from dwellgrid.catalog.segments import HOURLY, hourly
from dwellgrid.catalog.views import CELLS, INTEG, SAMPLES, SPECTRA, cells, integrations, r6, samples, spectra, table
from dwellgrid.functions import complexnum as C
from dwellgrid.operators import aggregates as ag
from dwellgrid.operators import rangejoins as rj
from dwellgrid.operators import segments as sg
from dwellgrid.operators import solve
from dwellgrid.operators import timejoins as tj
from dwellgrid.plans import calibration, campaign, evaluation, flagging

# nodes of a state: time, value and a label that changes now and then
_NODE_STATE = "SELECT t, power AS p, CASE WHEN user_id%5=0 THEN 'B' ELSE 'A' END AS label FROM ev WHERE state='{s}'"


def state_nodes(s, state):
    return s.where(F.col("state") == state).select("t", F.col("power").alias("p"), F.when(F.col("user_id") % 5 == 0, "B").otherwise("A").alias("label"))


@query("calibrated_visits", f"""WITH {SAMPLES}, c AS (SELECT *, t-lag(t) OVER (ORDER BY t,event_id) AS g FROM ev WHERE state='RFANT' AND t>=1704100000 AND t<1706000000),
v AS (SELECT *, sum(CASE WHEN g>600 THEN 1 ELSE 0 END) OVER (ORDER BY t,event_id) AS visit FROM c), m AS (SELECT CAST(visit AS BIGINT) AS visit, count(*) AS n, sum(t*(1+input))/sum(1+input) AS t, sum(power*(1+input))/sum(1+input) AS power FROM v GROUP BY 1),
nd AS (SELECT t, 2.0+power/100 AS sc, -power AS ofs FROM ev WHERE state='RFNON'), j AS (SELECT m.*, a.t AS pt, a.sc AS psc, a.ofs AS pof, b.t AS nt, b.sc AS nsc, b.ofs AS nof FROM m ASOF LEFT JOIN nd a ON m.t>=a.t ASOF LEFT JOIN nd b ON m.t<=b.t),
k AS (SELECT *, pt IS NULL OR nt-t<t-pt AS nx FROM j), l AS (SELECT *, abs(t-CASE WHEN nx THEN nt ELSE pt END)<=1800 AS ok FROM k)
SELECT visit, n, round(t,2) AS t, round(power,7) AS power, round(CASE WHEN ok THEN t-CASE WHEN nx THEN nt ELSE pt END END,4) AS node_dt, round(CASE WHEN ok THEN CASE WHEN nx THEN nsc*power+nof ELSE psc*power+pof END END,6) AS calibrated FROM l""")
def calibrated_visits(spark, folder):
    """The flagship: filter, visits, weighted means, nearest node, calibration."""
    s = samples(spark, folder, window=(1704100000.0, 1706000000.0), states=["RFANT"])
    nd = samples(spark, folder, states=["RFNON"]).select(F.col("t").alias("node_t"), (2.0 + F.col("power") / 100).alias("sc"), (-F.col("power")).alias("ofs"))
    out = calibration.calibrated_visits(s, "t", ["event_id"], "power", 1 + F.col("input"), "state", "RFANT", 1704100000.0, 1706000000.0,
                                        600.0, nd, "node_t", "sc", "ofs", 1800.0)
    return out.select("visit", "n", r6("t", 2).alias("t"), r6("power", 7).alias("power"), r6("node_dt", 4).alias("node_dt"), r6("calibrated", 6).alias("calibrated"))


_RAW = CELLS + """, fc AS (SELECT label, row_no, chan, 1000*x+300 AS raw, row_no%4<>0 AS ant FROM cells),
rp AS (SELECT label, row_no, chan, ant, raw<0 AS wrapped, CASE WHEN raw<0 THEN coalesce(median(CASE WHEN raw>=0 THEN log10(greatest(raw,1)) END) OVER (PARTITION BY label,chan),0) ELSE log10(greatest(raw,1)) END AS logp FROM fc)"""


def raw_cells(spark, folder):
    return cells(spark, folder).select("label", "row_no", "chan", (1000 * F.col("x") + 300).alias("raw"))


@query("overflow_repair", f"WITH {_RAW} SELECT row_no, chan, wrapped, round(logp,9) AS logp FROM rp")
def overflow_repair(spark, folder):
    out = flagging.overflow_repair(raw_cells(spark, folder), ["label"], "chan", "raw")
    return rounded(out.select("row_no", "chan", "wrapped", "logp"))


@query("categorise", f"""WITH {CELLS}, c AS (SELECT row_no, chan, x>0.15 AS pix, chan=17 AS st, chan%8=0 AS own, row_no%3=0 AS bb, row_no%5=0 AS ms, chan BETWEEN 22 AND 27 OR chan BETWEEN 13 AND 21 AS air, chan IN (34,35) AS orb FROM cells)
SELECT row_no, chan, (CASE WHEN NOT (pix OR st) THEN 0 WHEN own OR st AND chan BETWEEN 36 AND 40 THEN 4 WHEN bb AND air THEN 16 WHEN ms AND air THEN 8 WHEN orb AND NOT air THEN 32 ELSE 64 END)::INT AS category FROM c""")
def categorise(spark, folder):
    ch, r = F.col("chan"), F.col("row_no")
    cat = flagging.categorise(F.col("x") > 0.15, ch == 17, ch % 8 == 0, r % 3 == 0, r % 5 == 0, _bands())
    return cells(spark, folder).select("row_no", "chan", cat.alias("category"))


def _bands():
    ch = F.col("chan")
    return flagging.Bands(analysis=ch.between(8, 58), fm=ch.between(22, 27), dtv=ch.between(13, 21), orbit=ch.isin(34, 35), local=ch.between(36, 40))


_FLAG = (_RAW + ", v AS (SELECT * FROM rp WHERE ant), " + padded("", "v", "label,chan", "row_no", "row_no, logp", 4, "a") + f""",
b AS (SELECT label, chan, row_no, rn, cn, logp-median(logp) OVER {_roll('label,chan', 4)} AS r FROM a), b1 AS (SELECT * FROM b WHERE rn BETWEEN 1 AND cn), tm AS (SELECT label, chan, median(r) AS m FROM b1 GROUP BY 1,2),
ts AS (SELECT label, chan, 1.4826*median(abs(r-m)) AS s FROM b1 JOIN tm USING (label,chan) GROUP BY 1,2), pix AS (SELECT label, chan, row_no, cn>=12 AND s>=1e-9 AND abs(r)>2.5*s AS pix FROM b1 JOIN ts USING (label,chan)),
md AS (SELECT label, chan, median(logp) AS med FROM v GROUP BY 1,2), """ + padded("", "md", "label", "chan", "chan, med", 15, "p") + f""",
q AS (SELECT label, chan, rn, cn, med-median(med) OVER {_roll('label', 15)} AS r FROM p), q1 AS (SELECT * FROM q WHERE rn BETWEEN 1 AND cn), qm AS (SELECT label, median(r) AS m FROM q1 WHERE chan BETWEEN 8 AND 58 GROUP BY 1),
qs AS (SELECT label, 1.4826*median(abs(r-m)) AS s FROM q1 JOIN qm USING (label) WHERE chan BETWEEN 8 AND 58 GROUP BY 1), st AS (SELECT label, chan, chan BETWEEN 8 AND 58 AND r>1.5*s AS st FROM q1 JOIN qs USING (label)),
""" + padded("", "md", "label", "chan", "chan, med", 4, "e") + f""", k AS (SELECT label, chan, rn, cn, med-median(med) OVER {_roll('label', 4)} AS r FROM e), k1 AS (SELECT * FROM k WHERE rn BETWEEN 1 AND cn AND chan BETWEEN 8 AND 58),
km AS (SELECT label, median(r) AS m FROM k1 GROUP BY 1), ks AS (SELECT label, 1.4826*median(abs(r-m)) AS s FROM k1 JOIN km USING (label) GROUP BY 1),
kp AS (SELECT label, ph, (median(CASE WHEN chan%4=ph THEN r END)-median(CASE WHEN chan%4<>ph THEN r END))/any_value(s) AS c FROM k1 JOIN ks USING (label), (SELECT unnest(range(0,4)) AS ph) GROUP BY 1,2), kc AS (SELECT label, max(c) AS c, arg_max(ph,(c,-ph)) AS ph FROM kp GROUP BY 1),
al AS (SELECT rp.*, coalesce(pix,false) AS pix, st, kc.c>=0.5 AND chan%4=kc.ph AND chan BETWEEN 8 AND 58 AS own, chan BETWEEN 13 AND 27 AS air FROM rp LEFT JOIN pix USING (label,chan,row_no) JOIN st USING (label,chan) JOIN kc USING (label)),
ev2 AS (SELECT label, row_no, avg(CASE WHEN chan BETWEEN 8 AND 58 THEN pix::INT END)>0.15 AS bb, avg(CASE WHEN chan BETWEEN 22 AND 27 THEN pix::INT END)>0.05 AND avg(CASE WHEN chan BETWEEN 13 AND 21 THEN pix::INT END)>0.05 AS ms FROM al GROUP BY 1,2),
ct AS (SELECT row_no, chan, wrapped, (CASE WHEN NOT (pix OR st) THEN 0 WHEN own OR st AND chan BETWEEN 36 AND 40 THEN 4 WHEN bb AND air THEN 16 WHEN ms AND air THEN 8 WHEN chan IN (34,35) THEN 32 ELSE 64 END)|(CASE WHEN ant THEN 0 ELSE 1 END) AS c FROM al JOIN ev2 USING (label,row_no))""")


@query("flag_cells", f"WITH {_FLAG} SELECT row_no, chan, (CASE WHEN wrapped THEN (c&131)|128 ELSE c END)::INT AS flags FROM ct")
def flag_cells(spark, folder):
    out = flagging.flag_cells(raw_cells(spark, folder), ["label"], "row_no", "chan", "raw", F.col("row_no") % 4 != 0, _bands(),
                              [("locked", 4, ag.locked_teeth(F.col("chan"), 4))], clip=2.5, steady_clip=1.5, comb_threshold=0.5)
    return out.select("row_no", "chan", "flags")


@query("identify_combs", f"""WITH {_FLAG} SELECT label, round(c,9) AS locked_contrast, ph::DOUBLE AS locked_phase, c>=0.5 AS locked_detected FROM kc""")
def identify_combs(spark, folder):
    from dwellgrid.operators.rolling import persistent_track
    w = flagging.overflow_repair(raw_cells(spark, folder), ["label"], "chan", "raw")
    med = persistent_track(w, ["label"], "chan", "logp", F.col("row_no") % 4 != 0, F.col("chan").between(8, 58)).select("label", "chan", "med")
    return rounded(flagging.identify_combs(med, ["label"], "chan", "med", F.col("chan").between(8, 58), [("locked", 4, ag.locked_teeth(F.col("chan"), 4))], 0.5))


def _comb_sql(name: str, half: int, teeth: str) -> str:
    """CTEs: residuals of the median spectrum, their MAD, contrast of every phase, the best of them."""
    return (padded("", "md", "label", "chan", "chan, v", half, f"{name}p") + f""",
{name}q AS (SELECT label, chan, rn, cn, v-median(v) OVER {_roll('label', half)} AS r FROM {name}p), {name}r AS (SELECT label, chan, r FROM {name}q WHERE rn BETWEEN 1 AND cn),
{name}m AS (SELECT label, median(r) AS m FROM {name}r GROUP BY 1), {name}s AS (SELECT label, 1.4826*median(abs(r-m)) AS s, count(*) AS n FROM {name}r JOIN {name}m USING (label) GROUP BY 1),
{name}t AS (SELECT label, ph, r, {teeth} AS tooth FROM {name}r, ph WHERE ph.comb='{name}'),
{name}k AS (SELECT label, ph, (median(CASE WHEN tooth THEN r END)-median(CASE WHEN NOT tooth THEN r END))/any_value(s) AS c FROM {name}t JOIN {name}s USING (label) WHERE s>=1e-12 AND n>=32 GROUP BY 1,2
  HAVING count(*) FILTER (tooth)>=8 AND count(*) FILTER (NOT tooth)>=8),
{name} AS (SELECT label, max(c) AS c, arg_max(ph,(c,-ph)) AS ph FROM {name}k GROUP BY 1)""")


_WALKING = CELLS + """, md AS (SELECT label, chan, median(x) AS v FROM cells GROUP BY 1,2), ph AS (SELECT 'lk' AS comb, unnest(range(0,4))::DOUBLE AS ph UNION ALL SELECT 'wk', unnest(range(0,16))*12.5/16),
""" + _comb_sql("lk", 4, "chan%4=ph") + ", " + _comb_sql("wk", 6, "abs((4.0::DOUBLE*chan-ph)/12.5-round_even((4.0::DOUBLE*chan-ph)/12.5,0))*12.5<=2.0")


@query("identify_walking_comb", f"""WITH {_WALKING} SELECT l.label, round(lk.c,9) AS locked_contrast, lk.ph AS locked_phase, coalesce(lk.c,0)>=0.3 AS locked_detected,
round(wk.c,9) AS walking_contrast, wk.ph AS walking_phase, coalesce(wk.c,0)>=0.3 AND coalesce(wk.c,0)>coalesce(lk.c,0) AS walking_detected
FROM (SELECT DISTINCT label FROM md) l LEFT JOIN lk USING (label) LEFT JOIN wk USING (label)""")
def identify_walking_comb(spark, folder):
    med = ag.block_stats(cells(spark, folder), ["label"], "chan", "x")
    combs = [("locked", 4, ag.locked_teeth(F.col("chan"), 4)), ("walking", 6, ag.walking_teeth(4.0 * F.col("chan"), 12.5, 4.0))]
    return rounded(flagging.identify_combs(med, ["label"], "chan", "value", F.lit(True), combs, 0.3))


@query("quicklook_flags", f"""WITH {CELLS}, c AS (SELECT label, row_no, chan, CASE WHEN row_no%11=0 OR chan=50 OR abs(x)<0.01 THEN 0 ELSE abs(x) END AS m FROM cells), lv AS (SELECT label, row_no, max(m)>0 AS live FROM c GROUP BY 1,2),
md AS (SELECT label, chan, median(m) AS v, avg((m=0)::INT)>0.9 AS dead FROM c JOIN lv USING (label,row_no) WHERE live GROUP BY 1,2), sc AS (SELECT label, chan%8 AS ph, median(v) AS s FROM md GROUP BY 1,2), bs AS (SELECT label, median(CASE WHEN v>0 THEN v END) AS b FROM md GROUP BY 1),
cb AS (SELECT label, CASE WHEN max(s)/any_value(b)>=1.02 THEN arg_max(ph,(s,-ph)) END AS ph FROM sc JOIN bs USING (label) GROUP BY 1),
w AS (SELECT c.*, live, dead OR coalesce(least((chan-ph+64)%8, 8-(chan-ph+64)%8)<=1,false) AS static FROM c JOIN lv USING (label,row_no) JOIN md USING (label,chan) JOIN cb USING (label)),
s AS (SELECT label, row_no, chan, m, row_number() OVER (PARTITION BY row_no ORDER BY chan)-1 AS i, count(*) OVER (PARTITION BY row_no) AS n FROM w WHERE live AND NOT static),
e AS (SELECT *, i AS pos FROM s UNION ALL SELECT *, -i FROM s WHERE i BETWEEN 1 AND 5 UNION ALL SELECT *, 2*(n-1)-i FROM s WHERE i BETWEEN n-6 AND n-2),
f AS (SELECT *, m-median(m) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS r FROM e), g AS (SELECT * FROM f WHERE pos=i), sg AS (SELECT label, median(CASE WHEN r<>0 THEN abs(r) END) AS sg FROM g GROUP BY 1)
SELECT w.row_no, w.chan, w.static OR w.m=0 OR coalesce(r<>0 AND abs(r)>3*1.4826*sg, false) AS flag FROM w LEFT JOIN g USING (row_no,chan) LEFT JOIN sg ON w.label=sg.label""")
def quicklook_flags(spark, folder):
    zero = (F.col("row_no") % 11 == 0) | (F.col("chan") == 50) | (F.abs("x") < 0.01)
    c = cells(spark, folder).select("label", "row_no", "chan", F.when(zero, 0.0).otherwise(F.abs("x")).alias("m"))
    return flagging.quicklook_flags(c, ["label"], "row_no", "chan", "m", nsig=3.0, spacing=8, min_excess=1.02).select("row_no", "chan", "flag")


def _bracket_sql(name, src, nodes_cte, vals, gap, hold=None):
    """CTE text: bracket of ``src`` (event_id, t) by a node CTE."""
    pick = []
    for v in vals:
        hold_case = f" WHEN abs(t-CASE WHEN pt IS NULL OR nt-t<t-pt THEN nt ELSE pt END)<={hold} THEN CASE WHEN pt IS NULL OR nt-t<t-pt THEN n_{v} ELSE p_{v} END" if hold else ""
        pick.append(f"CASE WHEN pt=t THEN p_{v} WHEN pl=nl AND nt-pt<={gap} THEN (1-(t-pt)/(nt-pt))*p_{v}+(t-pt)/(nt-pt)*n_{v}{hold_case} END AS {name}_{v}")
    cols = lambda a, p: ", ".join(f"{a}.{v} AS {p}_{v}" for v in vals)
    return f"""{name}0 AS (SELECT s.event_id, s.t, a.t AS pt, a.label AS pl, {cols('a', 'p')}, b.t AS nt, b.label AS nl, {cols('b', 'n')} FROM {src} s ASOF LEFT JOIN {nodes_cte} a ON s.t>=a.t ASOF LEFT JOIN {nodes_cte} b ON s.t<=b.t),
{name} AS (SELECT event_id, {', '.join(pick)} FROM {name}0)"""


_REFL = "SELECT t, power/2000 AS re, (input-1)/50.0 AS im, CASE WHEN user_id%7=0 THEN 'B' ELSE 'A' END AS label FROM ev WHERE state='VNAANT' AND input={i}"
_MISM = "(1-{g}_re*{g}_re-{g}_im*{g}_im)/((1-({g}_re*rec_re-{g}_im*rec_im))*(1-({g}_re*rec_re-{g}_im*rec_im))+({g}_re*rec_im+{g}_im*rec_re)*({g}_re*rec_im+{g}_im*rec_re))"


@query("calibrate_rows", f"""WITH {SAMPLES}, src AS (SELECT event_id, t, input FROM ev WHERE state='RFANT'), n_amb AS ({_NODE_STATE.format(s='RFAMB')}), n_non AS (SELECT t, p+1000 AS p, label FROM ({_NODE_STATE.format(s='RFNON')})),
r_ant AS ({_REFL.format(i=0)}), r_amb AS ({_REFL.format(i=1)}), r_rec AS ({_REFL.format(i=2)}), th AS (SELECT t, 290+power/100 AS k FROM ev WHERE state='UNKNOWN'),
{_bracket_sql('amb', 'src', 'n_amb', ['p'], 3600)}, {_bracket_sql('non', 'src', 'n_non', ['p'], 3600)}, {_bracket_sql('ga', 'src', 'r_ant', ['re', 'im'], 20000, 1800)}, {_bracket_sql('gl', 'src', 'r_amb', ['re', 'im'], 20000, 1800)}, {_bracket_sql('rec', 'src', 'r_rec', ['re', 'im'], 20000, 1800)},
tn AS (SELECT s.event_id, s.t, a.t AS pt, a.k AS pk, b.t AS nt, b.k AS nk FROM src s ASOF LEFT JOIN th a ON s.t>=a.t ASOF LEFT JOIN th b ON s.t<=b.t), tl AS (SELECT event_id, CASE WHEN abs(t-CASE WHEN pt IS NULL OR nt-t<t-pt THEN nt ELSE pt END)<=900 THEN CASE WHEN pt IS NULL OR nt-t<t-pt THEN nk ELSE pk END END AS t_load FROM tn),
j AS (SELECT src.event_id, input, t_load, 917/(non_p-amb_p) AS a, t_load-917/(non_p-amb_p)*amb_p AS b, {_MISM.format(g='ga')} AS ma, {_MISM.format(g='gl')} AS ml FROM src JOIN amb USING (event_id) JOIN non USING (event_id) JOIN ga USING (event_id) JOIN gl USING (event_id) JOIN rec USING (event_id) JOIN tl USING (event_id))
SELECT event_id, round(t_load,6) AS t_load, round(CASE WHEN input<3 THEN a/ma END,7) AS scale, round(CASE WHEN input<3 THEN (b-(1-ml)*t_load)/ma END,6) AS offset FROM j""")
def calibrate_rows(spark, folder):
    s = samples(spark, folder)
    refl = lambda i: s.where((F.col("state") == "VNAANT") & (F.col("input") == i)).select(
        "t", (F.col("power") / 2000).alias("re"), ((F.col("input") - 1) / 50.0).alias("im"), F.when(F.col("user_id") % 7 == 0, "B").otherwise("A").alias("label"))
    non = state_nodes(s, "RFNON").withColumn("p", F.col("p") + 1000)
    therm = s.where("state = 'UNKNOWN'").select("t", (290 + F.col("power") / 100).alias("k"))
    out = calibration.calibrate_rows(s.where("state = 'RFANT'").select("event_id", "t", "input"), ["event_id"], "t", {"amb": state_nodes(s, "RFAMB"), "non": non},
                                     {"ant": refl(0), "amb": refl(1), "rec": refl(2)}, therm,
                                     calibration.Limits(max_s11_gap_s=20000.0, therm_tol_s=900.0), F.col("input") < 3)
    return out.select("event_id", r6("t_load").alias("t_load"), r6("scale", 7).alias("scale"), r6("offset").alias("offset"))


@query("as_received", f"""WITH {SPECTRA}, c AS (SELECT row_no, unnest(range(0,64)) AS chan, spec FROM spectra), z AS (SELECT chan::INT AS chan, spec[chan+1]/2 AS ar, spec[(chan+16)%64+1]/2 AS ai, spec[(chan+1)%64+1]/4 AS lr, spec[(chan+17)%64+1]/4 AS li, spec[(chan+32)%64+1]/3 AS rr, spec[(chan+47)%64+1]/3 AS ri FROM c),
m AS (SELECT chan, avg(ar) AS ar, avg(ai) AS ai, avg(lr) AS lr, avg(li) AS li, avg(rr) AS rr, avg(ri) AS ri FROM z GROUP BY 1),
t AS (SELECT chan, (1-ar*ar-ai*ai)/(pow(1-(ar*rr-ai*ri),2)+pow(ar*ri+ai*rr,2))*1300-(1-lr*lr-li*li)/(pow(1-(lr*rr-li*ri),2)+pow(lr*ri+li*rr,2))*295 AS t FROM m),
e AS (SELECT z.chan, abs((1-ar*ar-ai*ai)/(pow(1-(ar*rr-ai*ri),2)+pow(ar*ri+ai*rr,2))*1300-(1-lr*lr-li*li)/(pow(1-(lr*rr-li*ri),2)+pow(lr*ri+li*rr,2))*295-t) AS d, t FROM z JOIN t USING (chan))
SELECT chan, round(any_value(t),6) AS t_ns, round(median(d),6) AS median_move, round(max(d),6) AS max_move FROM e GROUP BY 1""")
def as_received(spark, folder):
    s = spectra(spark, folder).select("spec", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("chan"))
    at = lambda k, d: F.get("spec", (F.col("chan") + k) % 64) / d
    out = calibration.as_received(s, "chan", C.cplx(at(0, 2), at(16, 2)), C.cplx(at(1, 4), at(17, 4)), C.cplx(at(32, 3), at(47, 3)), 300.0, 1000.0, 295.0)
    return rounded(out, 6)


@query("reference_spectrum", f"""WITH {CELLS}, r AS (SELECT DISTINCT row_no, CASE WHEN label<6 THEN 'sky' WHEN label<8 THEN 'non' ELSE 'amb' END AS state FROM cells), b AS (SELECT *, sum(n) OVER (ORDER BY row_no)-1 AS block FROM (SELECT *, CASE WHEN lag(state) OVER (ORDER BY row_no) IS NULL OR lag(state) OVER (ORDER BY row_no)<>state THEN 1 ELSE 0 END AS n FROM r)),
bt AS (SELECT block, state, avg(row_no) AS t FROM b GROUP BY 1,2), sp AS (SELECT block, state, t, chan, median(p+CASE WHEN state='non' THEN 2000 ELSE 0 END) AS v FROM cells JOIN b USING (row_no) JOIN bt USING (block,state) GROUP BY 1,2,3,4),
bb AS (SELECT k.t, a.t AS at0, a2.t AS at1, n.t AS nt0, n2.t AS nt1 FROM (SELECT t FROM bt WHERE state='sky') k ASOF LEFT JOIN (SELECT t FROM bt WHERE state='amb') a ON k.t>=a.t ASOF LEFT JOIN (SELECT t FROM bt WHERE state='amb') a2 ON k.t<=a2.t ASOF LEFT JOIN (SELECT t FROM bt WHERE state='non') n ON k.t>=n.t ASOF LEFT JOIN (SELECT t FROM bt WHERE state='non') n2 ON k.t<=n2.t),
pk AS (SELECT t, CASE WHEN at0 IS NULL OR at1-t<t-at0 THEN at1 ELSE at0 END AS ta, CASE WHEN nt0 IS NULL OR nt1-t<t-nt0 THEN nt1 ELSE nt0 END AS tn FROM bb),
ts AS (SELECT s.chan, 300+917*(s.v-a.v)/(n.v-a.v) AS ts FROM sp s JOIN pk ON s.t=pk.t JOIN sp a ON a.state='amb' AND a.t=pk.ta AND a.chan=s.chan JOIN sp n ON n.state='non' AND n.t=pk.tn AND n.chan=s.chan WHERE s.state='sky')
SELECT chan, count(*) AS n, round(median(ts),6) AS t_star FROM ts GROUP BY 1""")
def reference_spectrum(spark, folder):
    state = F.when(F.col("label") < 6, "sky").when(F.col("label") < 8, "non").otherwise("amb")
    c = cells(spark, folder).withColumn("state", state).withColumn("t", F.col("row_no").cast("double"))
    c = c.withColumn("p", F.col("p") + F.when(F.col("state") == "non", 2000.0).otherwise(0.0))
    return rounded(calibration.reference_spectrum(c, "state", "t", "chan", "p", "sky", "non", "amb", 300.0, 917.0, 1e9), 6)


@query("cross_check", f"""WITH {SAMPLES}, l AS (SELECT *, t-lag(t) OVER (ORDER BY t,event_id) AS g FROM ev WHERE state='RFANT'), v AS (SELECT *, sum(CASE WHEN g>600 THEN 1 ELSE 0 END) OVER (ORDER BY t,event_id) AS visit FROM l),
vt AS (SELECT visit, min(t) AS a, max(t) AS b, avg(power) AS ref FROM v GROUP BY 1), md AS (SELECT visit, median(2*power) AS m, any_value(ref) AS ref FROM vt JOIN (SELECT t, power FROM ev WHERE state='RFANT') r ON r.t BETWEEN a AND b GROUP BY 1)
SELECT count(*) AS n, round(quantile_cont(m/ref,0.05),7) AS p5, round(median(m/ref),7) AS median, round(quantile_cont(m/ref,0.95),7) AS p95, round(max(m/ref),7) AS worst FROM md""")
def cross_check(spark, folder):
    s = samples(spark, folder).where("state = 'RFANT'")
    v = sg.visits(s, "t", ["event_id"], 600.0).groupBy("visit").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.avg("power").alias("ref"))
    return rounded(calibration.cross_check(s, "t", 2 * F.col("power"), v, "visit", "start", "stop", "ref"), 7)


_CAMP = HOURLY + """, f AS (SELECT hfile AS file, max(t) AS closed, min(phase) AS phase FROM hourly GROUP BY 1), md AS (SELECT s_suppkey AS num, 'corr_202401'||lpad(CAST(1+s_suppkey%28 AS VARCHAR),2,'0')||lpad(CAST(s_nationkey%10 AS VARCHAR),2,'0') AS a, 'corr_202401'||lpad(CAST(1+s_suppkey%28 AS VARCHAR),2,'0')||lpad(CAST(10+s_nationkey%14 AS VARCHAR),2,'0') AS b, 'm'||s_nationkey%3 AS mode FROM supplier),
mm AS (SELECT file, arg_min(mode,num) AS mode FROM f JOIN md ON file BETWEEN a AND b GROUP BY 1), mk AS (SELECT t AS a, t+3600 AS b, event_id AS rank, state FROM ev WHERE power>200), mh AS (SELECT file, arg_min(mk.state,rank) AS mask FROM f JOIN mk ON closed BETWEEN a AND b GROUP BY 1),
camp AS (SELECT file, CASE WHEN NOT closed BETWEEN 1704200000 AND 1706400000 THEN 'time' WHEN phase<>'A' THEN 'phase' WHEN mode IS NULL THEN 'unmapped' WHEN mode NOT IN ('m0','m1') THEN 'mode' WHEN mask IS NOT NULL THEN 'mask: '||mask END AS reason FROM f LEFT JOIN mm USING (file) LEFT JOIN mh USING (file))"""


def _campaign(spark, folder, masks=None, **asked):
    h = hourly(spark, folder)
    files = h.groupBy("file").agg(F.max("t").alias("closed"), F.min("phase").alias("phase"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.concat(F.lit("corr_202401"), two(1 + k % 28))
    modes = table(spark, folder, "supplier").select(k.alias("number"), F.concat(day, two(n % 10)).alias("file_first"), F.concat(day, two(10 + n % 14)).alias("file_last"), F.concat(F.lit("m"), (n % 3).cast("string")).alias("mode"))
    if masks is None:
        masks = samples(spark, folder).where("power > 200").select(F.col("t").alias("start"), (F.col("t") + 3600).alias("stop"), F.col("event_id").alias("rank"), F.col("state").alias("mask"))
    return campaign.campaign_select(files, "file", "closed", 1704200000.0, 1706400000.0, "phase", ["A"], modes, masks, {"mode": ["m0", "m1"]}, **asked)


@query("campaign_select", f"WITH {_CAMP} SELECT file, reason FROM camp")
def campaign_select(spark, folder):
    return _campaign(spark, folder).select("file", "reason")


@query("campaign_warnings", f"WITH {_CAMP} SELECT coalesce(reason,'kept') AS outcome, count(*) AS files FROM camp GROUP BY 1")
def campaign_warnings(spark, folder):
    return campaign.selection_warnings(_campaign(spark, folder))


_SCOPED = """mk2 AS (SELECT t AS a, t+3600 AS b, event_id AS rank, state AS mask, user_id%3=0 AS must, CASE WHEN user_id%2=1 THEN input END AS inp FROM ev WHERE power>100),
h AS (SELECT file, (NOT must)::INT AS late, rank::DOUBLE AS rank, mask FROM f JOIN mk2 ON closed BETWEEN a AND b WHERE must OR mask IN ('RFANT','VNAANT') AND coalesce(inp IN (0,1),true)
 UNION ALL SELECT DISTINCT hfile, 1, 500.5, 'overflow' FROM hourly WHERE power>120 AND input IN (0,1)),
g AS (SELECT file, arg_min(mask,(late,rank)) AS mask FROM h GROUP BY 1)"""


def _scoped(spark, folder):
    """Masks of which some are mandatory and some bound to an input, and files with wrapped samples."""
    h, s = hourly(spark, folder), samples(spark, folder)
    masks = s.where("power > 100").select(
        F.col("t").alias("start"), (F.col("t") + 3600).alias("stop"), F.col("event_id").alias("rank"), F.col("state").alias("mask"),
        (F.col("user_id") % 3 == 0).alias("mandatory"), F.when(F.col("user_id") % 2 == 1, F.array("input")).alias("inputs"))
    return masks, h.where("power > 120").select("file", "input")


@query("campaign_masks", f"WITH {HOURLY}, f AS (SELECT hfile AS file, max(t) AS closed FROM hourly GROUP BY 1), {_SCOPED} SELECT file, mask FROM f LEFT JOIN g USING (file)")
def campaign_masks(spark, folder):
    """Mandatory masks first, then the wanted ones that concern inputs 0 and 1, overflow among them."""
    masks, wrapped = _scoped(spark, folder)
    files = hourly(spark, folder).groupBy("file").agg(F.max("t").alias("closed"))
    return campaign.first_mask(files, "file", "closed", masks, ["RFANT", "VNAANT", "overflow"], [0, 1], wrapped, ("overflow", 500.5)).select("file", "mask")


@query("campaign_select_masks", f"WITH {_CAMP}, {_SCOPED}" + """ SELECT file, CASE WHEN NOT closed BETWEEN 1704200000 AND 1706400000 THEN 'time' WHEN phase<>'A' THEN 'phase' WHEN mode IS NULL THEN 'unmapped' WHEN mode NOT IN ('m0','m1') THEN 'mode'
WHEN mask IS NOT NULL THEN 'mask: '||mask END AS reason FROM f LEFT JOIN mm USING (file) LEFT JOIN g USING (file)""")
def campaign_select_masks(spark, folder):
    """A campaign's files under mandatory, wanted, input-bound and overflow masks in one call."""
    masks, wrapped = _scoped(spark, folder)
    out = _campaign(spark, folder, masks, mask_names=["RFANT", "VNAANT", "overflow"], inputs=[0, 1], overflow=wrapped, overflow_mask=("overflow", 500.5))
    return out.select("file", "reason")


@campaign.register("flags")
def flags_product(base, version, source):
    return rj.join_exact(base, source.where(F.col("version") == version).select("file", "row_no", "mask"), ["file", "row_no"], "flags_")


@campaign.register("gain")
def gain_product(base, version, source):
    return tj.nearest(base, "t", source.where(F.col("version") == version).select("t", "gain"), "t", ["gain"], tolerance_s=1800.0, prefix="gain_")


@query("bundle", f"""WITH {INTEG}, fl AS (SELECT file, row_no, CASE WHEN power>50 THEN 256 ELSE 0 END AS flags FROM integ WHERE file<>'corr_20240104_235959Z.h5'), g AS (SELECT t, power/10 AS gain FROM ev WHERE state='RFNON' AND input=0),
j AS (SELECT i.file, i.row_no, i.t, flags, a.t AS pt, a.gain AS pg, b.t AS nt, b.gain AS ng FROM integ i LEFT JOIN fl USING (file,row_no) ASOF LEFT JOIN g a ON i.t>=a.t ASOF LEFT JOIN g b ON i.t<=b.t)
SELECT file, row_no, coalesce(flags,-1)::INT AS flags, round(CASE WHEN abs(t-CASE WHEN pt IS NULL OR nt-t<t-pt THEN nt ELSE pt END)<=1800 THEN CASE WHEN pt IS NULL OR nt-t<t-pt THEN ng ELSE pg END END,6) AS gain FROM j""")
def bundle(spark, folder):
    """Two products that exist in two versions each, joined at the versions named."""
    i = integrations(spark, folder).where("t IS NOT NULL")
    versions = F.explode(F.array(*map(F.lit, ["v1", "v2"]))).alias("version")
    flags = i.where("file <> 'corr_20240104_235959Z.h5'").select("file", "row_no", "power", versions)
    flags = flags.withColumn("mask", F.when(F.col("version") == "v1", F.when(F.col("power") > 50, 256).otherwise(0)).otherwise(1))
    gain = samples(spark, folder).where("state = 'RFNON' AND input = 0").select("t", "power", versions)
    gain = gain.withColumn("gain", F.when(F.col("version") == "v2", F.col("power") / 10).otherwise(0.0))
    out = campaign.bundle(i.select("file", "row_no", "t"), {"flags@v1": flags, "gain@v2": gain}, ["t", "file", "row_no"])
    return out.select("file", "row_no", F.coalesce("flags_mask", F.lit(-1)).alias("flags"), r6("gain_gain").alias("gain"))


@query("bundle_skipped", f"""WITH {INTEG}, f AS (SELECT file, count(*) AS n, count(*) FILTER (power>2 AND file<>'corr_20240104_235959Z.h5') AS k FROM integ GROUP BY 1)
SELECT file, 'flags@v1' AS product, CASE WHEN k=0 THEN 'absent' ELSE 'partial' END AS reason, n-k AS rows FROM f WHERE k<n""")
def bundle_skipped(spark, folder):
    """Files that a product has no row, or not every row, for."""
    i = integrations(spark, folder)
    have = i.where("power > 2 AND file <> 'corr_20240104_235959Z.h5'").select("file", "row_no", F.lit("v1").alias("version"))
    return campaign.skipped_files(i, {"flags@v1": have}, "file", ["file", "row_no"])


_PLAN = HOURLY + """, pf AS (SELECT hfile AS file, min(CASE WHEN state='UNKNOWN' AND power>40 THEN 'reject' ELSE 'use' END) AS status FROM hourly GROUP BY 1), dn AS (SELECT DISTINCT hfile AS file FROM hourly WHERE day<'20240110'),
td AS (SELECT file FROM pf WHERE status='use' AND file NOT IN (SELECT file FROM dn)), fl AS (SELECT hfile AS file, count(*) AS n, min(t) AS ft, max(t) AS lt, min(day) AS day, min(phase) AS phase FROM hourly WHERE hfile IN (SELECT file FROM td) GROUP BY 1),
fb AS (SELECT *, CASE WHEN lag(ft) OVER w IS NULL OR ft-lag(lt) OVER w>600 OR day<>lag(day) OVER w OR phase<>lag(phase) OVER w THEN 1 ELSE 0 END AS b FROM fl WINDOW w AS (ORDER BY ft,file)), fc AS (SELECT *, sum(b) OVER (ORDER BY ft,file)-1 AS block FROM fb),
fd AS (SELECT *, floor((row_number() OVER (PARTITION BY block ORDER BY ft,file)-1)/3) AS ch FROM fc), fe AS (SELECT block, ch, count(*) AS files, sum(n) AS rows FROM fd GROUP BY 1,2)"""


@query("resume_plan", f"""WITH {_PLAN} SELECT (SELECT count(*) FROM pf) AS requested, (SELECT count(*) FROM pf WHERE status='use') AS approved, (SELECT count(*) FROM pf WHERE status='reject') AS rejected,
(SELECT count(*) FROM pf WHERE status='use' AND file IN (SELECT file FROM dn)) AS completed, count(*) AS batches, CAST(coalesce(sum(files),0) AS BIGINT) AS pending, CAST(coalesce(sum(rows),0) AS BIGINT) AS pending_rows FROM fe""")
def resume_plan(spark, folder):
    h = hourly(spark, folder).withColumn("status", F.when((F.col("state") == "UNKNOWN") & (F.col("power") > 40), "reject").otherwise("use"))
    done = h.where("day < '20240110'").select("file")
    return campaign.resume_plan(h, "file", "status", done, 3, "t", "dt", ["day", "phase"])[0]


@query("extract_scan")
def extract_scan(spark, folder):
    """Time window and consistent clock, pointing columns, tilt from the 3-axis stream."""
    s = spectra(spark, folder).withColumn("t", F.col("row_no").cast("double")).where("t >= 10 AND label <> 3")
    e = F.col("spec")
    s = s.select("row_no", "t", *[e[i].alias(n) for i, n in enumerate("xyz")], (F.col("row_no") % 90).cast("double").alias("motor"), e[10].alias("auto_a"), e[11].alias("auto_b"))
    return rounded(solve.principal_plane_angle(s, ["row_no"], ["x", "y", "z"], "motor").select("row_no", "auto_a", "auto_b", "angle"), 5)


@query("labelled_recall", f"""WITH {CELLS}, r AS (SELECT row_no, avg((x>0.15)::INT) AS f FROM cells GROUP BY 1), n AS (SELECT count(*) AS n FROM spectra), w AS (SELECT o_orderkey%n*1.0 AS a, o_orderkey%n+4.0 AS b, CASE WHEN o_orderkey%2=0 THEN 'labelled' ELSE 'control' END AS label FROM orders, n)
SELECT label, count(*) AS n, round(median(f),9) AS median_flagged FROM (SELECT DISTINCT row_no, label, f FROM r JOIN w ON row_no BETWEEN a AND b) GROUP BY 1""")
def labelled_recall(spark, folder):
    c = cells(spark, folder).withColumn("t", F.col("row_no").cast("double"))
    k, n = F.col("o_orderkey"), F.lit(spectra(spark, folder).count())
    w = table(spark, folder, "orders").select((k % n * 1.0).alias("a"), (k % n + 4.0).alias("b"), F.when(k % 2 == 0, "labelled").otherwise("control").alias("label"))
    return rounded(evaluation.labelled_recall(c, "row_no", "t", F.col("x") > 0.15, w, "a", "b", "label"))


_INJ = (CELLS + ", " + padded("", "cells", "chan", "row_no", "row_no, x", 4, "a") + f""", b AS (SELECT chan, row_no, x, rn, cn, x-median(x) OVER {_roll('chan', 4)} AS r, list(x) OVER {_roll('chan', 4)} AS w FROM a), b1 AS (SELECT * FROM b WHERE rn BETWEEN 1 AND cn),
m AS (SELECT chan, median(r) AS m FROM b1 GROUP BY 1), s AS (SELECT chan, 1.4826*median(abs(r-m)) AS s FROM b1 JOIN m USING (chan) GROUP BY 1), i AS (SELECT w, s, x+am*s AS xi, am FROM b1 JOIN s USING (chan), (SELECT unnest([2.0,4.0,6.0]) AS am) WHERE (row_no*7919+chan*104729)%97<5)""")


@query("injection_curve", f"""WITH {_INJ} SELECT am::DOUBLE AS amplitude, count(*) AS n, round(avg((abs(xi-list_median(list_concat(list_concat(w[1:4],[xi]),w[6:9])))>5*s)::INT),9) AS detected FROM i GROUP BY 1""")
def injection_curve(spark, folder):
    chosen = (F.col("row_no") * 7919 + F.col("chan") * 104729) % 97 < 5
    return rounded(evaluation.injection_curve(cells(spark, folder), ["chan"], ["row_no"], "x", chosen, [2.0, 4.0, 6.0]))


_DIP = "CASE WHEN row_no%5=2 AND abs(chan-30)<=32 THEN exp(-pow((chan-30)/8.0,2)/2) ELSE 0 END"


def _dip_sql() -> str:
    """The whole table altered and detected again, at every depth."""
    w = _roll("depth, chan", 4)
    return f"""WITH {CELLS}, d AS (SELECT unnest([0.0,0.05,0.3]) AS depth), c AS (SELECT depth, row_no, chan, p, p*(1-depth*({_DIP})) AS q, ({_DIP})<>0 AS k FROM cells, d),
{padded('', 'c', 'depth, chan', 'row_no', 'row_no, p, q, k', 4, 'a')}, m AS (SELECT depth, row_no, chan, p, q, rn, cn, median(p) OVER {w} AS mp, median(q) OVER {w} AS mq, bool_or(k) OVER {w} AS near FROM a),
i AS (SELECT * FROM m WHERE rn BETWEEN 1 AND cn), o AS (SELECT depth, chan, median(p-mp) AS o FROM i GROUP BY 1,2), s AS (SELECT depth, chan, 1.4826*median(abs(p-mp-o)) AS s FROM i JOIN o USING (depth, chan) GROUP BY 1,2),
f AS (SELECT depth, near, s>=1e-9 AND abs(p-mp)>2*s AS b, s>=1e-9 AND abs(q-mq)>2*s AS a FROM i JOIN s USING (depth, chan))
SELECT depth::DOUBLE AS depth, count_if(near) AS n, count_if(b AND near) AS before, count_if(a AND near) AS after, round(count_if(a AND NOT b)/count_if(near),9) AS newly_flagged FROM f GROUP BY 1"""


@query("smooth_injection", _dip_sql())
def smooth_injection(spark, folder):
    """A smooth dip in every fifth row: what the transient track newly flags, against a run over the whole altered table."""
    shape = F.when(F.col("row_no") % 5 == 2, evaluation.smooth_dip(F.col("chan"), 30.0, 8.0)).otherwise(0.0)
    return rounded(evaluation.smooth_injection(cells(spark, folder), ["chan"], ["row_no"], "p", shape, [0.0, 0.05, 0.3], clip=2.0))
