"""Queries over scalar functions, complex numbers, bits, arrays, time text."""

from pyspark.sql import functions as F

from dwellgrid.catalog.aggregates import rounded
from dwellgrid.catalog.registry import query
from dwellgrid.catalog.views import CELLS, SAMPLES, SPECTRA, cells, r6, samples, spectra, table
from dwellgrid.functions import arrays as A
from dwellgrid.functions import bits, clock
from dwellgrid.functions import complexnum as C
from dwellgrid.functions import scalars as S
from dwellgrid.operators import timejoins as tj

_Z = SPECTRA + """, z AS (SELECT row_no, CASE WHEN label<>3 THEN spec[1] END AS ar, spec[2] AS ai, spec[3] AS br, spec[4] AS bi, spec[5] AS f FROM spectra)"""


def _pair(spark, folder):
    e = F.col("spec")
    z = spectra(spark, folder).select("row_no", F.when(F.col("label") != 3, e[0]).alias("ar"), e[1].alias("ai"), e[2].alias("br"), e[3].alias("bi"), e[4].alias("f"))
    return z.select("row_no", "f", C.cplx(F.col("ar"), F.col("ai")).alias("a"), C.cplx(F.col("br"), F.col("bi")).alias("b"))


@query("complex_pair", f"WITH {_Z} SELECT row_no, ar AS re, CASE WHEN ar IS NOT NULL THEN ai END AS im FROM z")
def complex_pair(spark, folder):
    return _pair(spark, folder).select("row_no", F.col("a.re").alias("re"), F.col("a.im").alias("im"))


@query("complex_arithmetic", f"""WITH {_Z} SELECT row_no, round(ar*br-ai*bi,9) AS mre, round(CASE WHEN ar IS NOT NULL THEN ar*bi+ai*br END,9) AS mim, round(CASE WHEN ar IS NOT NULL THEN -ai END,9) AS cim,
 round((ar*br+ai*bi)/(br*br+bi*bi),7) AS dre, round(CASE WHEN ar IS NOT NULL THEN (ai*br-ar*bi)/(br*br+bi*bi) END,7) AS dim FROM z""")
def complex_arithmetic(spark, folder):
    a, b = F.col("a"), F.col("b")
    p = _pair(spark, folder).select("row_no", C.mul(a, b).alias("m"), C.conj(a).alias("c"), C.div(a, b).alias("d"))
    return p.select("row_no", r6("m.re", 9).alias("mre"), r6("m.im", 9).alias("mim"), r6("c.im", 9).alias("cim"), r6("d.re", 7).alias("dre"), r6("d.im", 7).alias("dim"))


@query("complex_parts", f"""WITH {_Z} SELECT row_no, round(sqrt(br*br+bi*bi),9) AS modulus, round(atan2(bi,br),9) AS phase, round(br*br+bi*bi,9) AS power, round(cos(2*pi()*f*3),9) AS pre, round(-sin(2*pi()*f*3),9) AS pim FROM z""")
def complex_parts(spark, folder):
    b = F.col("b")
    out = _pair(spark, folder).select("row_no", C.modulus(b).alias("modulus"), C.phase(b).alias("phase"), C.abs2(b).alias("power"), C.phasor(F.col("f"), 3.0, -1).alias("p"))
    return rounded(out.select("row_no", "modulus", "phase", "power", F.col("p.re").alias("pre"), F.col("p.im").alias("pim")))


@query("mismatch_factor", f"""WITH {_Z} SELECT row_no, round((1-ar*ar-ai*ai)/((1-(ar*br-ai*bi))*(1-(ar*br-ai*bi))+(ar*bi+ai*br)*(ar*bi+ai*br)),9) AS m FROM z""")
def mismatch_factor(spark, folder):
    return rounded(_pair(spark, folder).select("row_no", C.mismatch(F.col("a"), F.col("b")).alias("m")))


@query("complex_interpolation", f"""WITH {CELLS}, g AS (SELECT row_no, chan, x, lead(x) OVER w AS x1, y, lead(y) OVER w AS y1 FROM (SELECT a.row_no, a.chan, a.x, b.x AS y FROM cells a JOIN cells b ON a.row_no=b.row_no AND b.chan=63-a.chan) WINDOW w AS (PARTITION BY row_no ORDER BY chan))
SELECT row_no, chan, round(0.75*x+0.25*x1,9) AS re, round(0.75*y+0.25*y1,9) AS im FROM g""")
def complex_interpolation(spark, folder):
    """Each spectrum, as nodes over frequency, read a quarter channel on."""
    s = spectra(spark, folder)
    c = s.select("row_no", F.posexplode(F.transform("spec", lambda x, i: F.struct(x.alias("re"), F.get("spec", 63 - i).alias("im")))).alias("chan", "z"))
    n = c.select("row_no", F.col("chan").cast("double").alias("f"), "z.re", "z.im", F.lit("one").alias("label"))
    grid = c.select("row_no", "chan", (F.col("chan") + 0.25).alias("f"))
    return rounded(tj.bracket(grid, "f", n, "f", ["re", "im"], "label", max_gap_s=1.0, keys=["row_no"]).select("row_no", "chan", "re", "im"))


@query("unit_conversions", """SELECT event_id, round(10*log10(value),9) AS db, round(pow(10,value/1000),9) AS lin, round(value+273.15,6) AS kelvin FROM events""")
def unit_conversions(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select("event_id", r6(S.to_db(v), 9).alias("db"), r6(S.from_db(v, 1000.0), 9).alias("lin"), r6(S.to_kelvin(v)).alias("kelvin"))


@query("safe_divide", f"""WITH {CELLS} SELECT row_no, chan, CASE WHEN chan%5=0 THEN 'inf' ELSE CAST(x/(chan%5)>0 AS VARCHAR) END AS q, round(CASE WHEN chan%5<>0 THEN x/(chan%5) END,9) AS v FROM cells""")
def safe_divide(spark, folder):
    q = S.safe_divide(F.col("x"), (F.col("chan") % 5).cast("double"))
    c = cells(spark, folder).select("row_no", "chan", q.alias("q"))
    inf = F.col("q") == float("inf")
    return c.select("row_no", "chan", F.when(inf, "inf").otherwise((F.col("q") > 0).cast("string")).alias("q"), F.when(~inf, r6("q", 9)).alias("v"))


@query("radiometer", """SELECT event_id, round(value/sqrt(0.5*250000),9) AS auto, round(value/sqrt(0.5*250000)/sqrt(2),9) AS crossed, round(sqrt((value*value+value*value/4+1.0/4)/(250000*0.5)),9) AS diff,
 CASE WHEN value>5 THEN round((100/greatest(value,1)-1)*sqrt(2*0.5*250000),6) END AS z FROM events""")
def radiometer(spark, folder):
    v, dt, df = F.col("value"), F.lit(0.5), F.lit(250000.0)
    z = S.residual_z(F.lit(100.0), v - F.when(v > 5, 0.0).otherwise(v), dt, df)
    return table(spark, folder, "events").select(
        "event_id", r6(S.radiometer_noise(v, dt, df), 9).alias("auto"), r6(S.radiometer_noise(v, dt, df, True), 9).alias("crossed"),
        r6(S.difference_sigma(v, v, F.lit(1.0), df, dt), 9).alias("diff"), F.when(z != float("inf"), r6(z)).alias("z"))


@query("thermistor", """SELECT event_id, round(1/(0.001+0.0002*ln(value*100*0.47)+1e-7*pow(ln(value*100*0.47),3)),6) AS k FROM events""")
def thermistor(spark, folder):
    return table(spark, folder, "events").select("event_id", r6(S.thermistor_k(F.col("value") * 100, 4700.0, 0.001, 0.0002, 1e-7)).alias("k"))


@query("three_state_ratio", """SELECT l_orderkey, l_linenumber, l_suppkey, round(CASE WHEN l_quantity<>25 THEN 300+917*(l_extendedprice-25000)/((l_quantity-25)*1000) END/pi(),5) AS t FROM lineitem""")
def three_state_ratio(spark, folder):
    p = F.lit(25000.0)
    t = S.three_state(F.col("l_extendedprice"), F.col("l_quantity") * 1000, p, F.lit(300.0), 917.0)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", r6(t / F.pi(), 5).alias("t"))


@query("reflection_corrections", f"""WITH {_Z}, m AS (SELECT row_no, ar, ai, (1-ar*ar-ai*ai)/((1-(ar*br-ai*bi))*(1-(ar*br-ai*bi))+(ar*bi+ai*br)*(ar*bi+ai*br)) AS ma, (1-0.01)/((1-0.1*br)*(1-0.1*br)+0.01*bi*bi) AS ml FROM z)
SELECT row_no, round(500/(1-ar*ar-ai*ai),6) AS ant, round((500-(1-ml)*300)/ma,6) AS rec FROM m""")
def reflection_corrections(spark, folder):
    load = C.cplx(F.lit(0.1), F.lit(0.0))
    return _pair(spark, folder).select(
        "row_no", r6(S.antenna_correction(F.lit(500.0), F.col("a"))).alias("ant"),
        r6(S.receiver_correction(F.lit(500.0), F.lit(300.0), F.col("a"), load, F.col("b"))).alias("rec"))


@query("apply_calibration", f"""WITH {SAMPLES} SELECT event_id, round(CASE WHEN state='RFANT' THEN 2*power-7 END,6) AS t, round(0.9*power+0.1*290,6) AS path, round(power-1.1*input,6) AS residual FROM ev""")
def apply_calibration(spark, folder):
    s, p = samples(spark, folder), F.col("power")
    return s.select("event_id", r6(S.calibrated(p, F.lit(2.0), F.lit(-7.0), F.col("state"))).alias("t"),
                    r6(S.behind_path(F.lit(0.9), p, F.lit(290.0))).alias("path"), r6(p - 1.1 * F.col("input")).alias("residual"))


@query("tilt_angles", f"""WITH {SPECTRA}, g AS (SELECT row_no, spec[1] AS x, spec[2] AS y, spec[3] AS z, spec[4] AS w FROM spectra), q AS (SELECT row_no, x, y, z, 2*(x*z+y*w)/(x*x+y*y+z*z+w*w) AS a, 2*(y*z-x*w)/(x*x+y*y+z*z+w*w) AS b, 1-2*(x*x+y*y)/(x*x+y*y+z*z+w*w) AS c FROM g)
SELECT row_no, round(acos(-least(greatest((0.6*y+0.8*z)/sqrt(x*x+y*y+z*z),-1),1)),6) AS gravity, round(acos(-least(greatest(c/sqrt(a*a+b*b+c*c),-1),1)),6) AS quaternion FROM q""")
def tilt_angles(spark, folder):
    e = [F.col("spec")[i] for i in range(4)]
    return spectra(spark, folder).select("row_no", r6(S.tilt(*e[:3], [[1, 0, 0], [0, 0.8, -0.6], [0, 0.6, 0.8]])).alias("gravity"), r6(S.tilt_quaternion(*e)).alias("quaternion"))


@query("stripe_split", """SELECT event_id, CASE (floor(((value+180)-360*floor((value+180)/360))/12)::INT)%5 WHEN 1 THEN 'validation' WHEN 3 THEN 'test' ELSE 'train' END AS split FROM events""")
def stripe_split(spark, folder):
    return table(spark, folder, "events").select("event_id", S.stripe_split(F.col("value"), 12.0, 5, 1, 3).alias("split"))


PIXEL_SQL = """dirs AS (SELECT row_no, acos(least(greatest(spec[1]*2,-1),1)) AS theta, 20*spec[2] AS phi FROM spectra), px0 AS (SELECT *, cos(theta) AS z, (phi-2*pi()*floor(phi/(2*pi())))/(pi()/2) AS tt FROM dirs),
px1 AS (SELECT *, floor(4*(0.5+tt)-4*z*0.75)::BIGINT AS jp, floor(4*(0.5+tt)+4*z*0.75)::BIGINT AS jm, floor((tt-floor(tt))*4*sqrt(3*(1-abs(z))))::BIGINT AS kp, floor((1-tt+floor(tt))*4*sqrt(3*(1-abs(z))))::BIGINT AS km FROM px0),
px AS (SELECT row_no, theta, phi, CASE WHEN abs(z)<=2.0/3 THEN 24+(4+jp-jm)*16+(((jp+jm-4+(1-(5+jp-jm)%2)+1)//2)%16+16)%16
 WHEN z>0 THEN 2*(kp+km+1)*(kp+km)+floor(tt*(kp+km+1))::BIGINT%(4*(kp+km+1)) ELSE 192-2*(kp+km+1)*(kp+km+2)+floor(tt*(kp+km+1))::BIGINT%(4*(kp+km+1)) END AS pix FROM px1)"""


def directions(spark, folder):
    s = spectra(spark, folder)
    th = F.acos(F.least(F.greatest(F.col("spec")[0] * 2, F.lit(-1.0)), F.lit(1.0)))
    return s.withColumn("theta", th).withColumn("phi", 20 * F.col("spec")[1])


@query("sky_pixel", f"WITH {SPECTRA}, {PIXEL_SQL} SELECT row_no, CAST(pix AS BIGINT) AS pix FROM px")
def sky_pixel(spark, folder):
    return directions(spark, folder).select("row_no", S.sky_pixel(F.col("theta"), F.col("phi"), 4).alias("pix"))


@query("unix_time", """SELECT o_orderkey, epoch_us(o_orderdate)/1e6 AS t, strftime(o_orderdate + INTERVAL 90 SECOND,'%Y-%m-%d %H:%M:%S') AS txt FROM orders""")
def unix_time(spark, folder):
    t = clock.unix_seconds(F.col("o_orderdate"))
    return table(spark, folder, "orders").select("o_orderkey", t.alias("t"), clock.utc_text(t + 90).alias("txt"))


@query("filename_time", """WITH n AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'corr_'||strftime(ts,'%Y%m%d_%H%M%S')||'Z.h5' WHEN 'view' THEN 'corr_'||strftime(ts,'%Y%m%d_%H%M%S')||'Z-1.h5' WHEN 'error' THEN 'corr_20241399_000000Z.h5' ELSE 'notes.txt' END AS name FROM events)
SELECT event_id, CASE WHEN name LIKE 'corr_2024%' AND name NOT LIKE '%1399%' THEN epoch(date_trunc('second',ts))::DOUBLE END AS t, substr(name,6,8) AS day FROM n""")
def filename_time(spark, folder):
    ev = table(spark, folder, "events")
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    name = (F.when(F.col("event_type") == "click", F.concat(F.lit("corr_"), stamp, F.lit("Z.h5")))
            .when(F.col("event_type") == "view", F.concat(F.lit("corr_"), stamp, F.lit("Z-1.h5")))
            .when(F.col("event_type") == "error", "corr_20241399_000000Z.h5").otherwise("notes.txt"))
    return ev.select("event_id", clock.file_time(name).alias("t"), clock.file_day(name).alias("day"))


@query("phase_of", f"""WITH {SAMPLES} SELECT event_id, CASE WHEN t<1704500000 THEN 'A' WHEN t<1705500000 THEN 'B' ELSE 'C' END AS phase FROM ev""")
def phase_of(spark, folder):
    return samples(spark, folder).select("event_id", clock.phase_of(F.col("t"), [(1704500000.0, "B"), (1705500000.0, "C")], "A").alias("phase"))


@query("local_time_window", f"""WITH {SAMPLES} SELECT event_id FROM ev WHERE t>=1704934800 AND t<1704970800""")
def local_time_window(spark, folder):
    a, b = clock.local_window("2024-01-10 18:00:00", "2024-01-11 04:00:00", "America/Denver")
    return samples(spark, folder).where((F.col("t") >= a) & (F.col("t") < b)).select("event_id")


_RE = CELLS + """, b AS (SELECT row_no, chan, (CASE WHEN x>0.2 THEN 4 ELSE 0 END)|(CASE WHEN x<-0.2 THEN 8 ELSE 0 END)|(CASE WHEN label=0 THEN 1 ELSE 0 END)|(CASE WHEN chan%9=0 THEN 512 ELSE 0 END) AS flags, label FROM cells)"""


def _reasons(spark, folder):
    x = F.col("x")
    f = bits.encode({"positive_auto_excess": x > 0.2, "negative_or_model_failure": x < -0.2, "non_sky_switch_state": F.col("label") == 0, "high_scatter": F.col("chan") % 9 == 0})
    return cells(spark, folder).withColumn("flags", f)


@query("encode_reasons", f"""WITH {_RE} SELECT row_no, chan, flags::INT AS flags, concat_ws(',', CASE WHEN flags&512<>0 THEN 'high_scatter' END, CASE WHEN flags&8<>0 THEN 'negative_or_model_failure' END,
 CASE WHEN flags&1<>0 THEN 'non_sky_switch_state' END, CASE WHEN flags&4<>0 THEN 'positive_auto_excess' END) AS names FROM b""")
def encode_reasons(spark, folder):
    return _reasons(spark, folder).select("row_no", "chan", "flags", F.concat_ws(",", bits.decode(F.col("flags"))).alias("names"))


@query("mask_classes", f"""WITH {_RE} SELECT row_no, chan, flags&32255<>0 AS mask, flags<>0 AS conservative, flags&12404<>0 AS rfi FROM b""")
def mask_classes(spark, folder):
    f = F.col("flags")
    return _reasons(spark, folder).select("row_no", "chan", bits.excluded(f).alias("mask"), bits.excluded(f, True).alias("conservative"), bits.interference(f).alias("rfi"))


@query("union_bits", f"""WITH {_RE} SELECT row_no, chan, (flags|CASE WHEN label=4 AND abs(0.3*chan-round_even(0.3*chan,0))<0.15 THEN 4096 ELSE 0 END|CASE WHEN label=4 AND row_no%2=0 AND abs(0.3*chan-round_even(0.3*chan,0))<0.15 THEN 8192 ELSE 0 END)::INT AS flags FROM b""")
def union_bits(spark, folder):
    from dwellgrid.operators.filters import near_integer
    on = near_integer(0.3 * F.col("chan"), 0.15) & (F.col("label") == 4)
    f = bits.add_union_bit(F.col("flags"), "identified_self_emi", on)
    f = bits.add_union_bit(f, "identified_calibration_comb", on & (F.col("row_no") % 2 == 0))
    return _reasons(spark, folder).select("row_no", "chan", f.alias("flags"))


@query("array_functions", f"""WITH {SPECTRA} SELECT row_no, round(list_avg(spec),9) AS mean, round(list_median(spec),9) AS median, round(list_sum(list_transform(spec, lambda q: least(greatest(q,-0.1),0.1))),9) AS clipped,
 round(list_sum(spec[3:12]),9) AS sliced, spec[62] AS rolled, round(list_sum([spec[4],spec[12],spec[20],spec[28],spec[36],spec[44],spec[52],spec[60]]),9) AS residue FROM spectra""")
def array_functions(spark, folder):
    e = F.col("spec")
    return spectra(spark, folder).select(
        "row_no", r6(A.mean(e), 9).alias("mean"), r6(A.median(e), 9).alias("median"), r6(A.total(A.clipped(e, -0.1, 0.1)), 9).alias("clipped"),
        r6(A.total(F.slice(e, 3, 10)), 9).alias("sliced"), A.rolled(e, 3)[0].alias("rolled"), r6(A.total(A.residue(e, 8, 3)), 9).alias("residue"))


@query("json_fallback", """SELECT event_id, coalesce(CASE WHEN event_type<>'error' THEN CAST(json_extract(props,'$.k') AS BIGINT) END, -1) AS k FROM events""")
def json_fallback(spark, folder):
    text = F.when(F.col("event_type") == "error", F.lit("{truncated")).otherwise(F.col("props"))
    return table(spark, folder, "events").select("event_id", F.coalesce(F.from_json(text, "k bigint")["k"], F.lit(-1)).alias("k"))


@query("key_lists", """SELECT p_partkey, len(string_split(p_name,' '))::INT AS n, list_contains(string_split(p_name,' '),'red') AS red FROM part""")
def key_lists(spark, folder):
    words = F.split("p_name", " ")
    return table(spark, folder, "part").select("p_partkey", F.size(words).alias("n"), F.array_contains(words, "red").alias("red"))
