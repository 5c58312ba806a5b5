"""Scalar formulas: units, noise, calibration, geometry."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dwellgrid.functions.complexnum import abs2, mismatch

EPS = 2.220446049250313e-16  # fixed value: spacing of doubles at 1
ZERO_C = 273.15  # fixed value: 0 degrees Celsius in kelvin
PULLUP_OHM = 10_000.0  # fixed value: pull-up the logged resistance assumes
INF = float("inf")


@F.arrow_udf(DoubleType())
def _log10(x: pa.Array) -> pa.Array:
    """Logarithm of positive numbers by the C library, as SQL engines and numpy take it:
    Java's differs in the last bit, on which a rounded digit can hang."""
    return pa.array([None if v is None else math.log10(v) for v in x.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def _power_of_10(x: pa.Array) -> pa.Array:
    """10 to the power of x by the C library."""
    return pa.array([None if v is None else _exp10(v) for v in x.to_pylist()], pa.float64())


def _exp10(x: float) -> float:
    try:
        return math.pow(10.0, x)
    except OverflowError:
        return INF


def to_db(x: Column) -> Column:
    """10 log10 x; -inf for 0, NULL below."""
    return 10 * F.when(x == 0, -INF).otherwise(_log10(F.when(x > 0, x)))


def from_db(x: Column, decade: float = 10.0) -> Column:
    """10^(x / decade); ``decade`` is how many units of x make a factor of ten."""
    return _power_of_10(x / decade)


def to_kelvin(celsius: Column) -> Column:
    return celsius + ZERO_C


def safe_divide(a: Column, b: Column, eps: float = EPS) -> Column:
    """a / b; +inf for a denominator of about zero."""
    return F.when(F.abs(b) > eps, F.try_divide(a, b)).when(b.isNotNull(), F.lit(INF))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b of doubles as floating point has it: over zero infinite, 0/0 NaN; NULL only for NULL."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def radiometer_noise(x: Column, dt: Column, df: Column, cross: bool = False) -> Column:
    n = F.try_divide(F.abs(x), F.sqrt(dt * df))
    return n / math.sqrt(2) if cross else n


def difference_sigma(a: Column, b: Column, c: Column, bandwidth: Column, t: Column) -> Column:
    """Noise of a - (b + c)/2."""
    return F.sqrt(F.try_divide(a * a + b * b / 4 + c * c / 4, bandwidth * t))


def residual_z(data: Column, model: Column, dt: Column, df: Column) -> Column:
    """Fractional residual in units of radiometer noise; inf for a model <= 0."""
    z = (F.try_divide(data, F.greatest(model, F.lit(1.0))) - 1) * F.sqrt(2 * dt * df)
    return F.when(model > 0, z).otherwise(F.lit(INF))


def thermistor_k(logged_ohm: Column, pullup_ohm: float, a: float, b: float, c: float) -> Column:
    """Steinhart-Hart temperature of a resistance logged for another pull-up; its limit, 0 K, for no resistance."""
    ohm = logged_ohm * (pullup_ohm / PULLUP_OHM)
    lr = F.when(ohm == 0, -INF).otherwise(F.ln(ohm))
    return ieee_divide(F.lit(1.0), a + b * lr + c * lr * lr * lr)


def three_state(p_ant: Column, p_noise: Column, p_load: Column, t_load: Column, t_ns: Column | float) -> Column:
    """T* = T_load + T_ns (P_ant - P_load)/(P_noise - P_load); NULL for 0/0."""
    return t_load + t_ns * F.try_divide(p_ant - p_load, p_noise - p_load)


def antenna_correction(t_star: Column, g_ant: Column) -> Column:
    return F.try_divide(t_star, 1 - abs2(g_ant))


def receiver_correction(t_star: Column, t_load: Column, g_ant: Column, g_load: Column, g_rec: Column) -> Column:
    return F.try_divide(t_star - (1 - mismatch(g_load, g_rec)) * t_load, mismatch(g_ant, g_rec))


def calibration_line(p_noise: Column, p_load: Column, t_ns: Column | float, t_load: Column) -> tuple[Column, Column]:
    """(a, b) of T* = a P + b."""
    a = F.try_divide(F.lit(1.0) * t_ns, p_noise - p_load)
    return a, t_load - a * p_load


def receiver_line(a: Column, b: Column, t_load: Column, g_ant: Column, g_load: Column, g_rec: Column) -> tuple[Column, Column]:
    """(scale, offset) of T = scale P + offset with reflections corrected."""
    m_ant, m_load = mismatch(g_ant, g_rec), mismatch(g_load, g_rec)
    return F.try_divide(a, m_ant), F.try_divide(b - (1 - m_load) * t_load, m_ant)


def calibrated(p: Column, scale: Column, offset: Column, state: Column, want: str = "RFANT") -> Column:
    """scale x P + offset in the antenna state, NULL elsewhere."""
    return F.when(state == want, scale * p + offset)


def behind_path(gain: Column, t: Column, t_path: Column) -> Column:
    """A load seen through a lossy path."""
    return gain * t + (1 - gain) * t_path


def tilt(x: Column, y: Column, z: Column, rotation: list[list[float]] | None = None) -> Column:
    """Angle to the vertical of a gravity vector after a constant rotation."""
    r = (rotation or [[1, 0, 0], [0, 1, 0], [0, 0, 1]])[2]
    gz = F.try_divide(r[0] * x + r[1] * y + r[2] * z, F.sqrt(x * x + y * y + z * z))
    return F.acos(-F.least(F.greatest(gz, F.lit(-1.0)), F.lit(1.0)))


def tilt_quaternion(x: Column, y: Column, z: Column, w: Column, rotation: list[list[float]] | None = None) -> Column:
    """The same from a quaternion: the third column of its rotation matrix."""
    n = F.nullif(x * x + y * y + z * z + w * w, F.lit(0.0))
    return tilt(2 * (x * z + y * w) / n, 2 * (y * z - x * w) / n, 1 - 2 * (x * x + y * y) / n, rotation)


def stripe_split(az: Column, width: float, period: int, validation: int, test: int) -> Column:
    k = F.pmod(F.floor(F.pmod(az + 180, F.lit(360.0)) / width), F.lit(period))
    return F.when(k == validation, "validation").when(k == test, "test").otherwise("train")


def sky_pixel(theta: Column, phi: Column, nside: int) -> Column:
    """Ring-ordered equal-area pixel of a direction (published HEALPix formula)."""
    z = F.cos(theta)
    za = F.abs(z)
    tt = F.pmod(phi, F.lit(2 * math.pi)) / (math.pi / 2)
    # belt around the equator
    t1, t2 = nside * (0.5 + tt), nside * z * 0.75
    jp, jm = F.floor(t1 - t2), F.floor(t1 + t2)
    ir = nside + 1 + jp - jm
    shift = 1 - F.pmod(ir, F.lit(2))
    ip = F.pmod(F.floor((jp + jm - nside + shift + 1) / 2), F.lit(4 * nside))
    belt = 2 * nside * (nside - 1) + (ir - 1) * 4 * nside + ip
    # polar caps
    tp = tt - F.floor(tt)
    tmp = nside * F.sqrt(3 * (1 - za))
    kp, km = F.floor(tp * tmp), F.floor((1 - tp) * tmp)
    ring = kp + km + 1
    iq = F.pmod(F.floor(tt * ring), 4 * ring)
    cap = F.when(z > 0, 2 * ring * (ring - 1) + iq).otherwise(12 * nside * nside - 2 * ring * (ring + 1) + iq)
    return F.when(za <= 2 / 3, belt).otherwise(cap).cast("bigint")
