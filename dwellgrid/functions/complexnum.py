"""Complex numbers as structs of two doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cplx(re: Column, im: Column) -> Column:
    """NULL together: a number lacking a part is missing."""
    return F.when(re.isNotNull() & im.isNotNull(), F.struct(re.alias("re"), im.alias("im")))


def conj(z: Column) -> Column:
    return cplx(z["re"], -z["im"])


def mul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def div(a: Column, b: Column) -> Column:
    n = F.nullif(abs2(b), F.lit(0.0))
    return cplx((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)


def abs2(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def modulus(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def phase(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def phasor(f: Column, delay: Column | float, sign: int = 1) -> Column:
    """exp(sign 2 pi i f delay)."""
    a = sign * 2 * F.pi() * f * delay
    return cplx(F.cos(a), F.sin(a))


def mismatch(g: Column, rec: Column) -> Column:
    """(1 - |G|^2) / |1 - G G_rec|^2."""
    p = mul(g, rec)
    return F.try_divide(1 - abs2(g), (1 - p["re"]) * (1 - p["re"]) + p["im"] * p["im"])
