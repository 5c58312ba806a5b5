"""Reason bits per cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: category bits of a cell
CAL = 1
TONE = 2
SELF = 4
SCATTER = 8
BROADBAND = 16
ORBIT = 32
UNKNOWN = 64
OVERFLOW = 128
CATEGORY_BITS = {"self": SELF, "ms": SCATTER, "airplane": BROADBAND, "orbcomm": ORBIT, "unknown": UNKNOWN}
INTERFERENCE = SELF | SCATTER | BROADBAND | ORBIT | UNKNOWN

# fixed values: bit positions of the reasons of the segment detector
REASON_BITS = {
    "non_sky_switch_state": 0, "invalid_input_or_domain": 1, "positive_auto_excess": 2,
    "negative_or_model_failure": 3, "cross_change": 4, "band_group_trigger": 5,
    "comb_group_trigger": 6, "unsupported_background": 7, "guard": 8, "high_scatter": 9,
    "identified_self_emi": 12, "identified_calibration_comb": 13,
}
INTERFERENCE_REASONS = ["positive_auto_excess", "cross_change", "band_group_trigger", "comb_group_trigger",
                        "identified_self_emi", "identified_calibration_comb"]
ADVISORY_REASONS = ["high_scatter"]


def encode(reasons: dict[str, Column]) -> Column:
    """Named booleans -> one integer; an unknown name raises."""
    unknown = set(reasons) - set(REASON_BITS)
    if unknown:
        raise KeyError(f"unknown flag reasons: {sorted(unknown)}")
    out = F.lit(0)
    for name, mask in reasons.items():
        out = out.bitwiseOR(F.when(mask, 1 << REASON_BITS[name]).otherwise(0))
    return out


def decode(flags: Column) -> Column:
    """Sorted list of reason names set in an integer."""
    names = F.array(*[F.when(flags.bitwiseAND(1 << b) != 0, n) for n, b in sorted(REASON_BITS.items())])
    return F.filter(names, lambda n: n.isNotNull())


def any_of(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def bits_of(names: list[str]) -> int:
    return sum(1 << REASON_BITS[n] for n in names)


def excluded(flags: Column, conservative: bool = False) -> Column:
    """Any bit but the advisory ones; with ``conservative`` any bit."""
    mask = (1 << 15) - 1
    return any_of(flags, mask if conservative else mask & ~bits_of(ADVISORY_REASONS))


def interference(flags: Column) -> Column:
    return any_of(flags, bits_of(INTERFERENCE_REASONS))


def add_union_bit(flags: Column, reason: str, on: Column) -> Column:
    """OR one reason into the flags where ``on``; other cells are unchanged."""
    return F.when(on, flags.bitwiseOR(1 << REASON_BITS[reason])).otherwise(flags)
