"""Rounded sizes as exact byte intervals, and byte counts as text. Integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")
DISPLAY = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def size_interval(text: Column, mode: str = "decimal") -> Column:
    """struct<lo, hi> of a shown size such as '1.22 GB'; null for other text.

    All whole byte counts that round to the shown value at its precision: with n digits-as-a-
    number, d decimals and unit m the edges are (2n - 1) m / (2 10^d) and (2n + 1) m / (2 10^d).
    The text is matched once; products that fit are taken in longs, others in decimals.
    """
    base = {"decimal": 1000, "binary": 1024}[mode]
    rx = r"^\s*([0-9]+)(?:\.([0-9]+))?\s*(B|KB|MB|GB|TB)\s*$"
    mark = "\x01"
    parts = F.split(F.regexp_replace(text, rx, f"$1{mark}$2{mark}$3"), mark)
    big = "decimal(38,0)"

    def edges(p: Column) -> Column:
        whole, part, unit = p[0], p[1], p[2]
        step = F.array_position(F.array(*[F.lit(u) for u in UNITS]), unit).cast("int")
        digits = F.concat(whole, part)
        exact = F.when(part.rlike("^0*$"), whole.try_cast("long"))
        n, d = digits.try_cast("long"), F.length(part)
        factor = F.element_at(F.array(*[F.lit(base**i) for i in range(len(UNITS))]), step)
        scale = F.element_at(F.array(*[F.lit(2 * 10**i) for i in range(18)]), F.least(d, F.lit(17)) + 1)
        low = F.greatest(F.call_function("div", (2 * n - 1) * factor + scale - 1, scale), F.lit(0))
        high = F.greatest(low, F.call_function("div", (2 * n + 1) * factor + scale - 1, scale) - 1)
        # 2n m < 2 10^(digits) 1.1 10^(3 units) stays below 2^63
        fits = F.length(digits) + 3 * (step - 1) <= 18
        n, factor = digits.try_cast(big), factor.cast(big)
        scale = F.rpad(F.lit("2"), d + 1, "0").cast(big)
        far_low = _ceil_div(F.greatest((2 * n - 1).cast(big) * factor, F.lit(0)), scale)
        far_high = F.greatest(far_low, _ceil_div((2 * n + 1).cast(big) * factor, scale) - 1)
        lo = F.when(unit == "B", exact).when(fits, low).otherwise(far_low)
        hi = F.when(unit == "B", exact).when(fits, high).otherwise(far_high)
        return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))

    matched = (F.size(parts) == 3) & ~F.contains(text, F.lit(mark))
    return F.transform(F.array(F.when(matched, parts)), edges)[0]


def _ceil_div(a: Column, b: Column) -> Column:
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return F.call_function("div", a + b - 1, b).cast("long")


def within(size: Column, lo: Column, hi: Column) -> Column:
    return size.between(lo, hi)


def human_bytes(v: Column) -> Column:
    """'12 B', '1.50 KiB' ... with two decimals, ties to even; the unit is chosen before rounding."""
    v = v.cast("long")
    step = F.lit(0)
    for i in range(1, len(DISPLAY)):
        step = step + (v >= (1 << (10 * i))).cast("int")
    unit = F.element_at(F.array(*[F.lit(1 << (10 * i)) for i in range(len(DISPLAY))]), step + 1)
    # v < 2^53 leaves room for the factor 100; larger counts go through decimals
    hundred = v.cast("decimal(38,0)") * 100
    q = F.call_function("div", hundred, unit.cast("decimal(20,0)")).cast("long")
    twice = 2 * (hundred - q * unit)
    q = q + F.when((twice > unit) | ((twice == unit) & (q % 2 == 1)), 1).otherwise(0)
    name = F.element_at(F.array(*[F.lit(f" {u}") for u in DISPLAY]), step + 1)
    text = F.concat(F.call_function("div", q, F.lit(100)).cast("string"), F.lit("."), F.lpad((q % 100).cast("string"), 2, "0"))
    return F.concat(F.when(step == 0, v.cast("string")).otherwise(text), name)


def signed_human_bytes(v: Column) -> Column:
    return F.concat(F.when(v > 0, "+").when(v < 0, "-").otherwise(""), human_bytes(F.abs(v)))


def catalog_size(text: Column) -> Column:
    """Whole bytes, or null for anything but digits."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("long"))


def tolerant(size: Column, lo: Column, hi: Column, percent: float, most_bytes: int) -> Column:
    """Within the interval widened by ``percent`` of the storage size, or at most ``most_bytes`` from its nearer edge."""
    # percent as a whole number of millionths keeps the comparison exact
    parts = round(percent * 1_000_000)
    scaled = size.cast("decimal(38,0)") * parts
    one = F.lit(100_000_000).cast("decimal(38,0)")
    wide = (((lo - size).cast("decimal(38,0)") * one) <= scaled) & (((size - hi).cast("decimal(38,0)") * one) <= scaled)
    off = F.greatest(lo - size, size - hi, F.lit(0))
    return wide | (off <= most_bytes)
