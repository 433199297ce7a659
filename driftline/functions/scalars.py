"""Numbers, angles, times and text keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("name a column")
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def finite(x: Column | str) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_double(x: Column | str) -> Column:
    """Text as a finite double, null where it is none."""
    return finite(F.expr(f"try_cast({x} AS double)") if isinstance(x, str) else x.try_cast("double"))


def half_even(x: Column, digits: int = 6) -> Column:
    """Half-even rounding, as every report has it."""
    return F.bround(x, digits)


def wrap180(a: Column) -> Column:
    """An angle in degrees as one in [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def wrap_pi(a: Column) -> Column:
    """An angle in radians as one in [-pi, pi)."""
    return F.pmod(a + F.pi(), 2 * F.pi()) - F.pi()


def yaw_of_heading(deg: Column) -> Column:
    """North-clockwise heading to east-counterclockwise yaw, both in degrees."""
    return wrap180(F.lit(90.0) - deg)


def seconds_between(t_ns: Column, origin_ns: Column) -> Column:
    """Seconds from integer nanoseconds: the subtraction comes first, so no bit is lost."""
    return (t_ns - origin_ns) / F.lit(1e9)


def undirected_residual(a: Column, b: Column) -> Column:
    """Angle in radians between two lines without direction."""
    d = F.abs(wrap_pi(a - b))
    return F.least(d, F.pi() - d)


def header_key(label: Column) -> Column:
    """A CSV label with single spaces, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def leading_count(ratio: Column) -> Column:
    """The number before the slash of ``used / in range``, null if it is not one."""
    first = F.trim(F.split(ratio, "/")[0])
    return F.when(first.rlike("^[0-9]+$"), first.try_cast("int"))


def group_key(name: Column) -> Column:
    """A recording's group: its name without the letters after its last digits."""
    return F.regexp_replace(name, "(?<=[0-9])[A-Za-z]+$", "")


def hash_mod3(name: Column) -> Column:
    """sha256(name) mod 3, from its hexadecimal digits: 16 = 1 mod 3, so their sum has the same rest."""
    digits = F.split(F.sha2(name, 256), "")
    return F.aggregate(digits, F.lit(0), lambda s, d: s + F.coalesce(F.conv(F.when(d != "", d), 16, 10).cast("int"), F.lit(0))) % 3


def as_unit(value: Column, unit: Column, factors: dict[tuple[str, str], float], target: str) -> Column:
    """``value`` in the target unit by a fixed table; an unknown pair is an error."""
    table = F.create_map(*[F.lit(x) for (a, b), f in factors.items() if b == target for x in (a, f)])
    return value * F.coalesce(table[unit], F.raise_error(F.concat(F.lit("no factor to " + target + " from "), unit)).cast("double"))
