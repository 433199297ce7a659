"""Rules as data: each makes a Column of error codes, and rejected rows keep all of theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


#: What a value must satisfy, by the rule's name; "?" after it lets nulls pass.
RULES = {
    "str": lambda c: c.isNotNull() & (F.length(c) > 0) & (F.length(c) <= 1024),
    "code": lambda c: c.rlike("^[A-Z][A-Z0-9_]*$"),
    "int": lambda c: c.isNotNull() & (c >= 0),
    "bool": lambda c: c.isNotNull(),
    "num": _finite,
    "nonneg": lambda c: _finite(c) & (c >= 0),
    "prob": lambda c: _finite(c) & (c >= 0) & (c <= 1),
    "lat": lambda c: _finite(c) & (F.abs(c) <= 90),
    "lon": lambda c: _finite(c) & (F.abs(c) <= 180),
    "heading": lambda c: _finite(c) & (c >= 0) & (c < 360),
    "vec": lambda c: (F.size(c) == 3) & F.forall(c, _finite),
    "quat": lambda c: (F.size(c) == 4) & F.forall(c, _finite) & (F.abs(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)) - 1) <= 1e-6),
    "codes": lambda c: (F.size(c) <= 64) & F.forall(c, lambda x: x.rlike("^[A-Z][A-Z0-9_]*$")),
}


def rule(name: str, value: Column) -> Column:
    """Whether a value satisfies a rule; never null."""
    ok = F.coalesce(RULES[name.rstrip("?")](value), F.lit(False))
    return ok | value.isNull() if name.endswith("?") else ok


def errors(checks: dict[str, Column]) -> Column:
    """The codes whose check is not true, in their order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]))


def first_error(checks: dict[str, Column]) -> Column:
    """The first code whose check is not true, null for none."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()])


def stream_guard(rows: DataFrame, session: str, event_id: str, header: Column, most: int) -> DataFrame:
    """Per stream: too many records, repeated ids, more than one header."""
    return rows.groupBy(session).agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct(event_id)).alias("n_repeated"), F.countDistinct(header).alias("n_headers"), (F.count("*") > most).alias("too_many")
    )


def interval_findings(intervals: DataFrame, keys: list[str], index: str, start: str, end: str, payload: str) -> DataFrame:
    """What is wrong with intervals that should stand in order and apart.

    Codes: EMPTY (end not after start), UNORDERED (start not after the one before),
    OVERLAP, and UNMERGED (touching the one before with an equal payload).
    """
    w = Window.partitionBy(*keys).orderBy(index)
    s0, e0, p0 = (F.lag(c).over(w) for c in (start, end, payload))
    first = s0.isNull()
    checks = {
        "EMPTY": F.col(start) < F.col(end),
        "UNORDERED": first | (F.col(start) > s0),
        "OVERLAP": first | (F.col(start) >= e0),
        "UNMERGED": first | ~((F.col(start) == e0) & F.col(payload).eqNullSafe(p0)),
    }
    return intervals.withColumn("findings", errors(checks))


def admission(criteria: dict[str, Column], required: int) -> tuple[Column, Column]:
    """(disposition, reasons): approved with all criteria, conditional with ``required``, else quarantined."""
    met = sum((F.coalesce(ok, F.lit(False)).cast("int") for ok in criteria.values()), F.lit(0))
    disposition = F.when(met == len(criteria), "approved").when(met >= required, "conditional").otherwise("quarantined")
    return disposition, F.array_join(errors(criteria), "; ")
