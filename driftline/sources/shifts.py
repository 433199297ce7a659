"""CSV files whose values stand one column off their headers: found from what the columns hold, and put right.

A known family of files has an empty cell before some column and an empty header at the end. Every place of such a cell is a hypothesis; it
holds if each column's values are of the kind that its header then wants. What columns hold is one aggregate over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import header_key

#: What a value of a kind looks like; an empty value is of every kind.
KINDS = {
    "number": r"^\s*[-+]?[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?\s*$",
    "ratio": r"^\s*[0-9]+\s*/\s*[0-9]+\s*$",
    "datetime": r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(:[0-9]{3})?\s*$",
    "text": r".*",
}


@dataclass(frozen=True)
class Layout:
    """The headers of a file, and before which column the empty cell is (None: nowhere)."""

    headers: tuple[str, ...]
    shift: int | None

    def column(self, i: int) -> int | None:
        """The header's number for column ``i``; None for the empty cell."""
        if self.shift is None or i < self.shift:
            return i
        return None if i == self.shift else i - 1


def _raw(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, ...]]:
    raw = spark.read.csv(path, header=False, encoding="UTF-8", enforceSchema=True)
    first = raw.limit(1).select(*[F.coalesce(header_key(F.col(c)), F.lit("")).alias(c) for c in raw.columns]).first()
    return raw, tuple(first[c] for c in raw.columns) if first else ()


def profile(rows: DataFrame) -> list[dict[str, int]]:
    """For each column: how many values are not empty, and how many of them are of each kind."""
    counts = [F.count_if(F.trim(c) != "").alias(f"{c}_some") for c in rows.columns] + [F.count_if((F.trim(c) != "") & F.col(c).rlike(p)).alias(f"{c}_{k}") for c in rows.columns for k, p in KINDS.items()]
    r = rows.agg(*counts).first()
    return [{k: r[f"{c}_{k}"] for k in ("some", *KINDS)} for c in rows.columns]


def layout(spark: SparkSession, path: str, kinds: dict[str, str]) -> Layout:
    """The layout of a file; ``kinds`` maps each header to the kind of its values. ValueError if none, or more than one shift, fits."""
    raw, headers = _raw(spark, path)
    known = {" ".join(k.split()).lower(): v for k, v in kinds.items()}
    if unknown := [h for h in headers if h and h not in known]:
        raise ValueError(f"unknown headers: {unknown}")
    rows = raw.filter(~F.array(*[F.coalesce(header_key(F.col(c)), F.lit("")) for c in raw.columns]).eqNullSafe(F.array(*map(F.lit, headers))))
    held = profile(rows)

    def fits(at: Layout) -> bool:
        for i, p in enumerate(held):
            h = at.column(i)
            name = headers[h] if h is not None else ""
            if p["some"] and (not name or p[known[name]] < p["some"]):
                return False
        # a cell that was put in is seen as such: its column is empty, and the headers end with an empty one
        return at.shift is None or (headers[-1] == "" and any(p["some"] for p in held[at.shift + 1 :]))

    if fits(plain := Layout(headers, None)):
        return plain
    found = [x for x in (Layout(headers, s) for s in range(len(headers))) if fits(x)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} layouts fit {path}: {held}")
    return found[0]


def read_shifted_csv(spark: SparkSession, path: str, names: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """The file's columns under their names, each value below the header that it belongs to, and ``shift`` (null if the file is straight).

    ``names`` and ``kinds`` map header texts to column names and kinds. Files of other layouts are refused.
    """
    at = layout(spark, path, kinds)
    raw, headers = _raw(spark, path)
    known = {" ".join(k.split()).lower(): v for k, v in names.items()}
    body = raw.filter(~F.array(*[F.coalesce(header_key(F.col(c)), F.lit("")) for c in raw.columns]).eqNullSafe(F.array(*map(F.lit, headers))))
    named = [F.col(c).alias(known[headers[h]]) for i, c in enumerate(raw.columns) if (h := at.column(i)) is not None and headers[h]]
    return body.select(*named, F.lit(at.shift).cast("int").alias("shift"))
