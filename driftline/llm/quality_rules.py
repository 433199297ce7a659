"""Quality rules: base text measures and cross-document line frequency.

Every text is measured once in numpy batches. Lines are normalised (ASCII
lower case, white space collapsed), hashed (XXH64) and counted over the distinct
texts of each host. A line that more than ``max_share`` of a host's texts carry
(and more than ``min_texts``), or more than ``max_texts`` whatever the host's size,
is boilerplate and is removed; a document that loses more than ``max_lost`` of its
words that way is depleted and rejected. Texts that are equal when normalised as
lines are count once, so that a much copied clean document is left to the
deduplication.

Defined cases: a null or empty text has no words and fails the base rules;
a null host is a host of its own; the texts of a host that have no words count as
one; repeated rows are judged alike and all returned; an empty table gives an empty result. Other columns are ignored.
Equality of words and lines is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import IS_SPACE, LOWER, mixed, spans, utf8, xxh64
from ._common import SPACE, blocks, fresh, stored, text_batches

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs again, and whether it occurred before (in some fixed order)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text"):
        raw, off = utf8(b.column(3), "\n")
        n = b.num_rows
        starts, stops, first = spans(raw, off)
        n_words = np.diff(first)
        of = np.repeat(np.arange(n, dtype=np.uint64), n_words)
        chars = np.add.reduceat(((raw & 0xC0) != 0x80) & ~IS_SPACE[raw], off[:-1], dtype=np.int64)
        symbols = np.add.reduceat(SYMBOL[raw], off[:-1], dtype=np.int64)

        # words in 3-word windows that the text has twice or more
        repeat = np.zeros(n, np.int64)
        if len(starts) > 2:
            w = xxh64(raw, starts, stops)
            with np.errstate(over="ignore"):
                key = mixed(w[:-2] + mixed(w[1:-1] + mixed(w[2:] + mixed(of[2:] + np.uint64(1)))))
            whole = np.flatnonzero(of[2:] == of[:-2])
            twice = np.zeros(len(key), bool)
            twice[whole] = _runs(key[whole])[0]
            inside = np.zeros(len(starts), bool)
            for k in range(3):
                inside[k : len(key) + k] |= twice
            repeat = np.bincount(of[inside].astype(np.int64), minlength=n)

        # lines with a word
        stop = np.flatnonzero(raw == 10)
        start = np.r_[0, stop[:-1] + 1]
        w0, w1 = np.searchsorted(starts, start), np.searchsorted(starts, stop)
        has = np.flatnonzero(w1 > w0)
        start, stop, w0, w1 = start[has], stop[has], w0[has], w1[has]
        doc = np.searchsorted(off, start, side="right") - 1
        exact = mixed(xxh64(raw, start, stop) ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
        dup = np.bincount(doc[_runs(exact)[1]], minlength=n)

        # the same lines, normalised: their words joined by one space
        keep = ~IS_SPACE[raw]
        keep[stops] = True
        flat = LOWER[raw[keep]]
        to = np.r_[0, np.cumsum(stops - starts + 1)]
        flat[to[1:] - 1] = 32
        line = xxh64(flat, to[w0], to[w1] - 1).view(np.int64)
        same = xxh64(flat, to[first[:-1]], np.maximum(to[first[1:]] - 1, to[first[:-1]])).view(np.int64)
        at = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
        lines = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(line), pa.array(w1 - w0)], ["line", "words"]))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), *map(pa.array, (n_words, chars, symbols, dup, repeat, same)), lines],
            ["doc_id", "host", "content", *(x.split()[0] for x in MEASURES.split(", ")), "same", "lines"],
        )


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_texts: int = 10, max_share: float = 0.02, max_texts: int = 10_000, max_lost: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` with its measures, verdicts and the lines to remove.

    Columns: doc_id, host and content (hashes that :func:`cleaned` joins on),
    the five measures, base_failed, n_removed_words, kept, removed_lines (array
    of line hashes, null for none).
    """
    spark = docs.sparkSession
    key = dict(docs.dtypes)[doc_id]
    seen = stored(
        text_batches(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(host).alias("host"), F.xxhash64(text).alias("content"), F.col(text).alias("text")))
        .mapInArrow(_measured, f"doc_id {key}, host long, content long, {MEASURES}, same long, lines array<struct<line:long,words:long>>")
    )
    texts = stored(seen.select("host", "content", "same", "lines").dropDuplicates(["host", "content"]))
    share = F.greatest(F.lit(float(min_texts)), F.count_distinct("same") * F.lit(max_share))
    limits = texts.groupBy("host").agg(F.least(share, F.lit(float(max_texts))).alias("limit"))
    lines = texts.select("host", "content", F.inline("lines"))
    # written first, as is what comes of it, so that each join with many rows stands alone in its stage
    # and Spark can split the rows of a hot line or text
    frequent = stored(
        texts.select("host", "same", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
        .groupBy("host", "line").agg(F.count_distinct("same").alias("n_texts"))
        .filter(F.col("n_texts") > min(min_texts, max_texts))
        .join(limits, "host").filter("n_texts > limit").select("host", "line")
    )
    lost = lines.join(frequent, ["host", "line"]).groupBy("host", "content").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed_lines"))
    lost = stored(lost)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        seen.drop("lines", "same").join(lost, ["host", "content"], "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= F.lit(max_lost) * F.col("n_words")))
        .select("doc_id", "host", "content", *(x.split()[0] for x in MEASURES.split(", ")), "base_failed", "n_removed_words", "kept", "removed_lines")
    )


UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_hash(line):
    """The normalised hash of a line as an SQL expression, as :func:`quality_rules` has it."""
    flat = F.regexp_replace(F.translate(line, UPPER_LETTERS, LOWER_LETTERS), SPACE, " ")
    return F.xxhash64(F.trim(flat))


def cleaned(docs: DataFrame, rules: DataFrame, *, text: str = "text", host: str = "source", n_chars: str | None = "n_chars", broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` without rejected documents, and without the lines to remove in the others.

    What to do depends on host and text alone, so it joins on their hashes.
    Only texts that are rejected or lose lines are joined: their table is
    broadcast if it has at most ``broadcast_rows`` rows and hashes to remove
    (8 bytes each), else Spark shuffles both sides. Other columns may have any names.
    """
    a_host, a_content, a_kept, a_lines = fresh(docs.columns, "a_host", "a_content", "a_kept", "a_lines")
    acts = stored(rules.filter("NOT kept OR removed_lines IS NOT NULL").select(F.col("host").alias(a_host), F.col("content").alias(a_content), F.col("kept").alias(a_kept), F.when(F.col("kept"), F.col("removed_lines")).alias(a_lines)).dropDuplicates([a_host, a_content]))
    held = acts.agg(F.sum(F.greatest(F.size(F.coalesce(a_lines, F.array())), F.lit(0)) + 1)).first()[0] or 0
    side = F.broadcast(acts) if held <= broadcast_rows else acts
    on = (F.xxhash64(docs[host]) == F.col(a_host)) & (F.xxhash64(docs[text]) == F.col(a_content))
    left = F.concat_ws("\n", F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col(a_lines), line_hash(x))))
    out = docs.join(side, on, "left").filter(F.col(a_kept).isNull() | F.col(a_kept)).withColumn(text, F.when(F.col(a_lines).isNull(), F.col(text)).otherwise(left))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(a_lines).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(dict(docs.dtypes)[n_chars]))
    return out.select(*docs.columns)
