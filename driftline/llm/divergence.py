"""How far the sources of a language differ in the words they use, in exact integers.

Terms are runs of ASCII letters (lower-cased) and of characters beyond ASCII. A language keeps
the terms that at least ``least_docs`` of its documents have. A group is a source of a language;
its probability of a term, in units of 1 / ``scale``, is p = 1 + floor(scale * (count + 2) / (N + 2 V)),
and two groups differ in a term by floor((p - q)^2 / (p + q)).

One pass over the texts counts terms by group, combined in its task and again by Spark
before the shuffle, so a hot source sends a row for each of its terms and task. Then

* terms that a good part of a language's groups have (``heavy_share``) are dense: numpy tiles of
  (terms) x (groups) x (groups), a tile for each pair of blocks of groups and bucket of terms;
* of the other, rare, terms each group has few. What two groups would differ by if neither
  had any term is one product. Against that, a group's own rare terms change its distance
  to every other group by a sum that depends on its counts alone (a row for each group and distinct
  count, not for each term), and only pairs of groups that share a rare term need a
  correction of their own, taken from the term's postings.

Both partial sums are integers and are added up by Spark.

No table of all terms or groups reaches the driver or one task: postings are streamed term by
term, tiles hold at most ``tile_rows`` postings and two blocks of groups, groups are joined.

Defined cases: null text, language or source count as empty; a group without terms is a group;
a language without kept terms differs by 0 everywhere; a language of one source has no
pairs and no terms of excess; repeated rows are documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, utf8
from ._common import blocks, stored, text_batches

IS_LETTER = np.ones(256, bool)
IS_LETTER[:0x41] = IS_LETTER[0x5B:0x61] = IS_LETTER[0x7B:0x80] = False


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in a row, and the number of the text that each is from."""
    raw, off = utf8(column, "\n")
    solid = IS_LETTER[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, solid, False].view(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    ends = np.r_[0, np.cumsum(stops - starts)]
    flat = LOWER[raw[solid]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
    return words, np.searchsorted(off, starts, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of texts: lang, source, term, occurrences and documents; a group's own row has a null term."""
    for b in blocks(batches, "text", 8 << 20):
        words, doc = terms_of(b.column(2))
        pairs = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["lang", "source"])
        names, place = _coded(pairs)
        coded = words.dictionary_encode()
        term = coded.indices.to_numpy()
        n_terms = max(1, len(coded.dictionary))
        # occurrences by document first, then by group
        by_doc, n = np.unique(doc * n_terms + term, return_counts=True)
        by_group, to = np.unique(place[by_doc // n_terms] * n_terms + by_doc % n_terms, return_inverse=True)
        count = np.bincount(to, n, len(by_group)).astype(np.int64)
        docs = np.bincount(to, minlength=len(by_group)).astype(np.int64)
        group = pa.array(np.r_[by_group // n_terms, np.arange(len(names))])
        own = pa.array(np.r_[by_group % n_terms, np.zeros(len(names), np.int64)], mask=np.r_[np.zeros(len(by_group), bool), np.ones(len(names), bool)])
        none = np.zeros(len(names), np.int64)
        dictionary = coded.dictionary if len(coded.dictionary) else pa.array([""], pa.large_string())
        got = names.take(group)
        yield pa.RecordBatch.from_arrays([got.field(0), got.field(1), dictionary.take(own).cast(pa.string()), pa.array(np.r_[count, none]), pa.array(np.r_[docs, none])], ["lang", "source", "term", "count", "docs"])


def _coded(pairs: pa.StructArray) -> tuple[pa.StructArray, np.ndarray]:
    """Distinct (lang, source) of a batch and each row's number among them."""
    a, b = pairs.field(0).dictionary_encode(), pairs.field(1).dictionary_encode()
    code = a.indices.to_numpy().astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy()
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return pairs.take(pa.array(first)), place


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), by long division in steps of 1,000, so that no product leaves 63 bits."""
    below, rest = n + 2 * v, count + 2
    out, rest = F.call_function("div", rest, below), rest % below
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, below), rest % below
    return out + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Counts:
    """What the audit works on: groups, kept terms and postings, written once.

    ``groups``: lang, source, g (a number), n (its kept terms' occurrences), n_lang, v (terms that the language
    keeps), s (groups of the language) and p0 (p of a term that it has not).
    ``postings``: g, lang, term, term_id, dense, count, total (of the language).
    """

    def __init__(self, docs: DataFrame, text: str, lang: str, source: str, least_docs: int, heavy_share: float) -> None:
        filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
        counts = text_batches(filled).mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
        counts = stored(counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
        terms = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("m")).filter(F.col("docs") >= least_docs)
        langs = counts.filter("term IS NULL").groupBy("lang").agg(F.count("*").alias("s"))
        terms = terms.join(F.broadcast(langs) if langs.count() <= 100_000 else langs, "lang")
        terms = stored(terms.select("lang", "term", "total", (F.col("m") >= heavy_share * F.col("s")).alias("dense"), F.monotonically_increasing_id().alias("term_id")))
        kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
        kept = langs.join(kept, "lang", "left").select("lang", "s", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "n_lang")))
        posted = stored(counts.filter("term IS NOT NULL").select("lang", "source", "term", "count").join(terms, ["lang", "term"]))
        own = posted.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        named = counts.filter("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(kept, "lang")
        named = named.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        p0 = F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(F.lit(1)).cast("long")
        self.groups = stored(named.select("lang", "source", F.monotonically_increasing_id().alias("g"), "n", "n_lang", "v", "s", p0.alias("p0")))
        p = probability(F.col("count"), F.col("n"), F.col("v")).alias("p")
        self.postings = stored(posted.join(self.groups.select("lang", "source", "g", "n", "n_lang", "v", "p0"), ["lang", "source"]).select("lang", "g", "term", "term_id", "dense", "total", "n_lang", "v", p, "p0"))


def _rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of groups that share a rare term; rows come ordered by term."""
    held: list[np.ndarray] = []

    def corrected(term, g, p, p0):  # noqa: ANN001, ANN202
        keys, sums = [], []
        for k in range(1, len(term)):
            same = np.flatnonzero(term[k:] == term[:-k])
            if not len(same):
                break
            a, b = same, same + k
            keys.append(np.stack([np.minimum(g[a], g[b]), np.maximum(g[a], g[b])]))
            sums.append(_apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b]))
            if sum(map(len, sums)) >= 1 << 20:
                yield _summed(np.concatenate(keys, axis=1), np.concatenate(sums))
                keys, sums = [], []
        if keys:
            yield _summed(np.concatenate(keys, axis=1), np.concatenate(sums))

    for b in batches:
        rows = np.stack([c.to_numpy() for c in b.columns])
        held.append(rows)
        if sum(x.shape[1] for x in held) < 1 << 16:
            continue
        rows = np.concatenate(held, axis=1)
        # the last term may go on in the next batch
        cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows[0, 0] != rows[0, -1] else 0
        yield from corrected(*rows[:, :cut])
        held = [rows[:, cut:]]
    if held:
        yield from corrected(*np.concatenate(held, axis=1))


def _summed(pair: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((pair[1], pair[0]))
    pair, value = pair[:, order], value[order]
    at = np.flatnonzero(np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)]) if len(value) else np.zeros(0, np.int64)
    total = np.add.reduceat(value, at) if len(value) else value
    return pa.RecordBatch.from_arrays([pa.array(pair[0, at]), pa.array(pair[1, at]), pa.array(total)], ["g", "h", "value"])


#: The kinds of rows that a tile gets: a group (p: its language's terms), a group's distinct count of rare terms (term_id: how many), a posting.
GROUP, SINGLE, POSTING = 0, 1, 2


def _tile(pdf):  # noqa: ANN001, ANN202
    """The sums of one tile: two blocks of groups, one bucket of terms. The baseline is in the first bucket only."""
    import pandas as pd

    kind, block = pdf["kind"].to_numpy(), pdf["block"].to_numpy()
    g, p, p0, term = (pdf[c].to_numpy() for c in ("g", "p", "p0", "term_id"))
    i, j, bucket = (int(pdf[c].iloc[0]) for c in ("bi", "bj", "bucket"))
    sides = []
    for b in (i, j):
        own = np.flatnonzero((kind == GROUP) & (block == b))
        own = own[np.argsort(g[own])]
        sides.append((g[own], p0[own], p[own]))
    (gi, zi, v), (gj, zj, _) = sides
    if not len(gi) or not len(gj):
        return pd.DataFrame({"g": [], "h": [], "value": []}).astype("int64")
    base = _apart(zi[:, None], zj[None, :])
    # as if no group had any term; what groups have is added as a change from that
    total = base * v[0] if bucket == 0 else np.zeros_like(base)
    for k in np.flatnonzero(kind == SINGLE):
        if block[k] == i:
            r = int(np.searchsorted(gi, g[k]))
            total[r] += term[k] * (_apart(p[k], zj) - base[r])
        if block[k] == j:
            c = int(np.searchsorted(gj, g[k]))
            total[:, c] += term[k] * (_apart(zi, p[k]) - base[:, c])
    dense = np.flatnonzero(kind == POSTING)
    ids, row = np.unique(term[dense], return_inverse=True)
    left, right = np.repeat(zi[None, :], len(ids), 0), np.repeat(zj[None, :], len(ids), 0)
    for own, names, table in ((block[dense] == i, gi, left), (block[dense] == j, gj, right)):
        table[row[own], np.searchsorted(names, g[dense][own])] = p[dense][own]
    some = max(1, (1 << 20) // max(1, base.size))
    for at in range(0, len(ids), some):
        total += _apart(left[at : at + some, :, None], right[at : at + some, None, :]).sum(axis=0)
    total -= base * len(ids)
    a, b = np.nonzero(gi[:, None] < gj[None, :] if i == j else np.ones_like(base, bool))
    x, y = gi[a], gj[b]
    return pd.DataFrame({"g": np.minimum(x, y), "h": np.maximum(x, y), "value": total[a, b]})


def pair_sums(c: Counts, *, block_groups: int = 128, tile_rows: int = 100_000) -> DataFrame:
    """g, h (g < h) and value of every two groups of a language."""
    rare = c.postings.filter("NOT dense")
    shared = rare.repartition("term_id").sortWithinPartitions("term_id", "g").select("term_id", "g", "p", "p0").mapInArrow(_rare_pairs, "g long, h long, value long")
    singles = stored(rare.groupBy("lang", "g", "p", "p0").agg(F.count("*").alias("times")))
    # blocks of a language's groups and buckets of its rows, from counts alone
    n_rows = c.postings.filter("dense").select("lang").union(singles.select("lang")).groupBy("lang").agg(F.count("*").alias("n_rows"))
    shape = c.groups.groupBy("lang").agg(F.first("s").alias("s")).join(n_rows, "lang", "left")
    n_blocks = F.ceil(F.col("s") / block_groups).cast("int")
    # a tile gets the rows of two of the blocks
    n_buckets = F.greatest(F.lit(1), F.ceil(2 * F.coalesce("n_rows", F.lit(0)) / n_blocks / tile_rows)).cast("int")
    shape = stored(shape.select("lang", n_blocks.alias("n_blocks"), n_buckets.alias("n_buckets")))
    place = F.pmod(F.xxhash64("g"), F.col("n_blocks").cast("long")).cast("int").alias("block")
    groups = c.groups.join(shape, "lang")
    every = F.explode(F.sequence(F.lit(0), F.col("n_buckets") - 1)).alias("bucket")
    zero = F.lit(0).cast("long")
    rows = groups.select("lang", "n_blocks", place, "g", F.lit(GROUP).alias("kind"), F.col("v").alias("p"), "p0", zero.alias("term_id"), every)
    rows = rows.union(singles.join(shape, "lang").select("lang", "n_blocks", place, "g", F.lit(SINGLE), "p", "p0", "times", F.pmod(F.xxhash64("g", "p"), F.col("n_buckets").cast("long")).cast("int")))
    dense = c.postings.filter("dense").join(shape, "lang")
    rows = rows.union(dense.select("lang", "n_blocks", place, "g", F.lit(POSTING), "p", "p0", "term_id", F.pmod(F.xxhash64("term_id"), F.col("n_buckets").cast("long")).cast("int")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    rows = rows.select("lang", "kind", "block", "g", "p", "p0", "term_id", "bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    tiles = rows.groupBy("lang", "bi", "bj", "bucket").applyInPandas(_tile, "g long, h long, value long")
    return tiles.union(shared).groupBy("g", "h").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10, heavy_share: float = 0.25, block_groups: int = 128, tile_rows: int = 100_000) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language and how far it is. Part ``term``: the ``top`` terms that the source
    has more often than its language, by how far. Ranks are from 1, the largest value first, ties in UTF-8 order of the item.
    """
    c = Counts(docs, text, lang, source, least_docs, heavy_share)
    names = c.groups.select("lang", "source", "g")
    sums = stored(pair_sums(c, block_groups=block_groups, tile_rows=tile_rows))
    both = sums.union(sums.select(F.col("h"), F.col("g"), F.col("value")))
    other = names.select(F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = both.join(names, "g").join(other, "h").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    q = probability(F.col("total"), F.col("n_lang"), F.col("v"))
    more = c.postings.withColumn("q", q).filter("p > q").select("g", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    best = more.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("value").desc(), "item"))).filter(F.col("rank") <= top)
    return pairs.union(best.join(names, "g").select("lang", "source", "part", "item", "value", "rank"))
