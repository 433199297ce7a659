"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

log P(word | context) = log P(class | context) + log P(word | class, context).

Classes: each of the commonest words is a class of its own; the others fall
into classes by their last letters. The class softmax is log-linear in hashed features of the two
words before: a bias, the last word (bigram), the last word with the class of
the one before (trigram), and that class alone (skip).

The softmax inside a class is log-linear too: a word's bias is its add-one count (words
never seen share one place), and a feature joins it with its history, by the words' own
64-bit hashes. The history is the word before (bigram), whichever it is. Only if the caller asks for a
``history_share`` under 1 it is the word before if that word's hash falls into the share, else the word
before that one (skip) if its hash does, else none. A feature stands for every pair of history and word that occurs at least ``least_pairs``
times in training, so the features grow with the corpus. Words without a
feature keep their bias, so a history's normaliser is its class's plus a sum over features alone.

1. Word counts: tasks count 64-bit word hashes; Spark adds them up.
2. Events: how often each class followed each context, added up the same way.
   Contexts have symbols, not words, so their table is bounded and the
   training data enter whole.
3. Gradient rounds: the contexts are partitioned by their last word; each task returns
   the gradient of its features, the driver takes a step scaled by each
   feature's expected count, and sends the weights out again. Weights are a
   table of ``2 ** feature_bits`` rows, whatever the corpus.
4. Every occurrence of a history and a word, of all texts, is dealt once to its history's shard, as the
   places of the two in the table of the commonest words (others as hashes). A shard counts its pairs over
   the training texts and makes the gradient rounds: a round is a sum by history (the normaliser) and a
   step of each feature along its gradient, observed less expected less ridge. It returns what each
   text gains. The number of shards grows with the corpus.
5. Words with over ``frequent`` occurrences would be too much for a shard as histories: their
   pairs are counted in the tasks first, added up by Spark, and the rounds are windows that spill.
6. Scores: batches look up the commonest words, and features and histories of frequent words, in tables of
   bounded size; Spark joins the other occurrences with the whole tables.

Defined cases: a null text counts as empty and is its end token alone; a null
doc_id hashes as the empty text; rows that repeat are scored and counted each;
without training texts every count is 0; an empty table gives an empty result. Equality of words is
equality of their XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import joined, mixed, xxh64
from ._common import blocks, stored, text_batches

HEAD, SHAPES = 16, 47  #: words that are classes, and classes by shape
CLASSES = HEAD + SHAPES
OWN, BOS = 448, 511  #: words that are symbols; the symbol before a text
EDGE = CLASSES  #: the class before a text, never predicted
BEFORE = np.uint64(1)  #: the hash that stands before a text

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token of each text, the end token (the hash of no bytes) included; first tokens (n + 1)."""
    flat, starts, stops, first = joined(column)
    n = len(first) - 1
    h = xxh64(flat, starts, stops)
    # the last two bytes before a final punctuation mark, and whether there is one
    mark = ~ALNUM[flat[stops - 1]] & (stops - starts > 1)
    last = stops - 1 - mark
    before = np.where(last > starts, flat[np.maximum(last - 1, 0)], 0).astype(np.uint64)
    shape = (mixed(flat[last].astype(np.uint64) | before << np.uint64(8) | mark.astype(np.uint64) << np.uint64(16)) % np.uint64(SHAPES)).astype(np.int64)
    end = first[1:]
    return np.insert(h, end, xxh64(flat, np.zeros(1, int), np.zeros(1, int))), np.insert(shape, end, 0), first + np.arange(n + 1)


class Lookup:
    """Place of each known hash in the order given, -1 for others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.at = np.argsort(hashes).astype(np.int32)
        self.keys = hashes[self.at]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, self.at[i], -1).astype(np.int64)


class Table:
    """Hashes and a weight for each."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        self.find, self.weights = Lookup(hashes), np.append(weights, 0).astype(np.float32)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and its weight (0 if not)."""
        at = self.find(h)
        return at >= 0, self.weights[at]


class Vocabulary:
    """The commonest words, by falling count: their classes and symbols."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, shapes: np.ndarray | None = None) -> None:
        self.find, self.counts, self.head, self.hashes, self.shapes = Lookup(hashes), counts, hashes[:HEAD], hashes, shapes

    def read(self, h: np.ndarray, shape: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank (-1: rare), class and context number of each token."""
        rank = self.find(h)
        known = rank >= 0
        cls = np.where(known & (rank < HEAD), rank, HEAD + shape)
        symbol = np.where(known & (rank < OWN), rank, OWN + shape)
        one, two = np.roll(symbol, 1), np.roll(cls, 2)
        one[first[:-1]], two[first[:-1]] = BOS, EDGE
        second = first[:-1] + 1
        two[second[second < len(two)]] = EDGE  # with an end token, the next text's first is set above or is this one's second
        return rank, cls, one * 64 + two


def histories(h: np.ndarray, cls: np.ndarray, first: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens that have a history, its hash for each of them, and how many tokens back it is (0: before the text).

    A word that is a class of its own needs none.
    """
    bounds, backs = [], []
    for back in (1, 2) if share < 1 else (1,):
        before, far = np.roll(h, back), np.full(len(h), back)
        for k in range(back):
            at = first[:-1] + k
            at = at[at < first[1:]]
            before[at], far[at] = BEFORE, 0
        bounds.append(mixed(before + np.uint64(back)))
        backs.append(far)
    if share >= 1:
        at = np.flatnonzero(cls >= HEAD)
        return at, bounds[0][at], backs[0][at]
    limit = np.uint64(int(share * 2.0**64))
    one, two = bounds[0] < limit, bounds[1] < limit
    at = np.flatnonzero((one | two) & (cls >= HEAD))
    return at, np.where(one, *bounds)[at], np.where(one, *backs)[at]


def classed(history: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The history's hash with the class that it is for."""
    return mixed(history ^ mixed(cls.astype(np.uint64) + np.uint64(1)))


def is_frequent(rank: np.ndarray, back: np.ndarray, at: np.ndarray, frequent: tuple[int, bool]) -> np.ndarray:
    """Whether the history of each of the tokens ``at`` is frequent: one of the first so many words, or what stands before a text."""
    of = rank[at - back]
    return np.where(back > 0, (of >= 0) & (of < frequent[0]), frequent[1])


def features(context: np.ndarray, bits: int) -> np.ndarray:
    """The rows of weights of each context's features (n x 4)."""
    one, two = context >> 6, context & 63
    raw = np.stack([np.zeros_like(one), one + (1 << 20), context + (2 << 20), two + (3 << 20)], axis=1)
    return (mixed(raw.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def class_scores(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log P(class | context), natural, for each context."""
    f = features(context, len(weights).bit_length() - 1)
    s = weights[f[:, 0]] + weights[f[:, 1]] + weights[f[:, 2]] + weights[f[:, 3]]
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 7."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 7


def _sums(key: np.ndarray, count: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys once, with the sums of their counts and their first of each of ``more``."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[at], np.add.reduceat(count, at) if len(at) else count, *(m[order][at] for m in more)


def word_counts(texts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """h, shape and c of every distinct token of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, s = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(c)], ["h", "shape", "c"])

        for b in blocks(batches, "text"):
            th, ts, _ = tokens_of(b.column(0))
            th, tc, ts = _sums(th, np.ones(len(th), np.int64), ts)
            h, c, s = _sums(np.r_[h, th], np.r_[c, tc], np.r_[s, ts])
            if len(h) > most:
                yield out()
                h, c, s = h[:0], c[:0], s[:0]
        yield out()

    return texts.select("text").mapInArrow(run, "h long, shape int, c long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))


def level(count: str) -> Column:
    """Eight levels for each doubling of a count."""
    return F.floor(F.log2(count) * 8).cast("int")


def commonest(counts: DataFrame, most: int, key: str, count: str, value: str) -> tuple[np.ndarray, np.ndarray, Column]:
    """Keys and values of at most ``most`` rows, all whose count is above a limit, by falling count; and what the others fulfil."""
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level(count)).count().collect()), reverse=True)
    held, least = 0, None
    for k, n in levels:
        if held + n > most:
            break
        held, least = held + n, k
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), F.lit(True)
    t = counts.filter(level(count) >= least).select(F.col(key).alias("k"), F.col(count).alias("n"), F.col(value).alias("v")).toArrow()
    k = t["k"].to_numpy().view(np.uint64)
    order = np.lexsort((k, -t["n"].to_numpy()))
    return k[order], t["v"].to_numpy()[order], level(count) < least


def pair_counts(texts: DataFrame, vocabulary, share: float, frequent: tuple[int, bool], most: int = 1_000_000) -> DataFrame:  # noqa: ANN001
    """q (a frequent history), h (a word) and n: how often the word followed it; and total, how often any word did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n, q, h = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q.view(np.int64)), pa.array(h.view(np.int64)), pa.array(n)], ["q", "h", "n"])

        for b in blocks(batches, "text"):
            th, shape, first = tokens_of(b.column(0))
            rank, cls, _ = vocabulary.value.read(th, shape, first)
            at, history, back = histories(th, cls, first, share)
            hot = is_frequent(rank, back, at, frequent)
            at, tq = at[hot], classed(history, cls[at])[hot]
            p, n, q, h = _sums(np.r_[p, tq ^ th[at]], np.r_[n, np.ones(len(at), np.int64)], np.r_[q, tq], np.r_[h, th[at]])
            if len(p) > most:
                yield out()
                p, n, q, h = p[:0], n[:0], q[:0], h[:0]
        yield out()

    # one exchange: a history is its class's part of what follows a word, and its rows are summed in the tasks first
    rows = texts.select("text").mapInArrow(run, "q long, h long, n long").repartition("q")
    return rows.groupBy("q", "h").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("q")))


def word_weights(pairs: DataFrame, counts: DataFrame, places: list[float], *, rounds: int, ridge: float, rate: float = 0.7) -> DataFrame:
    """q, h, n, total, b (the feature's weight) and z (log of the history's normaliser by its class's), natural.

    ``counts`` has h, shape and c; ``places`` the sum of the add-one counts of each shape.
    A window sums by history and spills, so a history of any size is no group in memory.
    """
    own = Window.partitionBy("q")
    rows = pairs.join(counts.select("h", "shape", (F.col("c") + 1.0).alias("bias")), "h")
    rows = rows.withColumn("all", F.element_at(F.array(*map(F.lit, places)), F.col("shape") + 1)).repartition("q")
    start = F.col("total") * F.col("bias") / F.col("all")
    rows = rows.withColumn("b", F.log((F.col("n") + ridge) / (start + ridge)))
    norm = F.col("all") + F.sum(F.col("bias") * F.expm1("b")).over(own)
    for _ in range(rounds):
        rows = rows.withColumn("norm", norm).withColumn("hope", F.col("total") * F.col("bias") * F.exp("b") / F.col("norm"))
        step = (F.col("n") - F.col("hope") - F.lit(ridge) * F.col("b")) / (F.col("hope") + F.lit(ridge))
        rows = rows.withColumn("b", F.col("b") + F.lit(rate) * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)))
    return rows.select("q", "h", "n", "total", "b", F.log(norm / F.col("all")).alias("z"))


def packed(n: int, *columns: np.ndarray) -> bytes:
    """Columns, each by its first bytes, second bytes and so on, compressed; before them ``n`` and the size."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return np.array([n, len(raw)], np.uint32).tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


class Unpacked:
    """What ``packed`` took, read in its order."""

    def __init__(self, body: bytes) -> None:
        self.n, size = np.frombuffer(body, np.uint32, 2).tolist()
        self.raw, self.at = pa.Codec("zstd").decompress(body[8:], size, asbytes=True), 0

    def __call__(self, kind: type, n: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        c = np.frombuffer(self.raw, np.uint8, n * width, self.at).reshape(width, n)
        self.at += n * width
        return np.ascontiguousarray(c.T).view(kind).ravel()


class Dealt:
    """Occurrences of histories and words, kept until there are enough to deal to the shards.

    A history is 0 (its hash is sent), or twice its place in the vocabulary and its distance; a word is 0
    (hash and shape are sent), or its place and one.
    """

    def __init__(self, shards: int) -> None:
        self.shards, self.parts, self.n = shards, [], 0

    def add(self, text: np.ndarray, q: np.ndarray, history: np.ndarray, history_rank: np.ndarray, back: np.ndarray, h: np.ndarray, rank: np.ndarray, shape: np.ndarray) -> None:
        """``text``: twice the number of the text, and one if it is held out; in order."""
        shard = (q >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)
        kind = np.uint16 if self.shards < 1 << 16 else np.uint32  # 16 bits sort by counting
        code = np.where((back > 0) & (history_rank >= 0), history_rank * 2 + back, 0)
        self.parts.append((shard.astype(kind), text.astype(np.uint32), code.astype(np.uint32), (rank + 1).astype(np.uint32), history, h, shape.astype(np.uint8)))
        self.n += len(q)

    def out(self) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
        """Shards and what each is sent; shards and the rare words of training texts whose counts they need."""
        shard, text, code, word, history, h, shape = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(shard, kind="stable")
        shard, text, code, word, history, h, shape = (x[order] for x in (shard, text, code, word, history, h, shape))
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        bodies = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(shard)], strict=True):
            own, rare = code[a:b] == 0, word[a:b] == 0
            bodies.append(packed(b - a, np.diff(text[a:b], prepend=np.uint32(0)), code[a:b], word[a:b], history[a:b][own], h[a:b][rare], shape[a:b][rare]))
        asked = np.flatnonzero((word == 0) & (text & 1 == 0))
        _, one = np.unique(mixed(h[asked] ^ mixed(shard[asked].astype(np.uint64) + np.uint64(1))), return_index=True)
        self.parts, self.n = [], 0
        return shard[at].tolist(), bodies, shard[asked[one]], h[asked[one]]


def shard_scores(vocabulary, places: np.ndarray, *, least_pairs: int, rounds: int, ridge: float, rate: float = 0.7):  # noqa: ANN001, ANN201
    """For a shard's occurrences: what its features and normalisers add to each text (log10).

    ``places``: the sum of the add-one counts of each shape.
    """

    def run(t: pa.Table) -> pa.Table:
        v, sent = vocabulary.value, t["body"].is_valid()
        rare = t.filter(pc.invert(sent))
        rare = Table(rare["h"].to_numpy().view(np.uint64), rare["c"].to_numpy())
        t = t.filter(sent)
        texts, ends, qs, hs, shapes, biases = [], [0], [], [], [], []
        for body in t["body"].to_pylist():
            read = Unpacked(body)
            texts.append(np.cumsum(read(np.uint32, read.n), dtype=np.uint32))
            code, word = read(np.uint32, read.n).astype(np.int64), read(np.uint32, read.n).astype(np.int64)
            own, unknown = np.flatnonzero(code == 0), np.flatnonzero(word == 0)
            if len(v.hashes):
                history = mixed(v.hashes[np.maximum(code - 1, 0) >> 1] + ((code - 1 & 1) + 1).astype(np.uint64))
                h, shape, bias = v.hashes[word - 1], v.shapes[word - 1].astype(np.int64), v.counts[word - 1] + 1.0
            else:
                history, h, shape, bias = np.zeros(read.n, np.uint64), np.zeros(read.n, np.uint64), np.zeros(read.n, np.int64), np.zeros(read.n)
            history[own] = read(np.uint64, len(own))
            h[unknown] = read(np.uint64, len(unknown))
            shape[unknown] = read(np.uint8, len(unknown))
            bias[unknown] = rare(h[unknown])[1] + 1.0  # what is not there is too rare for a feature
            ends.append(ends[-1] + read.n)
            for x, y in ((qs, classed(history, shape + HEAD)), (hs, h), (shapes, shape.astype(np.uint8)), (biases, bias)):
                x.append(y)
        if not texts:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["row", "body"])
        q, h, shape, bias = (np.concatenate(x) for x in (qs, hs, shapes, biases))
        train = np.concatenate([x & 1 == 0 for x in texts])
        pair = q ^ h
        del hs, qs, h
        # pairs once, in the order of their histories
        order = np.argsort(pair)
        new = np.r_[True, pair[order[1:]] != pair[order[:-1]]]
        of = np.empty(len(pair), np.int64)
        of[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        n, one = np.add.reduceat(train[order].astype(np.int64), at), order[at]
        del order, new, pair
        by = np.argsort(q[one])
        n, one = n[by], one[by]
        new = np.r_[True, q[one[1:]] != q[one[:-1]]]
        group = np.cumsum(new) - 1
        total, whole = np.add.reduceat(n, np.flatnonzero(new)).astype(float), places[shape[one[new]]]
        f = np.flatnonzero(n >= least_pairs)
        g, seen, bias = group[f], n[f].astype(float), bias[one[f]]
        start = total[g] * bias / whole[g]
        b = np.log((seen + ridge) / (start + ridge))
        norm = lambda: whole + np.bincount(g, bias * np.expm1(b), len(whole))
        for _ in range(rounds):
            hope = total[g] * bias * np.exp(b) / norm()[g]
            b = b + rate * np.clip((seen - hope - ridge * b) / (hope + ridge), -1, 1)
        # a history without features has log(whole / whole)
        gain = -np.log(norm() / whole)[group]
        gain[f] += b
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        gain = gain[back[of]] / np.log(10)
        bodies = []
        for text, a in zip(texts, ends[:-1], strict=True):
            at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            bodies.append(packed(len(at), np.diff(text[at] >> 1, prepend=np.uint32(0)), np.add.reduceat(gain[a : a + len(text)], at).astype(np.float32)))
        return pa.table([t["row"], pa.array(bodies, pa.binary())], ["row", "body"])

    return run


def added(t: pa.Table) -> pa.Table:
    """What all shards add to the texts that were dealt together."""
    texts, gains = [], []
    for body in t["body"].to_pylist():
        read = Unpacked(body)
        texts.append(np.cumsum(read(np.uint32, read.n), dtype=np.uint32))
        gains.append(read(np.float32, read.n))
    gain = np.bincount(np.concatenate(texts), np.concatenate(gains))
    return pa.table([pa.array(t["row"][0].as_py() + np.arange(len(gain))), pa.array(gain)], ["row", "more"])


def events(texts: DataFrame, vocabulary) -> DataFrame:  # noqa: ANN001
    """one (last symbol), context, class and n: how often the class followed the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(512 * 64 * 64, np.int64)
        for b in blocks(batches, "text"):
            _, cls, context = vocabulary.value.read(*tokens_of(b.column(0)))
            key, count = np.unique(context * 64 + cls, return_counts=True)
            n[key] += count
        key = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n[key])], ["key", "n"])

    return texts.select("text").mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


def trained(counted: DataFrame, *, feature_bits: int = 16, rounds: int = 12, rate: float = 0.35, ridge: float = 1.0) -> np.ndarray:
    """Weights (2 ** feature_bits x classes) after ``rounds`` distributed gradient steps."""
    spark = counted.sparkSession
    # all classes of a context in one row; contexts with one last word in one partition
    rows = stored(
        counted.select(F.shiftright("key", 6).alias("context"), F.struct((F.col("key") % 64).alias("cls"), "n").alias("e"))
        .groupBy("context").agg(F.collect_list("e").alias("e")).repartition(F.shiftright("context", 6))
    )
    weights = np.zeros((1 << feature_bits, CLASSES), np.float32)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            got, expected, seen = {}, {}, []
            for b in batches:
                context = b.column(0).to_numpy().astype(np.int64)
                e = b.column(1)
                seen = np.zeros((len(context), CLASSES))
                row = np.repeat(np.arange(len(context)), np.diff(e.offsets.to_numpy()))
                flat = e.flatten()
                np.add.at(seen, (row, flat.field(0).to_numpy()), flat.field(1).to_numpy())
                hope = np.exp(class_scores(sent.value, context)) * seen.sum(axis=1, keepdims=True)
                f = features(context, feature_bits)
                rows_of, where = np.unique(f.ravel(), return_inverse=True)
                where = where.reshape(f.shape)
                g, x = np.zeros((len(rows_of), CLASSES)), np.zeros((len(rows_of), CLASSES))
                for k in range(f.shape[1]):
                    np.add.at(g, where[:, k], seen - hope)
                    np.add.at(x, where[:, k], hope)
                for i, k in enumerate(rows_of.tolist()):
                    got[k] = got[k] + g[i] if k in got else g[i]
                    expected[k] = expected[k] + x[i] if k in expected else x[i]
            keys = list(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([d[k].astype(np.float32).tobytes() for k in keys], pa.binary()) for d in (got, expected))], ["f", "g", "x"])

        t = rows.mapInArrow(gradient, "f int, g binary, x binary").toArrow()
        sent.unpersist()
        f = t["f"].to_numpy()
        if not len(f):
            break
        g, x = np.zeros_like(weights), np.zeros_like(weights)
        for total, name in ((g, "g"), (x, "x")):
            np.add.at(total, f, np.frombuffer(b"".join(t[name].to_pylist()), np.float32).reshape(len(f), CLASSES))
        weights += rate * np.clip((g - ridge * weights) / (x + ridge), -2, 2)
    return weights


def lm_scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out_fold: int = 2, top_words: int = 1 << 19, feature_bits: int = 16, rounds: int = 12, history_share: float = 1.0, least_pairs: int = 2, word_rounds: int = 6, ridge: float = 0.5, frequent: int = 1 << 22, shard: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    What goes to every executor: ``top_words`` words of 33 bytes, as many features and
    histories of frequent words of 16, and a table of ``2 ** feature_bits`` weights for each class. A shard holds about
    ``shard`` occurrences; a word with over ``frequent`` in training is as a history in none.
    """
    spark = docs.sparkSession
    given = text_batches(docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == held_out_fold).alias("held_out"), F.col(text).alias("text")))
    learn = given.filter(~F.col("held_out"))
    counts = stored(word_counts(learn))
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    hashes, often, rare_word = commonest(counts.withColumn("both", F.col("c") * 64 + F.col("shape")), top_words, "h", "c", "both")
    often = often.astype(np.int64)
    vocabulary = Vocabulary(hashes, often >> 6, (often & 63).astype(np.uint8))
    words = spark.sparkContext.broadcast(vocabulary)
    weights = spark.sparkContext.broadcast(trained(events(learn, words), feature_bits=feature_bits, rounds=rounds))
    # tokens and types of each class by shape, without the words that are classes
    head = vocabulary.head.view(np.int64).tolist()
    mass = np.zeros(SHAPES)
    for shape, tokens, types in counts.filter(~F.col("h").isin(head) if head else F.lit(True)).groupBy("shape").agg(F.sum("c"), F.count("*")).collect():
        mass[shape] = tokens + types
    base_log, class_log = np.log10(n + v + 1), np.log10(mass + 1)
    # frequent histories: pairs by Spark's windows, looked up or joined; a text's end is counted once for each text
    end = vocabulary.find(xxh64(np.zeros(1, np.uint8), np.zeros(1, int), np.zeros(1, int)))
    hot = (int((vocabulary.counts > frequent).sum()), bool(end[0] >= 0 and vocabulary.counts[end[0]] > frequent))
    tables, rare_features = [], []
    if any(hot):
        pairs = stored(pair_counts(learn, words, history_share, hot).filter(F.col("n") >= least_pairs))
        learned = stored(word_weights(pairs, counts, (mass + 1).tolist(), rounds=word_rounds, ridge=ridge))
        joint = learned.select(F.col("q").bitwiseXOR(F.col("h")).alias("key"), "n", (F.col("b") / np.log(10)).cast("float").alias("weight"))
        alone = learned.groupBy(F.col("q").alias("key")).agg(F.first("total").alias("n"), F.first(-F.col("z") / np.log(10)).cast("float").alias("weight"))
        for t in (joint, alone):
            k, w, rare = commonest(t, top_words, "key", "n", "weight")
            tables.append(Table(k, w))
            rare_features.append(t.filter(rare).select("key", F.col("weight").cast("double").alias("weight")))
    tables = spark.sparkContext.broadcast(tables)
    key = dict(docs.dtypes)[doc_id]
    shards = 1 + n // shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = base = TaskContext.get().partitionId() << 40
        dealt, kinds = Dealt(shards), None

        def rows(**columns) -> pa.RecordBatch:  # noqa: ANN003
            size = len(next(iter(columns.values())))
            made = {k: c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for k, c in columns.items()}
            return pa.RecordBatch.from_arrays([made[k] if k in made else pa.nulls(size, t) for k, t in kinds.items()], list(kinds))

        def out() -> Iterator[pa.RecordBatch]:
            to, bodies, shard_of, asked = dealt.out()
            for k in range(0, len(to), 100):
                yield rows(row=np.full(len(to[k : k + 100]), base), shard=to[k : k + 100], body=bodies[k : k + 100])
            if len(asked):
                yield rows(shard=shard_of.astype(np.int32), h=asked.view(np.int64))

        for b in blocks(batches, "text"):
            kinds = {
                "row": pa.int64(), "doc_id": b.column(0).type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(),
                "rare": pa.list_(pa.struct({"key": pa.int64(), "times": pa.int32()})), "shard": pa.int32(), "body": pa.binary(), "h": pa.int64(),
            }
            h, shape, first = tokens_of(b.column(2))
            rank, cls, context = words.value.read(h, shape, first)
            contexts, where = np.unique(context, return_inverse=True)
            score = class_scores(weights.value, contexts)[where, cls] / np.log(10)
            common = rank >= 0
            log_count = np.where(common, np.log10(np.append(words.value.counts, 0)[rank] + 1.0), 0.0)
            score += np.where(cls < HEAD, 0.0, log_count - class_log[shape])
            of = np.repeat(np.arange(b.num_rows), np.diff(first))
            at, history, back = histories(h, cls, first, history_share)
            q = classed(history, cls[at])
            rare, doc = [h[~common]], [of[~common]]
            if any(hot):
                # the feature of each token with a frequent history, and the history's normaliser
                known = is_frequent(rank, back, at, hot)
                k, p = at[known], q[known] ^ h[at[known]]
                (has, w), (had, z) = (t(x) for t, x in zip(tables.value, (p, q[known]), strict=True))
                score[k] += w.astype(float) + z
                rare += [p[~has], q[known][~had]]
                doc += [of[k[~has]], of[k[~had]]]
                at, history, back, q = at[~known], history[~known], back[~known], q[~known]
            held = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            dealt.add(((of + (row - base)) * 2 + held[of])[at], q, history, rank[at - back], back, h[at], rank[at], shape[at])
            add = lambda x: np.bincount(of, weights=x, minlength=b.num_rows)  # noqa: E731, B023
            # what is not in the tables, once for each text
            rare, doc = np.concatenate(rare), np.concatenate(doc)
            _, times, doc, word = _sums(mixed(rare ^ mixed(doc.astype(np.uint64) + np.uint64(1))), np.ones(len(rare), np.int64), doc, rare)
            order = np.argsort(doc, kind="stable")
            at = np.searchsorted(doc[order], np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(word[order].view(np.int64)), pa.array(times[order].astype(np.int32))], ["key", "times"]))
            yield rows(row=row + np.arange(b.num_rows), doc_id=b.column(0), held_out=b.column(1), n_tokens=np.diff(first), n_known=add(common).astype(np.int64), base_score=add(log_count - base_log), score=add(score), rare=lists)
            row += b.num_rows
            if dealt.n >= 1 << 20:
                yield from out()
                base = row
        if dealt.n:
            yield from out()

    read = stored(given.mapInArrow(run, f"row long, doc_id {key}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<key:long,times:int>>, shard int, body binary, h long"))
    out = read.filter(F.col("shard").isNull()).drop("shard", "body", "h")
    # a rare word's count goes to the shards that ask for it, if it can have a feature
    asked = read.filter(F.col("h").isNotNull()).select("shard", "h").join(counts.filter(rare_word & (F.col("c") >= least_pairs)).select("h", "c"), "h")
    sent = read.filter(F.col("body").isNotNull()).select("shard", "row", "body", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("c"))
    sent = sent.union(asked.select("shard", F.lit(None).cast("long"), F.lit(None).cast("binary"), "h", "c"))
    learning = shard_scores(words, mass + 1, least_pairs=least_pairs, rounds=word_rounds, ridge=ridge)
    gains = sent.groupBy("shard").applyInArrow(learning, "row long, body binary").groupBy("row").applyInArrow(added, "row long, more double")
    # a rare word adds log10(c + 1) to both scores, a feature or history its weight to one; what was never seen adds nothing
    plain = F.log10(F.col("c") + 1)
    known = counts.filter(rare_word).select(F.col("h").alias("key"), F.lit(1).alias("one"), plain.alias("base"), plain.alias("weight"))
    for t in rare_features:
        known = known.union(t.select("key", F.lit(0), F.lit(0.0), "weight"))
    times = F.col("times")
    more = out.select("row", F.inline("rare")).join(known, "key").groupBy("row").agg(F.sum(times * F.col("one")).alias("more_known"), F.sum(times * F.col("base")).alias("more_base"), F.sum(times * F.col("weight")).alias("more"))
    return out.drop("rare").join(more, "row", "left").join(gains.withColumnRenamed("more", "gain"), "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
