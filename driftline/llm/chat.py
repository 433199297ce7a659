"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by their parents. Self-joins double the reach of every
message's ancestor pointer each round, so that a chain of n messages takes
log2(n) rounds. They give each message its depth and the sum of the scores on its
path. The leaves are ranked by score within their conversation, the chosen
ones' paths are listed by the same pointers, and each path becomes one text. The joins
carry keys and scores; texts are written once and join the chosen paths at the end.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles
and texts ``&`` is written ``&amp;`` and ``<|`` is written ``&lt;|``; a line break in a
role is written ``&#10;``. So control strings stand only where the template
puts them, and unescaping is exact. The loss mask is a list of (start, length)
in code points, one for each assistant text as written.

Defined cases: a null text or role counts as empty; a missing parent makes a
root; messages on a cycle have no root and are left out; ties of score go to
the smaller leaf; of rows that repeat a conversation's node, the one with the smallest
parent (none first), role, text and score counts; a null conversation is a
conversation and a null node a node like any other, but nothing can answer it; in linear
conversations repeated rows of a turn are turns of their own, in the order of role
and text, and a null turn is the first; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def chain(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: every row answers the one before it."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(order).cast("long")
    return rows.select("conv", n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, *, best: int = 1) -> DataFrame:
    """conv, leaf, rank, dist and node: the ``best`` root-to-leaf paths of each conversation, a row for each message.

    ``nodes`` has conv, node, parent and score, a row for each (conv, node). dist is the distance to the leaf.
    """
    # as one struct a key is equal to another whatever parts are null
    kind = nodes.select(F.struct("conv", "node").alias("me")).schema["me"].dataType.simpleString()
    up = F.when(F.col("parent").isNotNull(), F.struct("conv", F.col("parent").alias("node")).cast(kind))
    linked = stored(nodes.select(F.struct("conv", "node").alias("me"), up.alias("up"), F.coalesce("score", F.lit(0.0)).alias("total")))
    known = linked.select(F.col("me").alias("there"))
    linked = linked.join(known, F.col("up") == F.col("there"), "left").select("me", F.col("there").alias("up"), "total")
    hops = [stored(linked)]
    # after round k, up is the ancestor 2^k above and total the sum of the scores below it
    size = None
    while hops[-1].filter("up IS NOT NULL").limit(1).count():
        if len(hops) > 10:  # as long as this are paths, or cycles: those have no end
            size = size or linked.groupBy("me.conv").count().agg(F.max("count")).first()[0]
            if 1 << (len(hops) - 1) >= 2 * size:
                break
        now = hops[-1]
        far = now.select(F.col("me").alias("at"), F.col("up").alias("next"), F.col("total").alias("more"))
        live = now.filter("up IS NOT NULL").join(far, F.col("up") == F.col("at"))
        hops.append(stored(live.select("me", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total")).unionByName(now.filter("up IS NULL"))))
    parents = hops[0].filter("up IS NOT NULL").select("up").distinct()
    leaves = hops[-1].filter("up IS NULL").drop("up").join(parents, F.col("me") == F.col("up"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("me.conv").orderBy(F.desc("total"), "me.node"))
    out = leaves.withColumn("rank", rank).filter(F.col("rank") <= best).select(F.col("me.node").alias("leaf"), "rank", F.lit(0).cast("long").alias("dist"), "me")
    # every path so far, and the same ones again from 2^k higher
    for k, hop in enumerate(hops[:-1]):
        higher = out.join(hop.filter("up IS NOT NULL").select(F.col("me").alias("at"), "up"), F.col("me") == F.col("at"))
        out = stored(out.unionByName(higher.select("leaf", "rank", (F.col("dist") + (1 << k)).alias("dist"), F.col("up").alias("me"))))
    return out.select("me.conv", "leaf", "rank", "dist", "me.node")


def formatted(nodes: DataFrame, *, best: int = 1, trained: str = "assistant") -> DataFrame:
    """conv, leaf, rank, text and loss (array of start and length in code points) of each chosen path.

    A path's turns are gathered into one row, as it is one text.
    """
    row = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    messages = stored(nodes.groupBy("conv", "node").agg(F.min(row).alias("m")).select("conv", "node", "m.*"))
    texts = messages.select(F.struct("conv", "node").alias("at"), "role", "text")
    turns = paths(messages, best=best).join(texts, F.struct("conv", "node") == F.col("at"))
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;"))
    turn = F.struct((-F.col("dist")).alias("at"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == trained).alias("on"))
    rows = turns.groupBy("conv", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    tail = END + "\n"
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")

    def step(s: Column, x: Column) -> Column:
        begin = s["n"] + F.length(x["head"])
        spans = F.when(x["on"], F.concat(s["spans"], F.array(F.struct(begin.cast("int").alias("start"), F.length(x["body"]).cast("int").alias("length"))))).otherwise(s["spans"])
        return F.struct((begin + F.length(x["body"]) + len(tail)).cast("int").alias("n"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return rows.select("conv", "leaf", "rank", text.alias("text"), F.aggregate("t", zero, step, lambda s: s["spans"]).alias("loss"))


def read_back(out: DataFrame) -> DataFrame:
    """What :func:`formatted` has written: conv, leaf, rank, turns (role, text) and loss_text (all under the mask)."""
    pieces = F.slice(F.split("text", r"<\|im_start\|>"), 2, 1 << 30)

    def turn(x: Column) -> Column:
        at = F.instr(x, "\n")
        return F.struct(unescaped(F.substring(x, F.lit(1), at - 1)).alias("role"), unescaped(F.substring(x, at + 1, F.length(x) - at - len(END) - 1)).alias("text"))

    masked = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    return out.select("conv", "leaf", "rank", "text", F.transform(pieces, turn).alias("turns"), masked.alias("loss_text"))
