"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins by doubling (each message's ancestor so far
is joined to the row of that ancestor) give every message its depth and the sum of scores
up to the root in about log2(depth) joins of ids. Each leaf is a branch; branches of a tree
are ranked by score. Only the best ``keep`` are walked: the same ancestors, from the
farthest to the nearest, double a branch's rows until it has one for each message. No row
holds a path, so a thread costs rows in proportion to its turns. Texts join once at the end.

The template marks a turn as ``### role: text</turn>`` and a newline. Inside roles and
texts the characters that start a control string are escaped, so no text can imitate one:
backslash, ``#`` and ``<`` become a backslash followed by a backslash, ``h`` and ``l`` (in
roles also ``:`` as ``c``). ``parse`` and ``unescape`` are the exact inverse.

Defined results: null role and null text are empty; a message whose parent is null or
absent is a root; messages in or below a cycle reach no root and give no path, nor do
messages without an id; messages without a tree id are one tree; equal message ids of a
tree are one node, that row of least parent, score, role and text (nulls first); an empty
table gives an empty table; other columns are ignored. A conversation is one record: its
formatted text is one row, however long.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import trimmed, written

HEAD, END = "### ", "</turn>\n"
#: Joins of the walk in one plan.
_CUT = 4
#: The escapes: a code after a backslash and what it stands for.
_CODE, _RAW = re.compile(r"\\([\\hlc])"), {"\\": "\\", "h": "#", "l": "<", "c": ":"}


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, code in [("#", "h"), ("<", "l"), *([(":", "c")] if role else [])]:
        out = F.replace(out, F.lit(raw), F.lit(f"\\{code}"))
    return out


def unescape(text: Column, role: bool = False) -> Column:
    """Inverse of ``escape``: what lies between escaped backslashes has single-letter codes only."""

    def part(p):
        for raw, code in [("#", "h"), ("<", "l"), *([(":", "c")] if role else [])]:
            p = F.replace(p, F.lit(f"\\{code}"), F.lit(raw))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _node(parent: str, score: str, *more) -> Column:
    """The least row of a repeated message: parent ``p``, score ``s`` and what follows."""
    return F.min(F.struct(F.col(parent).alias("p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), *more))


def steps(messages: DataFrame, tree: str = "tree_id", node: str = "message_id", parent: str = "parent_id", score: str = "score", keep: int = 1) -> DataFrame:
    """(tree, branch, rank, branch_score, turn, node): a row for each message of the best ``keep`` branches, turn 0 the root.

    A branch is named by its leaf; its score is the mean score of its messages (null counts
    as 0), ties going to the smaller leaf.
    """
    m = messages.where(F.col(node).isNotNull()).groupBy(F.struct(F.col(tree).alias("k")).alias("t"), F.col(node).alias("n")).agg(_node(parent, score).alias("x"))
    # size, s: of the messages from n up to, but without, up, which may be absent until it is looked up
    state = written(m.select("t", "n", F.col("x.p").alias("up"), F.lit(1).cast("long").alias("size"), F.col("x.s").alias("s")), "ancestors", release=True)
    done, jumps, open_before = [], [], None
    while True:
        left, rows = state.agg(F.count("up"), F.count(F.lit(1))).first()
        if not left or left == open_before:  # done, or only cycles are left
            break
        open_before = left
        if 4 * left <= rows:  # trees whose messages all reach a root leave the loop
            trees = state.where(F.col("up").isNotNull()).select("t", F.lit(True).alias("open")).distinct()
            marked = written(state.join(trees, "t", "left"), "ancestors")
            done.append(marked.where(F.col("open").isNull()).select("t", "n", "up", "size", "s"))
            state = marked.where("open").select("t", "n", "up", "size", "s")
        # merged, here and below: each broadcast is held in the driver, for a thread and a copy of the rows
        step = state.select("t", F.col("n").alias("up"), F.col("up").alias("up2"), F.col("size").alias("size2"), F.col("s").alias("s2")).hint("merge")
        longer = state.where(F.col("up").isNotNull()).join(step, ["t", "up"], "left")
        longer = longer.select("t", "n", F.col("up2").alias("up"), F.coalesce(F.col("size") + F.col("size2"), "size").alias("size"), F.coalesce(F.col("s") + F.col("s2"), "s").alias("s"), F.when(F.col("size2").isNotNull(), F.col("up")).alias("via"))
        kept = state.where(F.col("up").isNull()).withColumn("via", F.col("up"))
        both = written(kept.unionByName(longer), "ancestors")
        jumps.append(both.where(F.col("via").isNotNull()).select("t", "n", F.col("via").alias("up")))  # 2 ** (len(jumps) - 1) turns up
        state = both.select("t", "n", "up", "size", "s")
    for part in done:
        state = state.unionByName(part)
    leaves = state.where(F.col("up").isNull()).withColumn("branch_score", F.col("s") / F.col("size"))
    if jumps:
        parents = jumps[0].select("t", F.col("up").alias("n")).distinct()
        leaves = leaves.join(parents.hint("merge"), ["t", "n"], "left_anti")
    w = Window.partitionBy("t").orderBy(F.desc("branch_score"), "n")
    ranked = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    walk = written(ranked.select("t", F.col("n").alias("branch"), "rank", "branch_score", (F.col("size") - 1).alias("turn"), "n"), "branches", release=True)
    for k, jump in reversed(list(enumerate(jumps))):
        # every distance below 2 ** (k + 1) is written once as a sum of powers of two
        both = F.array(F.struct("n", "turn"), F.struct(F.col("up").alias("n"), (F.col("turn") - (1 << k)).alias("turn")))
        walk = walk.join(jump.hint("merge"), ["t", "n"], "left").select("t", "branch", "rank", "branch_score", F.explode(F.filter(both, lambda x: x["n"].isNotNull())).alias("x")).select("t", "branch", "rank", "branch_score", "x.turn", "x.n")
        if k and k % _CUT == 0:  # no plan grows with the depth
            walk = written(walk, "branches")
    return walk.select(F.col("t.k").alias(tree), "branch", "rank", "branch_score", "turn", F.col("n").alias(node))


def paths(messages: DataFrame, tree: str = "tree_id", node: str = "message_id", parent: str = "parent_id", score: str = "score", keep: int = 1) -> DataFrame:
    """``steps`` as one row a branch: (tree, branch, rank, path array<node> from the root, branch_score)."""
    one = steps(messages, tree, node, parent, score, keep).groupBy(tree, "branch", "rank").agg(F.array_sort(F.collect_list(F.struct("turn", F.col(node).alias("n")))).alias("path"), F.first("branch_score").alias("branch_score"))
    return one.select(tree, "branch", "rank", F.col("path.n").alias("path"), "branch_score")


def format_turns(turns: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row per ``by``: formatted text and the spans (code points) under the loss mask.

    ``turns`` has role and text. The mask covers the escaped text of each assistant turn.
    """
    t = turns.select(*by, order, escape(F.coalesce("role", F.lit("")), True).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("x"))
    t = t.withColumn("piece", F.concat(F.lit(HEAD), "r", F.lit(": "), "x", F.lit(END)))
    before = Window.partitionBy(*by).orderBy(order, "r", "x").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    start = F.col("at") + F.length("r") + len(HEAD) + 2
    span = F.when(F.col("r") == "assistant", F.struct(start.alias("start"), (start + F.length("x")).alias("end")))
    g = t.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "piece", span.alias("span")))).alias("turns"))
    return g.select(*by, F.array_join(F.col("turns.piece"), "").alias("formatted"), F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> that ``format_turns`` wrote."""
    parts = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: F.length(p) > 0)
    cut = lambda p: F.instr(p, ": ")
    one = lambda p: F.struct(unescape(p.substr(F.lit(len(HEAD) + 1), cut(p) - len(HEAD) - 1), True).alias("role"), unescape(p.substr(cut(p) + 2, F.length(p))).alias("text"))
    return F.transform(parts, one)


def trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Format the best branches of reply trees: (tree_id, branch, rank, formatted, loss_spans).

    ``messages``: tree_id, message_id, parent_id, role, text, score.
    """
    chosen = steps(messages, keep=keep)
    least = _node("parent_id", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    texts = messages.groupBy("tree_id", "message_id").agg(least.alias("m"))
    texts = texts.select(F.col("tree_id").alias("_t"), F.col("message_id").alias("_n"), "m")
    turns = chosen.join(texts, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("message_id") == F.col("_n"))).select("tree_id", "branch", "rank", "turn", "m.role", "m.text")
    return format_turns(turns, ["tree_id", "branch", "rank"], "turn")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each turn replies to the one before.

    Turns with the same number follow each other by role and text.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(w).cast("long").alias("k"))
    return t.select(F.col("conv_id").alias("tree_id"), F.col("k").alias("message_id"), F.when(F.col("k") > 1, F.col("k") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """Read formatted conversations back: counts and digests of the turns and of what the mask covers.

    Plain strings in a worker: a span is cut in constant time, not by a scan from the text's start.
    """
    f = formatted.select(key, "formatted", F.col("loss_spans.start").alias("start"), F.col("loss_spans.end").alias("end"))
    schema = StructType([f.schema[key], *(StructField(n, t) for n, t in (("n_turns", LongType()), ("turns_sha256", StringType()), ("loss_chars", LongType()), ("loss_sha256", StringType()), ("formatted_chars", LongType())))])
    names = schema.names[1:]

    def plain(text):
        return _CODE.sub(lambda m: _RAW[m[1]], text)

    def one(text, starts, ends):
        turns = [p[len(HEAD) :].partition(": ") for p in text.split(END)[:-1]]
        said = "".join(f"{plain(role)}\n{plain(x)}\n" for role, _, x in turns)
        loss = "".join(plain(text[s:e]) for s, e in zip(starts, ends, strict=True))
        return len(turns), _sha(said), len(loss), _sha(loss), len(text)

    def step(batches):
        for batch in batches:
            rows = [one(*(c[i].as_py() for c in batch.columns[1:])) for i in range(batch.num_rows)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, *names])

    return f.mapInArrow(trimmed(step), schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
