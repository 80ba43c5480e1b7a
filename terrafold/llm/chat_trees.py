"""Chat formatting of reply trees.

Messages point to the message they answer. Pointers double: after round ``k`` every
message knows its ancestor ``2^k`` replies up and the sums over the messages between,
so a tree of depth ``d`` takes ``log2(d)`` self-joins. The sums give each message its
depth, the score of the branch down to it and the place of its turn in the formatted
text. Leaves are ranked within their tree by branch score, and the paths of the
chosen leaves are enumerated by the same pointers, again doubling.

Turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is
doubled and ``<|`` becomes ``<\\|``, in roles a line feed gets a backslash before it,
so control strings of the template never come from a text, and reading back gives
the texts as they were.

Join keys are message ids, each once on one side; a message with very many replies
can be split on the other. Only the turns of one conversation meet in one group,
which is one row of the output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordered import with_rank
from .common import cut, let

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape_text(text), F.lit(f"{END}\n"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    header = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"

    def read(piece: Column) -> Column:
        part = lambda i: unescape(F.regexp_extract(piece, header, i))
        return F.struct(part(1).alias("role"), part(2).alias("text"))

    return let(pieces, lambda ps: F.transform(F.slice(ps, 1, F.size(ps) - 1), read))


def chain(df: DataFrame, conversation: str, turn_no: str, role: str, text: str) -> DataFrame:
    """Messages of linear conversations: every row answers the one before it, by turn.

    Rows of one turn follow role and text; null turns come first. Null conversations
    are one conversation.
    """
    rows = df.select(
        F.col(conversation).alias("tree"),
        F.col(turn_no).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    slice_no = F.coalesce(F.floor(F.col("turn") / 512), F.lit(-(2**62)))
    ranked = with_rank(rows, ["tree"], slice_no, [F.asc_nulls_first("turn"), "role", "text"], "rank")
    node = lambda at: F.concat_ws(":", F.coalesce(F.col("tree").cast("string"), F.lit("null")), at.cast("string"))
    above = F.when(F.col("rank") > 1, node(F.col("rank") - 1))
    return ranked.select("tree", node(F.col("rank")).alias("node"), above.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branch_sums(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Per message ``node, depth, score, chars`` from its root down to it, and the ancestor tables.

    Table ``k`` has ``node, up``: the ancestor ``2^k`` replies up, for the messages that have one.
    Parents that are not there are roots' parents. Messages of a cycle have no root; they are left out.
    """
    own = messages.select("node", "parent", "score", F.length(turn(F.col("role"), F.col("text"))).cast("long").alias("chars"))
    known = own.select(F.col("node").alias("parent"), F.col("node").alias("up"))
    state = own.join(known, "parent", "left").select("node", "up", F.lit(1).cast("long").alias("depth"), "score", "chars")
    state = cut(state)
    left = state.filter("up IS NOT NULL").count()
    tables: list[DataFrame] = []
    total = state.count()
    while left and 2 ** len(tables) <= total:
        going = state.filter("up IS NOT NULL")
        tables.append(going.select("node", "up"))
        above = state.select(F.col("node").alias("up"), *[F.col(c).alias(f"__{c}") for c in ("up", "depth", "score", "chars")])
        stepped = going.join(above, "up").select(
            "node", F.col("__up").alias("up"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in ("depth", "score", "chars")]
        )
        state = cut(state.filter("up IS NULL").unionByName(stepped))
        left = state.filter("up IS NOT NULL").count()
    return state.filter("up IS NULL").drop("up"), tables


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of every tree, one formatted conversation each.

    ``messages``: ``tree, node, parent, role, text, score``, one row per node id (unique in the
    table). A branch scores the mean of its messages' scores; ties go to the least leaf id.
    Returns ``tree, leaf, branch_rank, branch_score, n_turns, formatted, loss``; ``loss`` holds
    ``struct<start, end>`` code points of each assistant text within ``formatted``.
    Null roles and texts are empty, null scores 0. An empty table gives no rows.
    """
    read = messages.select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    read = cut(read)
    sums, tables = branch_sums(read)
    sums = cut(sums)
    answered = read.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = read.select("tree", "node").join(answered, "node", "left_anti").join(sums, "node")
    leaves = leaves.withColumn("branch_score", F.col("score") / F.col("depth"))
    best = W.partitionBy("tree").orderBy(F.desc("branch_score"), "node")
    leaves = leaves.withColumn("branch_rank", F.row_number().over(best)).filter(F.col("branch_rank") <= branches)
    chosen = cut(leaves.select("tree", F.col("node").alias("leaf"), "branch_rank", "branch_score", F.col("depth").alias("n_turns")))

    def climb(path: DataFrame, table: DataFrame) -> DataFrame:
        higher = path.join(table, "node").select("leaf", F.col("up").alias("node"))
        return cut(path.unionByName(higher))

    path = reduce(climb, tables, chosen.select("leaf", F.col("leaf").alias("node")))
    turns = path.join(read.select("node", "role", "text"), "node").join(sums.select("node", "depth", "chars"), "node")
    shown = turn(F.col("role"), F.col("text"))
    start = F.col("chars") - F.length(shown) + len(START) + F.length(escape_role(F.col("role"))) + 1
    span = F.struct(start.alias("start"), (start + F.length(escape_text(F.col("text")))).alias("end"))
    turns = turns.select("leaf", F.struct("depth", shown.alias("shown"), F.when(F.col("role") == "assistant", span).alias("loss")).alias("t"))
    joined = turns.groupBy("leaf").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    formatted = joined.select(
        F.col("leaf").alias("__leaf"),
        F.array_join(F.col("ts.shown"), "").alias("formatted"),
        F.filter(F.col("ts.loss"), lambda s: s.isNotNull()).alias("loss"),
    )
    return chosen.join(formatted, F.col("leaf") == F.col("__leaf")).drop("__leaf")


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(
        loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
