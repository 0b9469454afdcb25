"""Chat formatting (operator 2), with DataFrame functions only.

Messages form reply trees.  Pointer-doubling self-joins find the depth and the summed score of every
path (log2 of the depth joins), leaves are ranked in their tree, and further self-joins list the
messages of the chosen leaves, which become one text each.

Template: `<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>` for each turn.  Control strings within roles and
texts get a backslash after their first character and backslashes are doubled, so no control string can
come from a text; removing one backslash before every character undoes it.

Defined cases: null roles and texts are empty; a parent that does not exist counts as none, so its
child is a root; messages on a cycle have no root and are on no path; equal scores are ordered by depth,
then by message; null trees form one tree; a message without a node is in no tree and left out; of messages
with one tree and node the first by parent, role, text and score counts; very long texts are one message,
and a path is one row of output, of at most 500 million code points where its mask is read back; empty tables give empty results; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

#: Fixed control strings of the template and of other common templates.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\.[]{}()<>*+-=!?^$|/" else c for c in text)


def escape(text: Column) -> Column:
    rest = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), f"({rest})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """nodes (tree, node, parent, score) to (tree, leaf, node, up): the messages of each chosen path."""
    n = nodes.count()
    parents = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = nodes.join(parents, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("ptr"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")
    )
    state = materialize(first, "chat-jump")
    # A message that has reached its root is done; only the others are joined again.
    active, done = state.where("ptr IS NOT NULL"), state.where("ptr IS NULL")
    jumps = []
    while 2 ** len(jumps) <= max(n, 1) and not active.isEmpty():
        jumps.append(active.select("tree", "node", "ptr"))
        above = active.unionByName(done).select("tree", F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        met = active.join(above, ["tree", "ptr"])
        moved = materialize(met.select("tree", "node", F.col("ptr2").alias("ptr"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")), "chat-jump")
        active, done = moved.where("ptr IS NOT NULL"), done.unionByName(moved.where("ptr IS NULL"))
    leaves = done.join(nodes.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= keep)
    out = materialize(chosen.select("tree", F.col("node").alias("leaf"), "branch", "node", F.lit(0).cast("long").alias("up")), "chat-path")
    for k, jump in enumerate(jumps):
        step = out.join(jump, ["tree", "node"]).select("tree", "leaf", "branch", F.col("ptr").alias("node"), (F.col("up") + 2**k).alias("up"))
        out = materialize(out.unionByName(step), "chat-path")
    return out


def format_trees(nodes: DataFrame, keep: int = 1, loss_roles: tuple[str, ...] = ("assistant",), unique: bool = False) -> DataFrame:
    """nodes (tree, node, parent, role, text, score) to (tree, leaf, branch, formatted, loss).

    loss: array<struct<start, end>>, the code points of `formatted` that are trained on.  One
    conversation is one row, as it is in the output; it is gathered by its own key only.
    unique: no tree has a node twice, so repeated messages need not be looked for.
    """
    kind, tree = nodes.schema["tree"].dataType, F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
    nodes = nodes.where("node IS NOT NULL").select(tree.alias("tree"), "node", "parent", "role", "text", F.col("score").cast("double").alias("score"))
    if not unique:
        first = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
        nodes = materialize(first.select("tree", "node", "m.*"), "chat-messages")
    turns = paths(nodes.select("tree", "node", "parent", "score"), keep).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    head, body = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), escape(F.col("text"))
    turns = turns.select("tree", "leaf", "branch", "up", head.alias("head"), body.alias("body"), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"))
    # Positions are a running sum over the turns before they meet in one row, by the same key.
    so_far = Window.partitionBy("tree", "leaf", "branch").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("head") + F.length("body") + len(END)).over(so_far) - len(END)
    placed = turns.withColumn("end", end).withColumn("start", F.col("end") - F.length("body"))
    turn = F.struct((-F.col("up")).alias("at"), "head", "body", "loss", "start", "end")
    gathered = placed.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    named = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).cast(kind)
    return gathered.select(named.alias("tree"), "leaf", "branch", formatted.alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read from a formatted conversation."""
    return F.transform(
        F.slice(F.split(formatted, _quoted(START)), 2, 1 << 30),
        lambda t: F.struct(
            unescape(F.substring_index(t, SEP, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(t, SEP, -1), END, 1)).alias("text"),
        ),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, in order.

    A place in UTF-8 is found by reading from the beginning, for every span anew; four bytes a code point make it a
    product.  Each piece gets a byte order mark, the one that decoding takes away.
    """
    piece = lambda wide, s: F.substring(wide, (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int"))
    said = lambda wide, s: unescape(F.decode(F.concat(F.unhex(F.lit("0000FEFF")), piece(wide, s)), "UTF-32"))
    # The array of one element has the encoded text made once, not once a span.
    return F.concat_ws("", F.flatten(F.transform(F.array(F.encode(formatted, "UTF-32")), lambda wide: F.transform(loss, lambda s: said(wide, s)))))


def from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to reply trees that are chains in the order of turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


#: The conversation that the contract adds.
HARD_TEXT = "</s>[INST] ok [/INST]"


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(hard)
    written = materialize(format_trees(materialize(from_turns(turns), "chat-nodes"), unique=True), "chat-formatted")
    read = written.select(
        F.col("tree").alias("conv_id"), F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("masked")
    )
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(col: str) -> str:
    inner = f"replace(coalesce({col}, ''), '\\', '\\\\')"
    return reduce(lambda s, c: f"replace({s}, '{c}', '{c[0]}\\{c[1:]}')", CONTROL, inner)


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(START + SEP + END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
