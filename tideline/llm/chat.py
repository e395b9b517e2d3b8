"""Chat formatting of reply trees.

Messages name their parent; jump pointers found by iterated self-joins give every root-to-leaf path in a number of
rounds that is logarithmic in the depth, branches are ranked by the mean score of their messages, and each chosen path
becomes one conversation in the template below.

Template: ``<s>[role] text</s>`` for each turn. Control strings inside a text or role are broken by a backslash after
their first character and backslashes are doubled, so a text can neither open nor close a turn and unescaping gives it
back exactly.

Edge cases: null text and null role count as empty; a null tree is a tree of its own where it comes as a struct, as
``reply_chain`` makes it; a message whose parent is missing is a root; a cycle of replies raises ValueError; null turns
come first; equal scores are settled by the smaller leaf id; repeated (tree, node) rows count once,
the smallest (role, text) staying; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import materialise, with_nulls, without_nulls

#: Control strings (fixed values): those of the template and those of common chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROL))
_TURN = re.compile(r"<s>\[((?:[^\]\\]|\\.)*)\] (.*?)</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans [start, end) of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[{escape(role).replace(']', chr(92) + ']')}] ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</s>")
        at += len(head) + len(body) + 4
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): each node of each root-to-leaf path, up edges above the leaf.

    nodes has tree, node and parent. jump k holds the ancestor 2^k edges up; a leaf's path is then laid out from the
    longest jumps to the shortest. Rows made are those of the paths themselves.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    edges = nodes.where(F.col("parent").isNotNull()).select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi")
    jumps, jump = [], materialise(edges.select("tree", "node", F.col("parent").alias("above")))
    size = nodes.count()
    while not jump.isEmpty():
        if 1 << len(jumps) > size:  # longer than any path without a cycle
            raise ValueError("the replies hold a cycle")
        jumps.append(jump)
        farther = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        jump = materialise(jump.join(farther, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")))
    leaves = nodes.join(edges.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    out = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        farther = out.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        out = materialise(out.unionByName(farther))
    return out


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, score, n_turns, formatted, spans) for the best branches of each tree.

    nodes: tree, node, parent, role, text, score; further columns are ignored.
    """
    text = nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    text = text.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "node", "m.*")
    tree = materialise(text)
    found = paths(tree.select("tree", "node", "parent"))
    scored = found.join(tree.select("tree", "node", "score"), ["tree", "node"])
    ranks = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    best = ranks.withColumn("rank", rank).where(F.col("rank") <= branches).drop("rank")
    turns = found.join(best, ["tree", "leaf"]).join(tree.select("tree", "node", "role", "text"), ["tree", "node"])
    whole = turns.groupBy("tree", "leaf", "branch_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))

    @F.pandas_udf("formatted string, spans array<struct<start:long,end:long>>")
    def laid_out(turns: pd.Series) -> pd.DataFrame:
        done = [format_turns([(t["role"], t["text"]) for t in x]) for x in turns]
        return pd.DataFrame({"formatted": [x[0] for x in done], "spans": [[{"start": a, "end": b} for a, b in x[1]] for x in done]}, dtype=object)

    return whole.select("tree", "leaf", F.col("branch_score").alias("score"), F.size("turns").cast("long").alias("n_turns"), laid_out("turns").alias("x")).select("tree", "leaf", "score", "n_turns", "x.*")


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row replies to the row before it.

    The tree is a struct of conv_id, so that a null conv_id joins with itself.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = conversations.select(F.struct("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return node.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from their text and spans."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = []
            for tree, text, spans in zip(b["conv_id"], b["formatted"], b["spans"], strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree"].dataType["conv_id"].dataType.simpleString()
    rows = without_nulls(formatted.select("tree.conv_id", "formatted", "spans"), "conv_id")
    return with_nulls(rows.mapInPandas(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"), "conv_id")
