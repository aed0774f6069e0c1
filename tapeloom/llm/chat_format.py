"""Chat formatting of reply trees.

Messages are nodes with a parent; a conversation is a path from a root to a leaf. The tree is walked on ids alone, by
self-joins that double their reach: after k of them every node knows the node 2^k replies above it and the sum of scores
between, so a thread of a thousand replies takes ten joins, not a thousand. Leaves are ranked within their tree by the
mean score of their path (ties: the smaller leaf), and the best `branches` of each tree are expanded back to their nodes
the same way; then the texts join and each path is formatted as one conversation. A cycle has no root and no leaf and is
left out, and so is what hangs on a parent that isn't there.

Template. A turn of the assistant is `text</s>`; one of any other role is `<s>[INST] role\\ntext [/INST]`. Within texts and
roles, a backslash comes before each backslash and each control string; in roles also before a line end. Taking the
backslashes away again gives the text, so the output can be read back exactly. The loss mask is the list of (start, end)
of the assistant's texts, in code points of the output.

Cases: null texts and null roles count as empty; empty texts are turns; rows of the same turn follow each other by role and
text (nulls first); repeated rows are turns of their own; the null conversation is one conversation; ties of scores go to the smaller
leaf; a very long text, and a conversation of very many turns, are formatted whole, in one task, as the output is one string; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, load, prefix_sums

#: Turns of a conversation that are ordered together.
RUN = 256

_control = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]")
_token = re.compile(r"\\(.)|(<s>\[INST\] )|( \[/INST\])|(</s>)|([^\\< \[]+)|(.)", re.S)


def escape(text: str) -> str:
    return _control.sub(lambda m: "\\" + m[0], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The output for (role, text) turns, and its loss mask."""
    out, mask, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            mask.append((at, at + len(body)))
            piece = body + "</s>"
        else:
            head = escape(role).replace("\n", "\\\n")
            piece = f"<s>[INST] {head}\n{body} [/INST]"
        out.append(piece)
        at += len(piece)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of an output of format_turns()."""
    turns: list[tuple[str, str]] = []
    role, text = None, []  # role: None before a header ends
    inside = False
    for m in _token.finditer(formatted):
        kind = m.lastindex
        if kind == 2 and not inside:
            inside, role, text = True, None, []
        elif kind == 3 and inside:
            turns.append((role or "", "".join(text)))
            inside, text = False, []
        elif kind == 4 and not inside:
            turns.append(("assistant", "".join(text)))
            text = []
        else:
            piece = m[1] if kind == 1 else m[0]
            if inside and role is None and kind != 1 and "\n" in piece:
                head, _, piece = piece.partition("\n")
                role, text = "".join(text) + head, []
            text.append(piece)
    return turns


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, node, step (0 at the leaf): the paths of each tree's best leaves.

    nodes: tree, node, parent (null at a root), score. (tree, node) is unique.
    """
    # `up` is the node 2^k replies above, null once the root is passed; n and sum are of the path before it; ended is the round k of that
    now = cut(nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).alias("n"), F.col("score").alias("sum"), F.lit(0).alias("ended")))
    jumps: list[DataFrame] = []
    # where some paths go on, others have ended in this round, unless only cycles are left
    while not now.where("up is not null").isEmpty() and not now.where(f"up is null and ended = {len(jumps)}").isEmpty():
        jumps.append(now.where("up is not null"))
        above = now.select(F.col("tree").alias("t"), F.col("node").alias("m"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("sum").alias("sum2"))
        same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m"))
        # only paths that haven't ended are followed; a parent that isn't there ends a path without a root
        further = jumps[-1].join(above, same).select("tree", "node", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("sum") + F.col("sum2")).alias("sum"), F.lit(len(jumps)).alias("ended"))
        now = cut(now.where("up is null").union(further))
    rooted = now.where("up is null")
    parents = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), "node"))
    paths = leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("step"))
    # the highest jump first: each join doubles what a path holds
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("m"), "up")
        more = paths.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("m"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("step") + (1 << k)).alias("step"))
        paths = cut(paths.unionByName(more))  # its plan holds the paths twice
    return paths


def as_tree(turns: DataFrame) -> DataFrame:
    """tree, node, parent, score, role, text: conversations by turn, each row the reply to the one before.

    Rows are numbered in runs of RUN turns (prefix_sums), so a conversation of very many turns isn't ordered in one task.
    """
    rows = turns.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("one"))
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(2**62))))
    rows = prefix_sums(rows, ["tree"], "run", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "one", "node")
    parent = F.when(F.col("node") > 0, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), F.length("text").cast("double").alias("score"), "role", "text")


def conversations(tree: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, formatted, mask: one row per chosen path. tree: tree, node, parent, score, role, text."""
    paths = best_paths(tree.select("tree", "node", "parent", "score"), branches)
    texts = tree.select(F.col("tree").alias("t"), F.col("node").alias("m"), "role", "text")
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("m")))
    whole = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("step"), "role", "text"))).alias("turns"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
            pdf = pdf[["tree", "leaf"]].copy()
            pdf["formatted"] = [m[0] for m in made]
            pdf["mask"] = [[{"start": a, "end": b} for a, b in m[1]] for m in made]
            yield pdf

    kind = tree.schema["tree"].dataType.simpleString()
    return whole.mapInPandas(run, f"tree {kind}, leaf long, formatted string, mask array<struct<start:int,end:int>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What op10 asks for, read back from the output alone."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for tree, text, mask in zip(pdf["tree"], pdf["formatted"], pdf["mask"]):
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(run, f"conv_id {formatted.schema['tree'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digest(conversations(cut(as_tree(turns))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\\\1', 'g') AS body,
         replace(regexp_replace(role, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\\\1', 'g'), chr(10), '\' || chr(10)) AS head FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(body) + 4 ELSE length(head) + length(body) + 19 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op10_chat_format": query}
ORACLE = {"op10_chat_format": SQL}
