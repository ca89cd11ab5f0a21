"""Chat formatting with a prefix tree.

Conversations that share initial turns are merged: a node of the tree is a distinct run of first
turns, and each node's tokens are emitted once, depth-first. Every segment (the tokens of a node)
carries the position id of its first token, counted along its conversation, and the intervals of its
ancestors in the block: a token attends to those and to the tokens before it in its own segment.
Tokens are code points of the formatted text.

Template. ``<|role|>\\n`` text ``<|end|>\\n``. In roles and texts each of ``\\ < [ |`` is followed by a
backslash, so no control string (``</s>``, ``[INST]``, ``<|end|>``) survives inside a text, and
removing that backslash restores it. The loss covers the escaped texts of assistants.

Scale. Copies of a conversation are one leaf; leaves are sorted by range. A tree of at most
``tree_chars`` lies in one block. A larger tree (a first turn that a third of all conversations
share) is cut in depth-first order into blocks, at partition borders and at ``tree_chars``; each block
restates its open ancestors, as attention cannot leave a block. One conversation is one row.

Defined cases: a null text or role is empty; turns are ordered by (turn, role, text), a null turn
first; a null conv_id is a conversation of its own; repeated rows are repeated turns; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read

TREE_CHARS = 4_000_000
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
SPECIAL = "\\<[|"
TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
INTERVALS = "array<struct<start:long,end:long>>"
SEGMENT = f"struct<node:string,start:long,end:long,position:long,ancestors:{INTERVALS},loss_start:long,loss_end:long>"
BLOCKS = f"tree string, text string, segments array<{SEGMENT}>, leaves array<struct<leaf:string,segment:int>>"


def escape(text: str) -> str:
    return re.sub(r"[\\<\[|]", lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([\\<\[|])\\", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of its loss (empty but for assistants)."""
    head = OPEN + escape(role) + MIDDLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body) if role == "assistant" else len(head)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns in order, path (a 128-bit name for each run of first turns), root, leaf, chars."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def chain(acc: Column, t: Column) -> Column:
        above = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))
        content = F.concat(above, F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])
        return F.array_append(acc, F.substring(F.sha2(content, 256), 1, 32))

    path = F.aggregate("t", F.array().cast("array<string>"), chain)
    chars = F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + F.length(t["role"]) + F.length(t["text"]) + len(OPEN + MIDDLE + CLOSE))
    whole = whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), path.alias("path"), chars.alias("chars"))
    return whole.withColumn("root", F.get("path", F.lit(0))).withColumn("leaf", F.get("path", F.size("path") - 1))


class _Block:
    """Segments in depth-first order with a stack of the open nodes."""

    def __init__(self, tree: str):
        self.tree, self.parts, self.size = tree, [], 0
        self.segments, self.leaves, self.stack = [], [], []

    def add(self, path: list[str], turns: list[dict]) -> None:
        depth = 0
        while depth < min(len(path), len(self.stack)) and self.stack[depth]["node"] == path[depth]:
            depth += 1
        del self.stack[depth:]
        for node, turn in zip(path[depth:], turns[depth:], strict=True):
            text, low, high = render(turn["role"], turn["text"])
            ancestors: list[dict] = []
            for a in self.stack:  # neighbours in the block become one interval
                if ancestors and ancestors[-1]["end"] == a["start"]:
                    ancestors[-1] = {"start": ancestors[-1]["start"], "end": a["end"]}
                else:
                    ancestors.append({"start": a["start"], "end": a["end"]})
            position = self.stack[-1]["position"] + self.stack[-1]["end"] - self.stack[-1]["start"] if self.stack else 0
            segment = {"node": node, "start": self.size, "end": self.size + len(text), "position": position, "ancestors": ancestors, "loss_start": self.size + low, "loss_end": self.size + high}
            self.stack.append(segment | {"index": len(self.segments)})
            self.segments.append(segment)
            self.parts.append(text)
            self.size += len(text)
        self.leaves.append({"leaf": path[-1], "segment": self.stack[-1]["index"]})

    def row(self) -> dict:
        return {"tree": self.tree, "text": "".join(self.parts), "segments": self.segments, "leaves": self.leaves}


def _blocks(batches: Iterator[pd.DataFrame], tree_chars: int) -> Iterator[pd.DataFrame]:
    """Leaves come sorted by tree and path."""
    block = None
    for batch in batches:
        for root, big, path, turns in zip(batch["root"], batch["big"], batch["path"], batch["turns"], strict=True):
            if block is not None and (block.tree != root or big and block.size >= tree_chars):
                yield pd.DataFrame([block.row()])
                block = None
            block = block or _Block(root)
            block.add(list(path), list(turns))
    if block is not None:
        yield pd.DataFrame([block.row()])


def merge(whole: DataFrame, tree_chars: int = TREE_CHARS) -> DataFrame:
    """BLOCKS of conversations() (or of a written copy of it)."""
    leaves = whole.groupBy("leaf").agg(F.first("root").alias("root"), F.first("path").alias("path"), F.first("turns").alias("turns"), F.first("chars").alias("chars"))
    leaves = materialise(leaves, "chat-leaves")
    large = leaves.groupBy("root").agg(F.sum("chars").alias("c")).where(F.col("c") > tree_chars).select(F.col("root").alias("_root"))
    large = materialise(large, "chat-large")
    rows = leaves.join(large, leaves["root"] == large["_root"], "left").withColumn("big", F.col("_root").isNotNull())
    # Equal keys stay together: a tree that isn't large has one key.
    rows = rows.withColumn("_order", F.when(F.col("big"), F.array_join("path", "")).otherwise(F.lit("")))
    rows = rows.repartitionByRange("root", "_order").sortWithinPartitions("root", "path").select("root", "big", "path", "turns")
    return rows.mapInPandas(lambda it: _blocks(it, tree_chars), BLOCKS)


def _read_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        for text, segments, leaves in zip(batch["text"], batch["segments"], batch["leaves"], strict=True):
            rows, by_start = [], {s["start"]: s for s in segments}
            for leaf in leaves:
                own = segments[leaf["segment"]]
                spans = [*((a["start"], a["end"]) for a in own["ancestors"]), (own["start"], own["end"])]
                if sum(b - a for a, b in spans[:-1]) != own["position"]:
                    raise ValueError(f"node {own['node']}: its position differs from its ancestors' lengths")
                formatted = "".join(text[a:b] for a, b in spans)
                turns, at = hashlib.sha256(), 0
                n = 0
                for m in TURN.finditer(formatted):
                    if m.start() != at:
                        raise ValueError(f"node {own['node']}: text between turns")
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    n, at = n + 1, m.end()
                loss, size = hashlib.sha256(), 0
                for a, b in spans:
                    while a < b:  # the segments that make up an interval
                        s = by_start[a]
                        piece = unescape(text[s["loss_start"] : s["loss_end"]])
                        loss.update(piece.encode("utf-8", "surrogatepass"))
                        size += len(piece)
                        a = s["end"]
                rows.append((leaf["leaf"], n, turns.hexdigest(), size, loss.hexdigest(), len(formatted)))
            yield pd.DataFrame(rows, columns=names)


def read_back(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """Digests of every conversation of members(conv_id, leaf), from the blocks alone."""
    found = blocks.mapInPandas(_read_blocks, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    # A large tree's leaf lies in one block, as its leaves are distinct: a row for each leaf.
    found = found.withColumnRenamed("leaf", "_leaf")
    return members.join(found, members["leaf"] == found["_leaf"]).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    whole = materialise(conversations(turns.union(more)), "chat-whole")
    return read_back(merge(whole), whole.select("conv_id", "leaf"))


QUERIES = {"op2_chat_prefix_tree": op2_chat_prefix_tree}
ORACLE_SQL = {
    "op2_chat_prefix_tree": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\<\[|]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[|]', '', 'g')) + 13 AS f FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(f) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
