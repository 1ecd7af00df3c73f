"""Chat formatting of reply trees.

Messages form trees by their parent.  Self-joins that double their reach each
time (a message with its parent, its grandparent, the ancestor four above ...)
find every message's depth and the sum of the scores from the root to it in
as many rounds as the depth has bits.  A leaf ends a branch; the branches of a
tree are ranked by their score, and the best ``top`` of them are laid out as
root-to-leaf paths by the same doubling.  Each chosen path is one conversation.

A turn is written as

    <|im_start|>role newline text <|im_end|> newline

with a backslash put after the first character of every control string inside
a text or role, and backslashes doubled, so reading gives back every turn.  The
loss mask is the list of [start, end) positions, in code points, of the
assistant texts.

Defined cases: a null text or role is empty; a null parent, or one that is not
there, makes a root; equal scores rank by the smaller leaf; messages on a
cycle have no root and are on no path; repeated rows of a conversation are
turns of their own, in the order turn (null first), role, hash of the text; a
null conversation is one conversation; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covera.llm.common import ordered_scan
from covera.session import cut_lineage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"(<(?=\||/?s>|unk>|pad>|</?SYS>>)|\[(?=/?INST\]))")
_ESCAPED = re.compile(r"\\([\s\S])")
_ROLE = re.compile(r"((?:[^\\\n]|\\[\s\S])*)\n")


# --- the template ----------------------------------------------------------

def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask, from (role, text) pairs."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role or "").replace("\n", "\\\n") + "\n"
        body = escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def read_turns(formatted: str):
    """(role, text) pairs of a formatted conversation."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        head = _ROLE.match(formatted, at + len(OPEN))
        end = formatted.index(CLOSE, head.end())
        yield unescape(head[1]), unescape(formatted[head.end():end])
        at = end + len(CLOSE) + 1


# --- paths -----------------------------------------------------------------

def best_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, node, depth) of the chosen paths, from (tree, node, parent, score).

    ``branch`` ranks the paths of a tree from 1; ``depth`` counts from the root, 0.
    ``top`` = None keeps all branches.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    up = cut_lineage(nodes.join(known, (F.col("tree") == F.col("_t")) & (F.col("parent") == F.col("_n")), "left").select(
        "tree", "node", F.col("_n").alias("above"), F.lit(1).cast("long").alias("hops"), F.col("score").alias("sum")))
    leaves = up.select("tree", "node").join(
        up.where("above IS NOT NULL").select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    # A round joins only messages whose root is not known yet; ``steps[k]`` leads 2 ** k messages up.
    done, open_, steps, total = up.where("above IS NULL"), up.where("above IS NOT NULL"), [], up.count()
    for _ in range(max(1, total).bit_length()):
        if open_.isEmpty():
            break
        steps.append(open_)
        b = done.unionByName(open_).select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("above").alias("_a"),
                                           F.col("hops").alias("_h"), F.col("sum").alias("_s"))
        met = cut_lineage(open_.join(b, (F.col("tree") == F.col("_t")) & (F.col("above") == F.col("_n"))).select(
            "tree", "node", F.col("_a").alias("above"), (F.col("hops") + F.col("_h")).alias("hops"),
            (F.col("sum") + F.col("_s")).alias("sum")))
        done, open_ = done.unionByName(met.where("above IS NULL")), met.where("above IS NOT NULL")
    ends = done.join(leaves, ["tree", "node"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "node"))
    ends = ends.withColumn("branch", rank)
    if top is not None:
        ends = ends.where(F.col("branch") <= top)
    paths = cut_lineage(ends.select("tree", F.col("node").alias("leaf"), "branch", "node",
                                    (F.col("hops") - 1).alias("depth")))
    for k, step in enumerate(steps):
        b = step.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "above")
        higher = paths.join(b, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n"))).select(
            "tree", "leaf", "branch", F.col("above").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        paths = cut_lineage(paths.unionByName(higher))
    return paths


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, formatted, loss) of every chosen path, from (tree, node, parent, role, text, score)."""
    paths = best_paths(messages, top)
    turns = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    rows = paths.join(turns, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")))
    whole = rows.groupBy("tree", "leaf", "branch").agg(
        F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(batches):
        for b in batches:
            out, masks = [], []
            for turns in b.column("turns").to_pylist():
                text, spans = format_turns((t["role"], t["text"]) for t in turns)
                out.append(text)
                masks.append([{"start": s, "end": e} for s, e in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("tree", "leaf", "branch")], pa.array(out, pa.string()),
                                              pa.array(masks, kind)], names=["tree", "leaf", "branch", "formatted", "loss"])

    return whole.mapInArrow(run, "tree long, leaf long, branch int, formatted string, "
                                 "loss array<struct<start:bigint,end:bigint>>")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, role, text, score, conv_id): each turn replies to the one before it."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = ordered_scan(rows, [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text")], index="node")
    first = rows.groupBy("conv_id").agg(F.min("node").alias("tree")).withColumnRenamed("conv_id", "_c")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")))
    return rows.select("tree", "node", F.when(F.col("node") > F.col("tree"), F.col("node") - 1).alias("parent"),
                       "role", "text", F.lit(1.0).alias("score"), "conv_id")


def digests(conversations: DataFrame) -> DataFrame:
    """Format all conversations, write them, read the files back and digest what was read."""
    messages = cut_lineage(conversation_messages(conversations))
    written = cut_lineage(format_trees(messages))
    names = messages.where("node = tree").select("tree", "conv_id")

    def run(batches):
        for b in batches:
            rows = {"n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
                turns, masked, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in spans:
                    said = unescape(text[span["start"]:span["end"]])
                    masked.update(said.encode())
                    chars += len(said)
                for name, v in zip(rows, (n, turns.hexdigest(), chars, masked.hexdigest(), len(text))):
                    rows[name].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("tree"), *[pa.array(v, k) for v, k in zip(rows.values(), kinds)]],
                                             names=["tree", *rows])

    read = written.select("tree", "formatted", "loss").mapInArrow(
        run, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.join(names, "tree").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                           "formatted_chars")
