"""Reply trees to conversations.

Messages (tree, node, parent, role, text, score) form trees. Paths from leaf to root are found by iterative self-joins with
doubling: rows (leaf, node, distance) start with each leaf at itself; each round joins them with the table of 2**k-th ancestors,
which is then joined with itself, so a path of n messages takes log2(n) rounds. A branch's score is the sum of its messages';
branches are ranked within their tree and the chosen ones are formatted, one conversation each:

    <|im_start|>role\ntext<|im_end|>\n

Inside roles and texts a backslash is put into each ``<|`` (and one more where there are some already), which can be undone;
line ends in roles are escaped. The mask lists where texts of the assistant stand in the result.

Defined results: null roles and texts are empty; a message whose parent is null or missing is a root; cycles belong to no root
and are left out, and so are branches that hang on one; rows that repeat tree and node are one message (the least parent, role
and text, the largest score); ties between branches go to the smaller leaf; an empty table gives no rows. A conversation is one row of the
result by its nature, and so is gathered in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>"
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def formatted(turns: list[tuple[str, str]], masked: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The text of (role, text) turns, and starts and ends of the masked role's texts in it."""
    out, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{role_line(role)}\n", escape(text)
        if role == masked:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), starts, ends


def parsed(conversation: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    return [(role_of(m[1]), unescape(m[2])) for m in _TURN.finditer(conversation)]


def chained(messages: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: each message's parent is the one before it by turn (nulls last; ties by role, then text)."""
    order = W.partitionBy(tree).orderBy(F.col(turn).asc_nulls_last(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    rows = messages.select(F.col(tree).alias("tree"), F.row_number().over(order).cast("long").alias("node"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, back): each leaf's messages up to its root, with their distance from the leaf."""
    keys = nodes.select("tree", "node", "parent")
    parent = keys.select(F.col("tree").alias("t"), F.col("node").alias("p")).distinct()
    # the rows of messages that have an ancestor so many steps up; fewer in each round
    up = keys.join(parent, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p"))).select("tree", "node", F.col("p").alias("up"))
    up = written(up.distinct(), "tree-up")
    parents = up.select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = keys.select("tree", "node").distinct().join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    found = written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")), "tree-paths")
    # a path has no more messages than its tree; what still climbs after that many steps is on a cycle or hangs on one
    most = keys.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    step = 1
    while step < 2 * most and not up.isEmpty():
        jump = up.select(F.col("tree").alias("t"), F.col("node").alias("from"), "up")
        more = found.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("from"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + step).alias("back"))
        found = written(found.unionByName(more), "tree-paths")
        up = written(up.join(jump.withColumnRenamed("up", "next"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("from"))).select("tree", "node", F.col("next").alias("up")), "tree-up")
        step *= 2
    # leaves whose path ends in a root: a message without a parent among the messages
    rooted = keys.join(parent, F.col("tree").eqNullSafe(F.col("t")) & F.col("parent").eqNullSafe(F.col("p")), "left_anti").select(F.col("tree").alias("t"), F.col("node").alias("r"))
    ends = found.join(rooted, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("r"))).select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return found.join(ends, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")


def conversations(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """tree, leaf, rank, score, n_turns, formatted, mask_starts, mask_ends of each tree's ``best`` branches (None: all)."""
    nodes = written(nodes, "tree-nodes")
    along = paths(nodes)
    values = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score")
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    branches = along.join(values.select("t", "n", "score"), same).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.col("score").desc(), F.col("leaf")))
    chosen = branches.withColumn("rank", rank)
    if best is not None:
        chosen = chosen.where(F.col("rank") <= best)
    chosen = chosen.select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "rank", F.col("score").alias("branch"))
    full = along.join(chosen, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl"))).join(values, same)
    whole = full.groupBy("tree", "leaf", "rank", "branch").agg(F.sort_array(F.collect_list(F.struct("back", "role", "text")), asc=False).alias("turns"))
    kind = nodes.schema["tree"].dataType.simpleString()
    names = ["tree", "leaf", "rank", "score", "n_turns", "formatted", "mask_starts", "mask_ends"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4).to_pylist()
            made = [formatted([(t["role"], t["text"]) for t in turns]) for turns in lists]
            cols = [pa.array([len(t) for t in lists], pa.int64()), pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), *cols], names)

    return whole.mapInArrow(write, f"tree {kind}, leaf long, rank int, score double, n_turns long, formatted string, mask_starts array<long>, mask_ends array<long>")


def digests(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a reader finds in formatted conversations: turns, and text under the loss mask."""
    kind = convs.schema["tree"].dataType.simpleString()
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tree, text, starts, ends in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                turns = parsed(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                rows.append((tree, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return convs.select("tree", "formatted", "mask_starts", "mask_ends").mapInArrow(read, f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
