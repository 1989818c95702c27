"""Chat formatting as a prefix tree: turns that conversations share at their beginning are emitted once.

A node is a turn together with all turns before it. Nodes stand in depth-first order, so every subtree is
an interval of the output. Each node carries its token ids, the position id of its first token (the tokens of
its ancestors), the place of its first token in the output, and the intervals of the output that hold its
ancestors: a token attends to those and to the earlier tokens of its own node.

The order comes from the sorted paths (sequences of node digests) of the distinct conversations: a node belongs to the
first path that holds it, and nodes are ordered by path and depth. Paths are dealt out by range, identical
conversations are one path, and where paths meet their nodes' facts, a first turn that a third of them share is dealt out
over many tasks.

A turn is written `<|im_start|>role\\n` text `<|im_end|>\\n`. Backslashes and the opening `<|` of control strings inside roles and
texts (and line feeds inside roles) are escaped by a backslash, reversibly. Head, body and foot are encoded apart, so the loss
mask, the body of each assistant turn, is a run of whole tokens.

Nulls: a null text or role is empty; rows with a null conv_id form one conversation of that id; a null turn comes
first. Rows of one turn are ordered by role and text, repeated rows are repeated turns; an empty table gives
an empty output; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bpe_codec import codec, default_ranks
from lectern.llm.common import arrow_map, join_facts, materialise

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def parse_turn(formatted: str) -> tuple[str, str]:
    head, _, rest = formatted.partition("\n")
    if not head.startswith(START) or not rest.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    return unescape(head[len(START) :]), unescape(rest[: -len(END) - 1])


def paths_of(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests of its nodes), roles and texts by turn."""
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return whole.selectExpr(
        "conv_id",
        "transform(turns, t -> t.role) AS roles",
        "transform(turns, t -> t.text) AS texts",
        # a node's digest covers the parent's and, with its length, the role: no two sequences are confused
        "aggregate(turns, cast(array() AS array<string>), (done, t) -> array_append(done, substring(sha2(concat("
        "coalesce(try_element_at(done, -1), ''), '|', char_length(t.role), '|', t.role, '|', t.text), 256), 1, 32))) AS path",
    )


NODES = "node string, head_tokens int, body_tokens int, ids binary"


def tree(conversations: DataFrame, ranks_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The output's nodes, and conv_id with its path.

    Nodes: node, parent, depth, role, offset, position, tokens, ids (unsigned 16-bit), loss_start and loss_end (places in ids),
    ancestors (array of start, end; neighbouring intervals are merged), paths (distinct conversations that hold the node), tree (digest of
    the first turn).
    """
    ranks, pattern = ranks_path or default_ranks()[0], default_ranks()[1]
    convs = materialise(paths_of(conversations), "paths")
    # one row for each distinct conversation, in depth-first order
    distinct = convs.groupBy(F.array_join("path", "").alias("sort")).agg(F.first("path").alias("path"), F.first("roles").alias("roles"), F.first("texts").alias("texts"))
    ordered = materialise(distinct.repartitionByRange("sort").sortWithinPartitions("sort").withColumn("rank", F.monotonically_increasing_id()), "ordered")
    each = ordered.select("rank", F.posexplode(F.arrays_zip("path", "roles", "texts"))).select("rank", F.col("pos").alias("depth"), F.col("col.path").alias("node"), F.col("col.roles").alias("role"), F.col("col.texts").alias("text"))
    parent = each.groupBy("node").agg(F.min("rank").alias("first"), F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("paths"))
    nodes = materialise(parent, "nodes")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks, pattern)
        made = [[c.encode(x) for x in format_turn(r, t)] for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(m[0]) for m in made], pa.int32()),
                pa.array([len(m[1]) for m in made], pa.int32()),
                pa.array([np.asarray(m[0] + m[1] + m[2], "<u2").tobytes() for m in made], pa.binary()),
            ],
            names=["node", "head_tokens", "body_tokens", "ids"],
        )

    tokens = materialise(arrow_map(nodes.select("node", "role", "text"), run, NODES).withColumn("tokens", (F.length("ids") / 2).cast("long")), "node-tokens")
    placed = nodes.join(tokens.select("node", "tokens"), "node").select("node", "first", "depth", "tokens", "paths", F.shiftright("first", 33).alias("part"))
    parts = placed.groupBy("part").agg(F.sum("tokens").alias("all"))
    below = F.coalesce(F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("part", below.alias("base"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("first", "depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = materialise(placed.withColumn("inside", inside).join(bases, "part").select("node", "first", "tokens", (F.col("base") + F.col("inside")).alias("offset"), "paths"), "located")
    # ancestors along each path, for the nodes that the path emits
    along = join_facts(each.select("rank", "depth", "node"), located, "node", "paths", located.agg(F.coalesce(F.sum("paths"), F.lit(0))).first()[0], ["rank"])
    gathered = along.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "first", "offset", "tokens"))).alias("nodes"))
    emitted = gathered.selectExpr("rank", "nodes", "posexplode(nodes) AS (at, n)").filter("n.first = rank").selectExpr(
        "n.node AS node",
        "at AS depth",
        "n.offset AS offset",
        "n.tokens AS tokens",
        "nodes[0].node AS tree",
        "CASE WHEN at > 0 THEN nodes[at - 1].node END AS parent",
        "aggregate(slice(nodes, 1, at), 0L, (s, x) -> s + x.tokens) AS position",
        "aggregate(slice(nodes, 1, at), cast(array() AS array<struct<start:bigint,end:bigint>>), (done, x) -> "
        "CASE WHEN size(done) > 0 AND try_element_at(done, -1).end = x.offset "
        "THEN array_append(slice(done, 1, size(done) - 1), struct(try_element_at(done, -1).start AS start, x.offset + x.tokens AS end)) "
        "ELSE array_append(done, struct(x.offset AS start, x.offset + x.tokens AS end)) END) AS ancestors",
    )
    out = emitted.join(nodes.select("node", "role", "paths"), "node").join(tokens.drop("tokens"), "node")
    loss = F.col("role") == LOSS_ROLE
    out = out.select(
        "node", "parent", "tree", "depth", "role", "offset", "position", "tokens", "ids", "ancestors", "paths",
        F.when(loss, F.col("head_tokens")).alias("loss_start"),
        F.when(loss, F.col("head_tokens") + F.col("body_tokens")).alias("loss_end"),
    )
    return materialise(out, "tree"), convs.select("conv_id", "path")


def read_back(nodes: DataFrame, convs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Every conversation decoded from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ranks, pattern = ranks_path or default_ranks()[0], default_ranks()[1]
    keyed = convs.select("conv_id", "path", F.array_join("path", "").alias("sort"))
    same = materialise(keyed.groupBy("sort").agg(F.first("path").alias("path"), F.count("*").alias("n")), "same")
    steps = same.select("sort", F.posexplode("path").alias("depth", "node"))
    # parts of a hot node repeat its ids, whatever their length, at most HOT times in all
    total = nodes.agg(F.coalesce(F.sum("paths"), F.lit(0))).first()[0]
    whole = join_facts(steps, nodes.select("node", "ids", "loss_start", "loss_end", "paths"), "node", "paths", total, ["sort"]).groupBy("sort").agg(F.array_sort(F.collect_list(F.struct("depth", "ids", "loss_start", "loss_end"))).alias("nodes"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, rows = codec(ranks, pattern), []
        for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            all_turns, loss, lost, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for n in path:
                ids = np.frombuffer(n["ids"], "<u2").tolist()
                formatted = c.decode(ids).decode("utf-8")
                role, text = parse_turn(formatted)
                all_turns.update(f"{role}\n{text}\n".encode())
                chars += len(formatted)
                if n["loss_start"] is not None:
                    masked = unescape(c.decode(ids[n["loss_start"] : n["loss_end"]]).decode("utf-8"))
                    loss.update(masked.encode())
                    lost += len(masked)
            rows.append((key, len(path), all_turns.hexdigest(), lost, loss.hexdigest(), chars))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sort", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    digests = arrow_map(whole, run, "sort string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    facts = materialise(digests.join(same.select("sort", "n"), "sort"), "read-back")
    return join_facts(keyed.select("conv_id", "sort"), facts, "sort", "n", convs.count(), ["conv_id"]).drop("sort")
