"""Prefix trie of conversations: which openings they share, how often, and how much text sharing saves.

A conversation is the sequence of its turn ids (128 bits of the SHA-256 of role and text) with the size of each text. The
sequences are sorted over range partitions; each task takes them in chunks of bounded size. A chunk is a matrix of dense turn ids padded to its
longest row: numpy's lexsort orders it, the cells that differ from the row above, OR-accumulated along the columns, mark where a node of each depth starts, and
`reduceat` over these starts aggregates all nodes of a depth at once.

Every figure is a sum over a node's members, given how many turns each shares with the row before it and the row after it: a row opens the nodes
deeper than it shares with the row before, ends in a leaf if the row after doesn't continue it, and saves the text of the turns it shares. So only the
nodes on the path of a chunk's first and last row can reach into other chunks. Those are kept as partial nodes; what a first row shares with
the chunk before follows from the partial nodes both hold, the same for a last row's successor, and partial nodes with one key are added up.
Copies of one conversation are told apart by their id in the sort, so they fill many chunks and meet again as sums.

Cases: null roles and texts are empty; turns are ordered with null first, turns of one number by role, then by the digest of role and text; repeated rows are
repeated turns; rows without a conversation id are left out; a conversation without turns is a member of the root; an empty table gives no
rows, not even a root; long texts are only ever digested and counted; a conversation's digests (20 bytes a turn) have to fit one row, and so do the ids that end in
one node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .arrays import flat

#: Cells of one chunk's matrix, and rows.
CELLS, ROWS = 1 << 21, 1 << 16
PARTS = ("shard long, key binary, parent_key binary, parent_conv long, depth long, conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
         "first boolean, last boolean, before long, through long, last_size long")


def turns(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turns): per conversation its turns in order, each as (turn, role, id, chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    one = F.struct(F.col(turn).alias("turn"), role.alias("role"), digest.alias("id"), F.length(text).alias("chars"))
    return rows.where(F.col(conversation).isNotNull()).groupBy(F.col(conversation).alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def regrafted(conversations: DataFrame, block: int, borrowed: Column) -> DataFrame:
    """The first `borrowed` turns of the conversation whose id is the block's smallest multiple, then the own turns after that many.

    `borrowed`, a column on `conv`, is below `block`; at most `block` conversations join one head, so no head is a hot key.
    """
    own = conversations.withColumn("head", F.col("conv") - F.col("conv") % block).withColumn("count", borrowed.cast("int"))
    heads = conversations.where(F.col("conv") % block == 0).select(F.col("conv").alias("head"), F.slice("turns", 1, block).alias("lent"))
    lent = F.slice(F.coalesce("lent", F.slice("turns", 1, 0)), F.lit(1), F.col("count"))
    kept = F.slice("turns", F.col("count") + 1, F.greatest(F.size("turns") - F.col("count"), F.lit(0)))
    return own.join(heads, "head", "left").select("conv", F.concat(lent, kept).alias("turns"))


def _path(ids: np.ndarray) -> list[bytes]:
    """Keys of the nodes on a row's path, from the root."""
    digest, keys = hashlib.sha256(), [hashlib.sha256().digest()[:16]]
    for one in ids:
        digest.update(one)
        keys.append(digest.digest()[:16])
    return keys


def chunk_nodes(shard: int, conv: np.ndarray, sizes: np.ndarray, ids: np.ndarray, chars: np.ndarray) -> list[list]:
    """Columns of PARTS for one chunk: `ids` (n x 16 bytes) and `chars` hold the turns of all rows, `sizes` of them per row."""
    rows, width = len(conv), int(sizes.max())
    matrix, lengths = np.zeros((rows, width), np.int32), np.zeros((rows, width), np.int64)
    cells = np.arange(width) < sizes[:, None]
    names = ids.reshape(-1, 16).view("S16").ravel() if len(ids) else np.zeros(0, "S16")
    distinct, dense = np.unique(names, return_inverse=True)
    matrix[cells], lengths[cells] = dense + 1, chars
    order = np.lexsort((conv, *matrix.T[::-1]))
    matrix, lengths, conv, sizes = matrix[order], lengths[order], conv[order], sizes[order]

    changed = np.ones((rows, width), bool)
    changed[1:] = matrix[1:] != matrix[:-1]
    starts = np.logical_or.accumulate(changed, axis=1)
    shared = np.minimum((~starts).sum(axis=1), sizes)
    leaf = (np.append(shared[1:], -1) < sizes).astype(np.int64)
    saves = (lengths * (np.arange(width) < shared[:, None])).sum(axis=1)

    def path(row: int) -> list[bytes]:
        return _path([distinct[i - 1].ljust(16, b"\0") for i in matrix[row, :sizes[row]].tolist()])

    opens = shared < sizes
    opens[0] = True
    ends_at = np.flatnonzero(opens)
    ends = {a: ",".join(map(str, conv[a:b].tolist())) for a, b in zip(ends_at.tolist(), [*ends_at[1:].tolist(), rows])}
    heads, tails = path(0), path(rows - 1)
    columns: list[list] = [[] for _ in PARTS.split(",")]
    before = np.zeros(rows, np.int64)
    upper = upper_convs = None
    for depth in range(width + 1):
        at = np.flatnonzero(starts[:, depth - 1]) if depth else np.zeros(1, np.int64)
        through = before + lengths[:, depth - 1] if depth else before
        smallest = np.minimum.reduceat(conv, at)
        opened = (starts[:, depth] & (sizes > depth)).astype(np.int64) if depth < width else np.zeros(rows, np.int64)
        figures = [smallest, np.diff(np.append(at, rows)), np.add.reduceat(opened, at), np.add.reduceat(leaf, at),
                   np.add.reduceat(np.where(shared >= depth, saves - before, 0), at)]
        present = np.flatnonzero(sizes[at] >= depth)
        parent = np.searchsorted(upper, at, "right") - 1 if depth else np.zeros(1, np.int64)
        for node in present.tolist():
            head, tail, up, start = node == 0, node == len(at) - 1, int(parent[node]), int(at[node])
            inner_parent = depth > 0 and 0 < up < len(upper) - 1
            row = [shard, (heads if head else tails)[depth] if head or tail else None,
                   None if inner_parent or not depth else (heads if up == 0 else tails)[depth - 1], int(upper_convs[up]) if inner_parent else None, depth,
                   *[int(f[node]) for f in figures], ends[start] if sizes[start] == depth else None, head, tail,
                   int(before[0]), int(through[0]), int(sizes[-1])]
            for column, value in zip(columns, row):
                column.append(value)
        upper, upper_convs, before = at, smallest, through
    return columns


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points here), ends.

    `conversations` has (conv, turns) as `turns` makes it; `ends` lists the ids that end in the node, ascending, comma-joined.
    """
    rows = conversations.select("conv", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))
    ordered = rows.repartitionByRange("ids", "conv").sortWithinPartitions("ids", "conv")
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        count = widest = 0

        def close() -> pa.RecordBatch:
            nonlocal made, held, count, widest
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids, sizes = whole.column(1), whole.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            columns = chunk_nodes(first + made, whole.column(0).to_numpy(), sizes, flat(ids.flatten())[0], whole.column(2).flatten().to_numpy(zero_copy_only=False))
            made, held, count, widest = made + 1, [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            sizes, low = batch.column(1).value_lengths().to_pylist(), 0
            for row, size in enumerate(sizes):
                if count and (count + 1) * max(widest, size) > CELLS or count == ROWS:
                    if row > low:
                        held.append(batch.slice(low, row - low))
                    low = row
                    yield close()
                count, widest = count + 1, max(widest, size)
            if low < len(sizes):
                held.append(batch.slice(low))
        if count:
            yield close()

    parts = cut_lineage(ordered.mapInArrow(run, PARTS))
    by_key, by_shard = Window.partitionBy("key"), Window.partitionBy("shard")
    border = (parts.where("key is not null").withColumn("lo", F.min("shard").over(by_key)).withColumn("hi", F.max("shard").over(by_key))
              .withColumn("common", F.max(F.when(F.expr("first and lo < shard"), F.col("depth"))).over(by_shard))
              .withColumn("common_chars", F.max(F.when(F.expr("first and lo < shard"), F.col("through"))).over(by_shard))
              .withColumn("continued", F.max(F.expr("last and depth = last_size and hi > shard")).over(by_shard)))
    added = border.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - F.when(F.expr("first and depth < common"), 1).otherwise(0)).alias("n_children"),
        F.sum(F.col("n_leaves") - F.when(F.expr("last and continued"), 1).otherwise(0)).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.when(F.expr("first and depth <= common"), F.expr("common_chars - before")).otherwise(0)).alias("saved_tokens"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.expr("if(ends is null, null, struct(shard, ends))"))), lambda s: s["ends"]), ",").alias("ends"))
    added = cut_lineage(added)
    figures = ["parent_key", "parent_conv", "depth", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    nodes = parts.where("key is null").select(figures).union(added.withColumn("parent_conv", F.lit(None).cast("long")).select(figures))
    parents = added.select(F.col("key").alias("parent_key"), F.col("conv").alias("border_parent"))
    return nodes.join(parents, "parent_key", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("parent_conv", "border_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends", F.lit("")).alias("ends"))
