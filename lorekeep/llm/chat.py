"""Reply trees formatted as conversations.

Messages form trees: each names its parent. Root-to-leaf paths are found by self-joins whose reach doubles: a leaf that knows
its ancestors at distances below 2**k gets those below 2**(k+1) from the jump table of 2**k steps, so a chain of n messages
takes about log2(n) joins of ids; texts join once at the end. The branches of a conversation are ranked by the sum of their messages'
scores, longer ones first among equals, and the best ones are formatted.

The template writes every turn as `<|turn|>role`, line feed, text, `<|end|>`, line feed. Wherever a control string starts inside a role
or text, a backslash follows its first character, and backslashes are doubled, so texts can't open or close turns and are
read back unchanged. The loss mask lists the spans (code points of the formatted text) of the assistant's texts.

Cases: null roles and texts are empty; a message whose parent is missing starts a tree; messages that are their own ancestors are on no path and left
out; equal scores and lengths go to the smaller leaf; conversations without messages don't occur; rows of a flat
conversation are ordered by turn, then role and text, and repeated rows are repeated turns; rows without a conversation id
are one conversation without an id; a conversation becomes one row and has to fit one; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, is_empty

TURN, END = "<|turn|>", "<|end|>"
#: Strings that steer chat models: the template's own and those of common templates.
CONTROL = [TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>",
           "<|start_header_id|>", "<|end_header_id|>", "<unk>", "<pad>", "<bos>", "<eos>"]
_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _STARTS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def chain(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Flat conversations as trees of one branch: (conv, node, parent, score, role, text)."""
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(turn, "role", "text")).cast("long")
    return (rows.select(F.col(conversation).alias("conv"), place.alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0)))


def branches(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, distance): the messages of every root-to-leaf path with their distance from the leaf."""
    links = messages.select("conv", "node", "parent")
    known = links.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    with_parent = links.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n")), "left")
    links = cut_lineage(with_parent.select("conv", "node", F.col("n").alias("parent")))
    parents = links.where("parent is not null").select(F.col("conv").alias("c"), F.col("parent").alias("n")).distinct()
    leaves = links.join(parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
    paths = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    jumps = links.where("parent is not null").select("conv", "node", F.col("parent").alias("to"))
    step, most = 1, max(1, links.count())
    while step <= most and not is_empty(jumps):
        by = jumps.select(F.col("conv").alias("c"), F.col("node").alias("n"), "to")
        same = F.col("conv").eqNullSafe(F.col("c"))
        further = paths.join(by, same & (F.col("node") == F.col("n"))).select("conv", "leaf", F.col("to").alias("node"), (F.col("distance") + step).alias("distance"))
        paths = cut_lineage(paths.union(further))
        twice = jumps.select("conv", "node", F.col("to").alias("via")).join(by, same & (F.col("via") == F.col("n")))
        jumps = cut_lineage(twice.select("conv", "node", "to"))
        step *= 2
    roots = links.where("parent is null").select(F.col("conv").alias("c"), F.col("node").alias("n"))
    rooted = paths.join(roots, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select(F.col("conv").alias("c"), F.col("leaf").alias("l"))
    return paths.join(rooted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("l"))).drop("c", "l")


def best_branches(messages: DataFrame, paths: DataFrame, keep: int = 1) -> DataFrame:
    """The rows of the `keep` best branches of each conversation, with `branch`, the branch's rank from 1."""
    scored = paths.join(messages.select(F.col("conv").alias("c"), F.col("node").alias("n"), "score"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    ranked = scored.groupBy("conv", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("turns"), "leaf"))
    chosen = ranked.withColumn("branch", rank).where(F.col("branch") <= keep).select(F.col("conv").alias("c"), F.col("leaf").alias("l"), "branch")
    return paths.join(chosen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("l"))).drop("c", "l")


def formatted(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(conv, branch, formatted, loss): one conversation per chosen branch; `loss` holds (start, end) spans of `formatted`."""
    messages = cut_lineage(messages)
    chosen = best_branches(messages, branches(messages), keep)
    said = messages.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text")
    turns = chosen.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    gathered = turns.groupBy("conv", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = [], []
            for turns in batch.column(2).to_pylist():
                out, at, spans = [], 0, []
                for turn in turns:
                    head = f"{TURN}{escape(turn['role']).replace('\n', '\\\n')}\n"
                    body = escape(turn["text"])
                    if turn["role"] == "assistant":
                        spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
                    out += [head, body, END, "\n"]
                    at += len(head) + len(body) + len(END) + 1
                texts.append("".join(out))
                masks.append(spans)
            mask = pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), mask], ["conv", "branch", "formatted", "loss"])

    kind = messages.schema["conv"].dataType.simpleString()
    return gathered.select("conv", "branch", "turns").mapInArrow(run, f"conv {kind}, branch int, formatted string, loss array<struct<start:long,end:long>>")


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv, branch, turns, loss_text, formatted_chars): what `formatted` wrote, parsed from the text and its mask alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses, sizes = [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turns.append([{"role": unescape(m.group(1)), "text": unescape(m.group(2))} for m in _TURN.finditer(text)])
                losses.append("".join(unescape(text[s["start"]:s["end"]]) for s in spans))
                sizes.append(len(text))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, kind), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())],
                                             ["conv", "branch", "turns", "loss_text", "formatted_chars"])

    kind = conversations.schema["conv"].dataType.simpleString()
    return conversations.select("conv", "branch", "formatted", "loss").mapInArrow(
        run, f"conv {kind}, branch int, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")
