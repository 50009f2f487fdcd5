"""Chat formatting from reply trees.

Messages name their parent. Iterative self-joins double each message's jump to its
ancestors, adding depths and scores, until every jump ends at a root: log2(depth)
joins of light rows. Leaves are ranked by their path's score; the chosen leaves' paths
are marked by going down the same jumps again, and each path is formatted as one
conversation.

Null texts and roles are empty. Messages whose parent isn't there are roots, and so is that
of smallest key on a cycle of replies: the cycle is cut there. Of messages that repeat a key,
replies go to the first in order of parent, role, text and score; the others are leaves of
their own. Linear conversations are keyed by position, which gives repeated rows keys of
their own. Ties in score go to the deeper path, then to the smaller key. Null conversation
ids are one conversation. A conversation is one row, so what a row can hold bounds it. Other
columns are ignored, whatever their names. Empty tables give no row.

Template: ``<|im_start|>role\\n text <|im_end|>\\n``. In texts a backslash is put between
``<`` and ``|``, also where backslashes stand there already, so removing one undoes it;
in roles the backslash and the line end are escaped as well.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.tables import discard, written

START, END = "<|im_start|>", "<|im_end|>\n"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
FORMATTED = "formatted string, spans array<struct<start:long,stop:long>>"
READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans that are under the loss mask: the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again, from the formatted text alone."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        shut = formatted.index(END, line)
        role = unescape(formatted[at + len(START) : line])
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
        turns.append((role, unescape(formatted[line + 1 : shut])))
        at = shut + len(END)
    return turns


def _formatted(turns: pa.Array) -> pa.Array:
    texts, spans = [], []
    for row in turns:
        text, found = format_turns([(t["role"].as_py() or "", t["text"].as_py() or "") for t in row.values])
        texts.append(text)
        spans.append([{"start": a, "stop": b} for a, b in found])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, kind)], ["formatted", "spans"])


def _read_back(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(formatted.to_pylist(), spans.to_pylist(), strict=True):
        turns = parse(text)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in found)
        out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    columns = list(zip(*out, strict=True)) or [()] * 5
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in READ_BACK.split(", ")]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_back(formatted: str, spans: str) -> Column:
    """Figures of the turns and of the masked text, from the output."""
    return F.arrow_udf(_read_back, READ_BACK)(formatted, spans)


def linear(messages: DataFrame) -> DataFrame:
    """Conversations kept as rows by turn are trees without branches, keyed by position."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    keyed = messages.select("conv_id", F.row_number().over(w).cast("long").alias("key"), "role", "text")
    return keyed.select("conv_id", "key", F.when(F.col("key") > 1, F.col("key") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _on(a: str, b: str) -> Column:
    return F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col(a) == F.col(b))


def _jumps(light: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of jumps of 1, 2, 4, ... steps up, as far as any goes; or the messages to cut where some never end."""
    there = light.alias("a").join(light.select("conv_id", "key").alias("b"), _on("a.parent", "b.key"), "left")
    first = there.select("a.conv_id", "a.key", F.col("b.key").alias("up"), F.lit(1).alias("depth"), "a.score", F.when(F.col("b.key").isNull(), F.col("a.key")).alias("root"), F.col("a.key").alias("least"))
    jumps = [written(first, "chat-jumps")]
    most = jumps[0].groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while not jumps[-1].where("up is not null").isEmpty():
        if 1 << (len(jumps) - 1) > most:  # further up than a tree can go: every end is on a cycle
            ends = jumps[-1].where("up is not null").select("conv_id", F.col("up").alias("key")).distinct()
            cut = jumps[-1].alias("a").join(ends.alias("b"), _on("a.key", "b.key"), "left_semi").where("key = least").select("conv_id", "key")
            cut = written(cut, "chat-cuts")
            discard(*jumps)
            return [], cut
        last = jumps[-1]
        # messages whose jump has ended are joined no more
        far = last.where("up is not null").alias("a").join(last.alias("b"), _on("a.up", "b.key"))
        add = lambda c: F.col(f"a.{c}") + F.col(f"b.{c}")
        far = far.select("a.conv_id", "a.key", F.col("b.up").alias("up"), add("depth").alias("depth"), add("score").alias("score"), F.coalesce("a.root", "b.root").alias("root"), F.least("a.least", "b.least").alias("least"))
        jumps.append(written(far.unionAll(last.where("up is null")), "chat-jumps"))
    return jumps, None


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The messages on each tree's best root-to-leaf paths: conv_id, root, leaf, place, role, text."""
    same = Window.partitionBy("conv_id", "key").orderBy("parent", "role", "text", "score")
    numbered = messages.select("conv_id", "key", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), "role", "text").withColumn("again", F.row_number().over(same))
    as_key = lambda key, again: F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), again.alias("again")))
    # a null key is one that no parent names
    own = F.struct(F.col("key").alias("key"), F.col("again").alias("again"))
    nodes = written(numbered.select("conv_id", own.alias("key"), as_key("parent", F.lit(1)).alias("parent"), "score", "role", "text"), "chat-nodes")
    light = nodes.select("conv_id", "key", "parent", "score")
    jumps, cut = _jumps(light)
    if cut is not None:
        marked = light.alias("a").join(cut.withColumn("cut", F.lit(True)).alias("b"), _on("a.key", "b.key"), "left")
        jumps, _ = _jumps(marked.select("a.conv_id", "a.key", F.when(F.col("cut").isNull(), F.col("a.parent")).alias("parent"), "a.score"))
    full = jumps[-1]
    parents = jumps[0].where("up is not null").select("conv_id", "up").distinct()
    leaves = full.alias("a").join(parents.alias("b"), _on("a.key", "b.up"), "left_anti").select("conv_id", "key", "root", "depth", "score")
    rank = F.row_number().over(Window.partitionBy("conv_id", "root").orderBy(F.desc("score"), F.desc("depth"), "key"))
    marked = leaves.withColumn("r", rank).where(F.col("r") <= branches).select("conv_id", "key", F.col("key").alias("leaf"))
    steps = []
    for step in reversed(jumps):
        up = marked.alias("a").join(step.where("up is not null").alias("b"), _on("a.key", "b.key"))
        marked = written(marked.unionAll(up.select("a.conv_id", "b.up", "a.leaf")).distinct(), "chat-paths")
        steps.append(marked)
    place = full.select("conv_id", "key", "root", F.col("depth").alias("place"))
    found = marked.alias("a").join(place.alias("b"), _on("a.key", "b.key")).select("a.conv_id", "a.key", "a.leaf", "b.root", "b.place")
    paths = found.alias("a").join(nodes.alias("b"), _on("a.key", "b.key")).select("a.conv_id", "root.key", "leaf", "place", "role", "text").withColumnRenamed("key", "root")
    discard(*steps[:-1], *jumps[1:-1])
    return paths


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One formatted text per chosen path, with the spans the loss is taken on."""
    paths = best_paths(messages, branches)
    turns = paths.groupBy("conv_id", "root", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    return turns.withColumn("out", F.arrow_udf(_formatted, FORMATTED)("turns")).select("conv_id", "root", "leaf", "out.formatted", "out.spans")
