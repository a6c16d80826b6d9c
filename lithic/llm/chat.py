"""Chat formatting from reply trees.

Messages name their parent.  Iterative self-joins by pointer doubling give each
message its ancestors 1, 2, 4, ... steps up together with the sum of scores on
the way, so a tree of depth d needs log2(d) rounds and a row never holds a path.
Leaves are ranked by the mean score of their branch; the chosen leaves then
walk up by the same jumps, largest first, which enumerates the messages of each
chosen root-to-leaf path with their depth.  A path is formatted as one
conversation.

The template writes <|im_start|>role, a newline, the text and <|im_end|> with a
newline for each message.  Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``; a newline in a role becomes ``\\n``.  So control strings in
a text never open or close a turn, and `parse` gives back exactly what went in.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop, together

START, END = "<|im_start|>", "<|im_end|>\n"


# ------------------------------------------------------------------ template
def escape_text(text):
    """Column expression: reversible, and without any ``<|`` in its result."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role):
    return F.replace(escape_text(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out += [text[at:k], {"n": "\n"}.get(text[k + 1], text[k + 1])]
        at = k + 2
    return "".join([*out, text[at:]])


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def masked_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    """The text under the loss mask, unescaped: spans are (start, length) in code points."""
    return "".join(unescape(formatted[a : a + n]) for a, n in spans)


# ------------------------------------------------------------------ trees
def ranked_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """Messages (key, id, parent, score; ids unique within a key, as `format_trees` makes them) on the `paths` best branches of each key.

    Gives key, leaf, branch_rank (from 1), id and depth (0 at the root).  A
    message whose parent is missing is a root; a branch's score is the mean of
    its messages' scores (null counts as 0), ties go to the longer branch and
    then to the smaller leaf.  Messages on a parent cycle lie on no
    root-to-leaf path and are left out.
    """
    m = messages.select("key", "id", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    known = m.select("key", F.col("id").alias("parent"), F.lit(True).alias("found"))
    first = m.join(known, ["key", "parent"], "left").select("key", "id", F.when(F.col("found"), F.col("parent")).alias("up"), "score")
    # up: the ancestor 2**k steps above; steps and total: of the way to it, this message included, or of the whole way to the
    # root once there is no such ancestor. Messages that have reached their root stay in the table of that round and are joined
    # no more; the tables of all rounds are read as one, so that plans do not grow with the rounds.
    tables = [cut(first.withColumn("steps", F.lit(1).cast("long")).withColumnRenamed("score", "total"), "jump")]
    count, climbing = tables[0].count(), lambda t: t.where(F.col("up").isNotNull())
    while climbing(tables[-1]).limit(1).count() and 2 ** (len(tables) - 1) <= 2 * count:  # beyond that only cycles are left
        high = tables[-1]
        if len(tables) > 1:
            high = climbing(high).unionByName(_done(tables))
        high = high.select("key", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        tables.append(cut(climbing(tables[-1]).join(high, ["key", "up"], "left").select(
            "key", "id", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
        ), "jump"))
    leaves = _done(tables).join(climbing(tables[0]).select("key", F.col("up").alias("id")).distinct(), ["key", "id"], "left_anti")
    w = Window.partitionBy("key").orderBy((F.col("total") / F.col("steps")).desc(), F.col("steps").desc(), "id")
    # leaves of a key are cut to `paths` within each of 32 parts first, so one large tree does not meet in one task
    part = Window.partitionBy("key", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy((F.col("total") / F.col("steps")).desc(), F.col("steps").desc(), "id")
    best = leaves.withColumn("r", F.row_number().over(part)).where(F.col("r") <= paths).withColumn("branch_rank", F.row_number().over(w)).where(F.col("branch_rank") <= paths)
    path = cut(best.select("key", F.col("id").alias("leaf"), "branch_rank", "id", (F.col("steps") - 1).alias("depth")), "path")
    for k in range(len(tables) - 2, -1, -1):  # the largest jump first: each round doubles what is known of a path
        jump = climbing(tables[k]).select("key", "id", "up")
        more = path.join(jump, ["key", "id"]).select("key", "leaf", "branch_rank", F.col("up").alias("id"), (F.col("depth") - 2**k).alias("depth"))
        longer = cut(path.unionByName(more), "path")
        drop(path)
        path = longer
    drop(*tables)
    return path


def _done(tables: list[DataFrame]) -> DataFrame:
    """The messages of the jump tables that have reached their root, in one scan."""
    return together(tables).where(F.col("up").isNull())


def formatted(messages: DataFrame, path: DataFrame) -> DataFrame:
    """One conversation for each (key, leaf): formatted text and loss spans (start, length in code points of assistant texts).

    Null roles and texts are empty; the turns stand by depth; other columns of messages are not looked at.
    """
    rows = path.join(messages.select("key", "id", "role", "text"), ["key", "id"])
    turn = F.struct("depth", escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape_text(F.coalesce("text", F.lit(""))).alias("text"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"))
    turns = rows.groupBy("key", "leaf", "branch_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    head, tail = len(START) + 1, len(END)

    def step(acc, t):
        begin = acc["at"] + F.length(t["role"]) + head
        span = F.array(F.struct(begin.alias("start"), F.length(t["text"]).cast("long").alias("length")))
        return F.struct((begin + F.length(t["text"]) + tail).cast("long").alias("at"), F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    return turns.select("key", "leaf", "branch_rank", text.alias("formatted"), F.aggregate("turns", zero, step, lambda a: a["spans"]).alias("loss_spans"))


def format_trees(messages: DataFrame, paths: int = 1, *, unique: bool = False) -> DataFrame:
    """The best `paths` branches of each reply tree (key, id, parent, score, role, text), each as one formatted conversation.

    Null keys are no trees; of repeated ids within a key one is taken (the first by parent, role and text); ties and
    cycles as in `ranked_paths`.  unique: ids are known to be so, which spares an aggregation.  An empty table gives none; other columns are not looked at.
    """
    names = ("key", "id", "parent", "score", "role", "text")
    messages = messages.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    if not unique:
        messages = messages.groupBy("key", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("r")).select("key", "id", "r.*")
    messages = cut(messages.select(*names), "messages")
    return formatted(messages, ranked_paths(messages, paths))


# ------------------------------------------------------------------ conversations
def linear_messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations whose turns follow each other, as reply trees of one branch: key, id, parent, score, role, text.

    Rows stand by turn (null first); rows of equal turn by role and text, and
    repeated rows are each a turn.  Null roles and texts are empty.  A null
    conversation id is a conversation of its own.  An empty table gives none.

    The order is one range sort of all rows, not a window for each conversation:
    a conversation may lie in many partitions.  Ids are the rows' numbers in it.
    """
    key = F.when(F.col("conv").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "conv"))
    rows = conversations.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(key.alias("key"), "turn", "role", "text").repartitionByRange("key", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("key", "turn", "role", "text")
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()).drop("turn"), "turns")  # ids are consecutive within a partition
    first = rows.groupBy("key").agg(F.min("id").alias("first"))
    # the first row of a partition follows the last one of the partition before: one row a partition
    ends = rows.groupBy(F.shiftright("id", 33).alias("part")).agg(F.min("id").alias("id"), F.max("id").alias("last"))
    before = ends.select("id", F.lag("last").over(Window.orderBy("part")).alias("before"))
    joined = rows.join(first, "key").join(F.broadcast(before), "id", "left")
    return joined.select("key", "id", F.when(F.col("id") > F.col("first"), F.coalesce("before", F.col("id") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(conversations: DataFrame) -> DataFrame:
    """key and digests of what formatted conversations hold, from their text and loss spans alone."""

    def run(batches):
        for batch in (piece for whole in batches for piece in _small(whole)):
            out = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"])
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = masked_text(r["formatted"], [(s["start"], s["length"]) for s in r["loss_spans"]])
                out.append((r["key"], len(turns), _hex(whole), len(loss), _hex(loss), len(r["formatted"])))
            names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return conversations.select("key", "formatted", "loss_spans").mapInArrow(
        run, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _small(batch: pa.RecordBatch, rows: int = 64):
    return (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
