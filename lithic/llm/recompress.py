"""Substring dedup by recompression.

Rounds rename a document's word sequence: in every third round maximal runs of a
symbol get a name, and in every round adjacent symbols (left, right) of a random
two-colouring of the symbols get a name as a pair.  A name is a fingerprint of
what it stands for, so all tasks give the same run or pair the same name without
a dictionary, and equal substrings get equal symbols inside.  Next to the words
that a symbol covers we keep the words that decided about it (its context): in
any document that has these words the symbol appears.

A window of ``window`` words is known by the highest-level symbol whose context
lies in it, the leftmost one; single words are symbols too, so there always is
one, and equal windows have the same.  So

1. one scan gives each document's symbols and a fingerprint of its words;
   documents with the same words as an earlier one are copies and wait aside;
2. symbols that several documents share reveal where long repeats can be;
3. windows with such a symbol are compared exactly, by 128-bit fingerprints of
   their words: a window goes if a document with a smaller id has it.

No pair of documents is ever formed.  Symbols and windows that very many
documents share are reduced by partial aggregation (smallest id), written, and
joined back in joins that adaptive execution can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, U64, Words, chunks, cut, drop, lean, mix, prefix_hash, span_hash

WINDOW = 50
ROUNDS = 11


# ------------------------------------------------------------------ symbols
class Symbols:
    """The symbols of one level: name, row, and the words [left, right) that decide about each."""

    def __init__(self, name, row, left, right):
        self.name, self.row, self.left, self.right = name, row, left, right

    def _edges(self, first):
        """What stands before and after each symbol: same row, and its context; past a row's end nothing can be known."""
        n = len(self.name)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = self.row[1:] == self.row[:-1]
        after[:-1] = before[1:]
        left, right = first[self.row] - 1, first[self.row + 1] + 1
        left[1:] = np.where(before[1:], self.left[:-1], left[1:])
        right[:-1] = np.where(after[:-1], self.right[1:], right[:-1])
        return before, after, left, right

    def runs(self, first: np.ndarray, level: int) -> Symbols:
        before, _, left, right = self._edges(first)
        same = np.zeros(len(self.name), bool)
        same[1:] = before[1:] & (self.name[1:] == self.name[:-1])
        head = np.flatnonzero(~same)
        last = np.append(head[1:], len(same)) - 1
        n = (last - head + 1).astype(U64)
        name = self.name[head]
        name = np.where(n > 1, mix(name + n * U64(0xA0761D6478BD642F) + U64(level)), name)
        return Symbols(name, self.row[head], left[head], right[last])  # a run ends where the neighbours differ

    def pairs(self, first: np.ndarray, level: int) -> Symbols:
        before, after, left, right = self._edges(first)
        second = (mix(self.name ^ U64(0x9E6C63D0876A9A35 * (level + 1) & (1 << 64) - 1)) & U64(1)).astype(bool)
        pair = np.zeros(len(second), bool)
        pair[:-1] = after[:-1] & ~second[:-1] & second[1:]
        tail = np.zeros(len(second), bool)
        tail[1:] = pair[:-1]
        alone = ~pair & ~tail
        new_left = np.where(alone & second, left, self.left)
        new_right = np.where(alone & ~second, right, self.right)
        new_right[:-1] = np.where(pair[:-1], self.right[1:], new_right[:-1])
        name = self.name.copy()
        at = np.flatnonzero(pair)
        name[at] = mix(name[at] * U64(0xE7037ED1A0B428DB) + self.name[at + 1] * U64(0x8EBC6AF09C88C6E3) + U64(level))
        keep = ~tail
        return Symbols(name[keep], self.row[keep], new_left[keep], new_right[keep])


def anchors(h: np.ndarray, w: Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of the chunk, and the name of the symbol it is known by."""
    n, first = len(h), w.first
    size = np.maximum(w.count - window + 1, 0)
    at = np.repeat(first[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    name, open_ = np.zeros(len(at), U64), np.arange(len(at))
    levels = [Symbols(h, w.row, np.arange(n), np.arange(1, n + 1))]
    for r in range(rounds):
        s = levels[-1]
        if not len(at) or len(s.name) < 2:
            break
        levels.append((s.runs(first, r) if r % 3 == 0 else s).pairs(first, r))
    for level in range(len(levels) - 1, -1, -1):
        if not len(open_):
            break
        s, p = levels[level], at[open_]
        a = np.searchsorted(s.left, p)  # contexts begin and end in the order of the symbols
        found = a < len(s.name)
        found[found] = s.right[a[found]] <= p[found] + window
        name[open_[found]] = mix(s.name[a[found]] + U64(level))
        open_ = open_[~found]
    return at, name


# ------------------------------------------------------------------ scans
def _joined(data: np.ndarray, w: Words, keep: np.ndarray, rows: int) -> list[bytes]:
    """Each row's kept words joined by one space."""
    start, end, row = w.start[keep], w.end[keep], w.row[keep]
    size = end - start + 1  # and a space after it
    out = np.full(int(size.sum()), 32, np.uint8)
    to = np.cumsum(size) - size
    take = np.ones(len(out), bool)
    take[to + size - 1] = False
    # word bytes in order are the bytes of the kept spans in order
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    out[take] = data[np.cumsum(mark[:-1]).astype(bool)]
    ends = np.append(to, len(out))
    cuts = np.searchsorted(row, np.arange(rows + 1))
    raw = out.tobytes()
    return [raw[ends[a] : max(ends[a], ends[b] - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _hex(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(window: int, rounds: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch, "text"):
                w = Words(data, offs, NON_SPACE)
                h = w.hashes(data)
                at, name = anchors(h, w, window, rounds)
                row = w.row[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
                names = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[fresh], np.arange(b - a + 1)), pa.int32()), _signed(name[fresh]))
                sha = [hashlib.sha256(x).digest() for x in _joined(data, w, np.ones(len(w.start), bool), b - a)]
                f1, f2 = (pa.array([int.from_bytes(x[k : k + 8], "big", signed=True) for x in sha], pa.int64()) for k in (0, 8))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(w.count, pa.int64()), pa.array([x.hex() for x in sha]), f1, f2, names],
                    ["doc_id", "n_words", "sha", "f1", "f2", "symbols"],
                )

    return run


def _windows(window: int, rounds: int, column: str):
    """Fingerprints of the windows whose symbol is in the row's list `column`."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            lists = batch.column(k)
            off, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(U64)
            for a, b, data, offs in chunks(batch, "text"):
                w = Words(data, offs, NON_SPACE)
                h = w.hashes(data)
                at, name = anchors(h, w, window, rounds)
                mine = values[off[a] : off[b]]
                owner = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
                # names salted by their row, so one lookup serves the chunk
                wanted = np.sort(mine ^ mix(owner.astype(U64)))
                key = name ^ mix(w.row[at].astype(U64))
                if len(wanted):
                    i = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    at = at[wanted[i] == key]
                else:
                    at = at[:0]
                h1 = span_hash(prefix_hash(h), at, at + window)
                h2 = span_hash(prefix_hash(w.hashes(data, 1), 1), at, at + window, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.row[at] + a)), _signed(h1), _signed(h2)], ["doc_id", "h1", "h2"])

    return run


def _covered(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words under any window that begins at `at`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + window, n), -1)
    return np.cumsum(step[:-1]) > 0


def _removed(batch: pa.RecordBatch, window: int, column: str = "text"):
    """For each chunk of rows with a list `starts` of window fingerprints: rows, bytes, offsets, words and which words go."""
    lists = batch.column(batch.schema.get_field_index("starts"))
    if lists.null_count:
        lists = lists.fill_null(pa.scalar([], lists.type))
    off, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(U64)
    copies = batch.schema.get_field_index("copy")
    for a, b, data, offs in chunks(batch, column):
        w = Words(data, offs, NON_SPACE)
        h1 = span_hash(prefix_hash(w.hashes(data)), np.arange(len(w.start) - window + 1), np.arange(window, len(w.start) + 1)) if len(w.start) >= window else np.zeros(0, U64)
        size = np.maximum(w.count - window + 1, 0)
        at = np.repeat(w.first[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mine = values[off[a] : off[b]]
        owner = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
        wanted = np.sort(mine ^ mix(owner.astype(U64)))
        key = h1[at] ^ mix(w.row[at].astype(U64))
        if len(wanted):
            i = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            at = at[wanted[i] == key]
        else:
            at = at[:0]
        gone = _covered(at, len(w.start), window)
        if copies >= 0:
            copy = np.array(batch.column(copies)[a:b].fill_null(False).to_pylist(), bool)
            gone |= (copy & (w.count >= window))[w.row]
        yield a, b, data, offs, w, gone


# ------------------------------------------------------------------ operator
class Repeats:
    """What `find` has learned: documents without text (`scanned`, with `copy`), texts of possible repeats, and window fingerprints that go."""

    def __init__(self, scanned: DataFrame, texts: DataFrame, starts: DataFrame, window: int):
        self.scanned, self.texts, self.starts, self.window = scanned, texts, starts, window


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> Repeats:
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = cut(docs.mapInArrow(lean(_scan(window, rounds)), "doc_id long, n_words long, sha string, f1 long, f2 long, symbols array<long>"), "scan")
    long_ = raw.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = cut(long_.groupBy("f1", "f2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("f1", "f2", "m"), "copies")
    # copies and the rest: the join is on fingerprints, which a large group of copies shares, so both sides are tables
    scanned = cut(
        raw.join(firsts, ["f1", "f2"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("m"), F.lit(False))).drop("m", "f1", "f2"), "scanned"
    )
    drop(raw, firsts)
    symbols = scanned.where(~F.col("copy") & F.col("doc_id").isNotNull()).select("doc_id", F.explode("symbols").alias("s"))
    shared = cut(symbols.groupBy("s").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("s", "m"), "shared")
    lists = symbols.join(shared, "s").groupBy("doc_id").agg(
        F.collect_set("s").alias("shared"), F.collect_set(F.when(F.col("doc_id") > F.col("m"), F.col("s"))).alias("later")
    )
    texts = cut(docs.join(lists, "doc_id"), "texts")
    kinds = "doc_id long, h1 long, h2 long"
    seen = texts.select("doc_id", "text", "shared").mapInArrow(lean(_windows(window, rounds, "shared")), kinds)
    known = cut(seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("h1", "h2", "m"), "windows")
    later = texts.where(F.size("later") > 0).select("doc_id", "text", "later").mapInArrow(lean(_windows(window, rounds, "later")), kinds)
    starts = cut(later.join(known, ["h1", "h2"]).where("doc_id > m").groupBy("doc_id").agg(F.collect_set("h1").alias("starts")), "starts")
    drop(shared, known)
    return Repeats(scanned, texts, starts, window)


def digest(documents: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (the kept words joined by one space) of every document row.

    A word goes if it lies under a window whose words also begin in a document
    with a smaller id.  A null text has no words; a document of fewer words
    than a window keeps all.  Repeated rows with one id never remove each
    other's words; rows with a null id keep all and remove nothing elsewhere.
    """
    r = find(documents, **kw)
    window = r.window

    def run(batches):
        for batch in batches:
            for a, b, data, _, w, gone in _removed(batch, window):
                n = np.bincount(w.row[gone], minlength=b - a)
                sha = [_hex(x) for x in _joined(data, w, ~gone, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(w.count, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    cut_ = r.texts.select("doc_id", "text").join(r.starts, "doc_id").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    plain = r.scanned.join(r.starts.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return plain.unionByName(cut_)


def remove(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """documents with repeated words cut out of their texts, together with the space after them; other columns as they are, whatever their names.

    Null and empty texts stay; repeated rows of one id do not cut each other; rows
    with a null id stay whole and cut nothing elsewhere; an empty table stays empty.
    """
    r = find(documents, id_col=id_col, text_col=text_col, window=window, rounds=rounds)
    # one row an id; a copy's rows are told from other rows of its id by their words
    copies = r.scanned.where("copy").select("doc_id", F.lit(True).alias("copy")).distinct()
    marks = r.starts.join(copies, "doc_id", "full")
    schema, k = documents.schema, documents.schema.names.index(text_col)
    plain = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)])
    packed = plain.join(marks, F.col(f"c{documents.columns.index(id_col)}").cast("long") == F.col("doc_id"), "left").drop("doc_id")

    def run(batches):
        for batch in batches:
            for a, b, data, offs, w, gone in _removed(batch, window, f"c{k}"):
                raw, texts = data.tobytes(), None
                for row in np.unique(w.row[gone]).tolist():
                    lo, hi = int(w.first[row]), int(w.first[row + 1])
                    g = np.concatenate([[False], gone[lo:hi], [False]])
                    begin, end = np.flatnonzero(g[1:-1] & ~g[:-2]), np.flatnonzero(g[1:-1] & ~g[2:]) + 1
                    kept, at = [], int(offs[row])
                    for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                        last = lo + y == hi  # nothing is kept after: the space before goes instead
                        kept.append(raw[at : (int(w.end[lo + x - 1]) if x else int(offs[row])) if last else int(w.start[lo + x])])
                        at = int(offs[row + 1]) if last else int(w.start[lo + y])
                    texts = texts or batch.column(k)[a:b].to_pylist()
                    texts[row] = b"".join([*kept, raw[at : int(offs[row + 1])]]).decode()
                columns = [pa.array(texts, batch.schema.field(k).type) if i == k and texts else batch.column(i)[a:b] for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return packed.mapInArrow(lean(run), schema)
