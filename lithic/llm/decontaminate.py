"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of one task's documents.  Its words are numbered by
the vocabulary of the benchmark phrases; any other word can stand in no match
and becomes a separator, so stretches of other words shrink to one symbol.  On
the shard's word sequence stands an FM-index: suffix order (found by prefix
doubling, suffixes ending at their separator), Burrows-Wheeler transform,
a wavelet matrix for ranks, and every ``sample``-th suffix position.  All
phrases are searched backward at once, occurrences are located by LF steps to
the next sampled position, and the hit spans of a document are merged.

Phrases are the stated query set: they are collected and broadcast in blocks of
at most about ``block_bytes`` of text, as word numbers and where each phrase
begins, about three bytes for each byte of text.  Up to ``wave_blocks`` blocks
are searched in one scan: a shard is indexed once and all of them go past its
index, and the documents are neither shuffled nor written.  A benchmark beyond
one such wave has the documents written once, with row numbers; every further
wave is one scan that returns only the numbers, spans and items of rows that are
hit, and these are joined back by number.  Rows are never told apart by an id,
and results are the same for any size of blocks and waves.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import ALNUM, LOWER, Words, chunks, cut, lean, unused

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
WAVE = 16


# ------------------------------------------------------------------ phrases
class Phrases:
    """Distinct phrases of a block of items, each a stretch of the items' words, and the items of each.

    A phrase is a window of `window` words of an item; an item of fewer words, but
    not none, is one phrase.  Words go by their hash; `words` holds numbers into `hash`.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        raw = [(text or "").encode() for _, text in items]
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        w = Words(data, np.cumsum([0, *map(len, raw)]), ALNUM)
        self.hash, number = np.unique(w.hashes(data), return_inverse=True)
        self.words = number.astype(np.int32)
        times = np.where(w.count > 0, np.maximum(w.count - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), times)
        begin = np.repeat(w.first[:-1] - np.cumsum(times) + times, times) + np.arange(len(item))
        length = np.minimum(w.count, window)[item]
        place = np.arange(window)
        shown = np.where(place < length[:, None], self.words[np.minimum(begin[:, None] + place, max(len(self.words) - 1, 0))], -1) if len(item) else np.zeros((0, window), np.int64)
        keys = np.ascontiguousarray(shown.astype(np.int32)).view(np.dtype((np.void, 4 * window))).ravel()
        _, one, same = np.unique(keys, return_index=True, return_inverse=True)
        self.begin, self.length = begin[one].astype(np.int32), length[one].astype(np.int32)
        self.names = [None if i is None else str(i) for i, _ in items]
        listed = np.array([i is not None for i in self.names], bool)[item]
        pairs = np.unique(same[listed] * len(items) + item[listed])
        self.item = (pairs % max(len(items), 1)).astype(np.int32)
        self.first = np.searchsorted(pairs // max(len(items), 1), np.arange(len(one) + 1)).astype(np.int32)

    def items_of(self, phrases: np.ndarray) -> set[str]:
        lo, n = self.first[phrases], self.first[phrases + 1] - self.first[phrases]
        at = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
        return {self.names[i] for i in np.unique(self.item[at]).tolist()}


class Wave:
    """Blocks of phrases under one numbering of their words, from 1."""

    def __init__(self, blocks: list[Phrases]):
        self.blocks = blocks
        self.hash = np.unique(np.concatenate([b.hash for b in blocks]))
        self.words = [(np.searchsorted(self.hash, b.hash) + 1).astype(np.int32)[b.words] for b in blocks]


# ------------------------------------------------------------------ index
class WaveletMatrix:
    """Ranks of symbols in a sequence, all at once for arrays of queries."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ranks = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before pos[i]."""
        begin, end = np.zeros_like(pos), pos
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ranks[k], ((symbol >> level) & 1).astype(bool)
            b1, e1 = ones[begin], ones[end]
            begin = np.where(one, self.zeros[k] + b1, begin - b1)
            end = np.where(one, self.zeros[k] + e1, end - e1)
        return end - begin

    def access(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at pos, and how often it stands before pos."""
        symbol, begin = np.zeros_like(pos), np.zeros_like(pos)
        for k in range(self.bits):
            ones = self.ranks[k]
            one = (ones[pos + 1] - ones[pos]).astype(bool)
            symbol = symbol * 2 + one
            b1, p1 = ones[begin], ones[pos]
            begin = np.where(one, self.zeros[k] + b1, begin - b1)
            pos = np.where(one, self.zeros[k] + p1, pos - p1)
        return symbol, pos - begin


class FMIndex:
    """Separators (0) are ordered by place, so that suffixes differ at the first separator at the latest;
    the position after a separator is always sampled, and LF steps never cross one."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        n = len(seq)
        blank = seq == 0
        rank = np.where(blank, np.cumsum(blank) - 1, int(blank.sum()) + seq)
        step = 1
        order = np.argsort(rank, kind="stable")
        while step < n:  # suffix order by twice as many words
            key = rank * (n + symbols + 2)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(key[1:] != key[:-1])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1:
                break
        self.bwt = seq[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols + 1))])
        self.tree = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        self.marked = (order % sample == 0) | (self.bwt == 0)
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.at = order[self.marked]

    def search(self, words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases words[begin:begin + length] at once: ranges of rows in suffix order."""
        lo = np.zeros(len(length), np.int64)
        hi = np.full(len(length), len(self.bwt), np.int64)
        live = np.arange(len(length))
        for back in range(1, int(length.max(initial=0)) + 1):
            live = live[(length[live] >= back) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = words[begin[live] + length[live] - back]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: LF steps until a row with a sampled position."""
        out = np.full(len(rows), -1, np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            done = self.marked[rows[todo]]
            hit = todo[done]
            out[hit] = self.at[self.mark_rank[rows[hit]]] + steps
            todo = todo[~done]
            c, r = self.tree.access(rows[todo])
            rows[todo] = self.before[c] + r
            steps += 1
        return out


# ------------------------------------------------------------------ shards
class Shard:
    """Words of a run of documents, numbered, with stretches of unknown words as one 0."""

    def __init__(self):
        self.seq, self.pos, self.bytes, self.total = [np.zeros(1, np.int64)], [np.full(1, -1, np.int64)], 0, 0

    def add(self, data: np.ndarray, offs: np.ndarray, wave: Wave) -> Words:
        data = LOWER[data]
        w = Words(data, offs, ALNUM)
        number = np.zeros(len(w.start), np.int64)
        if len(wave.hash) and len(w.start):
            h = w.hashes(data)
            k = np.minimum(np.searchsorted(wave.hash, h), len(wave.hash) - 1)
            number = np.where(wave.hash[k] == h, k + 1, 0)
        # a separator before each row, and only the first of consecutive unknown words
        seq = np.insert(number, w.first[:-1], 0)
        pos = np.insert(np.arange(len(number)) + self.total, w.first[:-1], -1)
        keep = seq > 0
        keep[1:] |= seq[:-1] > 0
        if len(seq):
            keep[0] = True
        self.seq.append(seq[keep])
        self.pos.append(pos[keep])
        self.bytes += len(data)
        self.total += len(number)
        return w

    def hits(self, wave: Wave):
        """For each block with occurrences: the block, and phrase number and first word of each occurrence; one index serves all."""
        seq, pos = np.concatenate([*self.seq, np.zeros(1, np.int64)]), np.concatenate([*self.pos, np.full(1, -1)])
        if not seq.any():
            return
        index = FMIndex(seq, len(wave.hash))
        for block, words in zip(wave.blocks, wave.words, strict=True):
            lo, hi = index.search(words, block.begin, block.length)
            n = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(n)), n)
            if len(which):
                rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                yield block, which, pos[index.locate(rows)]


def _merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<first:long,n:long,begin:long,end:long>>"


def _joined(spans: list[dict]) -> list[dict]:
    """Spans of one text, those that touch or overlap as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["first"] + out[-1]["n"]:
            last = out[-1]
            last["n"] = max(last["first"] + last["n"], s["first"] + s["n"]) - last["first"]
            last["end"] = max(last["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _flush(shard: Shard, parts: list, wave: Wave) -> list[dict]:
    """For each part (words, offsets) of the shard: spans and items of its rows that are hit, by row."""
    bases = np.cumsum([0, *(len(w.start) for w, _ in parts)])
    spans, items = [{} for _ in parts], [{} for _ in parts]
    for block, which, at in shard.hits(wave):
        order = np.argsort(at, kind="stable")
        which, at = which[order], at[order]
        for p, (w, _) in enumerate(parts):
            first = w.first + bases[p]
            cut_ = np.searchsorted(at, first)
            for r in np.flatnonzero(np.diff(cut_)).tolist():
                a, b = int(cut_[r]), int(cut_[r + 1])
                start = at[a:b] - int(first[r])
                spans[p].setdefault(r, []).extend(_merged(list(zip(start.tolist(), (start + block.length[which[a:b]]).tolist(), strict=True))))
                items[p].setdefault(r, set()).update(block.items_of(np.unique(which[a:b])))
    return [
        {
            r: ([{"first": x, "n": y - x, "begin": int(w.start[w.first[r] + x] - offs[r]), "end": int(w.end[w.first[r] + y - 1] - offs[r])} for x, y in _merged(pairs)], sorted(items[p][r]))
            for r, pairs in spans[p].items()
        }
        for p, (w, offs) in enumerate(parts)
    ]


def _search(given: list, text_col: str, names: list[str], shard_bytes: int, all_rows: bool):
    """Rows with n_words, spans and items as further columns; or of the hit rows only the first column, spans and items."""

    def run(batches):
        wave, shard, parts, held = Wave([g.value for g in given]), Shard(), [], []

        def flush():
            for (w, _), rows, found in zip(parts, held, _flush(shard, parts, wave), strict=True):
                hit = range(rows.num_rows) if all_rows else sorted(found)
                spans, items = (pa.array([found[r][k] if r in found else [] for r in hit], kind) for k, kind in ((0, SPANS), (1, pa.list_(pa.string()))))
                before = [*rows.columns, pa.array(w.count, pa.int64())] if all_rows else [rows.column(0).take(pa.array(hit, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*before, spans, items], names)

        for batch in batches:
            for a, b, data, offs in chunks(batch, text_col):
                parts.append((shard.add(data, offs, wave), offs))
                held.append(batch.slice(a, b - a))
                if shard.bytes >= shard_bytes:
                    yield from flush()
                    shard, parts, held = Shard(), [], []
        yield from flush()

    return run


def _as_one(batches):
    """Spans and items of several waves as those of one search."""
    for batch in batches:
        spans, items = (batch.column(k).to_pylist() for k in (1, 2))
        one = [_joined([s for part in parts for s in part]) for parts in spans]
        names = [sorted({i for part in parts for i in part}) for parts in items]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, SPANS), pa.array(names, pa.list_(pa.string()))], ["row", "spans", "items"])


def _marked(
    documents: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, shard_bytes: int, block_bytes: int, wave_blocks: int
) -> tuple[DataFrame, list[str]]:
    """documents with three further columns, and the names of these: number of words, merged hit spans, items that occur."""
    spark = documents.sparkSession
    extra = [(unused(documents, name), kind) for name, kind in (("n_words", "long"), ("spans", _SPANS_SQL), ("items", "array<string>"))]
    n_words, spans, items_ = (n for n, _ in extra)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        items = cut(items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks))).repartition("block").sortWithinPartitions("block"), "items")

    def wave(docs: DataFrame, k: int, all_rows: bool) -> DataFrame:
        """One search of docs: all rows with the three columns, or (row, spans, items) of hit rows, docs then being (row, text)."""
        given = []
        for n in range(k, min(k + wave_blocks, blocks)):
            block = items.where(F.col("block") == n).select("item_id", "text") if blocks > 1 else items
            given.append(spark.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()], window)))
        if all_rows:
            schema = StructType([*docs.schema.fields, *(StructField(n, DataType.fromDDL(kind)) for n, kind in extra)])
            return docs.mapInArrow(lean(_search(given, text_col, schema.names, shard_bytes, True)), schema)
        return docs.mapInArrow(lean(_search(given, "text", ["row", "spans", "items"], shard_bytes, False)), f"row long, spans {_SPANS_SQL}, items array<string>")

    out = wave(documents, 0, True)
    if blocks > wave_blocks:
        row = unused(out, "row")
        out = cut(out.withColumn(row, F.monotonically_increasing_id()), "marked")
        texts = out.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
        found = [out.where(F.size(spans) > 0).select(F.col(row).alias("row"), F.col(spans).alias("spans"), F.col(items_).alias("items"))]
        found += [wave(texts, k, False) for k in range(wave_blocks, blocks, wave_blocks)]
        parts = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
        at, more, names = (unused(out, n) for n in ("found_row", "found_spans", "found_items"))
        one = parts.mapInArrow(lean(_as_one), f"row long, spans {_SPANS_SQL}, items array<string>").toDF(at, more, names)
        joined = out.join(one, F.col(row) == F.col(at), "left")
        new = {spans: F.coalesce(more, spans), items_: F.coalesce(names, items_)}
        out = joined.select(*[F.col(f"`{c}`") for c in (*documents.columns, n_words)], *[e.alias(c) for c, e in new.items()])
    return out, [n_words, spans, items_]


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, wave_blocks: int = WAVE,
) -> DataFrame:
    """For each document row: doc_id, n_words, merged hit spans and the items that occur.

    A span has the first hit word, the number of hit words and their byte range.
    Null or empty texts have no words and no spans.  Repeated document rows and
    rows with a null id are each reported.  Items with a null id hit words but
    are not listed; repeated item rows count once.  An empty benchmark hits
    nothing; of the documents only id and text are looked at.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, (n_words, spans, items) = _marked(docs, benchmark, "text", item_col, item_text_col, window, shard_bytes, block_bytes, wave_blocks)
    return out.select("doc_id", n_words, spans, items)


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, wave_blocks: int = WAVE,
) -> DataFrame:
    """Documents with the hit spans cut out of their texts; texts without a hit, null and empty ones stay as they are.

    All columns pass through whatever their names; rows are not told apart by
    an id, so repeated and null ids make no difference.  An empty table stays
    empty, and an empty benchmark cuts nothing.
    """
    out, (_, spans, _) = _marked(documents, benchmark, text_col, item_col, item_text_col, window, shard_bytes, block_bytes, wave_blocks)
    s, raw = F.col(spans), F.col(text_col).cast("binary")

    def piece(i):
        """What stands between two spans, by byte offsets."""
        begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(s, i - 1)["end"])
        end = F.when(i == F.size(s), F.octet_length(raw).cast("long")).otherwise(F.get(s, i)["begin"])
        return F.substring(raw, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string")

    text = F.when(F.size(s) == 0, F.col(text_col)).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), piece), ""))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns])


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from `contamination`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
