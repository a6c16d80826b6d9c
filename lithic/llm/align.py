"""Alignment of two tokenizers over the same bytes by coalescing intervals.

The tokens of both sides are byte ranges.  Sorted by start, with the running
maximum of their ends, they break into groups wherever a start reaches that
maximum; inside a group the overlapping tokens of the two sides are expanded
into pairs, whose number is linear, as the ranges of one side tile the text.

A text is tokenized once.  Chunks of about a MB of text are the unit of what
follows: a pair of ids goes into the corpus-wide count once a chunk, with its
number there, and its answer comes back once a chunk, so that what is shuffled
is the distinct pairs of chunks and not the tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import cut, string_buffers, unused

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: Texts of a chunk at most.
ROWS = 2048


#: Where a text may be cut: at a single space between two characters that are no space. Neither side has tokens across it (see `Side.cuts`).
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space at which a text may not be cut.
_UNCUT = re.compile(r"\s (?=.)| (?=\s)|\A | \Z", re.S)
#: Parts whose tokens a worker keeps, at most, beside those of the chunk at hand.
KNOWN = 1 << 18


class Side:
    """A tokenizer: ids of a space and each text, and the bytes of every id.

    cuts: whether the tokens of a text are those of its parts between `_CUT`, each with a space before it.
    """

    def __init__(self, pieces: list[bytes], encode, cuts: bool):
        self.pieces, self.encode, self.cuts = pieces, encode, cuts
        self.length = np.array([len(p) for p in pieces], np.int64)
        #: Ids as text, once before each of the marks.
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(len(pieces))]

        self.raw, self.begin = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(self.length) - self.length

    def gives_back(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == f" {text}".encode()

    def all_given_back(self, ids: np.ndarray, n: np.ndarray, texts: list[str]) -> np.ndarray:
        """`gives_back` of texts, whose ids stand one behind the other, n of each."""
        offs, raw = string_buffers(pa.array(texts, pa.string()))
        want = np.insert(raw[offs[0] : offs[-1]], offs[:-1] - offs[0], 0x20)
        size, length = np.diff(offs) + 1, self.length[ids]
        row = np.repeat(np.arange(len(texts)), n)
        good = np.bincount(row, weights=length, minlength=len(texts)) == size
        length = length * good[row]
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.begin[ids], length)
        differ = self.raw[at] != want[np.repeat(good, size)]
        good[np.repeat(row, length)[differ]] = False
        return good


class Parts:
    """Tokens of both sides for parts of texts. Parts come again and again, so each is tokenized once as long as it is kept."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.good = np.zeros(0, bool)

    def _add(self, new: list[str]) -> None:
        good = np.ones(len(new), bool)
        for k, side in enumerate(self.sides):
            ids = side.encode(new)
            n = np.fromiter(map(len, ids), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            good &= side.all_given_back(flat, n, new)
            self.first[k] = np.concatenate([self.first[k], self.first[k][-1] + np.cumsum(n)])
            self.ids[k] = np.concatenate([self.ids[k], flat])
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.good = np.concatenate([self.good, good])

    def tokens(self, texts: list[str]):
        """For each side the ids of all texts, one behind the other, and how many each text has; texts that a side does not give back have none."""
        parts = [_CUT.split(t) if _UNCUT.search(t) else t.split(" ") for t in texts]
        if len(self.at) > KNOWN:
            self._clear()
        self._add(sorted(set().union(*parts).difference(self.at)))
        which = np.fromiter(map(self.at.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(texts)))
        bad = np.zeros(len(texts), bool)
        bad[row[~self.good[which]]] = True  # a part is not given back, so neither is the whole
        keep = ~bad[row]
        which, row = which[keep], row[keep]
        out = []
        for first, ids in zip(self.first, self.ids, strict=True):
            n = first[which + 1] - first[which]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which], n)
            out += [ids[at], np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64)]
        return out


def _whole(texts: list[str], a: Side, b: Side):
    """The same as `Parts.tokens`, of texts that must not be cut."""
    both = [side.encode(texts) for side in (a, b)]
    good = [a.gives_back(x, t) and b.gives_back(y, t) for t, x, y in zip(texts, *both, strict=True)]
    out = []
    for ids in both:
        ids = [x if ok else [] for x, ok in zip(ids, good, strict=True)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        out += [np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n]
    return out


@lru_cache(maxsize=2)
def _parts(a: Side, b: Side) -> Parts:
    return Parts(a, b)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_level(path: str) -> Side:
    """A byte-level BPE of the `tokenizers` library, on a space and the text; special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    letters, n = _byte_letters(), t.get_vocab_size(with_added_tokens=True)
    pieces = [bytes(letters[c] for c in t.id_to_token(i) or "" if c in letters) for i in range(n)]
    shape = json.loads(t.to_str())
    # its pattern never puts a character and a single space behind it into one part
    cuts = not shape["normalizer"] and (shape["pre_tokenizer"] or {}).get("type") == "ByteLevel" and shape["pre_tokenizer"].get("use_regex", True) and not shape["pre_tokenizer"]["add_prefix_space"]
    return Side(pieces, lambda texts: [e.ids for e in t.encode_batch_fast([f" {x}" for x in texts], add_special_tokens=False)], cuts)


_AS_IS = "  ﬁ Ａ\u0301  x\t\n½ "


@lru_cache(maxsize=4)
def piece_level(path: str) -> Side:
    """A sentencepiece model, which adds the space itself; U+2581 is a space, byte pieces are bytes."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
    # no piece goes on with a space behind another character, and texts are taken as they are
    cuts = not any(re.search("[^▁]▁", m.id_to_piece(i)) for i in range(m.get_piece_size())) and m.normalize(_AS_IS) == "▁" + _AS_IS.replace(" ", "▁")
    return Side([piece(i) for i in range(m.get_piece_size())], lambda texts: m.encode(texts, num_threads=1), cuts)


# ------------------------------------------------------------------ intervals
def coalesce(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each interval in that order): sorted by start, then end; a group begins where a start reaches the running maximum of the ends."""
    order = np.lexsort((end, start))
    s, top = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    begins = np.ones(len(s), bool)
    begins[1:] = s[1:] >= top[:-1]
    return order, np.cumsum(begins) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of ranges that share a byte; each side ascends and its ranges do not overlap one another."""
    lo = np.searchsorted(b_end, a_start, "right")
    n = np.maximum(np.searchsorted(b_start, a_end, "left") - lo, 0)
    i = np.repeat(np.arange(len(a_start)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return i, j


@lru_cache(maxsize=2)
def _words(a: Side, b: Side) -> list[str]:
    return a.shown + b.shown


def aligned(texts: list[str], a: Side, b: Side, kind: str = "end"):
    """Alignment of a chunk of texts.

    Gives for each text n_a, n_b, n_groups, n_links and the groups as text (None
    without tokens), and for each link its text, A id and B id.  Links are the
    pairs that overlap within a group (kind "overlap"), or of these only those
    whose ranges end together (kind "end").
    """
    some = np.array([k for k, t in enumerate(texts) if t], np.int64)
    n, counts = len(texts), np.zeros((4, len(texts)), np.int64)
    groups: list[str | None] = [None] * n
    given = [texts[k] for k in some.tolist()]
    ia, n_a, ib, n_b = _parts(a, b).tokens(given) if a.cuts and b.cuts else _whole(given, a, b)
    if not len(ia):
        return counts, groups, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row_a, row_b = np.repeat(some, n_a), np.repeat(some, n_b)
    # the texts stand one behind the other, and both sides tile the same bytes
    end_a, end_b = np.cumsum(a.length[ia]), np.cumsum(b.length[ib])
    start_a, start_b = end_a - a.length[ia], end_b - b.length[ib]
    counts[0], counts[1] = np.bincount(row_a, minlength=n), np.bincount(row_b, minlength=n)
    order, sorted_group = coalesce(np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]))
    group = np.empty(len(order), np.int64)
    group[order] = sorted_group
    ga, gb, m = group[: len(ia)], group[len(ia) :], int(sorted_group[-1]) + 1
    # a text never shares a group with the next one, as both sides end with it
    in_a, in_b = np.bincount(ga, minlength=m), np.bincount(gb, minlength=m)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    last_a = upto_a - 1  # the last A token of a group
    counts[2] = np.bincount(row_a[last_a], minlength=n)
    # tokens as they are shown: group by group, A before B, each with the mark that follows it
    shown = np.empty(len(order), np.int64)
    mark_a, mark_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    mark_a[last_a], mark_b[upto_b - 1] = 1, 2
    shown[np.arange(len(ia)) + (upto_b - in_b)[ga]] = ia + mark_a * len(a.pieces)
    shown[np.arange(len(ib)) + upto_a[gb]] = ib + mark_b * len(b.pieces) + 3 * len(a.pieces)
    words = list(map(_words(a, b).__getitem__, shown.tolist()))
    x = 0
    for k, size in zip(some.tolist(), (n_a + n_b).tolist(), strict=True):
        if size:
            groups[k] = "".join(words[x : x + size])[:-1]
            x += size
    i, j = overlaps(start_a, end_a, start_b, end_b)
    if kind == "end":
        both = end_a[i] == end_b[j]
        i, j = i[both], j[both]
    counts[3] = np.bincount(row_a[i], minlength=n)
    return counts, groups, row_a[i], ia[i], ib[j]


# ------------------------------------------------------------------ spark
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
#: A chunk's rows: its texts (pairs is null), and one with its distinct pairs (pairs is not null).
_KIND = "_chunk long, _at int, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs array<long>, times array<long>"


def _tokenized(docs: DataFrame, text: str, keep: list[str], path_a: str, path_b: str, kind: str, digest: bool) -> DataFrame:
    """Rows of texts with their numbers, groups and links (positions in the chunk's list of pairs), and a row a chunk with that list."""
    schema = StructType([*[StructField(c, docs.schema[c].dataType, True) for c in keep], *StructType.fromDDL(_KIND).fields])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), piece_level(path_b)
        size_b, chunk = len(b.pieces), (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            offs, _ = string_buffers(col)
            x = 0
            while x < len(col):
                y = min(max(x + 1, int(np.searchsorted(offs, offs[x] + CHUNK, "right")) - 1), len(col), x + ROWS)
                texts = col.slice(x, y - x).to_pylist()
                chunk, n = chunk + 1, y - x
                counts, groups, row, ia, ib = aligned(texts, a, b, kind)
                pairs, which, times = np.unique(ia * size_b + ib, return_inverse=True, return_counts=True)
                cuts = np.searchsorted(row, np.arange(n + 1))
                links = which.astype(np.int32)
                shown = [("" if g is None else hashlib.sha256(g.encode()).hexdigest()) if digest else g for g in groups]
                null = lambda k, m: pa.nulls(m, out.field(k).type)
                rows = {c: batch.column(batch.schema.get_field_index(c)).slice(x, n).cast(out.field(c).type) for c in keep}
                rows |= {"_chunk": pa.array([chunk] * n, pa.int64()), "_at": pa.array(range(n), pa.int32())} | {c: pa.array(counts[k]) for k, c in enumerate(_NUMBERS)}
                rows |= {"groups": pa.array(shown, pa.string()), "links": pa.array([links[p:q].tobytes() for p, q in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), "pairs": null("pairs", n), "times": null("times", n)}
                yield pa.RecordBatch.from_arrays([rows[f.name].cast(f.type) for f in out], schema=out)
                if len(pairs):
                    one = {f.name: pa.nulls(1, f.type) for f in out}
                    one |= {"_chunk": pa.array([chunk], pa.int64()), "pairs": pa.array([pairs.tolist()], out.field("pairs").type), "times": pa.array([times.tolist()], out.field("times").type)}
                    yield pa.RecordBatch.from_arrays([one[f.name] for f in out], schema=out)
                x = y

    return docs.select(*keep, text).mapInArrow(run, schema)


def pair_counts(tokenized: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links hold an id pair, and whether no other pair of its B id has more."""
    each = tokenized.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = cut(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")), "pairs")
    b = F.col("pair") % size_b
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path_a: str = f"{TOKENIZERS}/byte_bpe_50k.json", path_b: str = f"{TOKENIZERS}/piece_bpe_32k.model",
          kind: str = "end", digest: bool = False) -> DataFrame:
    """One row a row of docs: the columns of `keep`, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    groups is the alignment as text, `a1,a2|b1;a3|b2,b3` with the ids of both
    sides; with `digest` its SHA-256 instead, and '' without tokens.  n_best is
    how many links of the text have the pair that is the corpus-wide most
    frequent one of its B id (ties included), count_sum the sum of the links'
    corpus-wide counts.  Texts that are null or empty, or that one of the
    tokenizers does not give back byte by byte, have no tokens: zeros and null
    groups.  Repeated rows are rows.  An empty table gives no rows.  Results
    whose names `keep` has get underscores.  The vocabularies are read by every
    worker from the paths given, which all machines must have.
    """
    keep = list(docs.columns if keep is None else keep)
    inner = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    held = [f"_k{i}" for i in range(len(keep))]
    size_b = len(piece_level(path_b).pieces)
    done = cut(_tokenized(inner, "_text", held, path_a, path_b, kind, digest), "aligned")
    answers = cut(pair_counts(done, size_b), "counts")
    asked = done.where("pairs IS NOT NULL").select("_chunk", F.posexplode("pairs").alias("at", "pair"))
    # one row a chunk again; a chunk's pairs are bounded by its text
    found = asked.join(answers, "pair").groupBy("_chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("x"))
    found = cut(found.select("_chunk", F.col("x.n").alias("n"), F.col("x.best").alias("best")), "answers")
    rows = done.where("pairs IS NULL").select(*held, "_chunk", *_NUMBERS, "groups", "links")
    outs = StructType([*[f for f in rows.schema.fields if f.name not in ("_chunk", "links")], *StructType.fromDDL("n_best long, count_sum long").fields])
    shape = to_arrow_schema(outs)

    def scored(texts: pa.Table, answer: pa.Table) -> pa.Table:
        some = answer.num_rows > 0
        n = np.asarray(answer["n"][0].values) if some else np.zeros(0, np.int64)
        best = np.asarray(answer["best"][0].values.cast(pa.int64())) if some else n
        offs, raw = string_buffers(texts["links"])
        at = np.frombuffer(raw[offs[0] : offs[-1]].tobytes(), np.int32)
        cuts = (offs - offs[0]) // 4
        total = lambda v: pa.array(np.diff(np.r_[0, np.cumsum(v[at])][cuts]) if len(at) else np.zeros(len(cuts) - 1, np.int64), pa.int64())
        cols = {f.name: texts[f.name] for f in shape if f.name in texts.column_names} | {"n_best": total(best), "count_sum": total(n)}
        return pa.table([cols[f.name] for f in shape], schema=shape)

    out = rows.groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInArrow(scored, outs)
    given = docs.select(*keep)
    names = {c: unused(given, c) for c in (*_NUMBERS, "n_best", "count_sum", "groups")}
    return out.select(*[F.col(k).alias(c) for k, c in zip(held, keep, strict=True)], *[F.col(c).alias(n) for c, n in names.items()])

