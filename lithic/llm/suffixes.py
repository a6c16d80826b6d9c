"""Suffix dedup by a common-prefix-aware distributed merge sort.

Every ``length``-byte string that starts more than once in the corpus loses its
bytes.  Not all suffixes need sorting.  A string is known by its sync point, the
position of the smallest hash of eight bytes among the string's first ``gap``
positions; equal strings have it at the same offset.  So

1. one scan names each text (128 bits of its SHA-256) and hashes the bytes that all
   strings of a sync point share (its core); texts that occur twice go as a
   whole and stand in for their copies from there on;
2. suffixes at sync points whose core occurs twice are sorted: each task sorts
   its own, cuts the run by sampled range bounds, and front-codes it (shared
   prefix length and the rest); the runs of a range are merged by a loser tree
   that keeps for each run the prefix length shared with the last winner, and
   compares characters only beyond it.  Neighbours in the sorted order give each
   suffix's longest match to the right;
3. a match of m bytes at sync point x settles the strings that start from x to
   x + m - length.  What begins left of the first sync point of a match stays
   open.  Open strings and those at the same offsets of the same cores are taken
   in pieces of ``PIECE`` starts: what all strings of a piece share is hashed,
   and only pieces that occur twice have their strings fingerprinted (128 bits)
   and counted.

Names of cores and pieces only find candidates and are cheap hashes; what decides
is the sort or 128-bit fingerprints modulo a prime.

No pairs are formed; the sort's ranges split common prefixes anywhere, and equal
suffixes as well, as eight bytes of their own part them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK, U64, chunks, cut, drop, mix, prefix_hash, rough_prefix, rough_span, span_hash

LENGTH = 400
GAP = 128
RANGE_BYTES = 12 << 20
RUN_BYTES = 24 << 20
PIECE = 16
#: Suffixes sampled for each range.
SAMPLES = 8


# ------------------------------------------------------------------ sync points
class Sync:
    """Sync points of a chunk: position, row, and the first and last start of the strings known by each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int, gap: int):
        n = len(data)
        size = np.maximum(np.diff(offs) - length + 1, 0)
        self.pos = self.row = self.lo = self.hi = np.zeros(0, np.int64)
        if not size.any():
            return
        wide = np.zeros(n + 8, np.uint8)
        wide[:n] = data
        word = np.zeros(n, U64)
        for k in range(8):
            word |= wide[k : k + n].astype(U64) << U64(8 * k)
        bits = max(1, int(n).bit_length())
        # hash above, position below: the minimum of a stretch is its smallest hash, the leftmost of equal ones
        low = (mix(word) >> U64(bits)) << U64(bits) | np.arange(n, dtype=U64)
        span = 1
        while span * 2 <= gap:
            low[: n - span] = np.minimum(low[: n - span], low[span:])
            span *= 2
        if span < gap:
            low[: n - gap + span] = np.minimum(low[: n - gap + span], low[gap - span :])
        start = np.repeat(offs[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        sync = (low[start] & U64((1 << bits) - 1)).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        head = np.ones(len(sync), bool)
        head[1:] = (sync[1:] != sync[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(head)
        self.pos, self.row, self.lo, self.hi = sync[at], row[at], start[at], start[np.append(at[1:], len(sync)) - 1]


def _name(sha: bytes) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a text."""
    return int.from_bytes(sha[:8], "big", signed=True), int.from_bytes(sha[8:16], "big", signed=True)


def _signed(x):
    return pa.array(x.view(np.int64))


def _lists(values, rows, n):
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _scan(length: int, gap: int):
    core = length - gap + 1

    def run(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch, "text"):
                s = Sync(data, offs, length, gap)
                cores = _lists(_signed(rough_span(rough_prefix(data), s.pos, s.pos + core)), s.row, b - a)
                raw = data.tobytes()
                sha = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                f = np.array([_name(x) for x in sha], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(np.diff(offs)), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array([x.hex() for x in sha]), cores], ["doc_id", "n_bytes", "f1", "f2", "sha", "cores"]
                )

    return run


def _named(batches):
    """Each text with the 128 bits that name it."""
    for batch in batches:
        for a, b, data, offs in chunks(batch, "text"):
            raw = data.tobytes()
            f = np.array([_name(hashlib.sha256(raw[x:y]).digest()) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), batch.column(0)[a:b]], ["f1", "f2", "text"])


def _wanted(batch, column, a, b, rows, names):
    """Which (row, name) stand in the list column of rows a to b."""
    lists = batch.column(batch.schema.get_field_index(column))
    off, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(U64)
    owner = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
    known = np.sort(values[off[a] : off[b]] ^ mix(owner.astype(U64)))
    if not len(known) or not len(names):
        return np.zeros(len(names), bool)
    key = names ^ mix(rows.astype(U64))
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


# ------------------------------------------------------------------ runs
#: What goes with each suffix: text, position, core, and how far left of it its strings begin.
_PAYLOAD = np.dtype([("uid", "<i8"), ("core", "<i8"), ("pos", "<i4"), ("far", "<i2"), ("near", "<i2")])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, at least `known`."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, step = known, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(n, lo + step)
    while hi - lo > 1:  # they differ somewhere in lo..hi
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix with the key before, length of the rest, and all rests."""
    shared, rests, last = np.zeros(len(keys), np.uint16), [], b""
    for i, k in enumerate(keys):
        shared[i] = common_prefix(last, k)
        rests.append(k[shared[i] :])
        last = k
    return shared, np.array([len(r) for r in rests], np.uint16), b"".join(rests)


def _keys(raw: bytes, pos: np.ndarray, end: np.ndarray, uid: np.ndarray, place: np.ndarray, most: int) -> list[bytes]:
    """The suffixes raw[pos:end], those of `most` bytes with eight more that part equal ones: so range bounds can split them too.

    Only full-length suffixes get them, so the order of different suffixes stays.  They
    hang on the text and the place in it alone, so a sampled key is the one that is sorted.
    """
    ties = mix(uid.view(U64) + mix(place.astype(U64))).tobytes()
    return [raw[x:y] + ties[8 * k : 8 * k + 8] if y - x == most else raw[x:y] for k, (x, y) in enumerate(zip(pos.tolist(), end.tolist(), strict=True))]


def _runs(length: int, gap: int, given):
    """Sorted suffixes of a task, in front-coded pieces by range; given: the broadcast bounds."""
    core, most = length - gap + 1, length + gap

    def run(batches):
        from bisect import bisect_left

        bounds, keys, pay, held = given.value, [], [], 0

        def flush():
            payload = np.concatenate(pay)
            order = sorted(range(len(keys)), key=keys.__getitem__)
            cuts = [0, *(bisect_left(order, b, key=keys.__getitem__) for b in bounds), len(order)]
            for part, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if x < y:
                    shared, rest, raw = front_code([keys[i] for i in order[x:y]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([shared.tobytes()]), pa.array([rest.tobytes()]), pa.array([raw]), pa.array([payload[order[x:y]].tobytes()])],
                        ["part", "shared", "rest", "raw", "payload"],
                    )

        for batch in batches:
            for a, b, data, offs in chunks(batch, "text"):
                s = Sync(data, offs, length, gap)
                name = rough_span(rough_prefix(data), s.pos, s.pos + core)
                take = np.flatnonzero(_wanted(batch, "cores", a, b, s.row, name))
                if not len(take):
                    continue
                pos, row = s.pos[take], s.row[take]
                end = np.minimum(pos + most, offs[row + 1])
                raw = data.tobytes()
                keys += _keys(raw, pos, end, batch.column(0).to_numpy()[a:b][row], pos - offs[row], most)
                out = np.zeros(len(take), _PAYLOAD)
                out["uid"] = batch.column(0).to_numpy()[a:b][row]
                out["core"], out["pos"] = name[take].view(np.int64), pos - offs[row]
                out["far"], out["near"] = pos - s.lo[take], pos - s.hi[take]
                pay.append(out)
                held += int((end - pos).sum())
                if held >= RUN_BYTES:
                    yield from flush()
                    keys, pay, held = [], [], 0
        if keys:
            yield from flush()

    return run


def _decoded(shared: bytes, rest: bytes, raw: bytes):
    at, key = 0, b""
    for h, n in zip(np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(rest, np.uint16).tolist(), strict=True):
        key = key[:h] + raw[at : at + n]
        at += n
        yield key, h


def merge(runs: list) -> list[tuple[int, int, bytes]]:
    """Merge sorted runs of (key, prefix shared with the run's key before): yields (run, prefix shared with the output before, key).

    A loser tree: every inner node holds the run that lost there with the prefix
    length it shares with the winner that beat it.  On the way up, the run that
    shares more with the last output is the smaller one; only with equal lengths
    are bytes compared, from that length on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    key = [h[0] if h else None for h in heads]
    h = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's prefix length becomes that with the winner."""
        x, y = key[a], key[b]
        if x is None:
            return b, a
        if y is None or h[a] > h[b]:
            return a, b
        if h[a] < h[b]:
            return b, a
        n = common_prefix(x, y, h[a])
        if x[n : n + 1] < y[n : n + 1] or (n == len(x) and n == len(y) and a < b):
            h[b] = n
            return a, b
        h[a] = n
        return b, a

    loser, level = [0] * k, list(range(k))
    while len(level) > 1:  # the first round of games
        up = []
        for i in range(0, len(level), 2):
            w, x = play(level[i], level[i + 1])
            loser[(len(level) + i) // 2] = x
            up.append(w)
        level = up
    w = level[0]
    while key[w] is not None:
        yield w, h[w], key[w]
        nxt = next(runs[w], None)
        key[w], h[w] = nxt if nxt else (None, 0)
        node = (w + k) // 2
        while node:
            w, loser[node] = play(loser[node], w)
            node //= 2


def _matches(given, longest: int):
    """Merge a range's runs: each suffix with the longest prefix it surely shares (`sure`) and could share (`most`) with another; what parts equal ones is no prefix."""

    def run(batches):
        bounds = given.value
        blobs: dict[int, list] = {}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for part, *blob in zip(*cols, strict=True):
                blobs.setdefault(part, []).append(blob)
        for part in sorted(blobs):
            runs = [_decoded(s, r, raw) for s, r, raw, _ in blobs[part]]
            n = sum(len(s) // 2 for s, _, _, _ in blobs[part])
            which, shared, size = np.zeros(n, np.int32), np.zeros(n + 1, np.int32), np.zeros(n, np.int32)
            last = b""
            for i, (w, h, key) in enumerate(merge(runs)):
                which[i], shared[i], size[i], last = w, h, len(key), key
            # the bound above is a suffix of its own and the first of the next range
            shared[0] = 0
            shared[n] = common_prefix(last, bounds[part]) if part < len(bounds) else 0
            shared, size = np.minimum(shared, longest), np.minimum(size, longest)
            sure = np.maximum(shared[:-1], shared[1:])
            most = sure.copy()
            if part:  # the neighbour below the first suffix is in another range; so it is for those that share much with the first
                first = int(np.argmax(shared[1:-1] < size[0])) if n > 1 and (shared[1:-1] < size[0]).any() else n - 1
                most[: first + 1] = size[: first + 1]
            pay = np.zeros(n, _PAYLOAD)
            for w, blob in enumerate(blobs[part]):
                pay[which == w] = np.frombuffer(blob[3], _PAYLOAD)
            blobs[part] = None
            for a in range(0, n, 50_000):
                x = pay[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[c].astype(np.int64)) for c in _PAYLOAD.names), pa.array(sure[a : a + 50_000]), pa.array(most[a : a + 50_000])],
                    [*_PAYLOAD.names, "sure", "most"],
                )

    return run


# ------------------------------------------------------------------ open strings
def _ranges(batch: pa.RecordBatch, column: str, a: int, b: int):
    """Row and int64 fields of the structs in a list column of rows a to b."""
    lists = batch.column(batch.schema.get_field_index(column))
    off, fields = lists.offsets.to_numpy(), lists.values.flatten()
    row = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
    return row, [f.to_numpy(zero_copy_only=False)[off[a] : off[b]].astype(np.int64) for f in fields]


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which entry each of sum(n) items belongs to, and its number there."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _pieces(length: int):
    """Pieces of the asked starts of each text: first and last start, hash of what all its strings share, and whether a start is open."""

    def run(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch, "text"):
                row, (pos, lo, hi, first, last) = _ranges(batch, "ask", a, b)
                j0, j1 = (pos - hi) // PIECE, (pos - lo) // PIECE
                i, k = _spread(j1 - j0 + 1)
                j = j0[i] + k
                right = pos[i] - j * PIECE  # the piece's last start; its first is PIECE - 1 before
                x, y = np.maximum(lo[i], right - PIECE + 1), np.minimum(hi[i], right)
                start = offs[row[i]] + right
                name = rough_span(rough_prefix(data), start, start - PIECE + 1 + length)
                open_ = np.maximum(x, first[i]) <= np.minimum(y, last[i])
                # the sync point's offset belongs to the name: equal strings have theirs at the same place
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].take(pa.array(row[i])), pa.array(x), pa.array(y), pa.array(np.maximum(x, first[i])), pa.array(np.minimum(y, last[i])), _signed(mix(name + j.astype(U64))), pa.array(open_)],
                    ["uid", "a", "b", "first", "last", "piece", "open"],
                )

    return run


def _strings(length: int, only_open: bool):
    """Fingerprints of the strings that start in the listed ranges of each text."""

    def run(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch, "text"):
                row, (x, y, first, last) = _ranges(batch, "pieces", a, b)
                if only_open:
                    x, y = first, last
                i, k = _spread(np.maximum(y - x + 1, 0))
                at = x[i] + k
                start = offs[row[i]] + at
                names = [span_hash(prefix_hash(data, q), start, start + length, q) for q in (0, 1)]
                open_ = (at >= first[i]) & (at <= last[i])
                for s in range(0, len(at), CHUNK // 8):
                    z = slice(s, s + CHUNK // 8)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[a:b].take(pa.array(row[i][z])), pa.array(at[z].astype(np.int32)), _signed(names[0][z]), _signed(names[1][z]), pa.array(open_[z])], ["uid", "at", "h1", "h2", "open"]
                    )

    return run


def _kept(batch: pa.RecordBatch, length: int):
    """Chunks of rows with lists `ranges` (first and last start of repeated strings): which bytes go."""
    for a, b, data, offs in chunks(batch, "text"):
        owner, (lo, hi) = _ranges(batch, "ranges", a, b)
        step = np.zeros(len(data) + 1, np.int64)
        np.add.at(step, offs[owner] + lo, 1)
        np.add.at(step, offs[owner] + hi + length, -1)
        yield a, b, data, offs, np.cumsum(step[:-1]) > 0


def _digests(length: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offs, gone in _kept(batch, length):
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                at = offs[:-1][offs[:-1] < len(data)]
                first[at] |= gone[at]
                total, begins = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(first)])
                kept = data[~gone].tobytes()
                place = offs - total[offs]
                sha = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(total[offs[1:]] - total[offs[:-1]]), pa.array(begins[offs[1:]] - begins[offs[:-1]]), pa.array(sha)],
                    ["uid", "n_removed", "n_spans", "kept_sha256"],
                )

    return run


# ------------------------------------------------------------------ operator
def _range_bounds(texts: DataFrame, length: int, gap: int, total: int, range_bytes: int) -> list[bytes]:
    """Bounds that cut the suffixes into about equal ranges: quantiles of a sample of a bounded number of suffixes."""
    parts = max(1, -(-total * (length + gap) // range_bytes))
    if parts == 1:
        return []
    rate = min(1.0, SAMPLES * parts / total)

    def sample(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch, "text"):
                s = Sync(data, offs, length, gap)
                name = rough_span(rough_prefix(data), s.pos, s.pos + length - gap + 1)
                take = np.flatnonzero(_wanted(batch, "cores", a, b, s.row, name))
                f = batch.column(0).to_numpy()[a:b].view(U64)[s.row[take]]
                take = take[(mix(f ^ (s.pos[take] - offs[s.row[take]]).astype(U64)) >> U64(11)).astype(float) / 2.0**53 < rate]
                raw = data.tobytes()
                end = np.minimum(s.pos[take] + length + gap, offs[s.row[take] + 1])
                uid = batch.column(0).to_numpy()[a:b][s.row[take]]
                yield pa.RecordBatch.from_arrays([pa.array(_keys(raw, s.pos[take], end, uid, s.pos[take] - offs[s.row[take]], length + gap), pa.binary())], ["key"])

    keys = sorted({bytes(r[0]) for r in texts.select("uid", "text", "cores").mapInArrow(sample, "key binary").collect()})
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gap: int = GAP, range_bytes: int = RANGE_BYTES):
    """(scanned, names, texts, ranges): documents without text, distinct texts' numbers and counts, texts of possible repeats, and per text the starts of repeated strings."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = cut(docs.mapInArrow(_scan(length, gap), f"doc_id {kind}, n_bytes long, f1 long, f2 long, sha string, cores array<long>"), "scan")
    long_ = scanned.where(F.col("n_bytes") >= length)
    # one row a text; copies meet as a count
    one = long_.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.first("cores").alias("cores"))
    one = cut(one.withColumn("uid", F.monotonically_increasing_id()), "distinct")  # written, so the numbers stay
    cores = one.select("uid", F.explode("cores").alias("core"))
    shared = cut(cores.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core", "c"), "cores")
    total = shared.agg(F.sum("c").alias("c")).first()["c"] or 0
    lists = cut(cores.join(shared.select("core"), "core").groupBy("uid").agg(F.collect_set("core").alias("cores")), "lists")
    lists = lists.join(one.select("uid", "f1", "f2"), "uid")
    named = docs.where(F.octet_length("text") >= length).select("text").mapInArrow(_named, "f1 long, f2 long, text string")
    texts = cut(named.join(lists, ["f1", "f2"]).groupBy("uid").agg(F.first("text").alias("text"), F.first("cores").alias("cores")), "texts")
    bounds = _range_bounds(texts, length, gap, total, range_bytes)
    given = documents.sparkSession.sparkContext.broadcast(bounds)
    runs = texts.mapInArrow(_runs(length, gap, given), "part int, shared binary, rest binary, raw binary, payload binary")
    kinds = "uid long, core long, pos long, far long, near long, sure int, most int"
    found = matched = cut(runs.repartition(len(bounds) + 1, "part").mapInArrow(_matches(given, length + gap), kinds), "matches")
    drop(shared)
    # starts settled by the sync points before, as islands of overlapping ranges; a point's own starts begin left of it, so
    # they are settled up to the island's end only if the island begins no later than they do
    order = Window.partitionBy("uid").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("sure") >= length
    reach = F.coalesce(F.max(F.when(settles, F.col("pos") + F.col("sure") - length)).over(before), F.lit(-1))
    found = found.withColumn("reach", reach).withColumn("island", F.when(settles & (F.col("pos") > F.col("reach") + 1), F.col("pos")))
    begins = F.last("island", ignorenulls=True).over(before)
    own = F.col("pos") - F.col("far")
    open_ = (
        found.withColumn("begins", begins)
        .withColumn("first", F.when(F.col("begins") <= own, F.greatest(own, F.col("reach") + 1)).otherwise(own))
        .withColumn("last", F.least(F.col("pos") - F.col("near"), F.col("pos") + F.col("most") - length, F.when(F.col("sure") >= length, F.col("pos") - 1).otherwise(F.col("pos"))))
    )
    opened = cut(open_.select("uid", "core", "pos", "far", "near", "first", "last"), "opened")
    own_open = opened.where("first <= last").groupBy("core")
    asked = cut(own_open.agg(F.max(F.col("pos") - F.col("first")).alias("e1"), F.min(F.col("pos") - F.col("last")).alias("e0")), "asked")
    ask = (
        opened.join(asked, "core")
        .withColumn("a", F.greatest(F.col("pos") - F.col("far"), F.col("pos") - F.col("e1")))
        .withColumn("b", F.least(F.col("pos") - F.col("near"), F.col("pos") - F.col("e0")))
        .where("a <= b").groupBy("uid").agg(F.collect_list(F.struct("pos", "a", "b", "first", "last")).alias("ask"))
    )
    asking = cut(texts.select("uid", "text").join(ask, "uid"), "asking")
    pieces = asking.mapInArrow(_pieces(length), "uid long, a long, b long, first long, last long, piece long, open boolean")
    common = cut(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("c"), F.max("open").alias("open")).where("c > 1 AND open").select("piece"), "pieces")
    ranges = pieces.join(common, "piece").groupBy("uid").agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("a", "b", "first", "last")])).alias("pieces"))
    known = cut(asking.select("uid", "text").join(ranges, "uid"), "known")
    drop(asked, opened, common, asking)
    kinds = "uid long, at int, h1 long, h2 long, open boolean"
    twice = known.mapInArrow(_strings(length, False), kinds).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.max("open").alias("open"))
    twice = cut(twice.where("c > 1 AND open").select("h1", "h2"), "twice")
    by_string = known.mapInArrow(_strings(length, True), kinds).join(twice, ["h1", "h2"]).select("uid", F.col("at").alias("a"), F.col("at").alias("b"))
    by_sort = matched.where(F.col("sure") >= length).select("uid", F.col("pos").cast("int").alias("a"), (F.col("pos") + F.col("sure") - length).cast("int").alias("b"))
    ranges = cut(by_sort.unionByName(by_string).groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    drop(matched, twice, known)
    return scanned.drop("cores"), one.select("uid", "f1", "f2", "n"), texts.select("uid", "text"), ranges


def digest(documents: DataFrame, *, length: int = LENGTH, gap: int = GAP, **kw) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document row.

    A byte goes if it lies in a string of `length` bytes that starts anywhere
    else, in the same text too.  Null texts are empty; texts shorter than
    `length` stay.  Repeated rows are copies of each other, whatever their ids,
    and null ids are as good as others.
    """
    scanned, names, texts, ranges = find(documents, length=length, gap=gap, **kw)
    cut_ = texts.join(ranges, "uid").mapInArrow(_digests(length), "uid long, n_removed long, n_spans long, kept_sha256 string")
    marks = names.join(cut_, "uid", "left").where((F.col("n") > 1) | F.col("n_spans").isNotNull())
    copy = F.col("n") > 1  # all of it goes
    marks = cut(marks.select(
        "f1", "f2", F.when(~copy, F.col("n_removed")).alias("n_removed"), F.when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ), "marks")
    out = scanned.join(marks, ["f1", "f2"], "left")
    hit = F.col("n_spans").isNotNull()
    return out.select(
        "doc_id", "n_bytes", F.when(hit, F.coalesce("n_removed", "n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
