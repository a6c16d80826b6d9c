"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct shingles of five words; `COORDS` minwise tokens
represent it.  Documents with equal sets form one class and take part once.
Each of ``trees`` independent trees puts a class in the node of one minwise
token; classes of similarity s meet in a tree with probability s, so 16 trees
leave fewer than one link of 0.75 in 10**9 unseen.

1. Stars.  Every class is compared with the smallest members of its nodes by
   sizes and sketches (four bits of each coordinate); the best one that can be
   linked is confirmed on full sets.  That is one confirmation a class, and it
   joins most of a large group of near copies; it is repeated with the next best
   one in another component while that still finds links, `ROUNDS` times at most.
2. Branching.  Only nodes that still hold several components matter.  A node of
   more than ``small`` classes branches by ``BRANCHES`` further minwise tokens of
   its members as long as that at least halves the comparisons: a line that very
   many otherwise different documents share falls apart at once.  A pair of
   similarity 0.75 stays together in some child with probability 0.984.
3. Comparison.  Small nodes, and nodes that branching does not thin out, are
   compared exhaustively by sketches inside tasks, the latter in blocks of
   about ``BLOCK`` tokens and piece by piece; what comes out are the classes that
   have a promising partner in another component.
4. Ceilings.  A token that no other of these classes has cannot be common, so
   what is left of a set is the most that any pair with it can share.  Near
   copies of a template that differ too much from all others mostly go here.
5. Confirmation.  The classes left are compared once more, with their full sets,
   in large nodes through an index of each set's rarest tokens, one of which any
   link must share.  A part gives at most one link for each component that it
   joins, and classes that a link has joined are not compared again.

Beside the stars no pair is ever written, and pairs inside a component are not compared, as they cannot change the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, U64, Words, chunks, cut, drop, lean, mix, string_buffers, uniform, unused

SHINGLE = 5
COORDS = 48
TREES = 16
SMALL = 64
BRANCHES = 3
LEVELS = 4
#: Tokens of the sets of a block of a large node.
BLOCK = 1 << 19
#: Pairs of a part that are looked at together, and tokens that are counted together.
PAIRS = 1 << 19
ROUNDS = 4
#: Share of confirmed stars below which no further round is made.
FEW = 0.05
#: Members of a star that share one copy of its centre's set.
STAR = 256
#: Coordinates whose four-bit sketches must agree before full sets are compared: at similarity 0.75 they agree in 36.8 of 48
#: on average with a deviation of 2.9, so one pair in 10**8 is below 20.
AGREE = 20
BROADCAST_IDS = 200_000


# ------------------------------------------------------------------ sets
def shingle_hashes(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle of a chunk, and where each row's shingles begin; a row of fewer words, but not none, has one of all its words."""
    data = LOWER[data]
    w = Words(data, offs, NON_SPACE)
    h = w.hashes(data)
    size = np.where(w.count >= shingle, w.count - shingle + 1, np.minimum(w.count, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.first[:-1], size) + np.arange(first[-1]) - np.repeat(first[:-1], size)
    length = np.minimum(np.repeat(w.count, size), shingle)
    out = length.astype(U64)
    for k in range(shingle):
        use = length > k
        term = h[np.minimum(at + k, len(h) - 1)] if len(h) else h
        out = np.where(use, mix(out * U64(0x9FB21C651E98DF25) + term), out)
    return out, first


def set_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return np.unique(shingle_hashes(data, np.array([0, len(data)]), shingle)[0])


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of sorted distinct hashes."""
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SALT = uniform(COORDS, 7) | U64(1)


def _signatures(shingle: int, coords: int):
    salt = _SALT[:coords]

    def run(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch, "text", 1 << 19):
                h, first = shingle_hashes(data, offs, shingle)
                n, f1, f2, sig, sketch = [], [], [], [], []
                for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = np.unique(h[lo:hi])
                    n.append(len(own))
                    x, y = fingerprint(own)
                    f1.append(x)
                    f2.append(y)
                    if len(own):  # blocks keep the products small for very long texts
                        low, token = np.full(coords, (1 << 64) - 1, U64), np.zeros(coords, U64)
                        for k in range(0, len(own), 4096):
                            x = own[k : k + 4096, None] * salt[None, :]
                            x ^= x >> U64(29)
                            at = x.argmin(0)
                            least = x[at, np.arange(coords)]
                            token = np.where(least < low, own[k + at], token)
                            low = np.minimum(low, least)
                        sig.append(token.view(np.int64).tolist())
                        nibbles = (token & U64(15)).reshape(-1, 16) << (np.arange(16, dtype=U64) * U64(4))
                        sketch.append(np.bitwise_or.reduce(nibbles, axis=1).view(np.int64).tolist())
                    else:
                        sig.append([])
                        sketch.append([])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "f1", "f2", "sig", "sketch"],
                )

    return run


# ------------------------------------------------------------------ trees
def _roots(classes: DataFrame, trees: int) -> DataFrame:
    """(node, tree, id, size, a) of each tree's first branching: a class stands in the node of its minwise token, a is the node's
    smallest one; nodes of one class are left out."""
    names = F.transform(F.slice("sig", 1, trees), lambda x, i: F.struct(F.xxhash64(i, x).alias("node"), i.cast("int").alias("tree")))
    level = cut(classes.select("id", F.col("n").alias("size"), F.explode(names).alias("r")).select("id", "size", "r.*"), "level")
    sizes = cut(level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).where("n > 1").select("node", "a"), "sizes")
    out = cut(level.join(sizes, "node"), "nodes")
    drop(level, sizes)
    return out


def _mixed(nodes: DataFrame) -> DataFrame:
    """nodes (node, tree, id, size, component) that hold several components, with their classes n and tokens."""
    nodes = cut(nodes, "level")
    mixed = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = cut(mixed.where("lo < hi").select("node", "n", "tokens"), "mixed")
    out = cut(nodes.join(mixed, "node"), "nodes")
    drop(nodes, mixed)
    return out


def _named(nodes: DataFrame, component: DataFrame) -> DataFrame:
    """nodes with their classes' components; those of no link are their own."""
    return nodes.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _leaves(nodes: DataFrame, classes: DataFrame, trees: int, small: int) -> list[DataFrame]:
    """Tables (part, side, id) of what is to be compared: classes of one part, on different sides where sides are given.

    nodes: (node, tree, id, size, component, n, tokens).  The coordinates of a path are those
    after the trees', three a level, so that no path uses one twice.
    """
    whole = lambda rows: rows.select(F.col("node").alias("part"), F.lit(0).alias("side"), "id")
    out, big = [whole(nodes.where(F.col("n") <= small))], nodes.where(F.col("n") > small)
    for level in range(LEVELS):
        if not big.limit(1).count():
            return out
        at = [(F.col("tree") * 7 + (BRANCHES * level + k)) % (COORDS - trees) + trees for k in range(BRANCHES)]
        child = F.explode(F.array(*[F.xxhash64("node", i, F.get("sig", i)) for i in at]))
        kids = cut(big.join(classes.select("id", "sig"), "id").select("node", "tree", "id", "size", "component", "n", child.alias("child")), "kids")
        count = kids.groupBy("node", "n", "child").agg(F.count(F.lit(1)).cast("double").alias("c"))
        # comparisons in the children against those in the node: a node that does not fall apart is compared as it is
        dense = cut(count.groupBy("node", "n").agg(F.sum(F.col("c") * F.col("c")).alias("squares")).where(F.col("squares") > F.col("n") * F.col("n") * 0.5).select("node"), "dense")
        stay = cut(big.join(dense, "node", "left_semi"), "stay")
        out.append(_blocks(stay))
        below = _mixed(kids.join(dense, "node", "left_anti").select(F.col("child").alias("node"), "tree", "id", "size", "component"))
        drop(kids, dense)
        out.append(whole(below.where(F.col("n") <= small)))
        big = below.where(F.col("n") > small)
    return [*out, _blocks(big)]


def _blocks(nodes: DataFrame) -> DataFrame:
    """Large nodes in blocks: each two blocks of a node are a part of two sides, each block one of its own."""
    n = F.ceil(F.col("tokens") / F.lit(float(BLOCK)))
    own = F.pmod(F.xxhash64("id", "node"), n)
    rows = nodes.select("node", "id", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    part = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select(part.alias("part"), side.alias("side"), "id")


# ------------------------------------------------------------------ comparison
def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many four-bit coordinates of two arrays of sketches are equal."""
    d = x ^ y
    d |= d >> U64(1)
    d |= d >> U64(2)
    d &= U64(0x1111111111111111)
    return COORDS - np.bitwise_count(d).sum(-1).astype(np.int64)


class _Rows:
    """Rows of whole parts: part, side, id, component, set size, ceiling and sketch."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.part, self.side, self.id, self.component, self.n, self.most = columns[:6]
        self.sketch = np.stack(columns[6:], axis=1).view(U64) if len(columns[0]) else np.zeros((0, COORDS // 16), U64)

    def pairs(self, small: int, hit: np.ndarray | None = None):
        """Positions (i, j) of all pairs within parts, piece by piece; of large parts only those of which not both are marked in hit, as it stands then."""
        n = len(self.part)
        head = np.flatnonzero(np.concatenate([[True], self.part[1:] != self.part[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(head, n))
        last = np.repeat(head + size, size)  # where each row's part ends
        few = np.flatnonzero(np.repeat(size <= small, size))
        for d in range(1, int(size[size <= small].max(initial=1))):
            few = few[few + d < last[few]]
            yield few, few + d
        for k in np.flatnonzero(size > small).tolist():
            lo, hi = int(head[k]), int(head[k] + size[k])
            step = max(1, PAIRS // (hi - lo))
            for a in range(lo, hi, step):
                i, j = np.arange(a, min(a + step, hi)), np.arange(a, hi)
                for x, y in [(i, j)] if hit is None else [(i[~hit[i]], j), (i[hit[i]], j[~hit[j]])]:
                    x, y = np.meshgrid(x, y, indexing="ij")
                    use = x < y
                    yield x[use], y[use]

    def promising(self, small: int, percent: int, agree: int, hit: np.ndarray | None = None):
        """(i, j) of pairs in different components that sizes, ceilings and sketches let be linked."""
        for i, j in self.pairs(small, hit):
            n, m = self.n[i], self.n[j]
            ok = (self.component[i] != self.component[j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            ok &= (100 + percent) * np.minimum(self.most[i], self.most[j]) >= percent * (n + m)
            ok &= (self.side[i] != self.side[j]) | (self.side[i] == 0)
            i, j = i[ok], j[ok]
            ok = _agreement(self.sketch[i], self.sketch[j]) >= agree
            if ok.any():
                yield i[ok], j[ok]


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)


def _joined(x: _Rows, lo: int, hi: int, token: np.ndarray, off: np.ndarray, percent: int):
    """Links (i, j) of the rows lo to hi, one part, that join components; token[off[k]:off[k + 1]] is the set of row lo + k.

    Two sets of which the larger has n tokens can only be linked if they share
    one of their n - ceil(percent * n / 100) + 1 rarest tokens, so an index of
    these gives each row its candidates; those of its own component are passed
    over, the others are counted token by token.  Memory is that of the part's
    tokens, whatever the number of its pairs.
    """
    n, size = hi - lo, np.diff(off)
    _, column, times = np.unique(token, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    row = np.repeat(np.arange(n), size)
    token = rank[column]
    order = np.lexsort((token, row))
    token, often = token[order], times[column][order] > 1
    place = np.arange(len(token)) - np.repeat(off[:-1], size)
    prefix = often & (place < np.repeat(size + (-percent * size // 100) + 1, size))
    listed = np.flatnonzero(prefix)
    by_token = listed[np.argsort(token[listed], kind="stable")]
    post, head = row[by_token], np.searchsorted(token[by_token], np.arange(len(times) + 1))
    own, own_first = token[listed], np.searchsorted(row[listed], np.arange(n + 1))
    part, side, most = np.unique(x.component[lo:hi], return_inverse=True)[1], x.side[lo:hi], x.most[lo:hi]
    has, hit = np.zeros(len(times), bool), np.zeros(n, bool)
    for i in range(n):
        mine = own[own_first[i] : own_first[i + 1]].tolist()
        if not mine:
            continue
        for t in mine:
            hit[post[head[t] : head[t + 1]]] = True
        some = i + 1 + np.flatnonzero(hit[i + 1 :])
        for t in mine:
            hit[post[head[t] : head[t + 1]]] = False
        m = size[some]
        ok = (part[some] != part[i]) & (100 * np.minimum(m, size[i]) >= percent * np.maximum(m, size[i])) & ((side[some] != side[i]) | (side[i] == 0))
        some = some[ok & ((100 + percent) * np.minimum(most[some], most[i]) >= percent * (m + size[i]))]
        if not len(some):
            continue
        has[token[off[i] : off[i + 1]]] = True
        step = max(1, PAIRS // int(size[some].max()))
        for a in range(0, len(some), step):
            js = some[a : a + step]
            k = size[js]
            at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(off[js], k)
            both = np.add.reduceat(has[token[at]].astype(np.int64), np.cumsum(k) - k)
            for j in js[(both > 0) & (100 * both >= percent * (k + size[i] - both))].tolist():
                if part[j] != part[i]:
                    yield lo + i, lo + j
                    part[part == part[j]] = part[i]
        has[token[off[i] : off[i + 1]]] = False


def _tokens(own: pa.ChunkedArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the sets of rows lo to hi, one behind the other, and where each begins."""
    offs, raw = string_buffers(own.slice(lo, hi - lo))
    return np.frombuffer(raw[offs[0] : offs[-1]].tobytes(), U64), (offs - offs[0]) // 8


def _joining(x: _Rows, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Of linked pairs (i, j) those that join components, one part after the other."""
    out, part, root = [], None, {}

    def find(c):
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    for k in np.argsort(x.part[i], kind="stable").tolist():
        if x.part[i[k]] != part:
            part, root = x.part[i[k]], {}
        c, d = find(int(x.component[i[k]])), find(int(x.component[j[k]]))
        if c != d:
            root[d] = c
            out.append(k)
    return out


def _compared(leaves: list[DataFrame], known: DataFrame, small: int, percent: int, agree: int) -> DataFrame:
    """What the exhaustive comparison finds: the ids of classes with a promising partner or, if known has full sets `own`, links (a, b) that join components.

    known: (id, component, n, most, sketch); classes that are not there take no part.
    """
    rows, exact = leaves[0], "own" in known.columns
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    sketch = [F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(COORDS // 16)]
    rows = rows.join(known, "id").select("part", F.col("side").cast("long").alias("side"), "id", "component", "n", "most", *sketch, *["own"] * exact)

    def found(x: _Rows, own: pa.Array | None):
        if own is None:
            # a class whose ceiling is below its own share can be linked with nothing, one with a partner needs no other
            x = _Rows([c[100 * x.most >= percent * x.n] for c in x.columns])
            hit = np.zeros(len(x.part), bool)
            for i, j in x.promising(small, percent, agree, hit):
                hit[i] = hit[j] = True
            return [pa.array(np.unique(x.id[hit]))]
        ends = np.flatnonzero(np.diff(x.part)) + 1
        bounds = np.concatenate([[0], ends, [len(x.part)]]) if len(x.part) else np.zeros(1, np.int64)
        large = np.diff(bounds) > small
        links = [k for lo, hi in zip(bounds[:-1][large].tolist(), bounds[1:][large].tolist(), strict=True) for k in _joined(x, lo, hi, *_tokens(own, lo, hi), percent)]
        i, j = np.array(links, np.int64).reshape(-1, 2).T
        few = _Rows([c[np.repeat(~large, np.diff(bounds))] for c in x.columns])
        place = np.flatnonzero(np.repeat(~large, np.diff(bounds)))
        pairs = [np.stack(p) for p in few.promising(small, percent, agree)]  # of small parts only: at most `small` a row
        p, q = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        if len(p):
            use, back = np.unique(np.concatenate([p, q]), return_inverse=True)
            both = _common([np.frombuffer(own[int(k)].as_buffer(), U64) for k in place[use]], back[: len(p)], back[len(p) :])
            ok = (both > 0) & (100 * both >= percent * (few.n[p] + few.n[q] - both))
            p, q = p[ok], q[ok]
            some = _joining(few, p, q)
            i, j = np.concatenate([i, place[p[some]]]), np.concatenate([j, place[q[some]]])
        a, b = x.id[i], x.id[j]
        return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]

    names = ["a", "b"] if exact else ["id"]
    n = 6 + COORDS // 16

    def run(batches):
        held, texts = None, []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[:n]]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            texts += batch.columns[n:]
            # the last part may go on in the next batch; parts are bounded by blocks
            at = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            held = [c[at:] for c in columns]
            if at:
                own = pa.chunked_array(texts) if exact else None
                yield pa.RecordBatch.from_arrays(found(_Rows([c[:at] for c in columns]), own), names)
                texts = own.slice(at).chunks if exact else []
        if held is not None:
            yield pa.RecordBatch.from_arrays(found(_Rows(held), pa.chunked_array(texts, pa.binary()) if exact else None), names)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(lean(run), ", ".join(f"{c} long" for c in names)).distinct()


# ------------------------------------------------------------------ confirmation
def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, own) for classes ids: the full set as sorted 64-bit hashes, made anew from the text of a document of the class."""
    wanted = cut(ids.join(classes.select("id", "m", "f1", "f2"), "id"), "wanted")
    few = wanted.count() <= BROADCAST_IDS  # a few MB of ids spare the shuffle of all texts; beyond that the join shuffles

    def run(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch, "text", 1 << 19):
                h, first = shingle_hashes(data, offs, shingle)
                f1, f2 = (batch.column(k)[a:b].to_pylist() for k in (2, 3))
                keep, own = [], []
                for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    x = np.unique(h[lo:hi])
                    if fingerprint(x) == (f1[k], f2[k]):  # another row of the same id can have another text
                        keep.append(a + k)
                        own.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int64())), pa.array(own, pa.binary())], ["id", "own"])

    texts = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("m")).select("text", "id", "f1", "f2")
    return texts.mapInArrow(lean(run), "id long, own binary").groupBy("id").agg(F.first("own").alias("own"))


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The written table of pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union.

    Pairs of one a meet in groups of about `STAR`, to which the set of a is sent once.
    """
    pairs = cut(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = cut(_sets(ids, classes, docs, shingle), "own")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(STAR))).alias("parts"))
    dealt = cut(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt")
    heads = dealt.select("a", "part").distinct().join(own.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "own")
    rows = heads.unionByName(dealt.join(own.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "own"))

    def run(batches):
        head = np.zeros(0, U64)
        for batch in batches:
            a, b, own = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            out = []
            for k in range(len(a)):
                x = np.frombuffer(own[k].as_buffer(), U64)
                if b[k] is None:
                    head = x.copy()
                    continue
                both = len(np.intersect1d(head, x, assume_unique=True))
                if both and 100 * both >= percent * (len(head) + len(x) - both):
                    out.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    links = cut(rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(lean(run), "a long, b long"), "links")
    drop(pairs, own, dealt)
    return links


def _ceilings(ids: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, most): tokens of each class that some other of the classes ids has as well."""
    own = _sets(ids, classes, docs, shingle)

    def tokens(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), batch.column(0)[k].as_py())), pa.array(x)], ["id", "token"])

    single = own.mapInArrow(lean(tokens), "id long, token long").groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    alone = single.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    return ids.join(classes.select("id", "n"), "id").join(alone, "id", "left").select("id", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for all ids in links (a, b): the smallest id that each reaches.

    Each round takes the smallest label of itself, of its neighbours and of its
    label, so long chains shrink by doubling.  Labels are aggregated as minima,
    never listed, and every round is a written table.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    label = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l"), F.lit(True).alias("changed")), "label")
    while label.where("changed").limit(1).count():
        near = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        jump = label.select(F.col("a").alias("l"), F.col("l").alias("j"))
        best = F.least("l", "m", F.coalesce("j", "l"))
        new = cut(label.select("a", "l").join(jump, "l", "left").join(near, "a").select("a", best.alias("l"), (best < F.col("l")).alias("changed")), "label")
        drop(label)
        label = new
    drop(both)
    return label.select(F.col("a").alias("id"), F.col("l").alias("component"))


def _stars(nodes: DataFrame, classes: DataFrame, percent: int, agree: int) -> DataFrame:
    """(a, b, same): each class b with those smallest members a of its nodes that it can be linked with, and how many coordinates agree."""
    x, y = (classes.select(F.col("id").alias(i), F.struct("n", "sketch").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    n, m, same = F.col("x.n"), F.col("y.n"), F.lit(0)
    for k in range(COORDS // 16):
        d = F.get("x.sketch", F.lit(k)).bitwiseXOR(F.get("y.sketch", F.lit(k)))
        differ = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 2)).bitwiseAND(F.lit(0x1111111111111111))
        same = same + 16 - F.bit_count(differ)
    met = nodes.where("a < id").select("a", F.col("id").alias("b")).distinct().join(x, "a").join(y, "b")
    return met.where((100 * F.least(n, m) >= percent * F.greatest(n, m)) & (same >= agree)).select("a", "b", same.alias("same"))


def _star_links(stars: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, component) after rounds of one confirmation a class: with its best star in another component that it has not been compared with."""
    left, links, component = cut(stars, "stars"), None, None
    for _ in range(ROUNDS):
        best = cut(left.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a")), "best")
        new = _confirm(best, classes, docs, shingle, percent)
        links = new if links is None else links.unionByName(new)
        component = components(links)
        if new.count() < FEW * best.count():
            break  # what is left is for the comparison of nodes
        ends = (component.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
        rest = left.join(best, ["a", "b"], "left_anti").join(next(ends), "a", "left").join(next(ends), "b", "left")
        rest = cut(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "same"), "stars")
        drop(left, best)
        left = rest
    drop(left, best)
    return links, component


def find(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 75, trees: int = TREES,
    small: int = SMALL, agree: int = AGREE,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document row.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id reachable, and a row is kept
    if it is its own.  Texts that are null or have no word have an empty set and
    link with nothing.  Repeated rows with one id are one node of the graph,
    linked wherever one of them is, also if their texts differ; a null id links
    with nothing and is kept (its component is null).  An empty table gives an
    empty result; other columns are not looked at.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = cut(docs.mapInArrow(lean(_signatures(shingle, COORDS)), "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>, sketch array<long>"), "sets")
    usable = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    kept = F.first(F.struct("sig", F.col("n_shingles").alias("n"), "sketch")).alias("c")
    first = usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"), kept).select("f1", "f2", "m", "x", "c.*")
    classes = cut(first.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    nodes = _roots(classes, trees)
    links, component = _star_links(_stars(nodes, classes, percent, agree), classes, docs, shingle, percent)
    mixed = _mixed(_named(nodes.select("node", "tree", "id", "size"), component))
    drop(nodes)
    leaves = [cut(x, "leaves") for x in _leaves(mixed, classes, trees, small)]
    drop(mixed)
    known = _named(classes.select("id", "n", "sketch"), component)
    hot = cut(_compared(leaves, known.withColumn("most", F.col("n")), small, percent, agree), "hot")
    if hot.limit(1).count():
        most = cut(_ceilings(hot, classes, docs, shingle), "most")
        left = cut(_compared(leaves, known.join(most, "id"), small, percent, agree), "left")
        own = cut(_sets(left, classes, docs, shingle), "own")
        links = links.unionByName(cut(_compared(leaves, known.join(most, "id").join(own, "id"), small, percent, agree), "links"))
        drop(most, left, own)
    drop(hot, *leaves)
    # to documents: links between classes join their smallest ids, and each document is linked with that of its class
    m = classes.select("id", "m")
    ends = links.join(m.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(m.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b").where("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    copies = usable.join(classes.where("m < x").select("f1", "f2", "m"), ["f1", "f2"]).where("doc_id > m").select(F.col("m").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = components(ends.unionByName(copies))
    out = sets.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """documents without those that another one of their component stands for, all columns as they are.

    Repeated rows of one id all stay or all go.  Rows with a null id, and texts
    that are null or empty, stay; an empty table stays empty.
    """
    gone = find(documents, id_col=id_col, **kw).where(~F.col("kept")).select(F.col("doc_id").alias(unused(documents, "gone"))).distinct()
    return documents.join(gone, documents[id_col].cast("long") == gone[gone.columns[0]], "left_anti")
