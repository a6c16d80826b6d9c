"""A Merkle manifest of a dataset, and every leaf's proof by pointer jumping.

Leaves of one tree (a source) ascend by id; sixteen consecutive nodes become one
until one is left, the subroot; the subroots in the order of their sources make
the root in the same way.  Each inner node begins with a pointer to its parent
and one segment, the siblings to its left and right.  A round joins the nodes
with themselves: pointers jump to the ancestor's ancestor and segments are
concatenated, so the distance doubles and the rounds are the logarithm of the
depth.  Leaves of one run have the same way above them, so a run of sixteen is
what fetches a path, and its leaves add their own siblings.

H is the lowercase hex SHA-256 of the inputs concatenated, digests as hex text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop, unused

#: Children of a node.
ARITY = 16
#: The tree of the subroots; trees of leaves are numbered from 0.
TOP = -1

SEGMENT = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; null as -."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*cols: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with `pos` from 0 in each tree and `_part`, sizes (tree, n)): sorted into ranges, each of which numbers its own rows.

    A tree that spans many ranges is no single task: a range only adds how many
    rows of the tree the earlier ranges hold.  The last key is the row itself,
    so equal rows spread over ranges as well.
    """
    ranged = cut(rows.withColumn("_i", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "_i").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = cut(ranged.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range that the tree touches
    offsets = counts.select(F.col(tree).alias("_t"), F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part", tree).orderBy(*order, "_i")
    numbered = ranged.withColumn("_own", F.row_number().over(own) - 1).join(offsets, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t")))
    out = numbered.withColumn("pos", (F.col("_before") + F.col("_own")).cast("long")).drop("_own", "_before", "_t", "_p", "_part", "_i")
    return out, counts.groupBy(tree).agg(F.sum("n").alias("n"))


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """Sixteen consecutive nodes (tree, pos, m, digest, more) of trees of several as one row: kids in order, and the digest of all."""
    kids = F.array_sort(F.collect_list(F.struct((F.col("pos") % ARITY).cast("int").alias("i"), "digest", *more)))
    grouped = nodes.where("m > 1").groupBy("tree", F.expr(f"pos DIV {ARITY}").alias("run")).agg(kids.alias("kids"), F.first("m").alias("m"))
    return grouped.withColumn("digest", F.sha2(F.array_join(F.col("kids.digest"), ""), 256))


def _parents(runs: DataFrame) -> DataFrame:
    return runs.select("tree", F.col("run").alias("pos"), F.expr(f"(m + {ARITY - 1}) DIV {ARITY}").alias("m"), "digest")


def _siblings(digests: Column, i: Column) -> Column:
    return F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.lit(ARITY)), "").alias("right"))


def _climb(nodes: DataFrame, size: int, level: int) -> tuple[list[DataFrame], DataFrame, int]:
    """(links of nodes, roots, height) of trees of at most `size` nodes at `level`; each level is a sixteenth of the one below.

    nodes: (tree, pos, m, digest), m being the nodes of the tree at that level.
    links: node, parent, and the node's siblings.  roots: (tree, level, digest).
    """
    top = lambda n, k: n.where("m = 1").select("tree", F.lit(k).alias("level"), "digest")
    links, roots = [], [top(nodes, level)]
    while size > 1:
        runs = cut(_runs(nodes), "level")
        kid = runs.select("tree", "run", F.col("kids.digest").alias("d"), F.posexplode("kids").alias("i", "kid"))
        links.append(kid.select(
            "tree", F.lit(level).alias("level"), (F.col("run") * ARITY + F.col("i")).alias("pos"), F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.col("run").alias("up_pos"),
            F.array(_siblings(F.col("d"), F.col("i"))).alias("path"),
        ))
        level, size, nodes = level + 1, -(-size // ARITY), _parents(runs)
        roots.append(top(nodes, level))
    return links, reduce(DataFrame.unionByName, roots), level


def _jump(links: DataFrame, depth: int) -> DataFrame:
    """(tree, level, pos, path): every node's siblings from itself up to the root, after log2(depth) self-joins.

    Nodes that have arrived take no part in a join, so null pointers meet in no
    task; a pointer at a node without a row of its own points at the root.
    """
    nodes, reach = cut(links, "links"), 1
    key = ("tree", "level", "pos")
    while reach < depth:
        ways = nodes.select(*[F.col(c).alias(f"_{c}") for c in nodes.columns])
        at = reduce(lambda a, b: a & b, [F.col(f"up_{c}") == F.col(f"_{c}") for c in key])
        going = nodes.where("up_tree IS NOT NULL").join(ways, at, "left")
        step = going.select(*key, *[F.col(f"_up_{c}").alias(f"up_{c}") for c in key], F.concat("path", F.coalesce("_path", F.array().cast(SEGMENT))).alias("path"))
        last, nodes = nodes, cut(step.unionByName(nodes.where("up_tree IS NULL")), "jumped")
        drop(last)
        reach *= 2
    return nodes.select(*key, "path")


def proofs(leaves: DataFrame, tree_col: str, order_col: str, leaf_col: str, carry: list[str] | None = None) -> DataFrame:
    """One row a row of leaves: its order, tree and leaf columns and those of `carry`, subroot, root, and path.

    path is array<struct<left, right>>: the siblings at each level from the leaf
    up to the root, joined.  Leaves with equal order values are put in order by
    their digest, so repeated rows give the same tree however they are dealt; a
    null order value comes first, and a null tree is the first tree.  A lone leaf
    is its own subroot, a lone subroot the root.  An empty table gives no rows.
    Results whose names the given columns have get underscores.
    """
    carry = list(carry or [])
    kept = {f"_c{i}": c for i, c in enumerate(carry)}
    base = cut(leaves.select(F.col(tree_col).alias("_s"), F.col(order_col).alias("_o"), F.col(leaf_col).alias("digest"), *[F.col(c).alias(k) for k, c in kept.items()]), "leaves")
    placed, sizes = _ranked(base, "_s", ["_o", "digest"])
    trees, _ = _ranked(sizes.withColumn("_all", F.lit(TOP)), "_all", ["_s"])
    trees = cut(trees.select(F.col("_s").alias("_t"), F.col("pos").alias("tree"), F.col("n").alias("m")), "trees")
    most, n = trees.agg(F.coalesce(F.max("m"), F.lit(0)), F.count(F.lit(1))).first()  # the largest tree, and how many there are
    nodes = placed.join(trees, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    rest = ["_s", "_o", *kept]
    runs, alone = cut(_runs(nodes, *rest), "runs"), nodes.where("m = 1")
    links, roots, height = _climb(_parents(runs), -(-most // ARITY), 1)
    subroots = cut(roots.unionByName(alone.select("tree", F.lit(0).alias("level"), "digest")), "subroots")
    upper, root, more = _climb(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("m"), "digest"), n, 0)
    if upper:  # a subroot is the node of its own tree, not another one of the upper tree
        own = subroots.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"))
        first = upper[0].join(own, F.col("pos") == F.col("_tree"))
        upper[0] = first.select(F.col("_tree").alias("tree"), F.col("_level").alias("level"), F.lit(0).cast("long").alias("pos"), "up_tree", "up_level", "up_pos", "path")
    every = [*links, *upper]
    none = F.array().cast(SEGMENT)
    paths = _jump(reduce(DataFrame.unionByName, every), height + more).withColumnRenamed("tree", "_tree") if every else None
    at = lambda level, pos: (F.col("tree") == F.col("_tree")) & (F.col("_level") == level) & (F.col("_pos") == pos)

    def above(df: DataFrame, level: int, pos: Column) -> DataFrame:
        if paths is None:
            return df.withColumn("path", none)
        way = paths.where(F.col("level") == level).select("_tree", F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("path").alias("_path"))
        return df.join(way, at(level, pos), "left").withColumn("path", F.coalesce("_path", none))

    several = above(runs, 1, F.col("run")).select("tree", "path", F.col("kids.digest").alias("d"), F.explode("kids").alias("k"))
    several = several.select("tree", *[F.col(f"k.{c}").alias(c) for c in (*rest, "digest")], F.concat(F.array(_siblings(F.col("d"), F.col("k.i"))), "path").alias("path"))
    single = above(alone, 0, F.lit(0)).select(*several.columns)
    tops = subroots.select(F.col("tree").alias("_sub"), F.col("digest").alias("_subroot"))
    whole = several.unionByName(single).join(tops, F.col("tree") == F.col("_sub")).crossJoin(F.broadcast(root.select(F.col("digest").alias("_root"))))  # one root
    given = leaves.select(*dict.fromkeys([order_col, tree_col, leaf_col, *carry]))
    names = [unused(given, c) for c in ("subroot", "root", "path")]
    return whole.select(
        F.col("_o").alias(order_col), F.col("_s").alias(tree_col), F.col("digest").alias(leaf_col), *[F.col(k).alias(c) for k, c in kept.items()],
        F.col("_subroot").alias(names[0]), F.col("_root").alias(names[1]), F.col("path").alias(names[2]),
    )


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
