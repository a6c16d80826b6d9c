"""URL filter by association rules, in DataFrame operations throughout.

A URL becomes a set of tokens: its host's registered end, each label of the host
with its place, and the path's directories.  FP-growth mines token combinations
from labelled URLs; rules "tokens -> block" and "tokens -> allow" stay if their
support and confidence suffice and no smaller rule with the same verdict is as
confident.  A rule is kept in an inverted index under its rarest token, so a URL
meets only rules whose rarest token it has, and a subset test decides.

Host and path rules given by hand (see `HostPathRule`) stand above mined ones:
a rule fits its host and all subdomains when the path begins with the rule's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path)
HostPathRule = tuple[str, str, str]
RULES: tuple[HostPathRule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MAX_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels counted from the right (`h0:net`), and path directories by level (`p1:en`); numbers become #."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    dirs = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), shape(x)))
    paths = F.transform(dirs, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), shape(x)))
    return F.array_distinct(F.concat(hosts, paths))


def given_rules(host: Column, path: Column, rules: tuple[HostPathRule, ...] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; the rule list is short and becomes one expression.

    Longest: by the characters of host and path together; for equal length the earlier rule.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]) - len(rules[i][2]), i))
    out = None
    for i in order:
        verdict, h, p = rules[i]
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _together(items: DataFrame) -> DataFrame:
    """(token, group): tokens that stand in exactly the same rows have one group, their smallest one.

    A row's name is a hash of its number; equal counts, sums and exclusive ors of names mean equal rows.
    """
    name = F.xxhash64("row")
    signs = items.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(name).alias("x"), F.sum(F.shiftrightunsigned(name, 24)).alias("s"), F.sum(F.shiftrightunsigned(F.xxhash64("row", F.lit(1)), 24)).alias("s2")
    )
    groups = signs.groupBy("n", "x", "s", "s2").agg(F.min("token").alias("group"))
    return signs.join(groups, ["n", "x", "s", "s2"]).select("token", "group", "n")


def _kept(rules: DataFrame) -> DataFrame:
    """rules (needs, verdict, confidence, ...) of which no smaller one of the same verdict, part of it, is at least as confident.

    Every part of a frequent set is frequent, so it suffices to look one token
    down, level by level, at the best confidence of a set and of all its parts.
    """
    rules = cut(rules, "rules")
    levels = [r[0] for r in rules.select("size").distinct().orderBy("size").collect()]
    below, kept = None, []
    for k in levels:
        level = rules.where(F.col("size") == k)
        if below is None:
            level = level.withColumn("part", F.lit(-1.0))
        else:
            parts = level.select("needs", "verdict", F.explode("needs").alias("x")).select("needs", "verdict", F.array_remove("needs", F.col("x")).alias("p"))
            best = parts.join(below.select(F.col("needs").alias("p"), "verdict", "best"), ["p", "verdict"]).groupBy("needs", "verdict").agg(F.max("best").alias("part"))
            level = level.join(best, ["needs", "verdict"], "left").withColumn("part", F.coalesce("part", F.lit(-1.0)))
        below = cut(level.withColumn("best", F.greatest("confidence", "part")), "level")
        kept.append(below.where(F.col("confidence") > F.col("part")).drop("part", "best"))
    return reduce(DataFrame.unionByName, kept)


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from rows (tokens array<string>, blocked boolean): id, needs, size, rarest, verdict, confidence, support.

    Null token sets and null labels take no part.  With no labelled row there
    are no rules.  Tokens that only occur together are mined as one item and
    come back as several in a rule's needs, so one long URL does not give all
    subsets of its tokens.  `min_support` bounds the frequent items that
    FP-growth keeps.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col("tokens").isNotNull() & F.col("blocked").isNotNull())
    known = cut(known.select(F.array_distinct("tokens").alias("tokens"), "blocked").withColumn("row", F.monotonically_increasing_id()), "labelled")
    empty = "id long, needs array<string>, size int, rarest string, verdict string, confidence double, support double"
    total = known.count()
    if not total:
        return spark.createDataFrame([], empty)
    groups = cut(_together(known), "groups")
    label = F.when(F.col("blocked"), F.lit("!block")).otherwise(F.lit("!allow"))
    named = known.select("row", F.explode_outer("tokens").alias("token")).join(groups.select("token", "group"), "token", "left").groupBy("row").agg(F.collect_set("group").alias("g"))
    items = named.join(known.select("row", label.alias("label")), "row").select(F.concat("g", F.array("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(items)
    sets = cut(model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~x.isin("!block", "!allow"))).alias("needs"), F.filter("items", lambda x: x.isin("!block", "!allow")).alias("v"), "freq"), "frequent")
    plain = sets.where((F.size("v") == 0) & (F.size("needs") > 0)).select("needs", F.col("freq").alias("all"))
    both = sets.where((F.size("v") == 1) & (F.size("needs") > 0)).join(plain, "needs")
    confidence = F.col("freq") / F.col("all")
    rules = both.select("needs", F.substring(F.col("v")[0], 2, 5).alias("verdict"), confidence.alias("confidence"), (F.col("freq") / F.lit(float(total))).alias("support"), F.size("needs").alias("size"))
    kept = _kept(rules).where(F.col("confidence") >= min_confidence)
    kept = kept.select(F.xxhash64("needs", "verdict").alias("id"), F.col("needs").alias("mined"), "verdict", "confidence", "support")
    tokens = kept.select("id", F.explode("mined").alias("group")).join(groups, "group")
    named = tokens.groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("needs"), F.min_by("token", F.struct("n", "token")).alias("rarest"))
    out = kept.join(named, "id").select("id", "needs", F.size("needs").alias("size"), "rarest", "verdict", "confidence", "support")
    return cut(out, "rules")


def match(token_sets: DataFrame, rules: DataFrame, default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """For each distinct token set: the most confident rule that it contains, as verdict and rule id; else the default.

    The inverted index, rules under their rarest token, is broadcast if it has
    at most `max_rules` rows and joined by a shuffle beyond that.  Null token
    sets get the default.
    """
    index = rules.select("id", "needs", "size", "rarest", "verdict", "confidence")
    index = F.broadcast(index) if rules.count() <= max_rules else index
    met = token_sets.select("tokens", F.explode("tokens").alias("rarest")).join(index, "rarest").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = met.groupBy("tokens").agg(F.max(F.struct("confidence", "size", (F.col("verdict") == "block").alias("b"), "id", "verdict")).alias("best"))
    return token_sets.join(best, "tokens", "left").select("tokens", F.coalesce(F.col("best")["verdict"], F.lit(default)).alias("mined"), F.col("best")["id"].alias("mined_id"))


def judge(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[HostPathRule, ...] = RULES, labels: DataFrame | None = None,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_id (the mined rule that decided, where one did).

    Labels for mining are rows (page_id, blocked); without them the URLs that a
    given rule decides are the labelled ones.  A null URL or one without ``://``
    has empty host and path and gets the default.  Repeated rows are each judged;
    an empty table gives none; other columns are not looked at.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = urls.withColumn("host", host).withColumn("path", path).drop("url")
    parsed = parsed.withColumn("given", given_rules(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    if labels is None:
        labelled = parsed.where(F.col("given").isNotNull()).select("tokens", (F.col("given")["verdict"] == "block").alias("blocked"))
    else:
        labelled = parsed.join(labels.select("page_id", F.col("blocked").cast("boolean").alias("blocked")), "page_id").select("tokens", "blocked")
    found = mine(labelled, min_support=min_support, min_confidence=min_confidence)
    # far fewer token sets than URLs; each is matched once and the verdict joined back
    verdicts = cut(match(parsed.select("tokens").distinct(), found, default), "verdicts")  # a table, so both sides of the join can be split
    out = parsed.join(verdicts.withColumnRenamed("tokens", "t"), F.col("tokens") == F.col("t"), "left")
    return out.select(
        "page_id", "host", "path", F.col("given")["rule"].alias("rule"), F.coalesce(F.col("given")["verdict"], F.col("mined"), F.lit(default)).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("mined_id")).alias("mined_id"),
    )
