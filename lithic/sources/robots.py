"""robots.txt texts as policies of hosts, and what they allow.

The line automaton is written as windows over the lines of a host's text: a
`User-agent` line that does not follow another one begins a group, a blank line
or the next group ends it, and a group counts if it has at least one rule.  A
policy is one row a host, joined on the host.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.functions import text as T

#: One group of a text, in the order of the text. Agents in lower case; a group for `*` is the default and has no other agents.
GROUP = "struct<grp:long,agents:array<string>,default:boolean,delay:double,rules:array<struct<pos:int,prefix:string,allow:boolean>>>"
# Fields that make a group count, and line ends.
RULES = ("allow", "disallow", "crawl-delay", "request-rate")
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def robots_url(url: Column) -> Column:
    """Where the rules of a URL's host are."""
    return F.concat(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.lit("/robots.txt"))


def lines(bodies: DataFrame) -> DataFrame:
    """(host, pos, field, value) of the lines of texts that matter; a blank line has the field ''."""
    raw = bodies.select("host", F.posexplode(F.split("body", LINE_END)).alias("pos", "raw"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    line = strip(F.regexp_replace("raw", "(?s)#.*", ""))
    cut = raw.withColumn("line", line).withColumn("field", F.lower(strip(F.regexp_extract("line", "(?s)^([^:]*):", 1)))).withColumn("value", T.unquoted(strip(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1))))
    return cut.where((F.col("raw") == "") | F.col("field").isin("user-agent", *RULES)).select("host", "pos", "field", "value")


def policies(bodies: DataFrame) -> DataFrame:
    """(host, groups) of texts (host, status, body), one a host; a text that could not be had (null, or status 400 and above) has no groups and so allows all."""
    had = F.col("body").isNotNull() & (F.coalesce("status", F.lit(200)) < 400)
    w = Window.partitionBy("host").orderBy("pos")  # the lines of one text
    kind = F.when(F.col("field").isin("", "user-agent"), F.col("field")).otherwise("rule")
    events = lines(bodies.where(had)).withColumn("kind", kind)
    begins = (F.col("kind") == "user-agent") & F.coalesce(F.lag("kind").over(w) != "user-agent", F.lit(True))
    # a rule counts while a group is open: the last line that is no rule names an agent
    opened = F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(w) == "user-agent"
    placed = events.withColumn("grp", F.sum(begins.cast("long")).over(w)).withColumn("opened", F.coalesce(opened, F.lit(False))).where("opened")
    agent, rule = F.col("kind") == "user-agent", F.col("kind") == "rule"
    names = F.transform(F.array_sort(F.collect_list(F.when(agent, F.struct("pos", F.lower("value").alias("v"))))), lambda x: x["v"])
    listed = F.array_sort(F.collect_list(F.when(F.col("field").isin("allow", "disallow"), F.struct("pos", F.col("value").alias("prefix"), (F.col("field") == "allow").alias("allow")))))
    delay = F.max_by(F.when((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^\d+$"), F.col("value").try_cast("double")), F.when((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^\d+$"), F.col("pos")))
    groups = placed.groupBy("host", "grp").agg(names.alias("agents"), listed.alias("rules"), delay.alias("delay"), F.bool_or(rule).alias("some")).where("some")
    groups = groups.withColumn("default", F.array_contains("agents", "*"))
    one = groups.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("grp", F.when(F.col("default"), F.array(F.lit("*"))).otherwise(F.col("agents")).alias("agents"), "default", "delay", "rules"))).alias("g"))
    # of several groups for everyone the first is the default
    default = F.array_min(F.transform(F.filter("g", lambda g: g["default"]), lambda g: g["grp"]))
    return one.select("host", F.filter("g", lambda g: ~g["default"] | (g["grp"] == default)).cast(f"array<{GROUP}>").alias("groups"))


def table(policies: DataFrame) -> DataFrame:
    """(host, grp, pos, agent, prefix, allow) of policies; a group without paths has one row with a null prefix for each agent."""
    g = policies.select("host", F.explode("groups").alias("g")).select("host", "g.grp", F.explode("g.agents").alias("agent"), "g.rules")
    return g.select("host", "grp", "agent", F.explode_outer("rules").alias("r")).select("host", "grp", "r.pos", "agent", "r.prefix", "r.allow")


def from_table(rules: DataFrame) -> DataFrame:
    """Policies of a rule table (host, pos, agent, prefix, allow); an agent's rules are one group, or those of a column grp where there is one."""
    group = F.col("grp").cast("string") if "grp" in rules.columns else F.lower("agent")
    rule = F.when(F.col("prefix").isNotNull(), F.struct(F.col("pos").cast("int").alias("pos"), T.unquoted(F.col("prefix")).alias("prefix"), "allow"))
    each = rules.select("host", group.alias("_g"), "pos", F.lower("agent").alias("agent"), rule.alias("rule")).groupBy("host", "_g").agg(
        F.coalesce(F.min("pos"), F.lit(0)).cast("long").alias("grp"), F.array_sort(F.collect_set("agent")).alias("agents"), F.array_sort(F.array_distinct(F.collect_list("rule"))).alias("rules")
    )
    whole = F.struct("grp", "agents", F.array_contains("agents", "*").alias("default"), F.lit(None).cast("double").alias("delay"), "rules")
    return each.groupBy("host").agg(F.array_sort(F.collect_list(whole)).cast(f"array<{GROUP}>").alias("groups"))


def _group(agent: str) -> Column:
    """The group that an agent follows: the first whose agents' names its own (up to a slash) contains, else the default."""
    name = F.lit(agent.split("/")[0].lower())
    named = F.filter("_groups", lambda g: ~g["default"] & F.exists(g["agents"], lambda a: F.contains(name, a)))
    return F.coalesce(F.get(named, F.lit(0)), F.get(F.filter("_groups", lambda g: g["default"]), F.lit(0)))


def applied(urls: DataFrame, policies: DataFrame, agents: tuple[str, ...], least: float = 0.0) -> DataFrame:
    """urls with host, `allowed` (whether the rules permit it to any of the agents) and `delay`.

    Of a group's rules the first whose prefix fits decides; percent escapes are
    resolved on both sides, an empty prefix permits, a star is a star, and where none fits the URL
    is permitted, as on hosts without a policy.  delay is that of the first agent
    whose group has one that is not 0, `least` at least.
    """
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    base = urls.drop("host").withColumn("host", host(F.col("url"))).withColumn("_path", T.unquoted(path))
    joined = base.join(policies.select("host", F.col("groups").alias("_groups")), "host", "left")

    def verdict(agent: str) -> Column:
        fits = F.filter(_group(agent)["rules"], lambda r: F.startswith(F.col("_path"), r["prefix"]))
        first = F.get(fits, F.lit(0))
        return F.coalesce(F.when(first["prefix"] == "", True).otherwise(first["allow"]), F.lit(True))

    some = reduce(lambda a, b: a | b, [verdict(a) for a in agents])
    delays = [F.nullif(_group(a)["delay"], F.lit(0.0)) for a in agents]
    out = joined.withColumn("allowed", some).withColumn("delay", F.greatest(F.coalesce(*delays, F.lit(0.0)), F.lit(least)))
    return out.drop("_groups", "_path")
