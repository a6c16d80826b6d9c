"""Many patterns at once: an Aho-Corasick automaton over literal parts, expressions only for what it lets through.

A rule table (code, pattern) of any length costs one pass over a text.  Of each
pattern a literal that every match must contain goes into the automaton; the
patterns whose literals occur in a text are its candidates, and only these are
tried, on the JVM and with the same expressions as a short unrolled table.
Patterns without such a literal are candidates everywhere.

Phrases, rules that are words and nothing else, need no expressions: texts and
phrases are both reduced to their words, and what the automaton finds is the answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of one automaton, the bound of what the driver and a worker hold at once; longer tables are taken in blocks.
BLOCK = 50_000
#: Literals of fewer characters do not go into the automaton.
SHORTEST = 2
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _closing(pattern: str, i: int) -> int:
    """The place behind the bracket that closes the group or class that begins at i."""
    depth, inside = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]" or pattern[i - 1] == "[" or pattern[i - 2 : i] == "[^"
            depth -= not inside
            if not inside and depth == 0:
                return i + 1
        elif c == "[":
            inside, depth = True, depth + 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return i


def literals(pattern: str) -> list[str] | None:
    """For each alternative of a pattern its longest literal, A-Z in lower case; None if one has none.

    Every match of the pattern contains one of them.  Groups and classes are
    passed over, and so is a character that a quantifier makes optional.
    """
    if re.search(r"\(\?[a-zA-Z-]*x|\\Q", pattern):
        return None
    found, parts, run, i = [], [], "", 0

    def alternative():
        best = max([*parts, run], key=len)
        found.append(best.translate(_LOWER))
        parts.clear()

    while i < len(pattern):
        c, step = pattern[i], 1
        char = None
        if c == "|":
            alternative()
            run, i = "", i + 1
            continue
        if c == "\\" and i + 1 < len(pattern):
            nxt, step = pattern[i + 1], 2
            if not nxt.isalnum():
                char = nxt
            elif nxt in "pP" and pattern[i + 2 : i + 3] == "{":
                step = pattern.index("}", i) + 1 - i
            elif nxt in "xuc0123456789k":
                return None  # numeric escapes and back references are not read
        elif c in "([":
            step = _closing(pattern, i) - i
        elif c not in ".^$*+?{})]":
            char = c
        elif c == "{":
            step = max(pattern.find("}", i), i) + 1 - i
        i += step
        quantifier = re.match(r"[*?]|\{0*(?:,\d*)?\}", pattern[i:]) if char else None
        if char and not quantifier:
            run += char
            if pattern[i : i + 1] in ("+", "{"):
                parts.append(run)
                run = ""
        else:
            parts.append(run)
            run = ""
    alternative()
    return None if min(map(len, found)) < SHORTEST else found


def _automaton(words: dict[str, list[int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, ids in words.items():
        a.add_word(w, ids)
    a.make_automaton()
    return a


def _blocks(rules: DataFrame, size: int, keys: list[str] | None = None) -> Iterator[list[tuple]]:
    """The distinct rows of a rule table in blocks of about `size`, each of which fits the driver; rows equal in `keys` share a block."""
    n = rules.count()
    k = max(1, -(-n // size))
    for b in range(k):
        part = rules if k == 1 else rules.where(F.pmod(F.xxhash64(*(keys or rules.columns)), F.lit(k)) == b)
        yield sorted(tuple(r) for r in part.collect())


def _candidates(block: list[tuple[str, str]]):
    """A UDF: array<struct<code, pattern>> of the rules of a block that a text may match."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words: dict[str, list[int]] = {}
        always = []
        for k, (_, pattern) in enumerate(block):
            found = literals(pattern)
            if found is None:
                always.append(k)
            for w in set(found or ()):
                words.setdefault(w, []).append(k)
        a = _automaton(words) if words else None
        for s in texts:
            out = []
            for t in s:
                hit = set()
                for _, ids in a.iter((t or "").translate(_LOWER)) if a else ():
                    hit.update(ids)
                out.append([{"code": block[k][0], "pattern": block[k][1]} for k in sorted(hit.union(always))])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<code:string,pattern:string>>")


def topic_hits(questions: DataFrame, rules: DataFrame, text_col: str, out: str = "hits", block: int = BLOCK) -> DataFrame:
    """questions with a map code -> number of the code's distinct patterns that are found in the text, without regard to A-Z's case.

    rules: (code, pattern).  A null text is empty; a code without a match is left
    out; nulls in rules are passed over.
    """
    table = rules.select(F.col("code").cast("string").alias("code"), F.col("pattern").cast("string").alias("pattern")).dropna().distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = []
    for b in _blocks(table, block):
        cols.append(F.filter(_candidates(b)(text), lambda c: F.rlike(text, F.concat(F.lit("(?i)"), c["pattern"]))))
    hits = F.transform(F.concat(*cols), lambda c: c["code"])
    staged = questions.withColumn("_codes", hits)
    counted = F.transform(F.array_sort(F.array_distinct("_codes")), lambda c: F.struct(c, F.size(F.filter("_codes", lambda x: x == c))))
    return staged.withColumn(out, F.map_from_entries(counted)).drop("_codes")


def words_apart(text: Column) -> Column:
    """The words of a text, runs of letters and numbers with A-Z in lower case, each between single spaces."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def _found(block: list[tuple[str, str]], id_col: str):
    def run(batches):
        words: dict[str, list[str]] = {}
        for code, phrase in block:
            words.setdefault(phrase, []).append(code)
        a = _automaton({w: [w] for w in words}) if words else None
        for batch in batches:
            rows, codes, counts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist() if a else ()):
                hits = Counter(c for w in {w for _, (w,) in a.iter(t)} for c in words[w])
                rows += [i] * len(hits)
                codes += hits.keys()
                counts += hits.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(codes, pa.string()), pa.array(counts, pa.int32())], [id_col, "code", "n"])

    return run


def phrase_hits(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(id, code, n): how many of a code's distinct phrases stand in a text, word for word without regard to A-Z's case and to what is between words.

    phrases: (code, phrase).  Phrases without a word and nulls are passed over;
    phrases that differ in case count each.  A table of up to `block` phrases
    costs one pass over the texts, whatever they have in common with them.
    """
    table = phrases.select(F.col("code").cast("string").alias("code"), F.col("phrase").cast("string").alias("phrase")).dropna().distinct()
    table = table.select("code", words_apart(F.col("phrase")).alias("words"), "phrase").where("words <> ' '")
    rows = texts.select(id_col, words_apart(F.col(text_col)).alias("_words"))
    kind = f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, code string, n int"
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_found([r[:2] for r in b], id_col), kind) for b in _blocks(table, block, ["code"])])


def longest_alias(blob: Column, aliases: list[tuple[str, str, str]], bounded=()) -> Column:
    """struct(code, name) of the longest of (alias, code, name) in a text; ties to the earlier one, null without one.

    Aliases in `bounded` only count between characters that are not a-z.
    """
    edge = frozenset(bounded)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        for k, (alias, _, _) in enumerate(aliases):
            if alias:
                first.setdefault(alias, k)
        a = _automaton({w: [k] for w, k in first.items()}) if first else None
        for s in texts:
            out = []
            for t in s:
                best = None
                for end, (k,) in a.iter(t) if a and t else ():
                    alias = aliases[k][0]
                    at = end - len(alias)
                    if alias in edge and (at >= 0 and "a" <= t[at] <= "z" or end + 1 < len(t) and "a" <= t[end + 1] <= "z"):
                        continue
                    best = min(best or (0, 0), (-len(alias), k))
                out.append((aliases[best[1]][1], aliases[best[1]][2]) if best else (None, None))
            yield pd.DataFrame(out, columns=["code", "name"])

    return F.pandas_udf(run, "code string, name string")(blob)
