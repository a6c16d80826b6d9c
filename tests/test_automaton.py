"""The automaton's literals and results against plain expressions."""

import random
import re

from pyspark.sql import functions as F

from lithic.functions import automaton
from lithic.functions import text as T
from lithic.operators import tagging

PIECES = ["ab", "Cd", "x", r"\.", r"\b", "(ef|gh)", "[a-d]", "[^]x]", "y?", "z*", "k+", "m{2}", "n{0,2}", ".", "^", "$", r"\s", r"\w+", "(?:o(p)q)?", "|", "é", r"\(", "[(]", "r{2,}", " "]


def test_every_match_contains_a_literal():
    rng = random.Random(8)
    alphabet = [*"abcdxk.( é", "ab", "AB", "cD", "ef", "gh", "opq", "mm", "nn", "rrr", "y"]
    tried = 0
    for _ in range(4000):
        pattern = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 7)))
        try:
            rx = re.compile(pattern, re.I | re.A)
        except re.error:
            continue
        found = automaton.literals(pattern)
        for _ in range(25):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(9)))
            if found is not None and rx.search(text):
                tried += 1
                assert any(w in text.translate(automaton._LOWER) for w in found), (pattern, found, text)
    assert tried > 300


def test_literals_that_are_expected():
    assert automaton.literals(r"\binverse function\b") == ["inverse function"]
    assert automaton.literals(r"\basymptotes?\b") == ["asymptote"]
    assert automaton.literals(r"(^|[^\p{L}\p{N}_])The([^\p{L}]|$)") == ["the"]
    assert automaton.literals(r"left|RIGHT side") == ["left", "right side"]
    for none in (r"[*&%$]{3}", r"a|bcd", r"\d+", "", r"\x41bc", r"(?x) a b c", r"\Qa.b\E"):
        assert automaton.literals(none) is None, none


TEXTS = [
    None, "", "Find the INVERSE FUNCTION of f and sketch the curve", "hypothesis test at the 5% significance level, p-value", "one-one", "translated along the x axis of the graph", "binomial distribution B(12, 0.3)", "nothing here",
    "Maclaurin series\nand asymptotes", "least squares regression line of y on x", "position vector of the plane " * 200,
]


def test_a_table_says_what_the_unrolled_rules_say(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(2, TEXTS[2])], "id int, full_text string").repartition(3)
    pairs = [(c, p) for c, ps in tagging.RULES.items() for p in ps] + [("VEC", None), (None, "x"), ("VEC", tagging.RULES["VEC"][0]), ("ANY", r"\d{2}")]
    table = spark.createDataFrame(pairs, "code string, pattern string")
    rules = {**tagging.RULES, "ANY": (r"\d{2}",)}
    want = sorted(map(repr, tagging.rule_decisions(df, rules=rules).select("id", "hits", "reason", "tags").collect()))
    got = tagging.rule_decisions(df, rules=table).select("id", "hits", "reason", "tags")
    order = lambda rows: sorted(repr((r.id, sorted(r.hits.items()), r.reason, r.tags)) for r in rows)
    assert order(got.collect()) == order(tagging.rule_decisions(df, rules=rules).select("id", "hits", "reason", "tags").collect()) and want
    small = automaton.topic_hits(df, table, "full_text", block=7)
    assert sorted(repr((r.id, sorted(r.hits.items()))) for r in small.collect()) == sorted(repr((r.id, sorted(r.hits.items()))) for r in got.collect())
    assert automaton.topic_hits(df.limit(0), table, "full_text").count() == 0
    none = automaton.topic_hits(df, table.limit(0), "full_text").collect()
    assert all(r.hits == {} for r in none) and len(none) == len(TEXTS) + 1


def test_phrases_are_found_word_for_word(spark):
    texts = [None, "", "The big-cat_sat ON été!", "a big cat", "big cat big cat sat", "xbig cat", "bigcat sat on"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "Big cat")], "id int, t string").repartition(3)
    table = spark.createDataFrame([("A", "big cat"), ("A", "Big cat"), ("B", "cat sat on été"), ("B", "big  CAT"), ("C", "..."), (None, "big"), ("C", None), ("C", "cat big")], "code string, phrase string")
    want = sorted(map(repr, [(i, c, n) for i in (2, 3, 4, 5, None) for c, n in (("A", 2), ("B", 1 + (i == 2)), ("C", 1)) if i != 5 and (c != "C" or i == 4)]))
    for block in (50_000, 2):
        assert sorted(repr(tuple(r)) for r in automaton.phrase_hits(df, table, "id", "t", block=block).collect()) == want
    assert automaton.phrase_hits(df, table.limit(0), "id", "t").count() == 0


def test_phrases_need_no_expression_a_text(spark):
    """All words of ten thousand phrases stand in every text: candidates by one literal each would be all of them."""
    import time

    rng = random.Random(3)
    words = [f"w{k}x" for k in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3000))) for i in range(40)], "id int, t string").repartition(4)
    table = spark.range(10_000).selectExpr("'C' || id AS code", "'w' || id % 60 || 'x w' || id div 60 % 60 || 'x w' || id div 3600 || 'x w7x' AS phrase")
    began = time.time()
    assert automaton.phrase_hits(df, table, "id", "t").count() > 0
    assert time.time() - began < 20


def test_longest_alias_equals_the_unrolled_one(spark):
    titles = ["RI prelim", "xri", "Hwa Chong 2020", "st andrew junior", "mi promo", "st. andrew", "", None, "raffles institution vjc", "national junior college", "ri", "mid ri2", "nothing", "vjc-ri", "mi,hci", "himi"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    want = [tuple(r) for r in T.with_metadata(df, "title").orderBy("id").collect()]
    got = [tuple(r) for r in T.with_metadata(df, "title", table=T.aliases()).orderBy("id").collect()]
    assert got == want
    assert [r[0] for r in df.select(automaton.longest_alias(F.col("title"), [])["code"]).collect()] == [None] * len(titles)
    many = [(f"alias {k} of many", f"C{k}", "n") for k in range(30_000)]
    hit = spark.createDataFrame([("see alias 29999 of many, alias 1 of many",)], "t string").select(automaton.longest_alias(F.col("t"), many)["code"]).first()
    assert hit[0] == "C29999"
