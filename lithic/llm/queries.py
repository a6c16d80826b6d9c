"""The registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, chat, decontaminate, exact, language, merkle, mixing, neardup, quality, recompress, suffixes, topk, urls
from .common import table


def op1_chat(spark, sf_dir):
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    found = chat.read_back(chat.format_trees(chat.linear_messages(rows), unique=True))
    conv = F.when(F.startswith("key", F.lit("=")), F.substring("key", 2, 40).cast("long"))
    return found.select(conv.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out("doc_id", 3, 1)))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs.where(~quality.held_out("doc_id", 5, 0)))
    return language.predict(docs.select("doc_id", "text"), net).select("doc_id", quality.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark, sf_dir):
    return recompress.digest(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    return neardup.find(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_suffix_dedup(spark, sf_dir):
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op10_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return exact.classes(docs.select("doc_id", "text", F.sha2(exact.normalised(F.col("text")), 256).alias("text_sha256")), carry=["text_sha256"])


def op12_token_alignment(spark, sf_dir):
    found = align.align(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(F.translate("text", upper, upper.lower())))
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    out = merkle.proofs(leaves, "source", "doc_id", "leaf", ["tampered"])
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_quality, op3_language, op4_substring_dedup, op5_near_dedup, op6_mixing, op7_url_filter, op8_decontaminate, op9_suffix_dedup, op10_topk, op11_exact_dedup, op12_token_alignment, op13_merkle)}

_W8 = r"""list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
ORACLE_SQL = {
    "op11_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY norm) AS n FROM d WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id))
SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
    # nodes level by level, first of the sources, then of their subroots; a leaf walks up by the siblings at each level
    "op13_merkle": r"""
WITH RECURSIVE f AS (SELECT doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
p AS (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(low) || ':' || low, '-') AS tampered FROM f),
bits AS (SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) r(i))),
l AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || tampered) AS changed, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, x: xor(c // 256, tab[(xor(c % 256, x) + 1)::INTEGER]))) AS crc FROM p, bits),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS m FROM l),
n AS (SELECT tree, 0 AS lvl, pos, m, leaf AS h FROM o
  UNION ALL SELECT tree, lvl + 1, pos // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM n WHERE m > 1 GROUP BY tree, lvl, pos // 16, m),
t AS (SELECT -1::BIGINT AS tree, 0 AS lvl, tree AS pos, (SELECT count(DISTINCT tree) FROM o) AS m, h FROM n WHERE m = 1
  UNION ALL SELECT tree, lvl + 1, pos // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE m > 1 GROUP BY tree, lvl, pos // 16, m),
s AS (SELECT tree, lvl, pos, m, h, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM (SELECT * FROM n UNION ALL SELECT * FROM t)),
w AS (SELECT doc_id, leaf, tree AS home, tree, 0 AS lvl, pos, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END AS fold, '' AS proof FROM o
  UNION ALL SELECT doc_id, leaf, home, CASE WHEN m > 1 THEN w.tree ELSE -1 END, CASE WHEN m > 1 THEN w.lvl + 1 ELSE 0 END, CASE WHEN m > 1 THEN w.pos // 16 ELSE home END,
    CASE WHEN m > 1 THEN sha256(a || fold || b) ELSE fold END, CASE WHEN m > 1 THEN proof || a || b ELSE proof END FROM w JOIN s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = w.pos WHERE m > 1 OR w.tree >= 0)
SELECT doc_id, leaf, (SELECT h FROM n WHERE n.tree = home AND n.m = 1) AS subroot, t.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.h AS verified
FROM w JOIN t ON w.tree = -1 AND t.m = 1 AND w.lvl = t.lvl""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_W8.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_W8.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[k : k + 9] AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, k, n, w[k : k + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN bw USING (g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op1_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length('<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10))) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM t""".replace("\\\\", "\\"),
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 49)) AS p FROM g JOIN m USING (h) WHERE doc_id > first),
rl AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN rl USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op5_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k : k + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, min(r.c) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op10_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
