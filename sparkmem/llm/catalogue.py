"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitsliced import ranked_search
from .common import table
from .decontaminate import decontaminate
from .htmltext import main_text
from .jaccard import jaccard_groups
from .langid import fit, predict
from .linededup import line_dedup
from .lm import lm_scores
from .neighbourpack import neighbour_pack
from .packing import pack
from .spelling import spelling_groups
from .substrings import remove_copies
from .tokencount import document_tokens
from .topk import top_k

#: Vocabulary files of op9 and op11, by name.
PACKING_VOCABULARY, NEIGHBOUR_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(table(spark, sf_dir, "documents"), _draw(10) != 0, vocabulary(PACKING_VOCABULARY))
    return found.select("doc_id", F.coalesce(_draw(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_blocks").alias("n_blocks"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY))


def _draw(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(_draw(4) != 2))
    found = predict(documents, model)
    return found.select("doc_id", F.coalesce(_draw(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pack(table(spark, sf_dir, "documents"), vocabulary(NEIGHBOUR_VOCABULARY))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_substrings": op2_substrings,
    "op3_lm": op3_lm,
    "op4_lines": op4_lines,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard": op6_jaccard,
    "op7_html": op7_html,
    "op8_tokens": op8_tokens,
    "op9_pack": op9_pack,
    "op10_language": op10_language,
    "op11_neighbours": op11_neighbours,
    "op12_ranked": op12_ranked,
    "op13_spelling": op13_spelling,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_BLANK_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op2_substrings": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING max(doc_id) > min(doc_id)),
r AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS before FROM w JOIN m ON m.s = w.s WHERE low < w.doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, span),
q AS (SELECT p.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY p.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY p.doc_id ORDER BY a), 0))) AS piece, h FROM p JOIN d ON d.doc_id = p.doc_id),
g AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(piece, '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op6_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM j JOIN c AS x ON x.doc_id = a JOIN c AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) AS r ON r.doc_id = d.doc_id""",
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op12_ranked": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS nn, sum(len(w)) AS l FROM d),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY row, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t, c GROUP BY term, nn),
m AS (SELECT row, doc_id, 100 - 25 + CAST(25 * len(w) * nn AS BIGINT) // CAST(l AS BIGINT) AS m FROM d, c WHERE len(w) > 0),
a AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM q) GROUP BY item, item_id, term),
s AS (SELECT item, item_id, m.row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM a JOIN t ON a.term = t.term JOIN f ON f.term = t.term JOIN m ON m.row = t.row GROUP BY item, item_id, m.row, doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 20""",
    "op13_spelling": rf"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT doc_id, {_LOWER.format('run')} AS run, count(*) AS k FROM o GROUP BY ALL),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(str_split(bits, ''), lambda x: CAST(x AS BIGINT))),
      lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)))) AS h
      FROM (SELECT run, k, array_to_string(list_transform(range(0, octet_length(b)), lambda i: reverse(CAST(substr(CAST(CAST(b AS BIT) AS VARCHAR), 8 * i + 1, 8) AS VARCHAR))), '') AS bits
            FROM (SELECT run, k, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b FROM g))),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
p AS (SELECT word, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT x.word AS word, y.word AS near FROM p AS x JOIN p AS y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
      UNION SELECT p.word, w.word FROM p JOIN w ON w.word = p.a || p.z
      UNION SELECT w.word, p.word FROM p JOIN w ON w.word = p.a || p.z),
b AS (SELECT e.word, count(*) AS n_near, first(near ORDER BY w.n DESC, encode(near)) AS near, max(w.n) AS most FROM e JOIN w ON w.word = e.near GROUP BY e.word),
f AS (SELECT w.word, CASE WHEN most >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN most END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
r AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY word) AS l ON l.word = f.word""",
}
