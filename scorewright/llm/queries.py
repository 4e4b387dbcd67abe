"""One query per operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocation, divergence, embedding_dedup, exact_dedup, mixing, packing, pii, quality, simhash, substring_dedup, toxicity, url_filter
from .registry import ORACLES, QUERIES, query, table

LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query(rf"""
WITH parsed AS (
  SELECT page_id,
         {LOWER_SQL.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed)
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, parsed.host, parsed.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN best ON parsed.host = best.host AND parsed.path = best.path
""")
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rule_frame(spark, URL_RULES)).select(
        "page_id", "host", "path", "rule", "verdict")


@query(f"""
WITH t AS (SELECT doc_id, {LOWER_SQL.format("coalesce(text, '')")} AS n FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY doc_id DESC) = 1 AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(documents, table(spark, sf_dir, "labels")).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


MIX_WEIGHTS = [5.0, 2.0, 1.0]


@query(f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size,
         CAST('0x' || left(md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR), text)), 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
      FROM c WINDOW f AS (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS FIRST LIMIT 1), 'inf'::DOUBLE)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
p AS (SELECT d.*, source_size, target, passes, CAST(floor(target) AS BIGINT) - passes * source_size AS rest,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, passes * size + least(size, greatest(0, rest - start)) AS taken, source FROM p
""")
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"), MIX_WEIGHTS).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


@query("""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line
  FROM conversations),
c AS (SELECT conv_id, list(line ORDER BY i) AS lines, count(*) AS n FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT lines[1:i] AS lines FROM c JOIN t USING (conv_id) WHERE i < n),
d AS (SELECT min(conv_id) AS conv_id, n, lines, count(*) AS n_copies FROM c GROUP BY n, lines)
SELECT conv_id, n AS n_turns, n_copies, CAST(0 AS BIGINT) AS part, array_to_string(lines, '') AS text
FROM d ANTI JOIN p USING (lines)
""")
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render_chats(table(spark, sf_dir, "conversations"))


@query()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(documents).select("doc_id", "n_sentences", "n_removed", "text")


@query("""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings),
links AS (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.i <> b.i AND a.usable AND b.usable AND len(a.e) = len(b.e)
          AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT i AS a, i AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.i) AS n_links,
       (SELECT min(o.vec_id) FROM reach JOIN v o ON o.i = reach.b WHERE reach.a = v.i) AS component_id,
       v.vec_id IS NOT DISTINCT FROM (SELECT min(o.vec_id) FROM reach JOIN v o ON o.i = reach.b WHERE reach.a = v.i) AS kept
FROM v
""")
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


@query()
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


TOKENIZER = {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **TOKENIZER)


@query()
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined("base"), 256).alias("base_sha256"),
                        pii.joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))


@query(r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
parts AS (SELECT id, lang, unnest(regexp_extract_all(t, '[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+')) AS w,
                 unnest(range(len(regexp_extract_all(t, '[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+')))) AS i FROM docs),
marked AS (SELECT *, regexp_matches(w, '^[.,;:!?\x0A-\x0D]$') AS mark FROM parts),
seen AS (SELECT lang, w, mark, lead(w) OVER o AS w2, lead(mark) OVER o AS m2, lead(w, 2) OVER o AS w3, lead(mark, 2) OVER o AS m3
         FROM marked WINDOW o AS (PARTITION BY id ORDER BY i)),
grams AS (SELECT lang, 1 AS m, w AS phrase FROM seen WHERE NOT mark
          UNION ALL SELECT lang, 2, w || ' ' || w2 FROM seen WHERE NOT mark AND NOT m2
          UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM seen WHERE NOT mark AND NOT m2 AND NOT m3),
f AS (SELECT lang, m, phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
                CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
         FROM c JOIN (VALUES (1), (2)) AS s(k) ON k < m
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
most AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most FROM c, (VALUES (1), (2)) AS s(i) WHERE m = 3 GROUP BY ALL),
kept AS (SELECT scored.* FROM scored LEFT JOIN most ON scored.lang = most.lang AND scored.phrase = most.phrase
         WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine_collocations(table(spark, sf_dir, "documents"))


@query()
def op12_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(documents, table(spark, sf_dir, "labels")).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query(r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
l AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
gc AS (SELECT lang, source, term, count(*) AS c FROM words JOIN l USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM l GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) d
      LEFT JOIN (SELECT lang, source, sum(c) AS n FROM gc GROUP BY ALL) t ON d.lang = t.lang AND d.source = t.source),
p AS (SELECT g.lang, g.source, l.term, coalesce(gc.c, 0) AS c,
             CAST(1 + (1000000000::HUGEINT * (coalesce(gc.c, 0) + 5)) // (g.n + 5 * v.v) AS BIGINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (l.c + 5)) // (v.n + 5 * v.v) AS BIGINT) AS q
      FROM g JOIN l ON g.lang = l.lang JOIN v ON g.lang = v.lang
      LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = l.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
          ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
rows AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
         UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 50
""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
