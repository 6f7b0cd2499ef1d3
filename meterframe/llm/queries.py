"""The registered queries of the text operators and their SQL counterparts.

Each query applies its operator with production parameters to the whole table
and derives the digest columns; the operators themselves return texts, spans
and structures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    hard_negatives,
    language_id,
    permutation_index,
    quality_classifier,
    quality_rules,
    secrets,
    sentencepiece_nbest,
    simhash,
    substring_dedup,
    token_alignment,
    token_counts,
    toxicity,
)
from .frames import documents, id_crc, materialize, table, unsigned_hex


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.learn(docs))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    base = F.filter("spans", lambda x: x["kind"] != "grammar")
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
        F.size(of("grammar")).cast("long").alias("n_grammar"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(documents(spark, sf_dir))
    base = quality_rules.Policy("base", 1, quality_rules.BASE)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(base)).alias("base_failed"),
        quality_rules.passes(quality_rules.POLICIES[-1]).alias("kept"),
        "n_lines", "n_distinct_words", "failed_bits")


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.ledger(documents(spark, sf_dir)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_crc() % 3 == 1
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).select(
        "doc_id", held_out.alias("held_out"), "toxicity.severity", "toxicity.grade", "toxicity.p_toxic",
        (F.col("toxicity.p_toxic") >= 0.5).alias("toxic"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir)).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_crc() % 3 == 1
    model = quality_classifier.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "quality.score", "quality.predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    hits = decontamination.contamination(docs, items)
    found = decontamination.word_count(docs).join(hits, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce(F.array_join("items", ","), F.lit(""))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(documents(spark, sf_dir), digest=True) \
        .select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op9_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document, and whether the best
    one decodes to the text."""
    best = sentencepiece_nbest.encode(documents(spark, sf_dir), n=3)
    at = lambda i, what: F.get("segmentations", F.lit(i))[what]
    flat = best.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        (F.octet_length(at(0, "ids")) / 4).cast("long").alias("n_pieces"),
        *[at(i, "score").alias(f"score_{i + 1}") for i in range(3)],
        *[F.sha2(F.coalesce(at(i, "ids"), F.lit(b"")), 256).alias(f"ids_{i + 1}_sha256") for i in range(3)],
        at(0, "ids").alias("ids"))
    return sentencepiece_nbest.decode(flat, "ids").withColumn("decoded", F.col("ids") == F.col("text")) \
        .drop("ids", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_crc() % 5 == 0
    model = language_id.train(table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(~held_out))
    return language_id.identify(documents(spark, sf_dir), model).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.col("alignment")
    return token_alignment.alignment(documents(spark, sf_dir)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[got[c].alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        F.when(got["n_a"] > 0, F.sha2(got["groups"], 256)).otherwise("").alias("groups_sha256"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_toxicity": op3_toxicity,
        "op4_token_counts": op4_token_counts,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_decontamination": op6_decontamination,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_sentencepiece_nbest": op9_sentencepiece_nbest,
        "op10_language_id": op10_language_id,
        "op11_token_alignment": op11_token_alignment,
        "op12_nearest_neighbours": op12_nearest_neighbours,
        "op13_hard_negatives": op13_hard_negatives,
        "rule_ablation": rule_ablation,
    }


_LEDGER_SQL = r"""
w0 AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents),
grams AS (
  SELECT r, i AS p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w0 WHERE len(w) >= 3)),
dup AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c >= 2),
covered AS (
  SELECT r, count(DISTINCT q) AS n
  FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY r),
m AS (
  SELECT w0.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words
  FROM w0 LEFT JOIN covered USING (r)),
bits AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_distinct_words < 5 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed_bits
  FROM m)
"""

OP2_SQL = f"""
WITH {_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       failed_bits = 0 AS kept, n_lines, n_distinct_words, failed_bits
FROM bits
"""

RULE_ABLATION_SQL = f"""
WITH {_LEDGER_SQL},
rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8),
                            ('long_words', 16), ('duplicate_lines', 32), ('low_variety', 64)),
policies(policy, version, mask) AS (VALUES ('base', 1, 3), ('standard', 1, 7), ('standard', 2, 127))
SELECT policy, version, rule, count(*) AS n_docs,
       count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_failed,
       count(*) FILTER (WHERE failed_bits & mask = bit) AS n_only_this,
       count(*) FILTER (WHERE failed_bits & mask = 0) AS n_kept,
       count(*) FILTER (WHERE failed_bits & mask & ~bit = 0) AS n_kept_without
FROM bits, policies, rules
WHERE mask & bit <> 0
GROUP BY policy, version, rule
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT DISTINCT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) >= 2)),
cov AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM rep),
gone AS (SELECT r, count(*) AS n, list(p) AS ps FROM cov GROUP BY r),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS k
  FROM (SELECT d.r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d JOIN gone USING (r)) t
  WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.r = t.r AND cov.p = t.p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
        FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
   AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": OP2_SQL,
        "op6_decontamination": OP6_SQL,
        "op8_substring_dedup": OP8_SQL,
        "op13_hard_negatives": OP13_SQL,
        "rule_ablation": RULE_ABLATION_SQL,
    }
