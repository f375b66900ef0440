"""The registered queries of the operators for training text, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webposture.llm import (
    collocations, decontaminate, exact_dedup, licenses, line_dedup, lm_score, mixing, near_dedup, order_minhash, resampling,
    substring_dedup, token_store, toxicity,
)
from webposture.llm.text import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights: documents labelled good weigh 1, those labelled bad a quarter."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return labels.select("doc_id", F.when(F.col("q") >= 1, 1.0).otherwise(0.25).alias("quality"))


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"), 5)))
    scored = toxicity.toxicity(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), 5).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), quality(spark, sf_dir))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeated_windows(table(spark, sf_dir, "documents"))


@query
def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 10)
    found = lm_score.scores(docs, lm_score.train(docs.where(~apart)))
    return found.select("doc_id", apart.alias("held_out"), *found.columns[1:])


def tokenizer_path() -> str:
    """Where the vocabulary lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op7_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_offsets(table(spark, sf_dir, "documents"), tokenizer_path)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.similar_lines(table(spark, sf_dir, "documents"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_report(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op4_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap FROM sources
), filled AS (
  SELECT *, ((sum(source_size::DOUBLE) OVER ())
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM levels
), goals AS (
  SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM filled
), rated AS (
  SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS rate
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), keyed AS (
  SELECT s.*, g.source_size, g.target,
         -ln((('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(r.rate, 1.0) AS key
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN rated r USING (doc_id)
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM keyed
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

ORACLE["op9_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), marked AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256 FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM marked
"""

ORACLE["op10_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), ds AS (
  SELECT doc_id, w, i, unnest(['0 ' || concat_ws(' ', w[i+1], w[i+2], w[i+3], w[i+4], w[i+7], w[i+8]),
                               '1 ' || concat_ws(' ', w[i+1], w[i+2], w[i+4], w[i+6], w[i+7], w[i+8])]) AS seed
  FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM d WHERE len(w) >= 8)
  UNION ALL
  SELECT doc_id, w, i, '2 ' || concat_ws(' ', w[i+1], w[i+2], w[i+3], w[i+4], w[i+5]) AS seed
  FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), bs AS (
  SELECT item_id, w, j, unnest(['0 ' || concat_ws(' ', w[j+1], w[j+2], w[j+3], w[j+4], w[j+7], w[j+8]),
                                '1 ' || concat_ws(' ', w[j+1], w[j+2], w[j+4], w[j+6], w[j+7], w[j+8])]) AS seed,
         13 AS size, 11 AS need
  FROM (SELECT item_id, w, unnest(range(len(w) - 7)) AS j FROM b WHERE len(w) >= 13)
  UNION ALL
  SELECT item_id, w, 0 AS j, '2 ' || concat_ws(' ', w[1], w[2], w[3], w[4], w[5]) AS seed, len(w) AS size, len(w) AS need
  FROM b WHERE len(w) BETWEEN 5 AND 12
), windows AS (
  SELECT doc_id, item_id, i, need, size, ds.w AS dw, bs.w AS bw, i - j AS shift,
         unnest(range(greatest(j - CASE WHEN size = 13 THEN 5 ELSE 0 END, 0), least(j, len(bs.w) - size) + 1)) AS a
  FROM ds JOIN bs USING (seed)
), judged AS (
  SELECT doc_id, item_id, i, need,
         list_sum([CASE WHEN shift + a + k >= 0 AND bw[a + k + 1] = dw[shift + a + k + 1] THEN 1 ELSE 0 END FOR k IN range(size)]) AS equal
  FROM windows
)
SELECT doc_id, item_id, max(equal)::INTEGER AS equal_words, min(i)::INTEGER AS first_word, (max(i) + 7)::INTEGER AS last_word
FROM judged WHERE equal >= need GROUP BY ALL
"""

ORACLE["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), runs AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang
), placed AS (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM runs, range(1, 6) sizes(size)
), f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates q
    WHERE q.lang = c.lang AND q.size > c.size AND 100 * q.a >= 100 * c.a AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""

ORACLE["op13_resample"] = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), vocabulary AS (
  SELECT DISTINCT unnest(w) AS word FROM words
), bits AS (
  -- The bytes of a word, and after each one eight steps of the division.
  SELECT word, flatten([[('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(octet_length(encode(word)))]) AS steps
  FROM vocabulary
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, steps),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) % 10000 AS bucket
  FROM bits
), features AS (
  SELECT side, doc_id, bucket FROM (SELECT side, doc_id, unnest(w) AS word FROM words) JOIN hashed USING (word)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM features GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain
  FROM counts
), weighed AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w ON w.doc_id = d.doc_id
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM ranked
"""
