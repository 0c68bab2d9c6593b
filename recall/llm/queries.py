"""The operators as registered queries with their contracts' parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.llm import (collocations, exact_dedup, filter_audit, license_scan, line_dedup, packing, quality_classifier, quality_rules,
                        sharding, simhash, spm_codec, spot_signatures, toxicity)
from recall.llm.rows import documents, labels, located


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(located(documents(spark, sf_dir)))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = spm_codec.encode(located(documents(spark, sf_dir)), public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        "decoded_crc32", "parity", (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(located(documents(spark, sf_dir)), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = located(documents(spark, sf_dir))
    kept = line_dedup.drop_shared_lines(source, min_docs=10, min_chars=1)
    return kept.select(F.col("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(located(documents(spark, sf_dir))).drop("at")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(located(documents(spark, sf_dir)), words_per_shingle=4, most=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(located(docs), toxicity.learn(docs, labels(spark, sf_dir), most=12_000))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.judge(located(docs), quality_rules.learn(docs, labels(spark, sf_dir), most=4000)).drop("at")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digests(packing.pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1024))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score(located(documents(spark, sf_dir)), labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir), part="source")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), most_words=3, least=10, contained_percent=50, most=2000)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return spot_signatures.fingerprints(located(docs), spot_signatures.anchor_words(docs))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_sentencepiece, op3_sharding, op4_line_dedup, op5_license_scan, op6_simhash, op7_toxicity,
    op8_quality_rules, op9_packing, op10_quality_classifier, op11_filter_audit, op12_collocations, op13_fingerprints)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT k.*, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op11_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(source, '') AS part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws
            FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
        marks AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id),
        judged AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
                    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
                    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
            FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
        counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
        f AS (SELECT unnest(range(1, 6)) AS i),
        orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
                   WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        steps AS (
            SELECT part, o, s, fails[o[s]] AS failed, n, good, toxic,
                   len(list_filter(o[1:s - 1], lambda x: fails[x])) = 0 AS there,
                   len(list_filter([1, 2, 3, 4, 5], lambda x: fails[x])) = 1 AS alone
            FROM counts, orders, (SELECT unnest(range(1, 6)) AS s)),
        rows AS (
            SELECT part, o, s, coalesce(sum(n) FILTER (there AND NOT failed), 0) AS kept, coalesce(sum(n) FILTER (there AND failed), 0) AS removed,
                   coalesce(sum(n) FILTER (failed AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (failed AND alone), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (there AND failed), 0) AS good_lost, coalesce(sum(toxic) FILTER (there AND failed), 0) AS toxic_lost
            FROM steps GROUP BY part, o, s)
        SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', CAST(x AS INTEGER), 1)), '') AS filter_order, CAST(s AS INTEGER) AS step,
               CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, o[s]) AS BIGINT) AS shapley
        FROM rows""",
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang,
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
        suffixes AS (SELECT lang, w[i:i + 2] AS w FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces)),
        f AS (SELECT lang, k, array_to_string(w[1:k], ' ') AS phrase, count(*) AS f
              FROM suffixes, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k GROUP BY ALL),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
        cuts AS (
            SELECT c.lang, c.phrase, c.k AS words, c.a, cut, l.f AS l, r.f AS r,
                   CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        longer AS (
            SELECT lang, phrase, max(a) AS most FROM (
                SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
                UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
        ranked AS (
            SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
            FROM best LEFT JOIN longer ON best.words = 2 AND best.lang = longer.lang AND best.phrase = longer.phrase
            WHERE most IS NULL OR 100 * most < 50 * a)
        SELECT ranked.lang, rank, phrase, a, l, r, n, score
        FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) s ON s.lang = ranked.lang WHERE rank <= 2000""",
}
