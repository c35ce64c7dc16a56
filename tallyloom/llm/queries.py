"""The queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dialogue, exact_dedup, importance, langid, licenses, mixing, pst, quality, sharding, simhash, token_counts, warc
from .common import shared_dir, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after a session of edits."""
    return token_counts.count_with_edits(token_counts.sample_edits(table(spark, sf_dir, "documents")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_back(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the shards as written and read again."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/tallyloom/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, path)
    return sharding.report_shards(spark, path, docs.schema)


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by the contract's rule, then repaired."""
    return dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations")), F.col("dropped"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash_near_dedup, op3_exact_dedup, op4_language_id, op5_mixing, op6_quality_rules, op7_warc, op8_sharding, op9_suffix_tree, op10_bpe, op11_licenses, op12_importance, op13_dialogue)}

_GAP = r"[\x20\x09-\x0D]+"
_UNSPACED = quality.UNSPACED.replace("{Is", "{")
_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_RULES = ", ".join(
    f"CASE WHEN {r.where} AND coalesce({' OR '.join(f'{a} / nullif({b}, 0) {op} {x!r}' for op, x in (('<', r.least), ('>', r.most)) if x is not None)}, true) THEN '{r.name}' END"
    for r in quality.RULES for a, b in [r.measure.split(" / ")]
)

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op5_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> ''))::BIGINT AS size,
                -ln((('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
                / ((1.0 + coalesce(length(regexp_replace(text, '{mixing.NOISE}', '', 'g')), 0)) / (1.0 + coalesce(length(text), 0))) AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
        c AS (SELECT *, sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights,
                row_number() OVER (ORDER BY source_size * 3 / weight, source NULLS LAST) AS k FROM w),
        f AS (SELECT k AS first, rest AS level, weights AS shared FROM c WHERE rest * weight <= source_size * 3 * weights ORDER BY k LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN k >= first THEN (weight * level)::DOUBLE / shared::DOUBLE ELSE (source_size * 3)::DOUBLE END AS target FROM c LEFT JOIN f ON true),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
        p AS (SELECT d.*, source_size, target, epochs, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM p""",
    "op6_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        v AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 8),
        e AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER k, lead(x, 2) OVER k, lead(x, 3) OVER k, lead(x, 4) OVER k, lead(x, 5) OVER k, lead(x, 6) OVER k, lead(x, 7) OVER k) AS s, lead(i, 7) OVER k IS NOT NULL AS whole
                FROM v WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(s)) AS c FROM e WHERE whole),
        r AS (SELECT doc_id, sum(least(8, i - coalesce(last, i - 8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM g WHERE c > 1) GROUP BY doc_id),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
                (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclamations,
                length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals, length(t) - length(regexp_replace(t, '{_UNSPACED}', '', 'g')) AS n_unspaced, length(array_to_string(w, '')) - (length(t) - length(regexp_replace(t, '\p{{Latin}}', '', 'g'))) AS n_no_latin, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words
                FROM d LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEATED} AS base_failed, array_to_string(list_filter([{_RULES}], lambda x: x IS NOT NULL), ',') AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM b""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, payload_bytes, sha1(h) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to FROM k""",
    "op12_importance": rf"""
        WITH RECURSIVE bit AS (SELECT i AS b, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bit WHERE k < 8),
        crc AS (SELECT list(v ORDER BY b) AS c FROM bit WHERE k = 8),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents), q AS (SELECT {_WORDS} AS w FROM benchmark),
        dw AS (SELECT doc_id, unnest(w) AS x FROM d), qw AS (SELECT unnest(w) AS x FROM q),
        xs AS (SELECT x, hex(x) AS h FROM (SELECT x FROM dw UNION SELECT x FROM qw)),
        step AS (SELECT x, h, 0 AS k, 4294967295::BIGINT AS v FROM xs
            UNION ALL SELECT x, h, k + 1, xor(v // 256, c[xor(v % 256, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) + 1]) FROM step, crc WHERE 2 * k < length(h)),
        bucket AS (SELECT x, xor(v, 4294967295) % {importance.BUCKETS} AS b FROM step WHERE 2 * k = length(h)),
        s AS (SELECT b, count(*) AS s FROM dw JOIN bucket USING (x) GROUP BY b), t AS (SELECT b, count(*) AS t FROM qw JOIN bucket USING (x) GROUP BY b),
        g AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {importance.BUCKETS})) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM qw) + {importance.BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
        f AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN bucket USING (x) JOIN g USING (b) GROUP BY doc_id),
        r AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN f USING (doc_id)),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM r WHERE n_features >= {importance.LEAST_WORDS})
        SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * {importance.PERCENT} // 100 THEN k END AS rank FROM r LEFT JOIN o USING (doc_id)""",
}
