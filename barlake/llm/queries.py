"""The queries of this folder's operators with their production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import decontaminate, near_dup, packing, prefix_trie, pseudonyms, quality_rules, rule_ensemble, secrets, sentencepiece_model, sharding, url_rules, warc, whitening
from barlake.session import work_dir


#: The model file of the SentencePiece query and stage; the driver reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The tokenizer of the packing query; the driver reads it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = tuple(rule.kind for rule in secrets.BASE_RULES)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.find_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(kind) for kind in base),
        F.sha2(secrets.joined("secrets", base), 256).alias("base_sha256"),
        secrets.joined("secrets").alias("spans"),
    )


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), work_dir(spark))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _ = warc.archive_pages(table(spark, sf_dir, "pages"), work_dir(spark))
    return held.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), work_dir(spark))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_model.tokenize(docs, MODEL).select(
        "doc_id", "tokens.ids", F.size("tokens.ids").cast("long").alias("n_tokens"), "tokens.round_trip", "tokens.parity"
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), work_dir(spark))


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_rows(docs, sharding.tree_of(8), sharding.tree_of(9), work_dir(spark))


def op8_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.judge_leaks(docs, benchmark, work_dir(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.barlake.pseudonym.key", "not a secret: set spark.barlake.pseudonym.key")
    return pseudonyms.with_pseudonyms(table(spark, sf_dir, "documents"), key)


def op11_concatenate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, work_dir(spark))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.long_rows(*whitening.whiten(table(spark, sf_dir, "embeddings"), work_dir(spark)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), work_dir(spark))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_url_rules": op2_url_rules,
    "op3_warc_archives": op3_warc_archives,
    "op4_rule_ensemble": op4_rule_ensemble,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_hash_tree_shards": op7_hash_tree_shards,
    "op8_benchmark_templates": op8_benchmark_templates,
    "op9_quality_rules": op9_quality_rules,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_concatenate_cut": op11_concatenate_cut,
    "op12_bit_sliced_whitening": op12_bit_sliced_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op3_warc_archives": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS digest FROM p),
    t AS (
        SELECT *, max(page_id) OVER (PARTITION BY digest) AS newest,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(digest, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) + 1 AS BIGINT), 1)),
                '') AS payload_digest
        FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id < newest THEN newest END AS refers_to
    FROM t""",
    "op9_quality_rules": quality_rules.quality_sql(),
    "op13_prefix_trie": """
    WITH k AS (
        SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, strlen(coalesce(text, '')) AS size,
            substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS key
        FROM conversations WHERE conv_id IS NOT NULL),
    lists AS (SELECT conv_id, list({'k': key, 's': size} ORDER BY turn NULLS FIRST, key, size) AS turns FROM k GROUP BY 1),
    -- CRC-32 of the decimal id: byte by byte, each bit by bit
    crc AS (
        SELECT conv_id, turns, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda state, byte: list_reduce(list_prepend(xor(state, byte), range(8)),
                lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
        FROM lists),
    rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(f.turns, [])[:h], c.turns[h + 1:]) AS turns
        FROM crc c LEFT JOIN lists f ON f.conv_id = c.conv_id - c.conv_id % 5),
    steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
        FROM (
            SELECT conv_id, depth, depth = len(turns) AS is_end, array_to_string(list_transform(turns[:depth], lambda t: t.k), '') AS path,
                CASE WHEN depth > 0 THEN turns[depth].s ELSE 0 END AS size
            FROM steps)
        GROUP BY 1, 2),
    children AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    below AS (
        SELECT substr(path, 1, 32 * up) AS path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves
        FROM (
            SELECT n.path, unnest(range(0, n.depth + 1)) AS up, (n_convs - 1) * size AS saved, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf
            FROM nodes n LEFT JOIN children c ON c.path = n.path)
        GROUP BY 1)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
        CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children c ON c.path = n.path
        LEFT JOIN nodes p ON n.depth > 0 AND p.path = substr(n.path, 1, 32 * (n.depth - 1))""",
}
