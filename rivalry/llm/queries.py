"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.llm import archives, leaks, media, nearest, neardup, packing, phrases, secrets, substrings, tokens, toxicity, tries, urls
from rivalry.llm.common import table, written
from rivalry.llm.oracles import collocations_sql, leaks_sql, near_duplicates_sql, nearest_sql, repeats_sql, secrets_sql, trie_sql

#: Fixed rules of the url query: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored media are read back and decoded; the result stores the full-resolution RGB tensors beside the digests."""
    stored = written(media.encode_texts(table(spark, sf_dir, "documents")), "op1-media")
    payload, tail = F.col("payload"), F.expr("substring(payload, -16, 16)")
    return media.decode_media(stored).select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", "height", "width", "rgb",
    )


def op2_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 4, 80)


def op3_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, 2)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op9_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), 35)


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert_pages(table(spark, sf_dir, "pages"), 0).drop("record_id")


def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", nearest.quantised("embedding", 64).alias("embedding"))
    return nearest.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x, payload_bytes) AS kept FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM m"""


def op8_sql() -> str:
    hit = r"regexp_matches(t, '(^|[^a-z0-9]){}([^a-z0-9]|$)')"
    strict = " + ".join(f"{hit.format(x)}::INT" for x in urls.STRICT)
    soft = " + ".join(f"{hit.format(x)}::INT" for x in urls.SOFT)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT *, translate(url, '{upper}', '{lower}') AS t, CASE {fits} END AS r FROM h),
c AS (SELECT page_id, host, path, r, ({strict})::INT AS n_strict, ({soft})::INT AS n_soft FROM k)
SELECT page_id, host, path, split_part(r, '|', 1) AS rule,
  coalesce(split_part(r, '|', 2), CASE WHEN n_strict >= 1 OR n_soft >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft
FROM c"""


QUERIES = {f.__name__: f for f in (op1_progressive_jpeg, op2_min_max_near_dedup, op3_secret_linking, op4_spaced_seed_leaks, op5_token_counts, op6_toxicity, op7_best_fit_packing, op8_url_filter, op9_de_bruijn_dedup, op10_arc_to_warc, op11_pivot_search, op12_phrase_collocations, op13_prefix_trie)}
ORACLES = {
    "op2_min_max_near_dedup": near_duplicates_sql(),
    "op3_secret_linking": secrets_sql(),
    "op4_spaced_seed_leaks": leaks_sql(),
    "op8_url_filter": op8_sql(),
    "op9_de_bruijn_dedup": repeats_sql(),
    "op10_arc_to_warc": OP10_SQL,
    "op11_pivot_search": nearest_sql(),
    "op12_phrase_collocations": collocations_sql(),
    "op13_prefix_trie": trie_sql(),
}
