"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chat_rotation, decontamination, embedding_dedup, line_dedup, packing, secrets, simhash_dedup, substring_dedup, toxicity, warc_fixity


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer and the same vocabulary as ranks, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories() -> dict:
    """The chain's categories over the columns of ``labels``, in its order."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("findings", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *map(count, base), F.sha2(secrets.as_text(own).cast("binary"), 256).alias("base_sha256"), secrets.as_text(F.col("findings")).alias("spans")
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_units(table(spark, sf_dir, "documents"))


#: There is one copy of the pages, so the audit's second replica is made from it, with these faults.
FAULTS = {"altered": "page_id % 499 = 3", "missing": "page_id % 997 = 5", "extra": "page_id % 1499 = 7"}


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url, html = F.col("url"), F.col("html")
    first = pages.where(f"not ({FAULTS['extra']})").select(F.col("page_id").alias("id"), warc_fixity.record(url, html).alias("record"))
    worn = F.when(F.expr(FAULTS["altered"]), F.concat(html, F.lit("\x00"))).otherwise(html)
    second = pages.where(f"not ({FAULTS['missing']})").select(F.col("page_id").alias("id"), warc_fixity.record(url, worn).alias("record"))
    found = warc_fixity.audit(first, second)
    lacking = [F.coalesce(c, F.lit("" if c.startswith("digest") else -1)).alias(c) for c in found.columns[2:]]
    return found.select(F.col("id").alias("page_id"), "status", *lacking)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "padded")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train_on(docs, table(spark, sf_dir, "labels"), categories())
    found = toxicity.scored(docs.select("doc_id", "text"), chain)
    return found.select("doc_id", "p_low_quality", "p_toxic", "is_low_quality", "is_toxic")


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_decontamination, op2_secrets, op3_substring_dedup, op4_warc_fixity, op5_line_dedup, op6_packing, op7_toxicity, op8_chat_rotation, op9_embedding_dedup, op10_simhash_dedup)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


ORACLE = {
    "op4_warc_fixity": """
WITH rec AS (
  SELECT page_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
    coalesce(html, '') AS a, coalesce(CASE WHEN page_id % 499 = 3 THEN html || chr(0) ELSE html END, '') AS b,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM pages),
built AS (
  SELECT page_id, page_id % 1499 <> 7 AS in_a, page_id % 997 <> 5 AS in_b,
    head || strlen(a)::VARCHAR || gap || a || gap AS ra, head || strlen(b)::VARCHAR || gap || b || gap AS rb FROM rec),
placed AS (
  SELECT page_id, in_a, in_b, sha256(ra) AS da, sha256(rb) AS db, strlen(ra)::BIGINT AS la, strlen(rb)::BIGINT AS lb,
    sum(CASE WHEN in_a THEN strlen(ra) ELSE 0 END) OVER w AS ea, sum(CASE WHEN in_b THEN strlen(rb) ELSE 0 END) OVER w AS eb
  FROM built WINDOW w AS (ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT page_id, CASE WHEN NOT in_b THEN 'missing' WHEN NOT in_a THEN 'extra' ELSE 'altered' END AS status,
  CASE WHEN in_a THEN (ea - la)::BIGINT ELSE -1 END AS offset_a, CASE WHEN in_a THEN la ELSE -1 END AS length_a, CASE WHEN in_a THEN da ELSE '' END AS digest_a,
  CASE WHEN in_b THEN (eb - lb)::BIGINT ELSE -1 END AS offset_b, CASE WHEN in_b THEN lb ELSE -1 END AS length_b, CASE WHEN in_b THEN db ELSE '' END AS digest_b
FROM placed WHERE (in_a OR in_b) AND (in_a <> in_b OR da <> db)
""",
    "op8_chat_rotation": """
WITH own AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM own WHERE speaker <> 'system'),
named AS (
  SELECT o.*, p.perspective, speaker = perspective AS mine,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM own o JOIN people p ON o.conv_id IS NOT DISTINCT FROM p.conv),
headed AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM named)
SELECT conv_id, perspective, turn, role, CASE WHEN role = 'user' THEN speaker END AS name,
  head || said || '<|im_end|>' || chr(10) AS rendered, mine AS train, length(head)::INT AS mask_start,
  CASE WHEN mine THEN length(head || said || '<|im_end|>') ELSE length(head) END::INT AS mask_end
FROM headed
""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE
