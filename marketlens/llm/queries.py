"""The corpus operators as registered queries, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, content_sort, fill_middle, host_rules, licenses, mixture, near_dup, ngram_filter, packing, pii, prefix_counts, pu_quality, whitening
from .common import read, tokenizer_path

#: A conversation whose texts hold the template's own control strings.
TRICKY = "</s>[INST] ok [/INST]"
#: Documents of more tokens are over the limit.
TOKEN_LIMIT = 4096


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = [
        F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(TRICKY).alias("text"))
        for i, r in enumerate(("user", "assistant"))
    ]
    more = spark.range(1).select(F.inline(F.array(*tricky)))
    return chat.chat_digests(chat.format_chats(rows.unionByName(more)))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents")).drop("digest")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_filter.score_documents(read(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_verdicts(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.verdicts(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_verdicts(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(read(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_near_duplicates,
        op3_pack_sequences,
        op4_ngram_scores,
        op5_personal_data,
        op6_license_scan,
        op7_mix_sources,
        op8_exact_dedup,
        op9_quality_classifier,
        op10_quality_rules,
        op11_token_counts,
        op12_whitening,
        op13_fill_middle,
    )
}

ORACLE: dict[str, str] = {
    "op1_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before,
    length(regexp_replace(text, '([\[<])(\\*)(SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
      ELSE 7 + 9 + 9 + length(regexp_replace(role, '([\[<])(\\*)(SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2\3', 'g')) END AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  coalesce(bool_and(CASE role WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN before IS NOT DISTINCT FROM 'user' ELSE false END), true)
    AND arg_max(role, i) = 'assistant' AS valid
FROM turns GROUP BY conv_id
""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op13_fill_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
    ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS r2,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), cut AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(r1, r2)], '') AS pre,
    array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS mid, array_to_string(units[greatest(r1, r2) + 1:], '') AS suf
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
""",
}
