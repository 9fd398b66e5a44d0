"""The registered queries of this subpackage: each operator over its whole table, as the contracts want the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import byte_pairs, chat, divergence, fingerprints, licenses, media, ngram_join, packing, pieces, pii, quality, repair, secrets
from stratalake.llm.common import table
from stratalake.llm.vocabulary import tokenizer_path


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of two turns that imitate control strings."""
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(rows))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.BASE)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.text_media(table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.summary(repair.repair(repair.damaged(conversations)), conversations)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (op1_sentencepiece, op2_ngram_jaccard, op3_quality, op4_packing, op5_licenses, op6_chat, op7_pii, op8_media, op9_secrets, op10_fingerprints, op11_divergence, op12_byte_bpe, op13_repair, pipeline)
    return {f.__name__: f for f in found}


#: Texts escaped as the template escapes them, and what a turn adds around role and text.
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
CHAT_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN) + len(chat.END) + 1} + length(replace({_ESCAPED.format('role')}, chr(10), '&#10;')) + length({_ESCAPED.format('text')})
    + CASE WHEN role = 'assistant' THEN {len(chat.LOSS) + len(chat.UNLOSS)} ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def oracle_sql() -> dict:
    """The others learn, infer, cluster or tokenize: their tests hold them against brute force and libraries."""
    return {"op6_chat": CHAT_SQL}
