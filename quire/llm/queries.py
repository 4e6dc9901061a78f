"""The operN queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, decontaminate, hmm, langid, licenses, linededup, secrets, simhash, spelling, toxicity, vectors, whitening
from quire.llm.common import documents, held_out

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by models of three in four documents; null and letterless texts are `und`."""
    docs = documents(spark, sf_dir)
    stats = langid.train(docs.where(~held_out(F.col("doc_id"), 4)))
    found = langid.identify(docs, stats)
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places in documents where a benchmark passage occurs."""
    return decontaminate.contaminated_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without its duplicate lines."""
    return linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that a document is toxic, learned from the labels of three in four documents; null and empty
    texts have that of a text without features."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4))
    found = toxicity.toxicity(docs, toxicity.train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places in documents where a license notice occurs."""
    return licenses.license_spans(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again; a null text counts as empty."""
    return bpe.bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base rules' matches in every document, and all spans; none in null and empty texts."""
    found = secrets.find_secrets(documents(spark, sf_dir))
    spans = F.arrays_zip("kinds", "starts", "ends")
    base = F.filter(spans, lambda s: s["kinds"].isin([r.kind for r in secrets.BASE_RULES]))
    line = lambda part: F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE_RULES], F.sha2(line(base), 256).alias("base_sha256"), line(spans).alias("spans"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by a model of six in seven documents; a null text counts as empty."""
    found = hmm.train_and_score(documents(spark, sf_dir), ~held_out(F.col("doc_id"), 7))
    return found.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words, null ones too, have fingerprint zero."""
    found = simhash.near_duplicate_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; null, zero and non-finite ones link with nothing."""
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the 16 leading components, whitened; null and non-finite ones give no rows."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its count, near words, form and root; null texts have no words."""
    return spelling.spelling_groups(documents(spark, sf_dir))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as formatted and read back, and of one that says control strings.

    Each row of the table is a record of the layout of single turns, the added conversation one of a message list;
    null roles and texts are empty, rows of one turn are sorted by role and text, repeated rows stay."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.struct(F.array(*[F.struct(F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("content")) for role in ("user", "assistant")]).alias("messages"))
    records = rows.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("payload"))
    records = records.unionByName(spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.to_variant_object(said).alias("payload")))
    return chat.conversation_digests(chat.format_conversations(chat.canonical_turns(records)))


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 0, 'assistant', '</s>[INST] ok [/INST]'),
pieces AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\2\\\3', 'g') || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\2\\\3', 'g') AS piece FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece) + length('<|turn|><|text|><|end|>')) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id"""


QUERIES = {f.__name__: f for f in (op1_langid, op2_decontaminate, op3_lines, op4_toxicity, op5_licenses, op6_bpe, op7_secrets, op8_hmm, op9_simhash, op10_vectors, op11_whitening, op12_spelling, op13_chat)}
ORACLE_SQL: dict[str, str] = {"op13_chat": OP13_SQL}
