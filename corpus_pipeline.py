"""The corpus pipeline: stages of training-data operators, each written and read again.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns its kept rows
in the same columns; the last returns the token digests of each kept document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, langid, linededup, simhash
from quire.llm.common import Scratch, documents, held_out, small_batches
from quire.llm.queries import RANK_FILE

#: Bits a byte above which a text is like none of the languages (a learned one takes about 2), and the posterior
#: probability below which no language stands out.
MOST_BITS, LEAST_SCORE = 6.0, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, those that no learned language codes in MOST_BITS a byte, and those for
    which none has a probability of LEAST_SCORE; `lang` of the others becomes the language found, whatever it was
    or if it was null. Decisions are made by row, so null and repeated ids are no exception."""

    def free(name: str) -> str:
        return name if name not in docs.columns else free(f"{name}_")

    pred, score, bits = names = tuple(free(n) for n in ("lang_pred", "score", "bits_per_byte"))
    stats = langid.train(docs.where(~held_out(F.col("doc_id"), 4)))
    found = langid.annotate(docs, stats, names=names)
    found = found.where((F.col(pred) != langid.UNKNOWN) & (F.col(bits) <= MOST_BITS) & (F.col(score) >= LEAST_SCORE))
    return found.select(*[F.col(pred).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes duplicate lines out; every document stays, n_chars follows its text."""
    return linededup.dedup_lines(docs).select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, of one id that with the smallest hash
    of its text; rows with a null id stay."""
    return simhash.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in whose text a benchmark passage occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each kept document, encoded and decoded again."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def bounded(stage):
    """The stage, with small batches for Python workers."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [("language ID", language), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", benchmark_leaks), ("encoding", encoding)]
STAGES = [(name, bounded(stage)) for name, stage in STAGES]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one for each document that the stages
    before keep. Each stage's rows are written and read again as the next one's documents; a written stage is
    dropped once the next stands. Empty tables give no rows; stages say what becomes of null ids and texts."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(f"stage-{k - 1}")
    return docs
