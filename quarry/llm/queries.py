"""Queries of this subpackage: name -> callable (spark, sf_dir), and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, conversation_repair, decontaminate, embedding_dedup, language_id, mixing, ngram_join, quality, sharding, spelling, substring_dedup, token_files, toxicity, warc

#: The tokenizer file of the token queries; the operator takes any file of the tokenizers library.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: confirmed toxic and unlabelled texts of the folds 1 to 4 train, all are scored."""
    documents, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.id_bucket("doc_id", 5) == 0
    model = toxicity.fit(documents, labels, ~held)
    return toxicity.score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the discriminant of its statistics; labels of the folds 1 to 4 train."""
    held = common.id_bucket("doc_id", 5) == 0
    common.prepare(spark)
    stats = common.saved(quality.statistics(common.table(spark, sf_dir, "documents")), "quality")
    model = quality.fit(stats, common.table(spark, sf_dir, "labels"), ~held)
    return quality.score(stats, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it contains, with the best window and its edits."""
    return decontaminate.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.95."""
    return embedding_dedup.links(common.table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, written to the shared folder and read back."""
    path = common.shared_path(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), path)
    return warc.records(spark, path)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every document whose three-word shingles overlap by 0.9."""
    joined = ngram_join.components(common.table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents that bring sources to their tempered weights."""
    mixed = mixing.replicate(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("repetition_rate", 9).alias("repetition_rate"), "copies", "copy_no", "text")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as compressed token shards, written to the shared folder and read back."""
    path = common.shared_path(spark, "tokens")
    token_files.write(common.table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return token_files.read(spark, path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards by the law ``rows``: counts at most one apart."""
    placed = sharding.assign(common.table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds other than 2."""
    documents = common.table(spark, sf_dir, "documents")
    held = common.id_bucket("doc_id", 4) == 2
    model = language_id.fit(documents, ~held)
    return language_id.predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages of 13 words or more that a smaller document has too."""
    left = substring_dedup.remove(common.table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the (damaged) documents with its near words, its form and its root."""
    return spelling.groups(common.table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged: its faults, the cheapest edits that repair it and the digest of the result."""
    return conversation_repair.audit(conversation_repair.damaged(common.table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_warc": op5_warc,
    "op6_ngram_join": op6_ngram_join,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {"op4_embedding_dedup": embedding_dedup.oracle(), "op5_warc": warc.oracle(), "op6_ngram_join": ngram_join.oracle(), "op7_mixing": mixing.oracle(), "op11_substring_dedup": substring_dedup.oracle(), "op12_spelling_groups": spelling.oracle(), "op13_conversation_repair": conversation_repair.oracle()}
