"""The registered queries of this folder: opN_<name> over whole tables, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm import oracle
from veilstream.llm.chat import format_conversations, read_back
from veilstream.llm.common import table
from veilstream.llm.fingerprints import fingerprints
from veilstream.llm.hard_negatives import hard_negatives
from veilstream.llm.lexical import search
from veilstream.llm.mixing import mix
from veilstream.llm.near_dedup import near_duplicates
from veilstream.llm.packing import pack
from veilstream.llm.quality_net import quality_scores
from veilstream.llm.quality_rules import quality_rules
from veilstream.llm.repeats import remove_repeats
from veilstream.llm.secrets import digest, scan
from veilstream.llm.sharding import shard
from veilstream.llm.shingle_join import shingle_groups


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all texts that are covered by 400-byte strings found elsewhere, taken out."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return read_back(format_conversations(rows.union(extra)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, as counts, digests and places."""
    return digest(scan(table(spark, sf_dir, "documents")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents."""
    return mix(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of all for each item of the benchmark."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents linked by 85% of their four-word shingles."""
    return shingle_groups(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can say."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can say."""
    return op5_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shards_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of op6, and whether slots are gapless, equal texts together and shards within a largest group of each other."""
    out = op6_sharding(spark, sf_dir)
    shards = out.groupBy("shard").agg(F.sum("size").alias("bytes"), (F.max("slot") + 1 == F.count_distinct("slot")).alias("full"), (F.min("slot") == 0).alias("zero"), (F.count_distinct("slot") == F.count(F.lit(1))).alias("once"))
    groups = out.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n"), F.sum("size").alias("bytes"))
    sound = shards.agg(F.bool_and(F.col("full") & F.col("zero") & F.col("once")).alias("gapless"), (F.max("bytes") - F.min("bytes")).alias("spread")).crossJoin(groups.agg((F.max("n") == 1).alias("together"), F.max("bytes").alias("most")))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_distinct("shard").alias("shards")).crossJoin(sound).select("n", "bytes", "shards", "gapless", "together", (F.col("spread") <= F.col("most")).alias("even"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op7, and whether what is taken of each source is its target to the word."""
    out = op7_mixing(spark, sf_dir).groupBy("source").agg(F.sum("size").alias("size"), F.min("source_size").alias("source_size"), F.min("target").alias("target"), F.sum("taken").alias("taken"))
    return out.select("source", "size", "source_size", F.round("target", 3).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= 1).alias("met"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return own | {f.__name__: f for f in (rules_base, secrets_base, shards_sound, mix_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": oracle.OP3, "op10_near_dedup": oracle.OP10, "op11_lexical_search": oracle.OP11, "op12_shingle_join": oracle.OP12, "op13_hard_negatives": oracle.OP13, "rules_base": oracle.RULES, "secrets_base": oracle.SECRETS, "shards_sound": oracle.SHARDS, "mix_targets": oracle.MIX}
