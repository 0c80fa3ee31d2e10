"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from gridloom.llm.common import crc_mod, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count_columns=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return score(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.language_model import score_texts

    found = score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.imatch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", "licenses").alias("licenses"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.near_dup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("representative.doc_id").alias("component_id"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontamination import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.repair import damage, digests

    conversations = table(spark, sf_dir, "conversations")
    return digests(damage(conversations), conversations)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.resampling import resample

    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_line_dedup": op2_line_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_toxicity": op4_toxicity,
        "op5_context_tree_scores": op5_context_tree_scores,
        "op6_imatch_fingerprints": op6_imatch_fingerprints,
        "op7_license_scan": op7_license_scan,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_source_mix": op11_source_mix,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    from gridloom.llm.oracles import ORACLES

    return dict(ORACLES)
