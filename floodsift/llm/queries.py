"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodsift.llm import (
    filter_audit, language, lines, mix, multiset, neighbours, pack, resampling, simhash, spans, substrings, toxicity,
    transducer,
)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents shared out over the sources, and what each document gives."""
    mixed = mix.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document, with the languages of its mixture."""
    docs = table(spark, sf_dir, "documents")
    held_out = (language.remainder(5) == 0).alias("held_out")
    found = language.identify(docs, ["doc_id"])
    return found.select("doc_id", held_out, "lang_pred", "score", "languages", "proportions")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences of at most 4096 ids."""
    return pack.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that equal or nearly equal an earlier one."""
    cleaned = lines.drop_near_lines(table(spark, sf_dir, "documents"), short=True)
    return cleaned.select("doc_id", "text", F.col("_lines_removed").alias("lines_removed"))


def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_suffix_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    return substrings.drop_repeated_strings(table(spark, sf_dir, "documents"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans."""
    return spans.drop_repeated_spans(table(spark, sf_dir, "documents"))


def op8_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its offending sentences."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = (language.remainder(3) == 1).alias("held_out")
    found = toxicity.detect(docs, labels, ["doc_id"])
    return found.select("doc_id", held_out, "score", "predicted", "offending", "offence")


def op9_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and their edited texts, and their likeness."""
    return multiset.compare(table(spark, sf_dir, "documents"))


def op10_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at three or fewer differing fingerprint bits, with their component."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(
        "doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id"
    )


def op11_gray_code_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, at each step of all their orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark's texts."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the text decoded from them."""
    coded = transducer.encode(table(spark, sf_dir, "documents"), TOKENIZER, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pareto_mix,
        op2_language_mixture,
        op3_best_fit_packing,
        op4_line_edit_join,
        op5_collision_ann,
        op6_suffix_grouping,
        op7_sentence_spans,
        op8_noisy_or_toxicity,
        op9_multiset_fingerprint,
        op10_pigeonhole_simhash,
        op11_gray_code_audit,
        op12_radix_resampling,
        op13_streaming_bpe,
    )
}
