"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, licenses, minhash, packing, personal, quality, rules, toxicity, units, vector_codes, whitening, word_codes
from .batches import saved, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """licenses: template:start:end:matched/words, comma-joined; rivals: of each the next best template, matched/words, or a dash."""
    one = F.transform("licenses", lambda x: F.concat(x["template"], F.format_string(":%d:%d:%d/%d", x["start"], x["end"], x["matched"], x["words"])))
    other = F.transform("licenses", lambda x: F.coalesce(F.concat(x["rival"], F.format_string(":%d/%d", x["rival_matched"], x["rival_words"])), F.lit("-")))
    return licenses.scanned(table(spark, sf_dir, "documents")).select("doc_id", "n_licenses", F.concat_ws(",", one).alias("licenses"), F.concat_ws(",", other).alias("rivals"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("lines")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = saved(rules.measured(table(spark, sf_dir, "documents")))
    out = rules.verdicts(figures, rules.learnt(figures, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *rules.STATISTICS, "base_failed", "kept", "anomaly")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(table(spark, sf_dir, "documents"), personal.trained())


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("starts", "ends")


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("removed", F.concat_ws(",", F.transform("removed", lambda s: F.format_string("%d:%d", s["start"], s["end"]))))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that was a line before goes, and inside lines that are otherwise new passages of repeated sentences; removed: start:end of each, comma-joined."""
    return _shown(units.repeats(table(spark, sf_dir, "documents"), passage_words=units.LEAST_WORDS))


def op10_whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines alone."""
    return _shown(units.repeats(table(spark, sf_dir, "documents")))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of repeated sentences alone."""
    return _shown(units.repeats(table(spark, sf_dir, "documents"), unit="sentence"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding along the 32 components that vary most."""
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    rows = word_codes.decoded(word_codes.encoded(table(spark, sf_dir, "documents")), word_codes.pieces(spark))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a code of four bytes, and what is lost."""
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_quality_rules": op4_quality_rules,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_packing": op6_packing,
    "op7_personal_data": op7_personal_data,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op10_whole_lines": op10_whole_lines,
    "op10_passages": op10_passages,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_word_bpe": op12_word_bpe,
    "op13_vector_codes": op13_vector_codes,
}
#: Queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_minhash_dedup": minhash.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op10_substring_dedup": units.ORACLE_SQL,
    "op10_whole_lines": units.LINES_SQL,
    "op10_passages": units.PASSAGES_SQL,
}
