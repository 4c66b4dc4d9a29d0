"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitline.llm import decontamination, exact_dedup, language_id, license_scan, oracles, packing, pivot_codes, projection_passes, resampling, secrets, sharding, simhash, substring_dedup, toxicity
from waitline.llm.common import table


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents")).drop("balanced_shard")


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    """Half of the documents, by a hash of the id, stand for the snapshot; the others come in."""
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), half).drop("side", "screened_out")


def op6_language_id(spark, sf_dir):
    """Runs of one language as lang:start:end, places of words, joined by commas."""
    found = language_id.identify(table(spark, sf_dir, "documents"))
    text = F.transform("runs", lambda r: F.concat_ws(":", r["lang"], r["start"].cast("string"), r["end"].cast("string")))
    return found.withColumns({"n_runs": F.size("runs").cast("long"), "runs": F.array_join(text, ",")})


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_embedding_dedup(spark, sf_dir):
    return projection_passes.near_duplicates(table(spark, sf_dir, "embeddings")).drop("n_copies")


def op13_vector_codes(spark, sf_dir):
    return pivot_codes.encode(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_sharding, op3_license_scan, op4_substring_dedup, op5_exact_dedup,
    op6_language_id, op7_simhash, op8_decontamination, op9_secret_scan, op10_packing,
    op11_resampling, op12_embedding_dedup, op13_vector_codes)}

ORACLES = {
    "op2_sharding": oracles.SHARDING, "op4_substring_dedup": oracles.SUBSTRING_DEDUP, "op5_exact_dedup": oracles.EXACT_DEDUP,
    "op11_resampling": oracles.RESAMPLING, "op12_embedding_dedup": oracles.EMBEDDING_DEDUP, "op13_vector_codes": oracles.VECTOR_CODES}
