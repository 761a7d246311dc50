"""Registered queries of this package: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwise.llm import (curriculum, decontam, kdshard, langid, lines, negatives, personal, perspectives,
                           quality, repeats, simhash, spelling, toxicity)
from blockwise.llm.common import table


def op1_rindex_dedup(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_curriculum_mix(spark, sf_dir):
    d = curriculum.mix_plan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken",
                    F.get("positions", F.lit(0)).alias("first_position"),
                    F.get("positions", F.lit(1)).alias("second_position"))


def op3_language_profiles(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity_gbt(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_perspective_rotation(spark, sf_dir):
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op7_line_edit_join(spark, sf_dir):
    d = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_linked", "n_links", F.size("dropped").cast("long").alias("n_dropped"),
                    F.array_join("dropped", ",").alias("dropped"))


def op8_kd_sharding(spark, sf_dir):
    return kdshard.shard_documents(table(spark, sf_dir, "documents"))


def op9_simhash_vptree(spark, sf_dir):
    d = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op10_quality_crf(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_rns_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


def op12_personal_candidates(spark, sf_dir):
    return personal.personal_data(table(spark, sf_dir, "documents"))


def op13_spelling_partenum(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_rindex_dedup, op2_curriculum_mix, op3_language_profiles, op4_decontamination,
    op5_toxicity_gbt, op6_perspective_rotation, op7_line_edit_join, op8_kd_sharding, op9_simhash_vptree, op10_quality_crf,
    op11_rns_negatives, op12_personal_candidates, op13_spelling_partenum)}

SQL: dict[str, str] = {"op6_perspective_rotation": perspectives.SQL, "op11_rns_negatives": negatives.SQL}
