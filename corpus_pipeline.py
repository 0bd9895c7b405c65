"""The corpus pipeline: filter, de-duplicate, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``docs``.  :func:`run` writes each stage's result in the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm import compression, dedup, mixing, packing, rules
from panelloom.llm.common import BLANK, WORD, stage
from panelloom.llm.queries import vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` and a hash of the text; with the id it names a row, up to full repeats."""
    return docs.withColumn("_text_key", F.coalesce(F.md5("text"), F.lit("")))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of keyed ``docs`` whose id and text key stand in ``keys``; null counts as an id."""
    keys = keys.toDF("_kept_id", "_kept_key")
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_kept_id"]) & (docs["_text_key"] == keys["_kept_key"]), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose compression score is at least 0.3."""
    model = compression.train(docs, _labels(spark, sf_dir))
    if model is None:
        return docs
    score = compression.calibrated(model.at, model.score, compression.differences(F.col("text"), model.good, model.bad))
    return docs.where(score >= 0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and the learned list."""
    keyed = _keyed(docs)
    verdicts = rules.judge(keyed, _labels(spark, sf_dir), carry=("_text_key",))
    return _only(keyed, verdicts.where("kept").select("doc_id", "_text_key").distinct()).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the least id, and of its texts in
    the group the one with the least hash.  Rows that repeat an id and a text are one
    document; unlike texts under one id are several.  Rows without an id are linked with
    nothing and all stay."""
    keyed = _keyed(docs)
    groups = stage(dedup.grouped(keyed, carry=("_text_key",)).where("kept").select("doc_id", "component", "_text_key"), "pipeline-groups")
    group = F.coalesce("component", F.col("_text_key").cast("binary"))
    first = groups.groupBy("doc_id", group.alias("group")).agg(F.min("_text_key").alias("_text_key"))
    kept = _only(keyed, first.select("doc_id", "_text_key"))
    repeated = groups.where("doc_id is not null").groupBy("doc_id", "_text_key").count().where("count > 1")
    if repeated.take(1):
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        place = F.row_number().over(Window.partitionBy("doc_id", "_text_key").orderBy(*others, "text"))
        kept = kept.withColumn("_place", place).where("doc_id is null or _place = 1")
    return kept.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mixture in the order of its schedule: each document as often as the mixture
    reads it; where a source's target falls inside a document, that reading ends there."""
    keyed = _keyed(docs)
    plan = mixing.mix(keyed, carry=("_text_key",))
    plan = stage(plan.select(F.col("doc_id").alias("_plan_id"), F.col("source").alias("_plan_source"), F.col("_text_key").alias("_plan_key"),
                             F.col("size").alias("_size"), F.col("takes").alias("_takes"), F.col("slots").alias("_slots")), "pipeline-plan")
    same = keyed["doc_id"].eqNullSafe(plan["_plan_id"]) & keyed["source"].eqNullSafe(plan["_plan_source"]) & (keyed["_text_key"] == plan["_plan_key"])
    names = ["_plan_id", "_plan_source", "_plan_key"]
    if plan.groupBy(*names).count().where("count > 1").take(1):
        # Full repeats are numbered on both sides, so each row meets its own line of the plan.
        others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
        keyed = keyed.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "source", "_text_key").orderBy(*others, "text")))
        plan = plan.withColumn("_plan_copy", F.row_number().over(Window.partitionBy(*names).orderBy(F.col("_takes").desc())))
        same = keyed["doc_id"].eqNullSafe(plan["_plan_id"]) & keyed["source"].eqNullSafe(plan["_plan_source"])
        same = same & (keyed["_text_key"] == plan["_plan_key"]) & (keyed["_copy"] == plan["_plan_copy"])
    plan = plan.select("*", F.posexplode("_takes").alias("_reading", "_take")).where("_take > 0")
    plan = plan.withColumn("_slot", F.element_at("_slots", F.col("_reading")))
    # In the schedule's order: every stretch of the result holds the sources in proportion.
    rows = keyed.join(plan, same).repartitionByRange("_slot", "_text_key").sortWithinPartitions("_slot", "_text_key")
    begun = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[{BLANK}]*{WORD}"), F.lit(0)), 1, F.col("_take").cast("int")), "")
    text = F.when(F.col("_take") < F.col("_size"), begun).otherwise(F.col("text"))
    own = [text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*own)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as ``op4_curve_packing`` returns them."""
    out = packing.pack(docs, vocabulary(), length=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("curve_packing", curve_packing),
]

#: The trained stages, components over links and byte-pair ids are not SQL; the tests compare
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
