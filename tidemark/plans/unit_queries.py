"""Queries of the unit conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import units
from ..session import table


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = units.text_quantities(table(spark, sf_dir, "tm_chunks").select("chunk_id", "text"), "chunk_id")
    specs = units.spec_quantities(table(spark, sf_dir, "vessel_equipment").select("id", "specs", "notes"), "id")
    return text.withColumn("source_table", F.lit("tm_chunks")).unionByName(specs.withColumn("source_table", F.lit("vessel_equipment")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "unit_targets")
    text = units.text_quantities(table(spark, sf_dir, "tm_chunks").select("chunk_id", "text"), "chunk_id")
    specs = units.spec_quantities(table(spark, sf_dir, "vessel_equipment").select("id", "specs", "notes"), "id")
    a = units.converted(text, targets).withColumn("source_table", F.lit("tm_chunks"))
    b = units.converted(specs, targets).withColumn("source_table", F.lit("vessel_equipment"))
    return a.unionByName(b).select("source_table", "record_id", "quantity", "common_value")


def p3_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statements(spark, sf_dir)
    return s.select("source_table", "record_id", "quantity", "unit", F.round("value", 6).alias("common_value"), "unit_from", "unique")


def p3_open_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many statements of each unit keep more than one possible meaning."""
    s = _statements(spark, sf_dir)
    return s.groupBy("source_table", "quantity", "unit").agg(F.count("*").alias("statements"), F.sum(F.when(~F.col("unique"), 1).otherwise(0)).alias("not_unique"))


QUERIES = {f.__name__: f for f in (p3_found, p3_statements, p3_open_units)}
