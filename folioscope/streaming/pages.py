"""Pages and units as streams: stateless clean-up per page, counts per window of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions.labels import canonical_number, parse_kind
from folioscope.operators.layout import normalize_pages


def page_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Pages that arrive as Parquet files below ``path``, normalised as they come."""
    return normalize_pages(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def block_counts(pages: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Pages and blocks per window of scanning time; scans later than ``late`` are not waited for."""
    return pages.withWatermark("scanned_at", late).groupBy(F.window("scanned_at", window)).agg(F.count(F.lit(1)).alias("pages"), F.sum("num_blocks").alias("blocks"))


def orphan_counts(units: DataFrame, known: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Citations per window of arrival that name no unit of ``known`` (doc, kind, number), a table read anew for every batch.

    A first sign of gaps while records come in; the causes come from the batch report, which sees later arrivals too.
    """
    cited = units.withWatermark("arrived_at", late).select(F.col("_doc_id").alias("doc"), "arrived_at", F.explode("dependencies").alias("cited"))
    keyed = cited.select("doc", parse_kind(F.col("cited")).alias("kind"), canonical_number(F.col("cited")).alias("number"), "arrived_at").where("kind IS NOT NULL AND number IS NOT NULL")
    lost = keyed.join(known.select("doc", "kind", "number").distinct(), ["doc", "kind", "number"], "left_anti")
    return lost.groupBy(F.window("arrived_at", window)).agg(F.count(F.lit(1)).alias("orphans"))
