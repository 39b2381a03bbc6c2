"""References to records that do not exist.

A foreign key is resolved against the parents *as of* the moment its row arrives. The distinct
foreign keys are anti-joined with the parent keys and the survivors are joined back to the
citing rows, so a key cited a million times is resolved once and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.labels import canonical_number, parse_kind

KEY = ["doc", "kind", "number"]


def citations(units: DataFrame) -> DataFrame:
    """One row per citation that names a unit: (unit_id, dep_pos, doc, kind, number, arrived_at).

    Blank and NULL entries, and entries without kind and number, name no unit and are left out. A
    NULL array has no citations. A row without ``_doc_id`` or ``arrived_at`` can't be placed: left out.
    """
    return (
        units.where(F.col("_doc_id").isNotNull() & F.col("arrived_at").isNotNull())
        .select("unit_id", F.col("_doc_id").alias("doc"), "arrived_at", F.posexplode("dependencies").alias("dep_pos", "cited"))
        .select("unit_id", "dep_pos", "doc", parse_kind(F.col("cited")).alias("kind"), canonical_number(F.col("cited")).alias("number"), "arrived_at")
        .where("kind IS NOT NULL AND number IS NOT NULL")
    )


def parent_intervals(units: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """(doc, kind, number, born, gone): when each record that bears a number counts.

    ``gone`` is the first withdrawal of the record, NULL if there is none. Repeated withdrawals count once.
    """
    first = withdrawals.where("unit_id IS NOT NULL AND withdrawn_at IS NOT NULL").groupBy("unit_id").agg(F.min("withdrawn_at").alias("gone"))
    labelled = units.where("_doc_id IS NOT NULL AND arrived_at IS NOT NULL").select(
        "unit_id", F.col("_doc_id").alias("doc"), parse_kind(F.col("label")).alias("kind"), canonical_number(F.col("label")).alias("number"), F.col("arrived_at").alias("born")
    )
    return labelled.where("kind IS NOT NULL AND number IS NOT NULL").join(first, "unit_id", "left").select(*KEY, "born", "gone")


def _islands(intervals: DataFrame) -> DataFrame:
    """Withdrawn intervals of a key merged into disjoint ones, so that at most one holds a moment."""
    order = Window.partitionBy(*KEY).orderBy("born", "gone")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        intervals.withColumn("new", (F.coalesce(F.max("gone").over(before), F.lit("0001-01-01").cast("timestamp")) < F.col("born")).cast("int"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "island")
        .agg(F.min("born").alias("born"), F.max("gone").alias("gone"))
        .drop("island")
    )


def unresolved_keys(cited: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (doc, kind, number, arrived_at) that no parent satisfies, with their cause.

    Parents that were never withdrawn are pre-aggregated to their first arrival: one row per key,
    whatever the size of the key's group. Only the withdrawn ones need intervals; those are merged
    first. ``cause``: ``missing`` if the key has no parent, ``late`` if all came later, else ``withdrawn``.
    """
    wanted = cited.select(*KEY, "arrived_at").distinct()
    lasting = parents.groupBy(*KEY).agg(
        F.min("born").alias("first_born"),
        F.min(F.when(F.col("gone").isNull(), F.col("born"))).alias("first_lasting"),
    )
    open_ = wanted.join(lasting, KEY, "left").where(F.col("first_lasting").isNull() | (F.col("first_lasting") > F.col("arrived_at")))
    short = _islands(parents.where("gone IS NOT NULL AND gone > born"))
    held = (
        (F.col("o.doc") == F.col("s.doc"))
        & (F.col("o.kind") == F.col("s.kind"))
        & (F.col("o.number") == F.col("s.number"))
        & (F.col("s.born") <= F.col("o.arrived_at"))
        & (F.col("o.arrived_at") < F.col("s.gone"))
    )
    lost = open_.alias("o").join(short.alias("s"), held, "left_anti")
    cause = F.when(F.col("first_born").isNull(), "missing").when(F.col("first_born") > F.col("arrived_at"), "late").otherwise("withdrawn")
    return lost.select(*KEY, "arrived_at", cause.alias("cause"))


def orphan_citations(units: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """(unit_id, dep_pos, cause, arrived_at): the citations without a parent when their row arrived.

    A citation of the row's own label resolves to the row itself. Empty tables give an empty result;
    other columns of the inputs are ignored.
    """
    units = units.select("unit_id", "_doc_id", "label", "dependencies", "arrived_at")
    withdrawals = withdrawals.select("unit_id", "withdrawn_at")
    cited = citations(units)
    lost = unresolved_keys(cited, parent_intervals(units, withdrawals))
    return cited.join(lost, [*KEY, "arrived_at"]).select("unit_id", "dep_pos", "cause", "arrived_at")


def orphan_report(units: DataFrame, withdrawals: DataFrame, table: str = "units") -> DataFrame:
    """Counts per table and month of arrival: citations, and orphans by cause (0 where none)."""
    month = F.date_format("arrived_at", "yyyy-MM").alias("month")
    total = citations(units.select("unit_id", "_doc_id", "dependencies", "arrived_at")).groupBy(month).agg(F.count(F.lit(1)).alias("citations"))
    by_cause = (
        orphan_citations(units, withdrawals)
        .groupBy(month)
        .agg(*[F.count_if(F.col("cause") == c).alias(c) for c in ("missing", "late", "withdrawn")])
    )
    return total.join(by_cause, "month", "left").select(
        F.lit(table).alias("table_name"), "month", "citations", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("missing", "late", "withdrawn")]
    )
