"""Counts and summaries over the graph, the hypotheses and the discovery runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidra import vocab


def counts(**tables: DataFrame) -> DataFrame:
    """(metric, n): the row count of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def graph_stats(tables: dict[str, DataFrame], roles: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Row counts of all tables, distinct molecules per role, and validated hypotheses."""
    by_role = (
        roles.groupBy("role").agg(F.count_distinct("molecule_id").alias("n"))
        .select(F.concat(F.lit("num_"), "role", F.lit("s")).alias("metric"), "n")
    )
    validated = hypotheses.agg(F.count_if(F.col("status") == "validated").alias("n")).select(
        F.lit("num_hypotheses_validated").alias("metric"), "n"
    )
    totals = counts(**{f"num_{k}": v for k, v in tables.items()})
    return totals.unionByName(by_role).unionByName(validated)


def role_counts(molecules: DataFrame, roles: DataFrame) -> DataFrame:
    """Molecules per role; the rest is what neither solvents nor salts account for."""
    per = roles.groupBy("role").agg(F.count_distinct("molecule_id").alias("n")).where(F.col("role").isin("solvent", "salt"))
    named = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    other = molecules.agg(F.count("*").alias("n")).select(F.lit("other").alias("role"), (F.col("n") - named).alias("n"))
    return per.unionByName(other)


def top_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first (ties by value)."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), column).limit(top)


def prediction_split(provenance: DataFrame) -> DataFrame:
    predicted = F.col("extraction_method") == "ml_prediction"
    return provenance.agg(
        F.count_if(~predicted).alias("experimental"), F.count_if(predicted).alias("predicted")
    )


def source_category(doi: Column, method: Column) -> Column:
    """First matching rule of the ordered category list."""
    fields = {
        "doi": F.coalesce(doi, F.lit("")), "method": F.coalesce(method, F.lit("")),
        "method_lower": F.lower(F.coalesce(method, F.lit(""))),
    }
    cases = [F.when(fields[where].contains(text), name) for name, where, text in vocab.SOURCE_CATEGORIES]
    return F.coalesce(*cases, F.lit("Other"))


def records_per_category(provenance: DataFrame) -> DataFrame:
    category = source_category(F.col("source_doi"), F.col("extraction_method"))
    return top_counts(provenance.select(category.alias("category")), "category")


def hypothesis_summary(hypotheses: DataFrame) -> DataFrame:
    """(dimension, value, n): totals by status and source over their full vocabularies."""
    spark = hypotheses.sparkSession
    names = [("status", s) for s in vocab.HYPOTHESIS_STATUSES] + [("source", s) for s in vocab.HYPOTHESIS_SOURCES]
    dims = spark.createDataFrame(names, "dimension string, value string")
    pairs = F.array(
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")),
        F.struct(F.lit("source").alias("dimension"), F.col("source").alias("value")),
    )
    found = hypotheses.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return dims.join(found, ["dimension", "value"], "left").select(
        "dimension", "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def hypothesis_totals(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.agg(
        F.count("*").alias("total_hypotheses"), F.count_if("is_novel").alias("num_novel"),
        F.count_distinct("batch_id").alias("num_batches"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )


def batch_counters(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.groupBy("batch_id").agg(
        F.count("*").alias("num_proposed"), F.count_if("is_novel").alias("num_novel"),
        F.count_if(F.col("status") == "validated").alias("num_validated"),
        F.count_if(F.col("status") == "rejected").alias("num_rejected"),
    )


def discovery_metrics(hypotheses: DataFrame) -> DataFrame:
    """Funnel, rates and the lift of validated hypotheses in one pass."""
    validated, rejected = F.col("status") == "validated", F.col("status") == "rejected"
    lift = F.when(validated, F.col("model_lift"))
    return hypotheses.agg(
        F.count("*").alias("num_proposed"), F.count_if("is_novel").alias("num_novel"),
        F.count_if("passed_time_slice").alias("num_passed_time_slice"),
        F.count_if(validated).alias("num_validated"), F.count_if(rejected).alias("num_rejected"),
        F.avg("confidence").alias("avg_confidence"),
        F.coalesce(F.avg(lift), F.lit(0.0)).alias("avg_model_lift"), F.coalesce(F.sum(lift), F.lit(0.0)).alias("total_model_lift"),
    ).withColumns({
        "validation_rate": F.coalesce(F.col("num_validated") / F.nullif(F.col("num_validated") + F.col("num_rejected"), F.lit(0)), F.lit(0.0)),
        "novelty_rate": F.coalesce(F.col("num_novel") / F.nullif(F.col("num_proposed"), F.lit(0)), F.lit(0.0)),
    })


def proposal_summary(proposals: DataFrame) -> DataFrame:
    """Count, average confidence and novelty by type."""
    return proposals.groupBy("predicate").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg("novelty_score").alias("avg_novelty")
    )


def grouped_values(measurements: DataFrame, shown: int = 5) -> DataFrame:
    """(entity, property, first values as text, how many more)."""
    rows = measurements.where(F.col("value").isNotNull())
    totals = rows.groupBy("entity_id", "property_type").agg(F.count("*").alias("n"))
    first = Window.partitionBy("entity_id", "property_type").orderBy("id")
    text = F.concat_ws(" ", F.col("value").cast("string"), "unit")
    top = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= shown)
    listed = top.groupBy("entity_id", "property_type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda s: s["t"]), ", ").alias("shown")
    )
    return listed.join(totals, ["entity_id", "property_type"]).withColumn(
        "more", F.greatest(F.col("n") - shown, F.lit(0)).cast("bigint")
    ).drop("n")


def ingestion_stats(tagged: DataFrame, doi: str | None = None) -> DataFrame:
    """(outcome, n) from a ``reject_reason`` column, plus the distinct DOIs of kept rows."""
    outcome = F.coalesce("reject_reason", F.lit("processed"))
    out = tagged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    if doi is not None:
        dois = tagged.where(F.col("reject_reason").isNull()).select(doi).distinct().agg(F.count("*").alias("n"))
        out = out.unionByName(dois.select(F.lit("unique_dois").alias("outcome"), "n"))
    return out


def stats_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two (metric, n) tables."""
    side = lambda df, name: df.select("metric", F.lit(name).alias("side"), "n")
    total = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("n"))), F.lit(0)).cast("bigint")
    return (
        side(before, "before").unionByName(side(after, "after"))
        .groupBy("metric").agg(total("before").alias("before"), total("after").alias("after"))
        .withColumn("delta", F.col("after") - F.col("before"))
    )


def funnel(**stages: DataFrame) -> DataFrame:
    """(stage, n) in the given order of stages."""
    return counts(**stages).withColumnRenamed("metric", "stage")
