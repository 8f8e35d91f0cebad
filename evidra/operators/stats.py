"""Grouped statistics over measurements.

Inputs: ``measurements(property_type, value, ...)`` with NaN already read as null. Population
deviations divide by n, sample deviations by n - 1; quantiles are exact and interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidra.functions import pvalues, scalar
from evidra.operators.ranking import exact_quantiles
from evidra.operators.skew import checked_lookup


def property_stats(measurements: DataFrame, min_count: int = 5) -> DataFrame:
    """mean, population std, min, max, q1, q3, n per property with at least ``min_count`` values."""
    rows = measurements.where(F.col("value").isNotNull() & F.col("property_type").isNotNull())
    moments = (
        rows.groupBy("property_type")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count("*").alias("n"),
        )
        .where(F.col("n") >= min_count)
    )
    quantiles = exact_quantiles(rows, ["property_type"], "value", [0.25, 0.75], ["q1", "q3"])
    return moments.join(quantiles.drop("n"), "property_type")


def entity_property_means(measurements: DataFrame) -> DataFrame:
    """Mean value per (entity, property)."""
    return (
        measurements.where(F.col("value").isNotNull())
        .groupBy("entity_id", "property_type")
        .agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
    )


def correlation(x: str, y: str) -> Column:
    """Pearson r as an aggregate; null when either side is constant."""
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(scale, F.lit(0.0))


def property_correlations(measurements: DataFrame, min_pairs: int = 10) -> DataFrame:
    """r, t, p per property pair over the entities having both; pairs are ordered by name.

    Entity means shrink each entity to one row per property first, so the self-join makes at
    most (vocabulary choose 2) rows per entity, and the pair aggregate combines map-side.
    """
    means = entity_property_means(measurements)
    left = means.select("entity_id", F.col("property_type").alias("property_1"), F.col("mean_value").alias("x"))
    right = means.select("entity_id", F.col("property_type").alias("property_2"), F.col("mean_value").alias("y"))
    pairs = left.join(right, "entity_id").where(F.col("property_1") < F.col("property_2"))
    out = (
        pairs.groupBy("property_1", "property_2")
        .agg(F.count("*").alias("n"), correlation("x", "y").alias("r"))
        .where((F.col("n") >= min_pairs) & F.col("r").isNotNull())
    )
    out = out.withColumn("t", pvalues.pearson_t(F.col("r"), F.col("n")))
    return out.withColumn("p_value", pvalues.t_pvalue(F.col("t"), F.col("n") - 2))


def iqr_outliers(
    measurements: DataFrame, min_count: int = 10, fence: float = 3.0, max_share: float = 0.05
) -> DataFrame:
    """Rows outside q1 - 3 iqr .. q3 + 3 iqr, for properties where they stay under ``max_share``."""
    rows = measurements.where(F.col("value").isNotNull() & F.col("property_type").isNotNull())
    bounds = outlier_bounds(rows, min_count, fence)
    outside = checked_lookup(rows, bounds, "property_type").where(
        (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    )
    counts = outside.groupBy("property_type").agg(F.count("*").alias("n_outliers"))
    kept = counts.join(bounds.select("property_type", "n"), "property_type").where(
        F.col("n_outliers") < F.col("n") * max_share
    )
    return checked_lookup(outside, kept.select("property_type", "n_outliers"), "property_type")


def outlier_bounds(rows: DataFrame, min_count: int = 10, fence: float = 3.0) -> DataFrame:
    quantiles = exact_quantiles(rows, ["property_type"], "value", [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return quantiles.where(F.col("n") >= min_count).select(
        "property_type", "n",
        (F.col("q1") - fence * iqr).alias("lower"),
        (F.col("q3") + fence * iqr).alias("upper"),
    )


def dominant_component_stats(wide: DataFrame, fractions: list[str], value: str, above: float = 0.5) -> DataFrame:
    """Per component column: mean, sample std, min, max, count of rows where it exceeds ``above``."""
    long = wide.select(value, *fractions).unpivot([value], fractions, "component", "fraction")
    return (
        long.where(F.col("fraction") > above)
        .groupBy("component")
        .agg(
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.count("*").alias("count"),
        )
    )


def cross_property_correlations(component_properties: DataFrame, component_values: DataFrame) -> DataFrame:
    """Per property: correlation over components between its value and the component's mean.

    ``component_properties(component, property_type, property_value)`` and
    ``component_values(component, mean)``; one row per property with its strength label.
    """
    joined = component_properties.join(component_values, "component")
    out = joined.groupBy("property_type").agg(
        correlation("property_value", "mean").alias("correlation"),
        F.count("*").alias("n_components"),
    )
    r = F.abs("correlation")
    label = F.when(r > 0.5, "strong").when(r > 0.3, "moderate").otherwise("weak")
    return out.withColumn("strength", label)


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column to [0, 1]; 0.5 where constant, 0 where null. One small aggregate, no window."""
    ranges = df.agg(
        F.struct(*[F.min(c).alias(f"min_{i}") for i, c in enumerate(columns)],
                 *[F.max(c).alias(f"max_{i}") for i, c in enumerate(columns)]).alias("r")
    ).scalar()
    scaled = {}
    for i, c in enumerate(columns):
        low, high = ranges.getField(f"min_{i}"), ranges.getField(f"max_{i}")
        value = F.when(high > low, (F.col(c) - low) / F.nullif(high - low, F.lit(0))).otherwise(0.5)
        scaled[c] = F.when(F.col(c).isNull(), 0.0).otherwise(value)
    return df.withColumns(scaled)


def log_scaled_sizes(df: DataFrame, column: str, low: float = 0.4, high: float = 1.2) -> DataFrame:
    """log10(x + 1) mapped linearly onto [low, high]; the middle value if all are equal."""
    logged = df.withColumn("log_value", F.log10(F.col(column) + 1))
    bounds = logged.agg(F.struct(F.min("log_value").alias("a"), F.max("log_value").alias("b")).alias("s")).scalar()
    a, b = bounds.getField("a"), bounds.getField("b")
    share = (F.col("log_value") - a) / F.nullif(b - a, F.lit(0.0))
    return logged.withColumn("size", F.when(b > a, low + (high - low) * share).otherwise((low + high) / 2))


def comparison_pivot(component_properties: DataFrame, properties: list[str]) -> DataFrame:
    """One row per component, one column per listed property (first value in source order)."""
    picks = [
        F.min_by(F.when(F.col("property_type") == p, F.col("property_value")),
                 F.when(F.col("property_type") == p, F.col("row_order"))).alias(p)
        for p in properties
    ]
    return component_properties.where(F.col("property_type").isin(properties)).groupBy("component").agg(*picks)


def energy_gap(wide: DataFrame, low: str, high: str, out: str = "gap") -> DataFrame:
    return wide.withColumn(out, F.col(high) - F.col(low))


def melt(wide: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return wide.select(*ids, *columns).unpivot(ids, columns, name, value)
