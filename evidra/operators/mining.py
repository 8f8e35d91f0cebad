"""Component-property and component-component mining.

Inputs
    components(formulation_id, molecule_id, amount, position): one row per listed component;
        the same molecule may be listed twice (bag), unless an operator says it uses sets.
    measurements(formulation_id, property_type, value, temperature).

Every operator first reduces components to one row per (formulation, molecule) and
measurements to one row per (formulation, property). A formulation with a third of all rows
therefore enters the star join as its distinct components times its distinct properties, and
"without" figures come from totals by subtraction rather than from a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidra.functions import pvalues, scalar
from evidra.operators.ranking import exact_quantiles
from evidra.operators.skew import checked_lookup
from evidra.session import cut_lineage

HOT_FORMULATION = 1_000  # distinct components from which a formulation's pairs are salted
SALTS = 32
#: Formulations counted as frequent in a property, and the rows from which their rows are summed before they travel.
FREQUENT = 100
HEAVY_ROWS = 1_000_000


def multiplicities(components: DataFrame) -> DataFrame:
    """(formulation_id, molecule_id, m): how often each molecule is listed."""
    return components.groupBy("formulation_id", "molecule_id").agg(F.count("*").alias("m"))


def _property_rows(measurements: DataFrame, property_type: str) -> DataFrame:
    return measurements.where((F.col("property_type") == property_type) & F.col("value").isNotNull())


def presence_effects(
    components: DataFrame, measurements: DataFrame, property_type: str,
    min_samples: int = 5, min_correlation: float = 0.1,
) -> DataFrame:
    """Mean with vs without each component, scaled by the overall population deviation.

    "With" counts a repeated component once per listing; "without" are the values of the
    formulations that never list it.
    """
    rows = _property_rows(measurements, property_type)
    total = rows.agg(
        F.struct(
            F.count("*").alias("n"), F.sum("value").alias("s"), F.stddev_pop("value").alias("sd")
        ).alias("t")
    ).scalar()
    per_form = rows.groupBy("formulation_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    with_ = (
        multiplicities(components)
        .join(per_form, "formulation_id")
        .groupBy("molecule_id")
        .agg(
            F.sum(F.col("m") * F.col("n")).alias("n_with"),
            F.sum(F.col("m") * F.col("s")).alias("s_with"),
            F.sum("n").alias("n_in"),
            F.sum("s").alias("s_in"),
        )
    )
    n_without = total.getField("n") - F.col("n_in")
    mean_without = (total.getField("s") - F.col("s_in")) / F.nullif(F.col("n_without"), F.lit(0))
    effect = (F.col("mean_with") - F.col("mean_without")) / (total.getField("sd") + 1e-8)
    return (
        with_.where(F.col("n_with") >= min_samples)
        .withColumn("n_without", n_without)
        .where((F.col("n_without") >= min_samples) & (total.getField("n") >= min_samples))
        .withColumn("mean_with", F.col("s_with") / F.col("n_with"))
        .withColumn("mean_without", mean_without)
        .withColumn("correlation", effect)
        .where(F.abs("correlation") >= min_correlation)
        .select(
            F.col("molecule_id").alias("component_id"),
            F.lit(property_type).alias("property_type"),
            F.when(F.col("correlation") > 0, "increases").otherwise("decreases").alias("effect"),
            "correlation",
            F.col("n_with").alias("num_samples"),
            "n_without", "mean_with", "mean_without",
        )
    )


def amount_correlations(
    components: DataFrame, measurements: DataFrame, property_type: str,
    min_correlation: float = 0.1, temperature_range: tuple[float, float] = (15, 25), min_rows: int = 10,
) -> DataFrame:
    """Pearson r between a component's amount (0 where absent) and the value.

    The absent rows only add to n and to the value sums, so they are never built: with values
    centred on their mean, the covariance needs the present rows alone.
    """
    low, high = temperature_range
    t = F.col("temperature")
    rows = _property_rows(measurements, property_type).where(
        t.isNull() | (t == 0) | t.between(low, high)
    )
    total = rows.agg(
        F.struct(
            F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
        ).alias("t")
    ).scalar()
    n, mean, sd = (total.getField(f) for f in ("n", "mean", "sd"))
    per_form = rows.groupBy("formulation_id").agg(
        F.count("*").alias("n"), F.sum(F.col("value") - mean).alias("dy")
    )
    amounts = components.groupBy("formulation_id", "molecule_id").agg(
        F.max_by("amount", F.struct("position", "amount")).alias("a")
    )
    sums = (
        amounts.join(per_form, "formulation_id")
        .groupBy("molecule_id")
        .agg(
            F.sum(F.col("a") * F.col("n")).alias("sx"),
            F.sum(F.col("a") * F.col("a") * F.col("n")).alias("sxx"),
            F.sum(F.col("a") * F.col("dy")).alias("sxy"),
        )
    )
    mean_x = F.col("sx") / F.nullif(n, F.lit(0))
    sd_x = F.sqrt(F.greatest(F.col("sxx") / F.nullif(n, F.lit(0)) - mean_x * mean_x, F.lit(0.0)))
    return (
        sums.where(n >= min_rows)
        .withColumn("mean_amount", mean_x)
        .withColumn("sd_amount", sd_x)
        .where(F.col("sd_amount") >= 1e-6)
        .withColumn("correlation", F.col("sxy") / n / F.nullif(F.col("sd_amount") * sd, F.lit(0.0)))
        .where(F.abs("correlation") >= min_correlation)
        .select(
            F.col("molecule_id").alias("component_id"),
            F.lit(property_type).alias("property_type"),
            F.when(F.col("correlation") > 0, "increases").otherwise("decreases").alias("effect"),
            scalar.correlation_strength(F.col("correlation")).alias("strength"),
            "correlation",
            n.alias("num_samples"),
            F.col("mean_amount").alias("mean_with"),
            F.lit(0.0).alias("mean_without"),
        )
    )


def pair_counts(mult: DataFrame, weight: Column | None = None) -> DataFrame:
    """(comp_1 < comp_2, pair_count) from one row per (formulation, component).

    ``weight`` combines ``m_1`` and ``m_2`` (their product counts listings; default counts
    formulations). If some formulations have very many distinct components, the left side of
    their self-join is spread over ``SALTS`` buckets. ``mult`` is read three times, so pass a
    table that is cheap to read.
    """
    sizes = mult.groupBy("formulation_id").agg(F.count("*").alias("k")).where(F.col("k") > HOT_FORMULATION)
    keys = ["formulation_id"]
    left = mult.select("formulation_id", F.col("molecule_id").alias("comp_1"), F.col("m").alias("m_1"))
    right = mult.select("formulation_id", F.col("molecule_id").alias("comp_2"), F.col("m").alias("m_2"))
    if not sizes.isEmpty():
        hot = cut_lineage(sizes.select("formulation_id", F.lit(True).alias("hot")))
        one = F.when(F.col("hot"), F.pmod(F.xxhash64("comp_1"), F.lit(SALTS)).cast("int")).otherwise(0)
        every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        left = left.join(hot, "formulation_id", "left").withColumn("salt", one).drop("hot")
        right = right.join(hot, "formulation_id", "left").withColumn("salt", F.explode(every)).drop("hot")
        keys.append("salt")
    pairs = left.join(right, keys).where(F.col("comp_1") < F.col("comp_2"))
    value = F.count("*") if weight is None else F.sum(weight)
    return pairs.groupBy("comp_1", "comp_2").agg(value.alias("pair_count"))


def co_occurrence_rules(
    components: DataFrame, min_support: int = 3, min_confidence: float = 0.5
) -> DataFrame:
    """Rules antecedent -> consequent over component *lists*, both directions of each pair.

    A molecule listed m times in a formulation pairs m(m-1)/2 times with itself and m1*m2
    times with another, as pairs of list positions would; the position pairs are not built.
    """
    mult = cut_lineage(multiplicities(components))
    counts = mult.groupBy("molecule_id").agg(
        F.sum("m").alias("n"), F.sum(F.shiftright(F.col("m") * (F.col("m") - 1), 1)).cast("bigint").alias("self_pairs")
    )
    distinct_pairs = pair_counts(mult, F.col("m_1") * F.col("m_2"))
    self_pairs = counts.where(F.col("self_pairs") > 0).select(
        F.col("molecule_id").alias("comp_1"), F.col("molecule_id").alias("comp_2"),
        F.col("self_pairs").alias("pair_count"),
    )
    pairs = distinct_pairs.unionByName(self_pairs).where(F.col("pair_count") >= min_support)
    directed = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("comp_1").alias("antecedent"), F.col("comp_2").alias("consequent"), "pair_count"),
                F.struct(F.col("comp_2").alias("antecedent"), F.col("comp_1").alias("consequent"), "pair_count"),
            )
        )
    )
    body = counts.select(F.col("molecule_id").alias("antecedent"), F.col("n").alias("n_body"))
    head = counts.select(F.col("molecule_id").alias("consequent"), F.col("n").alias("n_head"))
    return (
        directed.join(body, "antecedent").join(head, "consequent")
        .withColumn("confidence", F.col("pair_count") / F.col("n_body"))
        .where(F.col("confidence") >= min_confidence)
        .select(
            F.lit("co-occurs-with").alias("head_relation"), "antecedent", "consequent",
            F.col("pair_count").alias("support"), "confidence",
            (F.col("pair_count") / F.col("n_head")).alias("head_coverage"),
        )
    )


def threshold_rules(
    components: DataFrame, measurements: DataFrame, property_type: str,
    high_percentile: float = 75, low_percentile: float = 25,
    min_support: int = 3, min_confidence: float = 0.6,
) -> DataFrame:
    """Components whose formulations concentrate in the high or low class of a property."""
    rows = _property_rows(measurements, property_type)
    cuts = exact_quantiles(
        rows, [], "value", [low_percentile / 100, high_percentile / 100], ["low_cut", "high_cut"]
    ).select(F.struct("low_cut", "high_cut", "n").alias("c")).scalar()
    classed = rows.withColumn("high", (F.col("value") >= cuts.getField("high_cut")).cast("bigint")).withColumn(
        "low", (F.col("value") <= cuts.getField("low_cut")).cast("bigint")
    )
    per_form = classed.groupBy("formulation_id").agg(
        F.count("*").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")
    )
    size = classed.agg(F.struct(F.sum("high").alias("high"), F.sum("low").alias("low")).alias("s")).scalar()
    counts = (
        multiplicities(components).join(per_form, "formulation_id")
        .groupBy("molecule_id")
        .agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in ("n", "high", "low")])
    )
    long = counts.unpivot(["molecule_id", "n"], ["high", "low"], "class", "support")
    class_size = F.when(F.col("class") == "high", size.getField("high")).otherwise(size.getField("low"))
    return (
        long.where((F.col("support") >= min_support) & (cuts.getField("n") >= 2 * min_support))
        .withColumn("confidence", F.col("support") / F.col("n"))
        .where(F.col("confidence") >= min_confidence)
        .select(
            F.concat(F.col("class"), F.lit(f"_{property_type}")).alias("head_relation"),
            F.col("molecule_id").alias("antecedent"),
            "support", "confidence",
            (F.col("support") / class_size).alias("head_coverage"),
        )
    )


def association_lift(
    components: DataFrame, min_support: int = 5, min_confidence: float = 0.6, top_pairs: int | None = None
) -> DataFrame:
    """Lift of component pairs over component *sets*; confidence is half the lift, at most 1.

    Where ``top_pairs`` is given, only so many most frequent pairs are kept before the support test, ties
    by name. Components below the support cannot be part of a kept pair, so they are dropped before pairing.
    """
    sets = cut_lineage(components.select("formulation_id", "molecule_id").distinct())
    n_forms = sets.agg(F.count_distinct("formulation_id").alias("n")).scalar()
    freq = sets.groupBy("molecule_id").agg(F.count("*").alias("freq"))
    rare = freq.where(F.col("freq") < min_support).select("molecule_id")
    frequent = sets.join(rare, "molecule_id", "left_anti").withColumn("m", F.lit(1))
    top = pair_counts(frequent)
    if top_pairs is not None:
        top = top.orderBy(F.desc("pair_count"), "comp_1", "comp_2").limit(top_pairs)
    top = top.where(F.col("pair_count") >= min_support)
    f1 = freq.select(F.col("molecule_id").alias("comp_1"), F.col("freq").alias("freq_1"))
    f2 = freq.select(F.col("molecule_id").alias("comp_2"), F.col("freq").alias("freq_2"))
    p = lambda c: F.col(c) / n_forms
    return (
        top.join(f1, "comp_1").join(f2, "comp_2")
        .withColumn("lift", p("pair_count") / (p("freq_1") * p("freq_2")))
        .withColumn("confidence", F.least(F.lit(1.0), F.col("lift") / 2))
        .where(F.col("confidence") >= min_confidence)
        .withColumn("support_pct", p("pair_count") * 100)
    )


def causal_contrasts(
    components: DataFrame, measurements: DataFrame, min_support: int = 5
) -> DataFrame:
    """With/without contrast of every (component, property) over component sets.

    Values are centred on the mean of their property's rows before squaring, so the subtraction
    of sums of squares does not cancel. Only formulations with at least one component take part.
    """
    known = F.col("value").isNotNull() & F.col("property_type").isNotNull() & F.col("formulation_id").isNotNull()
    rows = measurements.where(known).select("formulation_id", "property_type", "value")
    frequent = F.expr(f"approx_top_k(formulation_id, {FREQUENT}, {100 * FREQUENT})")
    centre = cut_lineage(rows.groupBy("property_type").agg(F.avg("value").alias("centre"), frequent.alias("top")))
    heavy = centre.select(F.inline("top")).where(F.col("count") > HEAVY_ROWS).select("item").distinct()
    hot = [r["item"] for r in heavy.collect()]  # at most FREQUENT a property, and rows / HEAVY_ROWS
    d = F.col("value") - F.col("centre")
    centred = checked_lookup(rows, centre.select("property_type", "centre"), "property_type").select(
        "formulation_id", "property_type", d.alias("d"))
    first = F.row_number().over(Window.partitionBy("formulation_id").orderBy("molecule_id")) == 1
    # Placed by formulation once: the distinct rows, their first molecule and the join all stay where they are.
    sets = components.select("formulation_id", "molecule_id").repartition("formulation_id").distinct()

    def star(mine: DataFrame, theirs: DataFrame) -> DataFrame:
        """Sums of each molecule's formulations; t* count every formulation once, at its first molecule."""
        per_form = mine.groupBy("formulation_id", "property_type").agg(
            F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
        once = lambda c: F.sum(F.when(F.col("first"), F.col(c)))
        return theirs.withColumn("first", first).join(per_form, "formulation_id").groupBy("molecule_id", "property_type").agg(
            *[F.sum(c).alias(f"{c}_with") for c in ("n", "s", "ss")], *[once(c).alias(f"t{c}") for c in ("n", "s", "ss")])

    # Rows of a formulation meet once, and are joined where they are summed; a partial sum takes more room than a row.
    # Only formulations with very many rows are summed before they travel.
    if hot:
        heavy = F.coalesce(F.col("formulation_id").isin(hot), F.lit(False))
        sums = star(centred.where(~heavy).repartition("formulation_id"), sets.where(~heavy)).unionByName(
            star(centred.where(heavy), sets.where(heavy)))
        sums = sums.groupBy("molecule_id", "property_type").agg(*[F.sum(c).alias(c) for c in sums.columns[2:]])
    else:
        sums = star(centred.repartition("formulation_id"), sets)
    sums = cut_lineage(sums)
    totals = sums.groupBy("property_type").agg(*[F.sum(c).alias(c) for c in ("tn", "ts", "tss")])
    totals = totals.join(centre.select("property_type", "centre"), "property_type")
    with_ = sums.select("molecule_id", "property_type", "n_with", "s_with", "ss_with").where(F.col("n_with") >= min_support)
    out = (
        checked_lookup(with_, totals, "property_type")
        .withColumn("n_without", F.col("tn") - F.col("n_with"))
        .where(F.col("n_without") >= min_support)
        .withColumn("m1", F.col("s_with") / F.nullif(F.col("n_with"), F.lit(0)))
        .withColumn("m2", (F.col("ts") - F.col("s_with")) / F.nullif(F.col("n_without"), F.lit(0)))
        .withColumn("css1", F.greatest(F.col("ss_with") - F.col("n_with") * F.col("m1") * F.col("m1"), F.lit(0.0)))
        .withColumn(
            "css2",
            F.greatest(
                F.col("tss") - F.col("ss_with") - F.col("n_without") * F.col("m2") * F.col("m2"), F.lit(0.0)
            ),
        )
    )
    sd_without = F.sqrt(F.col("css2") / F.nullif(F.col("n_without"), F.lit(0)))
    effect = F.coalesce((F.col("m1") - F.col("m2")) / F.nullif(sd_without, F.lit(0.0)), F.lit(0.0))
    t = pvalues.pooled_t(
        F.col("n_with"), F.col("m1"), F.col("css1"), F.col("n_without"), F.col("m2"), F.col("css2")
    )
    out = out.select(
        "molecule_id", "property_type", "n_with", "n_without",
        (F.col("m1") + F.col("centre")).alias("with_mean"),
        (F.col("m2") + F.col("centre")).alias("without_mean"),
        effect.alias("effect_size"), t.alias("t_statistic"),
    ).where((F.col("n_with") >= 3) & (F.col("n_without") >= 3))
    return out.withColumn(
        "p_value", pvalues.t_pvalue(F.col("t_statistic"), F.col("n_with") + F.col("n_without") - 2)
    )


def mined_families(
    components: DataFrame, measurements: DataFrame, property_type: str,
    min_support: int = 3, min_confidence: float = 0.5, min_correlation: float = 0.1,
) -> DataFrame:
    """How many patterns and rules each of the four families yields."""
    families = {
        "patterns": presence_effects(components, measurements, property_type, min_support, min_correlation),
        "amount_patterns": amount_correlations(components, measurements, property_type, min_correlation),
        "co_occurrence_rules": co_occurrence_rules(components, min_support, min_confidence),
        "threshold_rules": threshold_rules(
            components, measurements, property_type, min_support=min_support, min_confidence=min_confidence
        ),
    }
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "n")
        for name, df in families.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
