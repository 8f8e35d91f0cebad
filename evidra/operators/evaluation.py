"""Ranking and regression metrics, time slices, ablation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidra.functions import pvalues
from evidra.operators.ranking import global_row_number
from evidra.operators.relational import SPO, triples
from evidra.operators.skew import checked_lookup
from evidra.session import cut_lineage

MAX_FEATURES = 2_000
#: Square matrices of so many components, one for each fold, are solved by :func:`linear_ablation`.
GRAM_FEATURES = 1_000


def ranking_metrics(ranks: DataFrame, rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """MRR, hits@1/3/10 and the number of queries."""
    hits = [F.avg((F.col(rank) <= k).cast("double")).alias(f"hits_at_{k}") for k in (1, 3, 10)]
    return ranks.groupBy(*by).agg(F.avg(1 / F.col(rank)).alias("mrr"), *hits, F.count("*").alias("num_queries"))


def regression_metrics(pairs: DataFrame, y: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE, MAE and R^2 of predictions."""
    e = F.col(y) - F.col(predicted)
    agg = pairs.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count("*")).alias("_sst"), F.count("*").alias("num_samples"),
    )
    return agg.withColumn("r2", 1 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0))).drop("_sse", "_sst")


def edge_dates(relations: DataFrame, provenance: DataFrame, dated_sources: DataFrame | None = None) -> DataFrame:
    """Edges with their earliest known date: of the source's publication or of the record.

    ``relations`` carry ``provenance_id``; edges without a dated record get null.
    """
    records = provenance.select(F.col("id").alias("provenance_id"), "created_on", "source_ids")
    if dated_sources is not None:
        listed = records.select("provenance_id", F.explode("source_ids").alias("source_id"))
        published = (
            listed.join(dated_sources.select(F.col("id").alias("source_id"), "published_on"), "source_id")
            .groupBy("provenance_id").agg(F.min("published_on").alias("published_on"))
        )
        records = records.join(published, "provenance_id", "left")
        date = F.coalesce("published_on", "created_on")
    else:
        date = F.col("created_on")
    dated = records.select("provenance_id", date.alias("edge_date"))
    return relations.join(dated, "provenance_id", "left")


def first_seen(dated_edges: DataFrame) -> DataFrame:
    """Triples with the earliest date any of their edges carries."""
    return dated_edges.groupBy(*SPO).agg(F.min("edge_date").alias("first_seen"))


def time_split(seen: DataFrame, cutoff: str) -> DataFrame:
    """Triples with ``slice``: pre if first seen up to the cut-off (or undated), else post."""
    late = F.col("first_seen") > F.lit(cutoff).cast("date")
    return seen.withColumn("slice", F.when(late, "post").otherwise("pre"))


def rank_by_confidence(hypotheses: DataFrame) -> DataFrame:
    return global_row_number(hypotheses, [F.desc("confidence"), F.asc("id")])


def mark_time_slice(ranked: DataFrame, post: DataFrame) -> DataFrame:
    """Ranked hypotheses with a hit flag; hits are validated and pass the slice."""
    hit = triples(post).withColumn("hit", F.lit(True))
    marked = ranked.join(hit, SPO, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return marked.withColumn("status", F.when(F.col("hit"), "validated").otherwise(F.col("status"))).withColumn(
        "passed_time_slice", F.col("hit")
    )


def time_slice_result(marked: DataFrame, cutoff: str) -> DataFrame:
    """hits, hit rate, average rank and MRR over the hits of one cut-off."""
    rank = F.when(F.col("hit"), F.col("rank"))
    return marked.agg(
        F.count("*").alias("num_hypotheses"), F.count_if("hit").alias("num_appeared_after"),
        F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(rank), F.lit(float("inf"))).alias("avg_rank"),
        F.coalesce(F.avg(1 / rank), F.lit(0.0)).alias("mrr"),
    ).select(F.lit(cutoff).alias("cutoff"), "*")


def time_slice_experiment(hypotheses: DataFrame, dated_edges: DataFrame, cutoffs: list[str]) -> DataFrame:
    """One result row per cut-off; only edges first seen after it count as hits.

    Hypotheses are ranked and dated once. Each is counted under the number of cut-offs that its date comes after,
    and a cut-off's hits are the running sums over at most one row per cut-off, so a hundred cut-offs take the jobs
    of one. Rows without a date are no hits; without hypotheses every cut-off gets zeros.
    """
    spark = hypotheses.sparkSession
    days = sorted(set(cutoffs))
    before = F.filter(F.array(*[F.lit(c).cast("date") for c in days]), lambda day: day < F.col("first_seen"))
    dated = rank_by_confidence(hypotheses).join(first_seen(dated_edges), SPO, "left")
    steps = dated.groupBy(F.size(before).alias("passed")).agg(
        F.count("*").alias("n"), F.sum("rank").alias("ranks"), F.sum(1 / F.col("rank")).alias("inverse")
    )
    asked = spark.createDataFrame([(days.index(c) + 1, c) for c in cutoffs], "passed int, cutoff string")
    after = Window.orderBy(F.desc("passed")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    hits = F.coalesce(F.sum("n").over(after), F.lit(0))
    summed = steps.unionByName(asked, allowMissingColumns=True).select(
        "cutoff", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("num_hypotheses"), hits.alias("num_appeared_after"),
        F.sum("ranks").over(after).alias("ranks"), F.sum("inverse").over(after).alias("inverse"),
    )
    found = F.nullif(F.col("num_appeared_after"), F.lit(0))
    return summed.where("cutoff is not null").select(
        "cutoff", "num_hypotheses", "num_appeared_after",
        F.coalesce(F.col("num_appeared_after") / F.nullif(F.col("num_hypotheses"), F.lit(0)), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.col("ranks") / found, F.lit(float("inf"))).alias("avg_rank"),
        F.coalesce(F.col("inverse") / found, F.lit(0.0)).alias("mrr"),
    )


def time_slice_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("num_evaluations"), F.avg("hit_rate").alias("avg_hit_rate"), F.avg("mrr").alias("avg_mrr"),
        F.sum("num_appeared_after").alias("total_validated"),
    )


def feature_matrix(components: DataFrame, labels: DataFrame, vocabulary: list | None = None) -> DataFrame:
    """One row per labelled formulation, one column ``c_i`` per component, the last listed amount.

    ``labels(formulation_id, label)``. Columns must fit a row, so a vocabulary above
    ``MAX_FEATURES`` is refused.
    """
    if vocabulary is None:
        found = components.select("molecule_id").distinct().limit(MAX_FEATURES + 1).collect()
        vocabulary = sorted(r[0] for r in found)
    if len(vocabulary) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} component columns")
    last = components.where(F.col("molecule_id").isin(vocabulary)).groupBy("formulation_id", "molecule_id").agg(
        F.max_by("amount", F.struct("position", "amount")).alias("a")
    )
    cols = [
        F.coalesce(F.max(F.when(F.col("molecule_id") == m, F.col("a"))), F.lit(0.0)).alias(f"c_{i}")
        for i, m in enumerate(vocabulary)
    ]
    # At most MAX_FEATURES rows of a formulation meet before they turn into one wide row, which would else travel per component.
    wide = last.repartition("formulation_id").groupBy("formulation_id").agg(*cols)
    joined = labels.join(wide, "formulation_id", "left")
    return joined.fillna(0.0, subset=[f"c_{i}" for i in range(len(vocabulary))])


def first_labels(measurements: DataFrame, property_type: str) -> DataFrame:
    """The first (by id) value of a property per formulation."""
    rows = measurements.where((F.col("property_type") == property_type) & F.col("value").isNotNull())
    return rows.groupBy("formulation_id").agg(F.min_by("value", "id").alias("label"))


def ablation_errors(
    features: DataFrame, hypotheses: list[tuple[str, int | None]], n_folds: int = 5, estimator=None,
) -> DataFrame:
    """(hypothesis_id, fold, baseline_rmse, with_edge_rmse).

    ``hypotheses`` pairs an id with its component's column number (None: no such column, the
    indicator is constant zero). Folds come from a hash of the formulation id, so they do not
    depend on row order; every model is a distributed fit.
    """
    estimator = estimator or RandomForestRegressor(numTrees=100, seed=42)
    estimator = estimator.copy().setFeaturesCol("features").setLabelCol("label").setPredictionCol("prediction")
    base = sorted((c for c in features.columns if c.startswith("c_")), key=lambda c: int(c[2:]))
    data = features.withColumn("fold", F.pmod(F.xxhash64("formulation_id"), F.lit(n_folds)).cast("int"))
    for hid, column in hypotheses:
        flag = F.lit(0.0) if column is None else (F.col(f"c_{column}") > 0).cast("double")
        data = data.withColumn(f"h_{hid}", flag)
    data = cut_lineage(data)

    def rmse(columns: list[str], fold: int) -> float:
        vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(data)
        model = estimator.fit(vectors.where(F.col("fold") != fold))
        scored = model.transform(vectors.where(F.col("fold") == fold))
        return scored.agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))).first()[0]

    baseline = [rmse(base, f) for f in range(n_folds)]
    rows = [
        (hid, f, baseline[f], rmse(base + [f"h_{hid}"], f)) for hid, _ in hypotheses for f in range(n_folds)
    ]
    return features.sparkSession.createDataFrame(
        rows, "hypothesis_id string, fold int, baseline_rmse double, with_edge_rmse double"
    )


def ablation_results(errors: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean RMSEs, delta, relative improvement, paired t-test and the status it implies."""
    diff = F.col("baseline_rmse") - F.col("with_edge_rmse")
    agg = errors.groupBy("hypothesis_id").agg(
        F.avg("baseline_rmse").alias("baseline_rmse"), F.avg("with_edge_rmse").alias("with_edge_rmse"),
        F.avg(diff).alias("_d"), F.stddev_samp(diff).alias("_sd"), F.count("*").alias("num_folds"),
    )
    out = agg.withColumn("delta_rmse", F.col("with_edge_rmse") - F.col("baseline_rmse"))
    out = out.withColumn("t", pvalues.paired_t(F.col("num_folds"), F.col("_d"), F.col("_sd")))
    out = out.withColumn("p_value", pvalues.t_pvalue(F.col("t"), F.col("num_folds") - 1))
    better = F.coalesce(F.col("p_value") < alpha, F.lit(False)) & (F.col("delta_rmse") < 0)
    return (
        out.withColumn("relative_improvement", F.when(
            F.col("baseline_rmse") > 0, -F.col("delta_rmse") / F.nullif(F.col("baseline_rmse"), F.lit(0.0))).otherwise(0.0))
        .withColumn("is_significant", better)
        .withColumn("model_lift", F.greatest(-F.col("delta_rmse"), F.lit(0.0)))
        .withColumn("status", F.when(better, "validated").when(
            F.col("delta_rmse") > 0.05 * F.col("baseline_rmse"), "rejected").otherwise("proposed"))
        .drop("_d", "_sd")
    )


def sparse_features(components: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component numbers (molecule_id, idx) in order of the ids, and one sparse row per labelled formulation.

    Rows are (formulation_id, label, indices, amounts), indices ascending, with the last listed amount of
    each component that is not null. A row holds its own components only, so their number overall is free.
    """
    ids = global_row_number(components.select("molecule_id").where("molecule_id IS NOT NULL").distinct(), [F.col("molecule_id")], "idx")
    ids = cut_lineage(ids.withColumn("idx", F.col("idx") - 1))
    last = components.groupBy("formulation_id", "molecule_id").agg(F.max_by("amount", F.struct("position", "amount")).alias("amount"))
    # Amounts are one row per formulation and component by now, so a component in a third of all formulations is the only hot key.
    entries = checked_lookup(last.where("amount IS NOT NULL"), ids, "molecule_id").where("idx IS NOT NULL")
    rows = entries.groupBy("formulation_id").agg(F.sort_array(F.collect_list(F.struct("idx", "amount"))).alias("e"))
    entry = "array<struct<idx:bigint,amount:double>>"
    out = labels.select("formulation_id", "label").join(rows, "formulation_id", "left")
    out = out.withColumn("e", F.coalesce(F.col("e").cast(entry), F.array().cast(entry)))
    return ids, out.select("formulation_id", "label", F.col("e.idx").alias("indices"), F.col("e.amount").alias("amounts"))


def fold_grams(rows: DataFrame, indicated: DataFrame, fold: Column) -> DataFrame:
    """(fold, a, b, s): sums of products of columns a <= b over the rows of a fold, in one aggregation.

    Columns from 0 on are components, -1 is the constant, -2 the label and -3 - i the indicator of component i,
    for the ``indicated`` (idx) ones. Products are summed before the shuffle; indicators meet no other indicator.
    """
    wanted = [r.idx for r in indicated.select("idx").distinct().collect()]  # at most GRAM_FEATURES numbers
    entries = F.arrays_zip(F.col("indices").alias("i"), F.col("amounts").alias("x"))
    rows = rows.where("label IS NOT NULL").select(fold.alias("fold"), "label", entries.alias("e"))
    pair = lambda i, x: F.struct(i.cast("long").alias("i"), x.cast("double").alias("x"))
    present = F.filter("e", lambda e: (e["x"] > 0) & e["i"].isin(wanted))
    whole = F.concat(
        F.array(pair(F.lit(-1), F.lit(1)), pair(F.lit(-2), F.col("label"))), F.transform("e", lambda e: pair(e["i"], e["x"])),
        F.transform(present, lambda e: pair(-3 - e["i"], F.lit(1))),
    )
    pairs = rows.select("fold", whole.alias("e")).select("fold", "e", F.explode("e").alias("p")).select("fold", "p", F.explode("e").alias("q"))
    a, b = F.col("p.i"), F.col("q.i")
    return pairs.where((a <= b) & ((b > -3) | (a == b))).groupBy("fold", a.alias("a"), b.alias("b")).agg(F.sum(F.col("p.x") * F.col("q.x")).alias("s"))


def linear_errors(
    components: DataFrame, labels: DataFrame, hypotheses: DataFrame, n_folds: int = 5, ridge: float = 1e-3, fold: Column | None = None,
) -> DataFrame:
    """(hypothesis_id, fold, baseline_rmse, with_edge_rmse) of ridge regressions, without fitting one by one.

    ``hypotheses(hypothesis_id, molecule_id)``. One aggregation gives each fold's sums of products; a fold is fitted
    on the totals less its own, and its error follows from its own. A hypothesis adds the indicator of its component
    by a block update of the fold's inverse, all hypotheses in parallel. One whose component does not occur adds
    nothing. Fewer than two rows a fold on average give no errors. Up to ``GRAM_FEATURES`` components; beyond, use
    :func:`ablation_errors` with a distributed estimator.
    """
    ids, rows = sparse_features(components, labels)
    size = ids.count()
    if size > GRAM_FEATURES:
        raise ValueError(f"more than {GRAM_FEATURES} components")
    fold = F.pmod(F.xxhash64("formulation_id"), F.lit(n_folds)).cast("int") if fold is None else fold.cast("int")
    asked = hypotheses.select("hypothesis_id", "molecule_id").join(F.broadcast(ids), "molecule_id", "left")
    grams = cut_lineage(fold_grams(rows, asked.where("idx IS NOT NULL"), fold))
    base = np.zeros((n_folds, size + 2, size + 2))  # label, constant, components
    known = grams.where("a >= -2").toPandas()  # at most n_folds * (GRAM_FEATURES + 2) ** 2 / 2 rows
    f, a, b, s = (known[c].to_numpy() for c in ("fold", "a", "b", "s"))
    base[f, a + 2, b + 2] = base[f, b + 2, a + 2] = s
    spark = components.sparkSession
    schema = "idx bigint, fold int, with_edge_rmse double"
    folds = np.flatnonzero(base[:, 1, 1])
    if base[:, 1, 1].sum() < 2 * n_folds:
        folds = folds[:0]
    total, fits = base.sum(0), {}
    for k in folds.tolist():
        train = total - base[k]
        inverse = np.linalg.inv(train[1:, 1:] + ridge * np.eye(size + 1))
        fits[k] = (inverse, inverse @ train[1:, 0])

    def rmse(own: np.ndarray, w: np.ndarray) -> float:
        """From the sums of a fold, label first, and weights."""
        error = np.concatenate([[1.0], -w])
        return float(np.sqrt(max(error @ own @ error, 0.0) / own[1, 1]))

    held = spark.sparkContext.broadcast((base, fits))

    def updated(part: pd.DataFrame) -> pd.DataFrame:
        own, fitted = held.value
        z = np.zeros((n_folds, size + 3))  # products of the indicator with label, constant, components and itself
        at = part["b"].to_numpy()
        z[part["fold"], np.where(at <= -3, size + 2, at + 2)] = part["s"]
        out = []
        for k, (inverse, w) in fitted.items():
            train = z.sum(0) - z[k]
            shared = inverse @ train[1:-1]
            weight = (train[0] - train[1:-1] @ w) / (train[-1] + ridge - train[1:-1] @ shared)
            whole = np.block([[own[k], z[k, :-1, None]], [z[k]]])
            out.append((-3 - part["a"].iloc[0], k, rmse(whole, np.append(w - shared * weight, weight))))
        return pd.DataFrame(out, columns=["idx", "fold", "with_edge_rmse"])

    changed = grams.where("a <= -3").groupBy("a").applyInPandas(updated, schema)
    fitted = [F.struct(F.lit(k).alias("fold"), F.lit(rmse(base[k], w)).alias("baseline_rmse")) for k, (_, w) in fits.items()]
    if not fitted:
        return spark.createDataFrame([], "hypothesis_id string, fold int, baseline_rmse double, with_edge_rmse double")
    every = asked.select("hypothesis_id", "idx", F.inline(F.array(*fitted)))
    return every.join(changed, ["idx", "fold"], "left").select(
        "hypothesis_id", "fold", "baseline_rmse", F.coalesce("with_edge_rmse", "baseline_rmse").alias("with_edge_rmse")
    )


def linear_ablation(
    components: DataFrame, labels: DataFrame, hypotheses: DataFrame, n_folds: int = 5, top_k: int | None = None, **fitting,
) -> DataFrame:
    """:func:`ablation_results` of :func:`linear_errors` for all hypotheses, or the ``top_k`` by (confidence, id).

    Where there are too few rows to fit, every hypothesis gets the row of an undecided one: no errors, no folds.
    """
    if top_k is not None:
        hypotheses = cut_lineage(hypotheses.orderBy(F.desc("confidence"), "hypothesis_id").limit(top_k))
    results = ablation_results(linear_errors(components, labels, hypotheses, n_folds, **fitting))
    out = hypotheses.select("hypothesis_id").join(results, "hypothesis_id", "left")
    undecided = {"delta_rmse": 0.0, "relative_improvement": 0.0, "model_lift": 0.0, "num_folds": 0, "is_significant": False, "status": "proposed"}
    rmses = {c: F.coalesce(c, F.lit(float("nan"))) for c in ("baseline_rmse", "with_edge_rmse")}
    return out.withColumns(rmses | {c: F.coalesce(c, F.lit(v)) for c, v in undecided.items()})


def ablation_summary(results: DataFrame) -> DataFrame:
    significant = F.when(F.col("is_significant"), F.col("relative_improvement"))
    return results.agg(
        F.count("*").alias("num_studies"), F.count_if("is_significant").alias("num_significant"),
        F.avg("delta_rmse").alias("avg_delta_rmse"),
        F.coalesce(F.avg(significant), F.lit(0.0)).alias("avg_improvement"),
        F.coalesce(F.max(significant), F.lit(0.0)).alias("best_improvement"),
    )
