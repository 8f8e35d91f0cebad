"""The discovery loop: explore, propose, evaluate, queue for curation.

One lazy plan per output. The proposals feed several outputs, so they are checkpointed once
after ranking, when at most ``max_hypotheses`` rows are left.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from evidra import vocab
from evidra.operators import curation, gaps as G, hypotheses as H, mining as M, stats as ST, summaries as SU
from evidra.session import cut_lineage


@dataclass(frozen=True)
class Graph:
    """Inputs of the loop.

    molecules(id, role, smiles), formulations(id), components(formulation_id, molecule_id,
    ...), measurements(id, entity_id, formulation_id, property_type, value),
    relations(subject, predicate, object), proposed(subject, predicate, object).
    """

    molecules: DataFrame
    formulations: DataFrame
    components: DataFrame
    formulation_measurements: DataFrame
    entity_measurements: DataFrame
    relations: DataFrame
    proposed: DataFrame


@dataclass(frozen=True)
class Discovery:
    gaps: DataFrame
    tasks: DataFrame
    proposals: DataFrame
    evaluated: DataFrame
    queue: DataFrame
    funnel: DataFrame


def propose(
    graph: Graph, association: bool = True, correlation: bool = True, causal: bool = True,
    min_confidence: float = 0.6, min_support: int = 5, max_hypotheses: int | None = None, alpha: float = 0.05,
) -> DataFrame:
    strategies = []
    if association:
        strategies.append(H.association_hypotheses(M.association_lift(graph.components, min_support, min_confidence)))
    if correlation:
        strategies.append(H.correlation_hypotheses(
            ST.property_correlations(graph.entity_measurements), min_confidence, alpha))
    if causal:
        contrasts = M.causal_contrasts(graph.components, graph.formulation_measurements, min_support)
        strategies.append(H.causal_hypotheses(contrasts, min_confidence, alpha))
    union = reduce(DataFrame.unionByName, strategies)
    return H.rank_proposals(H.with_novelty(union, graph.relations, graph.proposed), graph.relations, max_hypotheses)


def run(
    graph: Graph, min_confidence: float = 0.6, min_support: int = 5, max_hypotheses: int | None = None,
    validation_threshold: float = 0.7, alpha: float = 0.05,
    expected: list[str] = vocab.EXPECTED_SOLVENT_PROPERTIES,
    association: bool = True, correlation: bool = True, causal: bool = True,
    coverage: bool = True, links: bool = True, properties: bool = True, outliers: bool = True, max_tasks: int | None = None,
) -> Discovery:
    """One pass of the loop over the whole graph; nothing is cut unless a maximum is given."""
    found = cut_lineage(G.explore(
        graph.molecules, graph.formulations, graph.entity_measurements, graph.relations, expected,
        coverage, links, properties, outliers,
    ))
    proposals = cut_lineage(propose(
        graph, association, correlation, causal, min_confidence, min_support, max_hypotheses, alpha))
    stats = ST.property_stats(graph.formulation_measurements)
    evaluated = cut_lineage(H.evaluate(
        proposals, graph.molecules, graph.relations, stats, validation_threshold=validation_threshold))
    by = lambda s: evaluated.where(F.col("status") == s)
    queue = curation.curation_queue(evaluated)
    tasks = G.candidate_tasks(found, max_tasks)
    funnel = SU.funnel(
        gaps_found=found, hypothesis_candidates=tasks, hypotheses_generated=proposals,
        validated=by("validated"), rejected=by("rejected"), inconclusive=by("inconclusive"), ready_for_curation=queue,
    )
    return Discovery(found, tasks, proposals, evaluated, queue, funnel)


def run_quick(graph: Graph, **overrides) -> Discovery:
    """The reduced preset: no link gaps, no correlations, fewer hypotheses, more support."""
    preset = dict(links=False, correlation=False, max_hypotheses=20, max_tasks=20, min_support=10)
    return run(graph, **{**preset, **overrides})


def run_metrics(funnel: DataFrame) -> DataFrame:
    """Validation rate and funnel conversion of one run."""
    n = lambda stage: F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("n"))), F.lit(0))
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return funnel.agg(
        n("gaps_found").alias("total_gaps"), n("hypotheses_generated").alias("total_hypotheses"),
        n("validated").alias("validated"), n("ready_for_curation").alias("ready_for_curation"),
    ).withColumns({
        "validation_rate": rate("validated", "total_hypotheses"),
        "funnel_conversion": rate("validated", "total_gaps"),
    })
