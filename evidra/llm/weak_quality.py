"""Quality by weak supervision (operator 8), in DataFrame functions only.

Rules look at counts of a text and each votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the vote patterns of all documents estimates how often each rule is right about good and about bad
documents, without labels; a document's verdict is the posterior probability of good under these
accuracies. Patterns are counted on Spark; with eight rules there are at most 3^8 of them, whatever the
corpus, and only their counts reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from evidra.llm.common import WORD, written

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_capitals", "n_shouts", "n_stops", "n_signs")
#: Starting chances of a bad vote, an abstention and a good vote: of a bad and of a good document.
START = ((0.5, 0.3, 0.2), (0.05, 0.35, 0.6))
PRIOR = 0.8
#: Votes that each rule is taken to have cast, by its starting chances, before any document is seen.
SMOOTH = 2.0
ROUNDS = 50


def _removed(text: Column, signs: str) -> Column:
    """How many characters of ``text`` are among ``signs``."""
    return (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")


def _repeated(words: Column, n: Column) -> Column:
    """Words inside three-word windows that the text has twice or more.

    Windows are sorted by hash; those with an equal neighbour are repeated. Their positions, in order,
    each cover three words less what the one before has covered.
    """
    def covered(windows: Column) -> Column:
        m = F.size(windows)
        again = F.filter(
            F.sequence(F.lit(0), m - 1),
            lambda k: ((k > 0) & (windows[k]["h"] == windows[F.greatest(k - 1, F.lit(0))]["h"]))
            | ((k < m - 1) & (windows[k]["h"] == windows[F.least(k + 1, m - 1)]["h"])),
        )
        at = F.array_sort(F.transform(again, lambda k: windows[k]["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(
            at, start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")), lambda a: a["sum"]
        )

    windows = F.array_sort(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))
    )
    # One-element arrays bind a value once, so that it is not worked out again for every element.
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.transform(F.array(windows), covered)[0])


def with_counts(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` columns of ``docs`` and the counts of its text."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        *kept, text.alias("_t"),
        F.filter(F.split(text, BLANKS), lambda w: w != "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_l"),
    )
    names = [c for c in cut.columns if c not in ("_t", "_w", "_l")]
    t, n = F.col("_t"), F.size("_w")
    return cut.select(
        *names, n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _removed(t, SYMBOLS).alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_w"), n).alias("n_repeat_words"), F.size("_l").cast("long").alias("n_lines"),
        _removed(t, CAPITALS).alias("n_capitals"), _removed(t, "!").alias("n_shouts"), _removed(t, ".,").alias("n_stops"),
        F.length(F.regexp_replace(t, "[\\p{L}\\p{N}\\x20\\x09-\\x0D]+", "")).cast("long").alias("n_signs"),
    )


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def votes() -> list[Column]:
    """The rules' votes, from the counts. What looks wrong in itself is voted bad and its absence is no
    evidence of good; only sentence-like punctuation, short of signs, is voted good."""
    c = {name: F.col(name) for name in (*COUNTS, *_MORE)}
    words, chars = c["n_words"], c["word_chars"]
    return [
        _vote(100 * c["n_symbols"] > 5 * chars),
        _vote(100 * c["n_signs"] > 12 * chars, 100 * c["n_signs"] <= 8 * chars),
        _vote(3 * c["n_symbols"] > words),
        _vote(100 * c["n_capitals"] > 30 * chars),
        _vote(100 * c["n_shouts"] > 20 * words),
        _vote(100 * c["n_repeat_words"] > 30 * words),
        _vote(100 * c["n_dup_lines"] > 30 * c["n_lines"]),
        _vote((chars < 2 * words) | (chars > 15 * words) | (100 * c["n_stops"] < words), 100 * c["n_stops"] >= 5 * words),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def pattern() -> Column:
    """The votes as one number: a base-3 digit per rule."""
    return sum(((v + 1) * 3**j for j, v in enumerate(votes())), F.lit(0)).cast("int")


def unpacked(code: int, rules: int) -> list[int]:
    return [code // 3**j % 3 - 1 for j in range(rules)]


def fit(counts: dict[int, int], rules: int, rounds: int = ROUNDS) -> tuple[float, list]:
    """(share of good, chances per rule) from counts of vote patterns.

    A rule's chances are those of (bad vote, abstention, good vote), of a bad and of a good document; its
    accuracy is the chance of the right vote. Votes are taken as independent given the class. A rule keeps
    its starting chances where it has seen nothing.
    """
    prior, chances = PRIOR, [START] * rules
    table = [(unpacked(code, rules), n) for code, n in sorted(counts.items())]
    for _ in range(rounds):
        total = good_total = 0.0
        cast = [[[SMOOTH * c for c in kind] for kind in START] for _ in range(rules)]
        for cast_votes, n in table:
            p = posterior_of(cast_votes, prior, chances)
            total, good_total = total + n, good_total + n * p
            for j, v in enumerate(cast_votes):
                cast[j][0][v + 1] += n * (1 - p)
                cast[j][1][v + 1] += n * p
        if not total:
            break
        prior = min(max(good_total / total, 0.05), 0.95)
        chances = [tuple(tuple(c / sum(kind) for c in kind) for kind in rule) for rule in cast]
    return prior, chances


def _weights(prior: float, chances) -> tuple[float, list[list[float]]]:
    """Log odds of good: at the start, and what each outcome of each rule adds."""
    return math.log(prior / (1 - prior)), [[math.log(g / b) for b, g in zip(*rule)] for rule in chances]


def posterior_of(cast_votes: list[int], prior: float, chances) -> float:
    odds, weights = _weights(prior, chances)
    odds += sum(w[v + 1] for v, w in zip(cast_votes, weights))
    return 1 / (1 + math.exp(-max(min(odds, 700.0), -700.0)))


def posterior(code: Column, prior: float, chances) -> Column:
    """The probability of good for a column of packed votes."""
    odds, weights = _weights(prior, chances)
    total = F.lit(odds)
    for j, (bad, none, good) in enumerate(weights):
        digit = F.pmod(F.floor(code / F.lit(3**j)), F.lit(3))
        total = total + F.when(digit == 2, good).when(digit == 0, bad).otherwise(none)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _fitted(table: DataFrame, code: str):
    """Documents that fail the base rules are bad whatever the votes, and are left out of the estimate."""
    counts = {r[0]: r[1] for r in table.where(~F.col("base_failed")).groupBy(code).agg(F.count("*")).collect()}  # at most 3^8 rows
    return fit(counts, len(votes()))


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, posterior) of every row.

    A null text has no words and fails the base; so does every text of fewer than ``MIN_WORDS`` words.
    Repeated rows get equal verdicts; null ids stay; an empty table gives no rows. Only doc_id and text
    are read. The counts are written once; the estimate and the verdicts read that table.
    """
    table = with_counts(docs, F.col("doc_id")).select("doc_id", *COUNTS, base_failed().alias("base_failed"), pattern().alias("_code"))
    table = written(table)
    good = posterior(F.col("_code"), *_fitted(table, "_code"))
    return table.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (good >= 0.5)).alias("kept"), good.alias("posterior"))


def quality_kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    table = written(with_counts(docs, row).select("_row", base_failed().alias("base_failed"), pattern().alias("_code")))
    good = posterior(F.col("_code"), *_fitted(table, "_code"))
    return table.where(~F.col("base_failed") & (good >= 0.5)).select("_row.*")
