"""Column expressions: keys, names, units, classifiers and identifiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidra import vocab

_STRUCTURE_CHARS = r"[()\[\]=#@+\-/\\]"


def any_of(words: list[str]) -> str:
    """Regex matching any of the literal words."""
    return "|".join(re.escape(w) for w in words)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any word occurs: byte searches, which beat an alternation regex on long texts."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def canonical_key(key: Column) -> Column:
    """Trimmed structure key; empty becomes null."""
    return F.nullif(F.trim(key), F.lit(""))


def with_canonical_key(df: DataFrame, column: str, out: str = "canonical_key", udf=None) -> DataFrame:
    """Add the key; an optional canonicaliser runs once per *distinct* key, not per row."""
    keyed = df.withColumn(out, canonical_key(F.col(column)))
    if udf is None:
        return keyed
    mapping = keyed.select(out).where(F.col(out).isNotNull()).distinct()
    mapping = mapping.select(F.col(out).alias("_raw"), udf(F.col(out)).alias("_canonical"))
    joined = keyed.join(mapping, keyed[out] == mapping["_raw"], "left")
    return joined.withColumn(out, F.coalesce("_canonical", out)).drop("_raw", "_canonical")


def looks_like_structure(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(_STRUCTURE_CHARS)


def normalize_name(name: Column) -> Column:
    out = F.trim(F.lower(name))
    out = F.regexp_replace(out, r"\s*@\s*\w+", "")
    out = F.regexp_replace(out, r"\s*/\s*", "/")
    return F.regexp_replace(out, r"\s+", " ")


def conductivity_multiplier(unit: Column) -> Column:
    """Factor to S/cm; the order of the tests matters ('us' also sits in other words)."""
    u = F.trim(F.lower(unit))
    return (
        F.when(u.contains("ms") | u.contains("millisiemens"), 0.001)
        .when(u.contains("μs") | u.contains("us") | u.contains("microsiemens"), 0.000001)
        .when(u.contains("s/cm") | u.contains("scm"), 1.0)
        .when(u.contains("s/m"), 0.01)
        .otherwise(1.0)
    )


def is_electrolyte(name: Column, composition: Column) -> Column:
    """Electrode words exclude, then electrolyte words, known names or an Li/Na salt formula.

    ``composition`` is a printed list of element maps such as ``[{'Li': '1.0', 'P': '1.0'}]``;
    it is read with patterns only, one map at a time.
    """
    norm = normalize_name(name)
    known = [r[0] for r in vocab.rows(vocab.KNOWN_MATERIALS)]
    maps = F.regexp_extract_all(F.coalesce(composition, F.lit("")), F.lit(r"(\{[^{}]*\})"), F.lit(1))

    def has_key(m: Column, keys: list[str]) -> Column:
        return m.rlike(r"['\"](" + any_of(keys) + r")['\"]\s*:")

    salt_formula = F.coalesce(composition, F.lit("")).startswith("[") & F.exists(
        maps,
        lambda m: has_key(m, vocab.COMPOSITION_CATIONS) & has_key(m, vocab.COMPOSITION_ANIONS),
    )
    return (
        F.when(contains_any(norm, vocab.ELECTRODE_KEYWORDS), False)
        .when(contains_any(norm, vocab.ELECTROLYTE_KEYWORDS), True)
        .when(norm.isin(known), True)
        .otherwise(salt_formula)
    )


def material_role(name: Column) -> Column:
    is_salt = contains_any(normalize_name(name), vocab.SALT_NAME_PARTS)
    return F.when(is_salt, "salt").otherwise("solvent")


def infer_molecule_type(name: Column, structure: Column) -> Column:
    low, smi = F.lower(name), F.coalesce(structure, F.lit(""))
    return (
        F.when(contains_any(low, vocab.SALT_INDICATORS), "salt")
        .when(name.rlike(r"^(Li|Na)(.?\p{Lu}|\p{Lu})"), "salt")
        .when(smi.contains("[Li") | smi.contains("[Na"), "salt")
        .when(contains_any(low, vocab.SOLVENT_INDICATORS), "solvent")
        .otherwise("molecule")
    )


def celsius(temperature: Column) -> Column:
    """Above 200 is Kelvin; missing is 298.15 K."""
    t = F.coalesce(temperature, F.lit(298.15))
    return F.when(t > 200, t - 273.15).otherwise(t)


def ms_to_s_per_cm(value: Column) -> Column:
    return value / 1000.0


def default_temperature(temperature: Column) -> Column:
    return F.coalesce(temperature, F.lit(25.0))


def conductivity_from_log(log_ms: Column) -> Column:
    """10^x mS/cm to S/cm, null outside (1e-12, 1)."""
    v = F.pow(F.lit(10.0), log_ms) / 1000.0
    return F.when((v > 1e-12) & (v < 1.0), v)


def ionization_in_range(value: Column) -> Column:
    return F.when((value > 2.0) & (value < 15.0), value)


def efficiency_from_log(log_ci: Column) -> Column:
    """1 - 10^x, null outside (0, 1)."""
    v = 1.0 - F.pow(F.lit(10.0), log_ci)
    return F.when((v > 0.0) & (v < 1.0), v)


def conductivity_guard(value: Column) -> Column:
    return value.between(1e-12, 1.0)


def shorten(text: Column, longest: int = 30) -> Column:
    """Longer than ``longest`` becomes its first ``longest - 3`` characters and dots."""
    cut = F.concat(F.substring(text, 1, longest - 3), F.lit("..."))
    return F.when(F.length(text) > longest, cut).otherwise(text)


def readable_name(df: DataFrame, structure: str, out: str = "name") -> DataFrame:
    """Lookup by canonical, then raw structure; otherwise the shortened structure."""
    names = vocab.dimension(df.sparkSession, vocab.STRUCTURE_NAMES, ["_s", "_name"])
    raw = names.select(F.col("_s").alias("_s2"), F.col("_name").alias("_name2"))
    joined = df.join(F.broadcast(names), canonical_key(F.col(structure)) == F.col("_s"), "left").join(
        F.broadcast(raw), F.col(structure) == F.col("_s2"), "left"
    )
    empty = canonical_key(F.col(structure)).isNull()
    name = F.when(empty, "Unknown").otherwise(
        F.coalesce("_name", "_name2", shorten(F.col(structure)))
    )
    return joined.withColumn(out, name).drop("_s", "_name", "_s2", "_name2")


def composition_name(parts: Column, salt: Column, row: Column, shown: int = 3) -> Column:
    """First ``shown`` sorted parts, ``+n`` for the rest, then salt and row."""
    more = F.when(F.size(parts) > shown, F.concat(F.lit("+"), F.size(parts) - shown)).otherwise("")
    head = F.array_join(F.slice(F.array_sort(parts), 1, shown), "-")
    return F.concat(head, more, F.lit("/"), salt, F.lit("-"), row.cast("string"))


def cation_of(structure: Column) -> Column:
    return F.when(structure.contains("[Li"), "Li+").when(structure.contains("[Na"), "Na+")


def anion_of(salt_name: Column) -> Column:
    return F.replace(salt_name, F.lit("Li"), F.lit(""))


def concentration_unit(unit_text: Column) -> Column:
    text = F.coalesce(unit_text, F.lit("mol/kg"))
    return F.when(text.contains("kg"), "m").otherwise("M")


def publication_date(text: Column) -> Column:
    """``['d', 'm', 'yyyy']`` or an ISO prefix; anything else is null."""
    part = lambda i: F.regexp_extract(text, r"^\[\D*(\d{1,2})\D+(\d{1,2})\D+(\d{4})\D*\]$", i)
    listed = F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)), "y-M-d")
    iso = F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(T.*)?$", 1), "yyyy-MM-dd")
    return F.coalesce(listed, iso)


def short_md5(length: int, *parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, length)


def hypothesis_id(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("hyp-"), short_md5(12, s, p, o))


def edge_id(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("edge-"), short_md5(12, s, p, o))


def fixed4(value: Column) -> Column:
    """Amount rounded to four decimals by one rule, as scaled integer text."""
    return F.round(value * 10000).cast("bigint").cast("string")


def composition_key(entries: Column) -> Column:
    """16 hex digits of the sorted ``name:amount`` entries of one formulation."""
    return F.substring(F.md5(F.array_join(F.array_sort(entries), "|")), 1, 16)


def property_entity_id(property_type: Column) -> Column:
    return F.concat(F.lit("property_type:"), property_type)


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def correlation_strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.3, "strongly").when(F.abs(r) > 0.2, "moderately").otherwise("weakly")


def lenient_double(text: Column) -> Column:
    """Unparseable and NaN values become null."""
    value = text.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)
