"""The severity cascade by the production rules: nine steps, the first that fits.

Machine-generated analytic indicators, not official assessments. The step is
found first; level, score, reason and the other fields follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import vocabulary as V
from tidewire.functions.lexicon import contains_word
from tidewire.functions.rules import first_rule

# What ends a text's own words, and how much of it is looked at.
BIO_TAIL = r"(?im)(?:senior correspondent|special correspondent|staff reporter|read more at|click here|follow us on|download the app|subscribe to|all rights reserved).*$"
HEAD = 1200
#: What begins such a tail, and more characters than it has.
BIO_START, BIO_CHARS = BIO_TAIL.removesuffix(".*$"), 40
# Title words that switch a step off, and words that a match in
# the body alone needs in title or body.
NOT_PROCUREMENT = ["encounter", "ambush", "gunfight", "martyred", "bomb blast", "kuki", "theft of firearms"]
NOT_CRIME = ["assault rifles", "army establishment", "crpf shot", "kuki", "ied", "terror"]
NOT_FOREIGN = ["indian army", "lac", "loc", "drdo", "j&k", "kashmir", "ladakh", "manipur"]
CRITICAL_CONTEXT = ["j&k", "kashmir", "lac", "loc", "manipur", "ladakh", "indian army"]
HIGH_CONTEXT = ["indian army", "iaf", "indian navy", "drdo", "mod", "lac", "loc"]
DIPLOMATIC = ["lac", "cross-border"]
# The fields of a step's outcome, in order, and the outcomes.
FIELDS = [
    "threat_level", "threat_score", "potential_threat", "army_monitoring_needed", "army_intervention_needed", "national_security_relevance",
    "military_relevance", "strategic_importance", "diplomatic_significance", "economic_security_relevance", "border_security_relevance",
    "escalation_risk", "emerging_situation", "requires_human_review", "requires_continuous_monitoring", "ai_confidence",
]
OUTCOMES = {
    "procurement": ("LOW", 0.10, "NO", "NO", "NO", "LOW", "HIGH", "MEDIUM", "LOW", "LOW", "LOW", "LOW", False, False, False, 0.95),
    "civic": ("LOW", 0.05, "NO", "NO", "NO", "LOW", "LOW", "LOW", "LOW", "LOW", "LOW", "LOW", False, False, False, 0.95),
    "crime": ("LOW", 0.08, "NO", "NO", "NO", "LOW", "LOW", "LOW", "LOW", "LOW", "LOW", "LOW", False, False, False, 0.95),
    "foreign": ("LOW", 0.15, "NO", "NO", "NO", "LOW", "LOW", "LOW", "MEDIUM", "LOW", "LOW", "LOW", False, False, False, 0.92),
    "politics": ("LOW", 0.15, "NO", "NO", "NO", "LOW", "LOW", "LOW", "MEDIUM", "LOW", "LOW", "LOW", False, False, False, 0.90),
    "critical": ("CRITICAL", 0.95, "YES", "YES", "YES", "HIGH", "HIGH", "HIGH", "MEDIUM", "LOW", "HIGH", "HIGH", True, True, True, 0.96),
    "high": ("HIGH", 0.82, "YES", "YES", "NO", "HIGH", "HIGH", "HIGH", "MEDIUM", "LOW", "HIGH", "MEDIUM", False, False, True, 0.92),
    "moderate": ("MODERATE", 0.50, "NO", "NO", "NO", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM", "LOW", False, False, False, 0.88),
    "baseline": ("LOW", 0.10, "NO", "NO", "NO", "LOW", "LOW", "LOW", "LOW", "LOW", "LOW", "LOW", False, False, False, 0.95),
}
REASONS = {
    "procurement": "Indian defence modernization / procurement partnership: %s. Not an adversary threat.",
    "civic": "Civic, economic, sports, entertainment, or human-interest reporting.",
    "crime": "Civilian law & order / state police / accident reporting.",
    "foreign": "International foreign affairs / overseas conflict development (External to Indian Armed Forces).",
    "politics": "Domestic political, diplomatic, or administrative public security news.",
    "critical": "Active high-severity national security event: %s.",
    "high": "Strategic Indian defence development: %s.",
    "moderate": "Institutional defence activity: %s.",
    "baseline": "Routine news reporting within normal baseline parameters.",
}


def without_bio(c: Column) -> Column:
    """A text without the tails of its lines that speak of the author."""
    return F.regexp_replace(c, BIO_TAIL, "")


def head_without_bio(c: Column) -> Column:
    """The first ``HEAD`` characters of ``without_bio``. A whole text is searched only
    if a tail begins in them."""
    tailed = F.substring(c, 1, HEAD + BIO_CHARS).rlike(BIO_START)
    return F.substring(F.when(tailed, without_bio(c)).otherwise(c), 1, HEAD)


def _says(title: Column, body: Column, patterns: dict[str, str], inside: Column | None) -> Column:
    """What the first pattern that fits says: in the title, or in the body if
    ``inside`` holds (never, if it is None)."""
    found = []
    for pattern, words in patterns.items():
        test = title.rlike(pattern)
        if inside is not None:
            test = test | (inside & body.rlike(pattern))
        found.append(F.when(test, words))
    return F.coalesce(*found)


def severity(df, title: str, body: str, *fallbacks: str):
    """``df`` with the 17 fields of its severity, and ``severity_rule``.

    ``body`` and then the ``fallbacks`` are the columns of the text, the first
    that is neither null nor empty; a null title counts as empty.
    """
    t = F.lower(F.coalesce(F.col(title), F.lit("")))
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (body, *fallbacks)], F.lit(""))
    seen = df.withColumns({"_t": t, "_b": F.lower(head_without_bio(text))})
    t, b = F.col("_t"), F.col("_b")
    both = F.concat_ws(" ", t, b)
    says = {
        "procurement": _says(t, b, V.PROCUREMENT, ~contains_word(t, NOT_PROCUREMENT)),
        "critical": _says(t, b, V.CRITICAL, contains_word(both, CRITICAL_CONTEXT)),
        "high": _says(t, b, V.HIGH, contains_word(both, HIGH_CONTEXT)),
        "moderate": _says(t, b, V.MODERATE, None),
    }
    seen = seen.withColumns({f"_{k}": v for k, v in says.items()})
    has = {k: F.col(f"_{k}").isNotNull() for k in says}
    rule = first_rule([
        (has["procurement"], "procurement"),
        (contains_word(t, V.CIVIC), "civic"),
        (contains_word(t, V.CRIME) & ~contains_word(t, NOT_CRIME), "crime"),
        (contains_word(t, V.FOREIGN) & ~contains_word(t, NOT_FOREIGN), "foreign"),
        (contains_word(t, V.POLITICS), "politics"),
        *[(has[k], k) for k in ("critical", "high", "moderate")],
    ], "baseline")
    seen = seen.withColumn("severity_rule", rule)
    rule = F.col("severity_rule")
    outcome = F.create_map(*[x for k, v in OUTCOMES.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for n, y in zip(FIELDS, v, strict=True)]))])
    reason = F.lit(None).cast("string")
    for k, phrase in REASONS.items():
        reason = F.when(rule == k, F.format_string(phrase, F.col(f"_{k}")) if k in says else F.lit(phrase)).otherwise(reason)
    seen = seen.withColumns({"_o": F.element_at(outcome, rule), "threat_reason": reason})
    fields = {n: F.col(f"_o.{n}") for n in FIELDS}
    wide = (rule == "critical") & contains_word(both, DIPLOMATIC)
    fields["diplomatic_significance"] = F.when(wide, "HIGH").otherwise(fields["diplomatic_significance"])
    return seen.withColumns(fields).drop("_t", "_b", "_o", *[f"_{k}" for k in says])


def severity_of_new(df, title: str, body: str, *fallbacks: str):
    """As ``severity``, but rows that have a ``threat_level`` keep all fields
    that they have."""
    old = [c for c in [*FIELDS, "threat_reason"] if c in df.columns]
    held = df.withColumns({f"_old_{c}": F.col(c) for c in old})
    new = severity(held, title, body, *fallbacks)
    known = F.coalesce(F.col("_old_threat_level") != "", F.lit(False))
    kept = {c: F.when(known, F.col(f"_old_{c}")).otherwise(F.col(c)) for c in old}
    return new.withColumns(kept).drop(*[f"_old_{c}" for c in old])
