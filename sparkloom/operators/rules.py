"""Rule-based validation: issue codes as arrays, then ordered routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue_codes(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that fail, in order, each once. A null condition is no failure."""
    return F.array_compact(F.array(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(code)) for code, failed in rules]))


def issues(rules: list[tuple[str, str, Column]]) -> Column:
    """code and severity of the rules that fail."""
    return F.array_compact(F.array(*[F.when(F.coalesce(failed, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, failed in rules]))


def split_valid(df: DataFrame, codes: str = "issues") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.size(codes) == 0), df.filter(F.size(codes) > 0)


# Reason codes by disposition.
REPAIR = ("CHALLENGER_REVISE",)
REJECT = (
    "EVIDENCE_BELOW_MIN_CONFIDENCE", "EVIDENCE_VALIDATION_FAILED", "BELOW_MIN_CONFIDENCE", "COMMERCE_CUE_BELOW_MIN_CONFIDENCE", "COMMERCIAL_RELATION_BELOW_MIN_CONFIDENCE",
    "COMMERCE_CUE_VALIDATION_FAILED", "COMMERCIAL_RELATION_VALIDATION_FAILED", "PROPOSAL_GRAPH_VALIDATION_FAILED", "VALIDATION_FAILED", "SEMANTIC_DUPLICATE", "CONFLICTING_VALUE",
    "CHALLENGER_REJECT", "CHALLENGER_REJECTED_OR_HUMAN_REVIEW", "SEMANTIC_VERIFIER_REJECT", "CHALLENGER_REPAIR_EXHAUSTED",
)
HUMAN = ("CHALLENGER_HUMAN_REVIEW", "SEMANTIC_VERIFIER_AMBIGUOUS", "MULTIPLE_PLAUSIBLE_ANSWERS")
ABSTAINED = ("ABSTENTION", "NO_COMMERCIAL_RECORD")
OMITTED = ("ADJUDICATOR_OMITTED", "ADJUDICATOR_UNKNOWN_SOURCE")


def disposition(code: Column, item_type: Column | None = None, stage: Column | None = None) -> Column:
    """disposition and output channel of a record: the first matching rule decides, unknown codes go to people,
    a null code is accepted. Engineering and schema failures never become human work."""
    kind, where = F.lower(F.coalesce(item_type, F.lit(""))) if item_type is not None else F.lit(""), F.lower(F.coalesce(stage, F.lit(""))) if stage is not None else F.lit("")
    failed = code.contains("PARSE_ERROR") | (kind == "stage_failure")
    rules = [
        (code.isNull(), "ACCEPT", "accepted"),
        (failed | (kind == "abstention") | code.isin(*ABSTAINED), "REJECT", "diagnostics"),
        (code.isin(*REPAIR), "REPAIR", "diagnostics"),
        (code.isin(*REJECT) | code.endswith("_VALIDATION_FAILED"), "REJECT", "rejected"),
        (code.isin(*HUMAN) | ((where == "adjudication") & ~code.isin(*OMITTED)), "HUMAN_REVIEW", "queue"),
        (code.startswith("ADJUDICATOR_"), "REJECT", "diagnostics"),
    ]
    out = None
    for when, result, channel in rules:
        value = F.struct(F.lit(result).alias("disposition"), F.lit(channel).alias("channel"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit("HUMAN_REVIEW").alias("disposition"), F.lit("queue").alias("channel")))


def enum_or(c: Column, domain: tuple[str, ...], other: str) -> Column:
    value = F.upper(F.trim(c))
    return F.when(value.isin(*domain), value).otherwise(F.lit(other))


def strongest(values: Column, priority: tuple[str, ...]) -> Column:
    """The value of an array that comes first in priority; null if none is in it."""
    return F.get(F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(values, p)), F.lit(0))


def first_class(c: Column, classes: list[tuple[str, str]], other: str) -> Column:
    """The first class whose pattern is found."""
    out = None
    for name, pattern in classes:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return F.lit(other) if out is None else out.otherwise(other)
