"""Scores, confidences and budgets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.words import BASE_AFFINITY, SIGNAL_WEIGHTS, TASK_AFFINITY

TIERS = {"EXACT": 1.0, "SCOPED": 0.75, "UNRESOLVED": 0.0}
HALF_LIFE_DAYS, FLOOR_SHARE, FLOOR_LEAST = 30, 0.25, 12.0


def effective_budget(budget: Column, margin: Column) -> Column:
    return F.floor(budget * (1 - F.least(F.greatest(margin, F.lit(0.0)), F.lit(0.5))))


def ambiguous_confidence(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(0.5), 1.0 / n))


def tier_confidence(tier: Column, n: Column) -> Column:
    return F.when(tier == "EXACT", 1.0).when(tier == "SCOPED", 0.75).when(tier == "AMBIGUOUS", ambiguous_confidence(n)).otherwise(0.0)


def recency(last: Column, newest: Column) -> Column:
    """Halves every 30 days before the newest (both in epoch seconds); 0 where unknown."""
    days = F.greatest(F.lit(0.0), (newest - last) / 86400.0)
    return F.when(last.isNotNull() & newest.isNotNull(), F.pow(F.lit(2.0), -days / HALF_LIFE_DAYS)).otherwise(0.0)


def weighted_score(signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """100 x the weighted mean of the signals with a weight over 0."""
    used = {k: w for k, w in (weights or SIGNAL_WEIGHTS).items() if w > 0 and k in signals}
    total = sum(w for w in (weights or SIGNAL_WEIGHTS).values() if w > 0)
    out = F.lit(0.0)
    for k, w in used.items():
        out = out + w * signals[k]
    return 100.0 * out / total if total else F.lit(0.0)


def affinity(kind: Column, entity_type: Column) -> Column:
    out = None
    for k, row in TASK_AFFINITY.items():
        for t, v in row.items():
            if v != BASE_AFFINITY.get(t):
                hit = (kind == k) & (entity_type == t)
                out = F.when(hit, v) if out is None else out.when(hit, v)
    for t, v in BASE_AFFINITY.items():
        out = out.when(entity_type == t, v)
    return out.otherwise(0.5)


def density(score: Column, tokens: Column) -> Column:
    return score / F.greatest(F.lit(1), tokens)


def symbol_match(name: Column, qualified: Column, symbols: Column) -> Column:
    """1 if a symbol is the name or qualified name, 0.5 if one contains the other, else 0 (case-free)."""
    n, q = F.lower(name), F.lower(qualified)
    whole = F.exists(symbols, lambda s: (F.lower(s) == n) | (F.lower(s) == q))
    part = F.exists(symbols, lambda s: q.contains(F.lower(s)) | F.lower(s).contains(n))
    return F.when(whole, 1.0).when(part, 0.5).otherwise(0.0)


def risk(direct: Column, indirect: Column, files: Column, tests: Column, exported: Column) -> Column:
    reach = direct + indirect
    return F.when(reach == 0, "LOW").when((reach > 20) | (files > 10), "HIGH").when((reach > 5) | (files > 3) | (exported & (tests == 0)), "MEDIUM").otherwise("LOW")


def risk_reason(direct: Column, indirect: Column, files: Column, tests: Column, exported: Column) -> Column:
    reach, s = direct + indirect, lambda c: c.cast("string")
    wide = F.concat(s(reach), F.lit(" callers in "), s(files), F.lit(" files"))
    high = (reach > 20) | (files > 10)
    return (
        F.when(reach == 0, F.lit("no caller in the index"))
        .when(high, wide)
        .when(exported & (tests == 0), F.concat(s(reach), F.lit(" callers and no test of an exported symbol")))
        .when((reach > 5) | (files > 3), wide)
        .otherwise(F.concat(s(reach), F.lit(" callers, "), s(tests), F.lit(" tests")))
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def is_test(kind: Column, path: Column) -> Column:
    return (kind == "TEST") | path.rlike(r"\.(test|spec)\.[jt]sx?$|(^|/)test_|_test\.py$")


def is_container(kind: Column) -> Column:
    """The entity holds others rather than doing something itself."""
    return kind.isin("FILE", "DIRECTORY", "PROJECT", "MODULE")
