"""Keys, labels and classes of a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, round_to

# Substrings that mark an error, matched in lower case.
TRANSIENT_PATTERNS = [
    "too many tokens",
    "rate limit",
    "rate_limit",
    "overloaded",
    "529",
    "too many requests",
    "capacity",
    "please wait",
]
AUTH_PATTERNS = [
    "expired",
    "expiredtoken",
    "the sso session associated with this profile has expired",
    "the sso token associated with this profile has expired",
    "unable to locate credentials",
    "invalidclienttokenid",
    "unauthorizedaccess",
    "could not resolve credentials",
    "security token included in the request is expired",
    "no credentials",
    "not authorized to perform",
]
# Matched as they are written.
DETERMINISTIC_PATTERNS = [
    "No Python files found",
    "Could not read any Python files",
    "aws_credentials_expired",
]

# Display names of the known dimensions.
DIMENSION_LABELS = {
    "composite": "Overall",
    "test_pass_rate": "Tests",
    "lint_score": "Lint",
    "complexity_score": "Complexity",
    "llm_quality": "LLM Quality",
    "token_efficiency": "Efficiency",
}


def _any_of(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.contains(p)
    return hit


def error_class(error: Column | str) -> Column:
    """auth, transient, deterministic or other; null where there is no error.

    Expired credentials win over a transient cause: retrying does not help until they are renewed.
    """
    e = col(error)
    low = F.lower(e)
    return (
        F.when(e.isNull() | (e == ""), F.lit(None).cast("string"))
        .when(_any_of(low, AUTH_PATTERNS), "auth")
        .when(_any_of(low, TRANSIENT_PATTERNS), "transient")
        .when(_any_of(e, DETERMINISTIC_PATTERNS), "deterministic")
        .otherwise("other")
    )


def is_retryable(error: Column | str) -> Column:
    return F.coalesce(error_class(error) == "transient", F.lit(False))


def error_message(error: Column | str) -> Column:
    e = col(error)
    return F.when(error_class(e) == "auth", F.concat(F.lit("Authentication failed: "), e)).otherwise(e)


def run_key(model: Column | str, profile: Column | str, task: Column | str, run_number: Column | str,
            variant: Column | str | None = None) -> Column:
    parts = [col(model), col(profile), col(task)]
    if variant is not None:
        parts.append(F.nullif(col(variant), F.lit("")))
    parts.append(F.concat(F.lit("run-"), col(run_number).cast("string")))
    return F.concat_ws("/", *parts)


def variant_key(profile: Column | str, variant: Column | str) -> Column:
    return F.concat_ws(":", col(profile), F.nullif(col(variant), F.lit("")))


def variant_label(key: Column | str) -> Column:
    return F.substring_index(col(key), ":", -1)


def task_category(task: Column | str) -> Column:
    return F.regexp_replace(col(task), "-[0-9]+$", "")


def dimension_label(dim: Column | str) -> Column:
    d = col(dim)
    out = F
    for name, label in DIMENSION_LABELS.items():
        out = out.when(d == name, label)
    return out.otherwise(F.initcap(F.replace(d, F.lit("_"), F.lit(" "))))


def score_tier(score: Column | str) -> Column:
    s = col(score)
    return (F.when(s.isNull(), F.lit(None).cast("string")).when(s >= 90, "excellent")
            .when(s >= 70, "good").when(s >= 50, "fair").otherwise("poor"))


def effect_label(d: Column | str) -> Column:
    a = F.abs(col(d))
    return (F.when(a.isNull(), F.lit(None).cast("string")).when(a < 0.2, "negligible")
            .when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large"))


def signed_pct(fraction: Column | str) -> Column:
    """0.034 -> +3.4%; rounded like every displayed number."""
    return F.format_string("%+.1f%%", round_to(col(fraction) * 100.0, 1))


def short_tokens(n: Column | str) -> Column:
    """1234 -> 1.2k; below a thousand the whole number; null -> -."""
    v = col(n).cast("double")
    return (F.when(v.isNull(), "-").when(v >= 1000, F.format_string("%.1fk", v / 1000.0))
            .otherwise(F.format_string("%.0f", v)))
