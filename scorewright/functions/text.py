"""Text helpers: sizes, front matter, source lines, prompts and parsed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col, last_entries

# Fixed values.
CHARS_PER_TOKEN = 4
TRUNCATED_MARK = "\n[truncated]"


def approx_tokens(text: Column | str) -> Column:
    """About four characters to a token; blank text has none."""
    t = col(text)
    n = F.greatest(F.lit(1), F.floor(F.length(t) / CHARS_PER_TOKEN)).cast("bigint")
    return F.when(F.trim(t, F.lit(" \t\n\r")) == "", F.lit(0).cast("bigint")).otherwise(n)


def lines(text: Column | str) -> Column:
    return F.split(F.regexp_replace(col(text), "\r\n?", "\n"), "\n")


def loc(text: Column | str) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(lines(text), lambda s: ~F.ltrim(s, F.lit(" \t")).startswith("#") & (F.trim(s, F.lit(" \t")) != ""))
                  ).cast("bigint")


def truncate(text: Column | str, limit: int | None = None) -> Column:
    """The first `limit` characters with a mark behind them; the whole text without a limit or below it."""
    t = col(text)
    if limit is None:
        return t
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit(TRUNCATED_MARK)))


FRONT_MATTER = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)(.*)\z"


def front_matter_block(text: Column | str) -> Column:
    """The text between the leading --- lines, empty where there is none."""
    return F.regexp_extract(col(text), FRONT_MATTER, 1)


def front_matter_map(text: Column | str) -> Column:
    """`key: value` lines of the block as a map; quotes around values are removed and the last line of a key counts."""
    entries = F.filter(F.split(front_matter_block(text), "\n"), lambda s: s.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(entries, lambda s: F.struct(
        F.trim(F.split_part(s, F.lit(":"), F.lit(1))).alias("key"),
        F.regexp_replace(F.trim(F.regexp_replace(s, r"^[^:]*:", "")), "^[\"'](.*)[\"']$", "$1").alias("value")))
    return last_entries(pairs)


def front_matter_body(text: Column | str) -> Column:
    t = col(text)
    body = F.when(t.rlike(FRONT_MATTER), F.regexp_extract(t, FRONT_MATTER, 2)).otherwise(t)
    return F.trim(body, F.lit(" \t\n\r"))


def pick_output(files: Column | str) -> Column:
    """First Python file of an output map in its own order, else its first entry, else empty."""
    entries = F.map_entries(col(files))
    python = F.filter(entries, lambda e: e["key"].endswith(".py"))
    return F.coalesce(F.try_element_at(python, F.lit(1))["value"], F.try_element_at(entries, F.lit(1))["value"], F.lit(""))


def rubric(criteria: list[tuple[str, str]]) -> str:
    return "\n".join(f"{i}. {name}: {about}" for i, (name, about) in enumerate(criteria, 1))


# The answer format a judge is asked for.
OUTPUT_FORMAT = (
    "## Required Output Format\n"
    "Return a JSON object with this exact structure:\n"
    "```json\n"
    "{\n"
    '    "evaluations": [\n'
    '        {"criterion": "<name>", "score": "<1-5>", "reasoning": "<explanation>"}\n'
    "    ]\n"
    "}\n"
    "```"
)


def judge_prompt(task: Column | str, code: Column | str, criteria: list[tuple[str, str]],
                 reference: Column | str | None = None, limit: int | None = None) -> Column:
    """The prompt for a judge; code and reference are cut at `limit` characters, if there is one."""
    def fenced(title: str, body: Column) -> Column:
        return F.concat(F.lit(f"## {title}\n```python\n"), truncate(body, limit), F.lit("\n```"))

    parts = [F.concat(F.lit("## Task\n"), col(task)), fenced("Code to Evaluate", col(code))]
    if reference is not None:
        parts.append(fenced("Reference Solution", col(reference)))
    parts += [F.lit("## Evaluation Criteria\n" + rubric(criteria)), F.lit(OUTPUT_FORMAT)]
    return F.concat_ws("\n\n", *parts)


def with_response_payload(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the JSON inside a judge response.

    An envelope gives its `structured_output`, else its `result` text; a text gives its fenced block,
    else everything from the first brace to the last, else itself. Each step is its own projection,
    so that a costly value is computed once and then read as a column.
    """
    names = ["_raw", "_envelope", "_inner", "_fenced", "_bare"]
    df = df.withColumn("_raw", F.trim(col(text), F.lit(" \t\n\r")))
    # Only an object can be an envelope; parsing any other text would cost an exception.
    df = df.withColumn("_envelope", F.when(F.col("_raw").startswith("{"), F.from_json("_raw", ENVELOPE)))
    df = df.withColumn("_inner", F.coalesce("_envelope.result", "_raw"))
    df = df.withColumns({"_fenced": F.regexp_extract("_inner", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1),
                         "_bare": F.regexp_extract("_inner", r"(?s)\{.*\}", 0)})
    structured = F.col("_envelope.structured_output")
    payload = (F.when(structured.startswith("{"), structured)
               .when(F.col("_fenced") != "", F.col("_fenced"))
               .when(F.col("_bare") != "", F.col("_bare")).otherwise(F.col("_inner")))
    return df.withColumn(out, payload).drop(*names)


ENVELOPE = "structured_output string, result string"
EVALUATIONS = "array<struct<criterion:string,score:string,reasoning:string>>"


def response_evaluations(parsed: Column | str) -> Column:
    """Evaluations of a payload parsed as a variant."""
    return F.try_variant_get(col(parsed), "$.evaluations", EVALUATIONS)


def whole_score(score: Column) -> Column:
    """A score as a whole number: 4, 4.0 and 4.7 are 4."""
    return score.try_cast("double").try_cast("int")


def response_verdict(text: Column | str, parsed: Column | str, evaluations: Column | str,
                     expected: list[str]) -> Column:
    """ok, or the first reason to reject the response; `parsed` is its payload as a variant, null if that is no JSON."""
    raw, ev = F.trim(col(text), F.lit(" \t\n\r")), col(evaluations)
    score = lambda e: whole_score(e["score"])
    names = F.transform(ev, lambda e: e["criterion"])
    wanted = F.array(*[F.lit(x) for x in expected])
    bad_entry = F.exists(ev, lambda e: e["criterion"].isNull() | e["score"].isNull() | e["reasoning"].isNull())
    bad_score = F.exists(ev, lambda e: score(e).isNull() | ~score(e).between(1, 5))
    no_reason = F.exists(ev, lambda e: F.trim(e["reasoning"]) == "")
    return (F.when(raw.isNull() | (raw == ""), "empty_response")
            .when(col(parsed).isNull(), "invalid_json")
            .when(ev.isNull() | (F.size(ev) <= 0), "no_evaluations")
            .when(bad_entry, "invalid_entry").when(bad_score, "invalid_score")
            .when(no_reason, "empty_reasoning")
            .when(F.size(F.array_except(wanted, names)) > 0, "missing_criteria").otherwise("ok"))


TEST_REPORT = "struct<tests:array<struct<nodeid:string,outcome:string,call:struct<longrepr:string>>>>"


def failed_tests(report: Column | str, error_chars: int | None = None, detail_chars: int | None = None) -> Column:
    """Failed tests of a report: short name, last error line and trace, cut at so many characters if given."""
    def cut(c: Column, n: int | None) -> Column:
        return c if n is None else F.left(c, F.lit(n))

    tests = F.filter(F.from_json(col(report), TEST_REPORT)["tests"], lambda t: t["outcome"] == "failed")

    def failure(t: Column) -> Column:
        trace = F.coalesce(t["call"]["longrepr"], F.lit(""))
        errors = F.regexp_extract_all(trace, F.lit(r"(?m)^[ \t]*(E [ \t]*\S[^\r\n]*)"), F.lit(1))
        last = F.coalesce(F.try_element_at(errors, F.lit(-1)), F.lit(""))
        error = F.trim(F.substr(last, F.lit(3)), F.lit(" \t"))
        return F.struct(
            F.substring_index(F.coalesce(t["nodeid"], F.lit("")), "::", -1).alias("name"),
            cut(error, error_chars).alias("error"),
            cut(trace, detail_chars).alias("detail"))

    return F.transform(tests, failure)
