"""Jobs over tables of texts: sessions, lines, rules, diffs, degraded copies, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text as tx


def session_result(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text",
                   answer: str = "assistant") -> DataFrame:
    """One result per conversation: turns, tokens in and out, the last answer; no answer is a failure."""
    tokens = tx.approx_tokens(text)
    is_answer = F.col(role) == answer
    g = messages.groupBy(key).agg(
        F.count_if(is_answer).alias("turns"),
        F.coalesce(F.sum(F.when(~is_answer, tokens)), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(is_answer, tokens)), F.lit(0)).alias("output_tokens"),
        F.max_by(F.when(is_answer, F.col(text)), F.when(is_answer, F.col(order))).alias("result_text"))
    done = F.col("result_text").isNotNull()
    return g.withColumn("success", done).withColumn(
        "error", F.when(~done, "No result message received"))


# Lint rules as (name, pattern that matches one bad line).
LINE_RULES = [
    ("long_line", r"(?m)^[^\n]{121,}$"),
    ("trailing_space", r"(?m)[ \t]+$"),
    ("tab_indent", r"(?m)^ *\t"),
    ("repeated_mark", r"(?m)^[^\n]*[%*#!?]{3,}[^\n]*$"),
]


def loc(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("loc", tx.loc(text))


def lint(docs: DataFrame, rules: list[tuple[str, str]] = LINE_RULES, text: str = "text",
         keep: list[str] | None = None) -> DataFrame:
    """Bad lines per document and rule, and the lint score of the document.

    All rules are counted in one projection over the text; no line leaves its row.
    """
    keep = keep or [c for c in docs.columns if c != text]
    hits = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.regexp_count(F.col(text), F.lit(pattern)).cast("bigint").alias("violations"))
        for name, pattern in rules])
    counted = docs.select(*keep, tx.loc(text).alias("loc"), hits.alias("_hits"))
    errors = F.aggregate("_hits", F.lit(0).cast("bigint"), lambda a, h: a + h["violations"])
    scored = counted.withColumn("lint_score", scoring.lint_score(errors, "loc"))
    return scored.select(*keep, "loc", "lint_score", F.explode("_hits").alias("_h")).select(
        *keep, "loc", "lint_score", "_h.rule", "_h.violations")


def parse_judgements(df: DataFrame, text: str, expected: list[str]) -> DataFrame:
    """Add the verdict on each response, and average and normalized score of the accepted ones."""
    out = tx.with_response_payload(df, text, "_payload")
    out = out.withColumn("_parsed", F.try_parse_json("_payload")).withColumn("_ev", tx.response_evaluations("_parsed"))
    out = out.withColumn("verdict", tx.response_verdict(text, "_parsed", "_ev", expected))
    scores = F.transform("_ev", lambda e: tx.whole_score(e["score"]).cast("double"))
    out = out.withColumn("average", F.when(F.col("verdict") == "ok", scoring.judge_average_array(scores)))
    return out.withColumn("normalized", scoring.judge_normalized("average")).drop("_payload", "_parsed", "_ev")


def concat_files(files: Column | str) -> Column:
    """One text from a map of files, sorted by name, each under a header line."""
    entries = F.array_sort(F.map_entries(files))
    return F.array_join(F.transform(
        entries, lambda e: F.concat(F.lit("# --- "), e["key"], F.lit(" ---\n"), e["value"])), "\n\n")


def line_set_diff(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Lines gained, lost and kept as multisets: one aggregation over lines, no join of the two sides."""
    def side(c: str, n: int) -> DataFrame:
        return pairs.select(*keys, F.explode(tx.lines(c)).alias("line"), F.lit(n).alias("_a"), F.lit(1 - n).alias("_b"))

    per_line = side(a, 1).unionByName(side(b, 0)).groupBy(*keys, "line").agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return per_line.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("additions"),
        F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("deletions"),
        F.sum(F.least("_a", "_b")).alias("unchanged"))


def test_failures(reports: DataFrame, report: str, keep: list[str], error_chars: int | None = None,
                  detail_chars: int | None = None) -> DataFrame:
    """One row per failed test of each report."""
    return reports.select(*keep, F.explode(tx.failed_tests(report, error_chars, detail_chars)).alias("_t")).select(*keep, "_t.name", "_t.error", "_t.detail")


# Tiers of degraded copies: gold stays as it is.
TIERS = ["gold", "mild", "severe", "broken"]
DOCSTRING = r'(?m)^[ \t]*(?:"""[^"]*"""|\'\'\'[^\']*\'\'\')[ \t]*\n'
# A string as it is, or a comment with the blanks before it.
COMMENT = r"""("[^"\n]*"|'[^'\n]*')|[ \t]*#[^\n]*"""
RETURN_TYPE = r"[ ]*->[ ]*[A-Za-z_][A-Za-z0-9_.\[\], ]*:"
ARGUMENT_TYPE = r"([A-Za-z_][A-Za-z0-9_]*):[ ]*(?:int|str|float|bool|list|dict)\b"
LONG_NAME = r"\b([a-z])[a-z0-9]*_([a-z0-9])[a-z0-9_]*\b"
# One of these makes a text wrong: the first place of the pattern is changed.
MISTAKES = [(r"(?s)\A(.*?)>=", "$1>"), (r"(?s)\A(.*?)\+ 1\b", "$1- 1"), (r"(?s)\A(.*?)return True\b", "$1return False")]


def degrade(docs: DataFrame, text: str = "text", tiers: list[str] = TIERS, seed: str = "42") -> DataFrame:
    """A copy of each text per tier.

    Mild loses its docstrings, severe also comments, types and long names (which keep two letters). Broken is the text
    with one logic mistake, chosen by a hash of seed and text among those that it has a place for; a text without any
    stays as it is.
    """
    t = F.col(text)
    mild = F.regexp_replace(t, DOCSTRING, "")
    severe = F.regexp_replace(mild, COMMENT, "$1")
    severe = F.regexp_replace(severe, RETURN_TYPE, ":")
    severe = F.regexp_replace(severe, ARGUMENT_TYPE, "$1")
    severe = F.regexp_replace(severe, LONG_NAME, "$1$2")
    possible = F.filter(F.array(*[F.when(t.rlike(p), i) for i, (p, _) in enumerate(MISTAKES)]), lambda i: i.isNotNull())
    draw = F.conv(F.left(F.md5(F.concat(F.lit(seed), t)), F.lit(8)), 16, 10).cast("bigint")
    chosen = F.try_element_at(possible, (F.try_mod(draw, F.size(possible)) + 1).cast("int"))
    broken = t
    for i, (pattern, change) in enumerate(MISTAKES):
        broken = F.when(chosen == i, F.regexp_replace(t, pattern, change)).otherwise(broken)
    rest = [c for c in docs.columns if c != text]
    copies = {"gold": t, "mild": mild, "severe": severe, "broken": broken}
    entries = F.array(*[F.struct(F.lit(name).alias("tier"), copies[name].alias(text)) for name in tiers])
    return docs.select(*rest, F.explode(entries).alias("_e")).select(*rest, "_e.tier", f"_e.{text}")


# Markers around filler text.
PADDING_BEGIN = "--- BEGIN BACKGROUND CONTEXT (for reference only) ---\n"
PADDING_END = "\n--- END BACKGROUND CONTEXT ---\n\n"
STYLES = ["prose", "comments", "lorem", "mixed"]


def styled(paragraphs: DataFrame, style: str, text: str = "text") -> DataFrame:
    """Paragraphs as prose, as comment lines, with their words in alphabetical order, or all three beside each other."""
    prose = F.col(text)
    comments = F.concat(F.lit("# "), F.regexp_replace(prose, "\n", "\n# "))
    lorem = F.array_join(F.array_sort(F.split(F.lower(prose), r"[ \n]+")), " ")
    kinds = {"prose": [prose], "comments": [comments], "lorem": [lorem], "mixed": [prose, comments, lorem]}
    if style not in kinds:
        raise ValueError(f"unknown style {style!r}, must be one of {STYLES}")
    return paragraphs.select(F.explode(F.array(*kinds[style])).alias(text))


def filler(paragraphs: DataFrame, chars: int, text: str = "text", seed: str = "42") -> DataFrame:
    """One row with `chars` characters of filler: paragraphs in an order fixed by their hash, again and again.

    Every paragraph that is not blank takes part. A paragraph brings three characters at least, one of its own and the
    blank line after it, so the first `chars` / 3 + 1 of the order are as many as can be needed. Their lengths say which of them
    start before the filler is full; only the texts of those are brought together.
    """
    hashed = (paragraphs.where(F.trim(text, F.lit(" \t\n\r")) != "")
              .select(F.md5(F.concat(F.lit(seed), F.col(text))).alias("h"), F.col(text).alias("t")))
    first = hashed.select("h", F.length("t").alias("n")).distinct().orderBy("h").limit(chars // 3 + 1)
    before = F.sum(F.col("n") + 2).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    last = first.withColumn("start", F.coalesce(before, F.lit(0))).where(F.col("start") < chars).agg(F.max("h"))
    ordered = hashed.where(F.col("h") <= last.scalar()).distinct()
    once = ordered.agg(F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("h", "t"))), lambda e: e["t"]), "\n\n"), F.lit("\n\n")).alias("once"))
    once = once.withColumn("once", F.when(F.length("once") > 2, F.col("once")).otherwise(
        F.raise_error(F.lit("there is no paragraph to pad with")).cast("string")))
    times = F.ceil(F.lit(float(chars)) / F.length("once")).cast("int")
    return once.select(F.left(F.repeat("once", times), F.lit(chars)).alias("filler"))


def pad_prompts(prompts: DataFrame, tokens: str, text: str, paragraphs: DataFrame, style: str = "prose") -> DataFrame:
    """Put `tokens` tokens of filler before each prompt, cut at a word; 0 leaves it alone.

    The filler is as long as the longest request. Without any paragraph a request fails.
    """
    most = prompts.agg(F.max(tokens)).first()[0] or 0
    if most <= 0:
        return prompts
    block = filler(styled(paragraphs, style), most * tx.CHARS_PER_TOKEN)
    joined = prompts.withColumn("filler", block.scalar())
    body = F.regexp_replace(F.left(F.col("filler"), F.col(tokens) * tx.CHARS_PER_TOKEN), r" [^ ]*\z", "")
    padded = F.concat(F.lit(PADDING_BEGIN), body, F.lit(PADDING_END), F.col(text))
    return joined.withColumn(text, F.when(F.col(tokens) > 0, padded).otherwise(F.col(text))).drop("filler")
