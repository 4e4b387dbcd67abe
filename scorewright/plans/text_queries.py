"""Jobs over the sample texts, and texts derived from the sample runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import round_to
from ..operators import documents, joins, ranking
from .aggregating_queries import r
from .bindings import RUNS_CTE, SCORED_CTE
from .registry import query, rnd

_LINE_OK = "trim(x, E' \\t') <> '' AND NOT starts_with(ltrim(x, E' \\t'), '#')"
_LOC = f"len(list_filter(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {_LINE_OK}))"


@query("loc_count", f"""SELECT doc_id, lang, {_LOC} AS loc FROM documents""")
def loc_count(t):
    return documents.loc(t.documents.select("doc_id", "lang", "text")).drop("text")


_RULES_SQL = [("long_line", "(?m)^[^\\n]{121,}$"), ("trailing_space", "(?m)[ \\t]+$"), ("tab_indent", "(?m)^ *\\t"),
              ("repeated_mark", "(?m)^[^\\n]*[%*#!?]{3,}[^\\n]*$")]


@query("lint_rules", "WITH c AS (SELECT doc_id, lang, " + _LOC + " AS loc, " + ", ".join(
    f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in _RULES_SQL) + f""" FROM documents),
 s AS (SELECT *, {rnd('CASE WHEN loc > 0 THEN greatest(0.0, least(100.0, 100.0 - CAST(long_line + trailing_space + tab_indent + repeated_mark AS DOUBLE) / loc * 1000)) ELSE 100.0 END', 4)} AS lint_score FROM c)
""" + " UNION ALL ".join(f"SELECT doc_id, lang, loc, lint_score, '{n}' AS rule, {n} AS violations FROM s" for n, _ in _RULES_SQL))
def lint_rules(t):
    out = documents.lint(t.documents.select("doc_id", "lang", "text"))
    return out.withColumn("lint_score", round_to("lint_score", 4))


_EXPECTED = ["readability", "correctness"]


def _responses(runs):
    """Judge responses around the scores of a run: fenced, bare, enveloped, and seven kinds of broken ones."""
    def entry(name, score, why="fine work"):
        return F.struct(F.lit(name).alias("criterion"), score.alias("score"), F.lit(why).alias("reasoning"))

    def doc(*entries):
        return F.to_json(F.struct(F.array(*entries).alias("evaluations")))

    read, corr = F.col("c_readability").cast("double"), F.col("c_correctness")  # 4.0 is as good as 4
    good = doc(entry("readability", read), entry("correctness", corr))
    k = F.col("k1") % 17
    return (F.when(k == 0, F.lit("  ")).when(k == 1, F.lit('{"evaluations": [{"criterion"'))
            .when(k == 2, F.lit('{"evaluations": []}')).when(k == 3, doc(entry("readability", read), entry("correctness", corr + 5)))
            .when(k == 4, doc(entry("readability", read), entry("correctness", corr, " ")))
            .when(k == 5, doc(entry("readability", read)))
            .when(k == 6, F.lit('{"evaluations": [{"criterion": "readability", "score": 3}]}'))
            .when(k < 10, F.concat(F.lit("Here it is:\n```json\n"), good, F.lit("\n```\nThanks")))
            .when(k < 12, F.to_json(F.struct(F.concat(F.lit("Result: "), good, F.lit(" done")).alias("result"))))
            .when(k < 14, F.concat(F.lit('{"structured_output": '), good, F.lit("}")))
            .otherwise(F.concat(F.lit("I think "), good)))


@query("parse_judge_response", f"""WITH {RUNS_CTE}
SELECT model, CASE k1 % 17 WHEN 0 THEN 'empty_response' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'no_evaluations' WHEN 3 THEN 'invalid_score' WHEN 4 THEN 'empty_reasoning'
   WHEN 5 THEN 'missing_criteria' WHEN 6 THEN 'invalid_entry' ELSE 'ok' END AS verdict, count(*) AS n,
   {rnd("avg(CASE WHEN k1 % 17 > 6 THEN ((c_readability + c_correctness) / 2.0 - 1) * 25 END)", 4)} AS mean_normalized
FROM runs GROUP BY 1, 2""")
def parse_judge_response(t):
    runs = t.runs
    df = runs.select("model", _responses(runs).alias("response"))
    parsed = documents.parse_judgements(df, "response", _EXPECTED)
    return parsed.groupBy("model", "verdict").agg(F.count("*").alias("n"), round_to(F.avg("normalized"), 4).alias("mean_normalized"))


_CRITERIA = [("readability", "names and layout"), ("correctness", "does what was asked")]
_RUBRIC = "1. readability: names and layout\n2. correctness: does what was asked"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trunc(c: str) -> str:
    return f"CASE WHEN length({c}) <= 8000 THEN {c} ELSE left({c}, 8000) || chr(10) || '[truncated]' END"


@query("judge_prompt", f"""WITH f AS (SELECT doc_id, source, '# --- a.py ---' || chr(10) || source || ': ' || text || chr(10) || chr(10) || '# --- b.py ---' || chr(10) || text AS code, text FROM documents),
 p AS (SELECT doc_id, '## Task' || chr(10) || 'Rewrite ' || source || chr(10) || chr(10) || '## Code to Evaluate' || chr(10) || '```python' || chr(10) || {_trunc('code')} || chr(10) || '```' || chr(10) || chr(10)
   || '## Reference Solution' || chr(10) || '```python' || chr(10) || {_trunc('text')} || chr(10) || '```' || chr(10) || chr(10) || '## Evaluation Criteria' || chr(10) || {_sql_text(_RUBRIC)} || chr(10) || chr(10) || {_sql_text(tx.OUTPUT_FORMAT)} AS prompt FROM f)
SELECT doc_id, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def judge_prompt(t):
    docs = t.documents.select("doc_id", "source", "text")
    files = F.create_map(F.lit("b.py"), F.col("text"), F.lit("a.py"), F.concat("source", F.lit(": "), "text"))
    prompt = tx.judge_prompt(F.concat(F.lit("Rewrite "), "source"), documents.concat_files(files), _CRITERIA, "text", limit=8000)
    return docs.select("doc_id", prompt.alias("p")).select("doc_id", F.length("p").cast("bigint").alias("chars"), F.md5("p").alias("digest"))


def _document_pairs(t):
    """The best labelled text of each source, paired with those of the other sources of its language."""
    docs = t.documents.select("doc_id", "lang", "source", "text").join(t.labels, "doc_id", "left")
    best = ranking.best_row(docs, ["lang", "source"], "quality", ["doc_id"], ["doc_id", "text"])
    return joins.output_pairs(best.drop("best_score"), ["lang"], "source", "text")


_PAIRS_CTE = """d AS (SELECT * FROM (SELECT d.doc_id, lang, source, text, row_number() OVER (PARTITION BY lang, source ORDER BY coalesce(quality, 0) DESC, d.doc_id) AS rn
   FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE rn = 1 AND text <> ''),
 prs AS (SELECT a.lang, a.source AS source_a, b.source AS source_b, a.text AS ta, b.text AS tb FROM d a JOIN d b ON a.lang = b.lang AND a.source < b.source)"""


@query("line_set_diff", f"""WITH {_PAIRS_CTE}, l AS (
   SELECT lang, source_a, source_b, unnest(string_split(regexp_replace(ta, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, 1 AS a, 0 AS b FROM prs
   UNION ALL SELECT lang, source_a, source_b, unnest(string_split(regexp_replace(tb, '\\r\\n?', chr(10), 'g'), chr(10))), 0, 1 FROM prs),
 c AS (SELECT lang, source_a, source_b, line, sum(a) AS a, sum(b) AS b FROM l GROUP BY 1, 2, 3, 4)
SELECT lang, source_a, source_b, sum(greatest(b - a, 0))::BIGINT AS additions, sum(greatest(a - b, 0))::BIGINT AS deletions, sum(least(a, b))::BIGINT AS unchanged FROM c GROUP BY 1, 2, 3""")
def line_set_diff(t):
    return documents.line_set_diff(_document_pairs(t), ["lang", "source_a", "source_b"], "text_a", "text_b")


_REPORT_SQL = """WITH {cte}, x AS (SELECT task, k1, k2, tests_passed FROM runs)
SELECT task, 'test_' || (k1 % 5) AS name, CASE WHEN k2 = 2 THEN '' ELSE left('assert ' || tests_passed || ' == 50 ' || repeat('x', 250), 200) END AS error,
  count(*) AS n, max(CASE WHEN k2 = 2 THEN 5 ELSE 2000 END) AS detail_chars FROM x WHERE tests_passed < 40 GROUP BY 1, 2, 3"""


@query("test_failures", _REPORT_SQL.format(cte=RUNS_CTE))
def test_failures(t):
    runs = t.runs
    message = F.concat(F.lit("assert "), F.col("tests_passed").cast("string"), F.lit(" == 50 "), F.repeat(F.lit("x"), F.lit(250)))
    trace = F.when(F.col("k2") == 2, F.lit("boom\n")).otherwise(F.concat(
        F.lit("def test():\nE   first error\n>   assert\n  E  "), message, F.lit("\n"), F.repeat(F.lit("trace line\n"), F.lit(300))))
    case = lambda node, outcome, text: F.struct(
        node.alias("nodeid"), outcome.alias("outcome"), F.struct(text.alias("longrepr")).alias("call"))
    report = F.to_json(F.struct(F.array(
        case(F.concat(F.lit("tests/test_a.py::test_"), (F.col("k1") % 5).cast("string")),
             F.when(F.col("tests_passed") < 40, "failed").otherwise("passed"), trace),
        case(F.lit("tests/test_b.py::test_ok"), F.lit("passed"), F.lit(""))).alias("tests")))
    failed = documents.test_failures(runs.select("task", report.alias("report")), "report", ["task"], error_chars=200, detail_chars=2000)
    return failed.groupBy("task", "name", "error").agg(F.count("*").alias("n"), F.max(F.length("detail")).alias("detail_chars"))


# A small program around each text: docstrings, comments, a sign in a string, types, long names and places for a mistake.
_CODE_SQL = """'def make_' || lang || '_page(total_count: int, name: str) -> str:' || chr(10) || '    \"\"\"Page of ' || source || '.\"\"\"' || chr(10) || '    page_total = total_count + 1  # running' || chr(10)
   || '    page_count = "#' || doc_id || '"' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '    if total_count >= 2: return True' || chr(10) ELSE '' END || text"""


def _code():
    even = F.when(F.col("doc_id") % 2 == 0, "    if total_count >= 2: return True\n").otherwise("")
    return F.concat(F.lit("def make_"), "lang", F.lit("_page(total_count: int, name: str) -> str:\n    \"\"\"Page of "), "source",
                    F.lit(".\"\"\"\n    page_total = total_count + 1  # running\n    page_count = \"#"), F.col("doc_id").cast("string"), F.lit("\"\n"), even, "text")


@query("degrade_corpus", f"""WITH g AS (SELECT doc_id, {_CODE_SQL} AS c FROM documents),
 m AS (SELECT *, regexp_replace(c, '(?m)^[ \\t]*(?:\"\"\"[^\"]*\"\"\"|''''''[^'']*'''''')[ \\t]*\\n', '', 'g') AS mild FROM g),
 s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(mild, '(\"[^\"\\n]*\"|''[^''\\n]*'')|[ \\t]*#[^\\n]*', '\\1', 'g'), '[ ]*->[ ]*[A-Za-z_][A-Za-z0-9_.\\[\\], ]*:', ':', 'g'),
   '([A-Za-z_][A-Za-z0-9_]*):[ ]*(?:int|str|float|bool|list|dict)\\b', '\\1', 'g'), '\\b([a-z])[a-z0-9]*_([a-z0-9])[a-z0-9_]*\\b', '\\1\\2', 'g') AS severe,
   list_filter([CASE WHEN contains(c, '>=') THEN 0 END, CASE WHEN regexp_matches(c, '\\+ 1\\b') THEN 1 END, CASE WHEN regexp_matches(c, 'return True\\b') THEN 2 END], lambda x: x IS NOT NULL) AS can,
   CAST('0x' || left(md5('42' || c), 8) AS BIGINT) AS draw FROM m),
 b AS (SELECT *, CASE can[draw % len(can) + 1] WHEN 0 THEN regexp_replace(c, '>=', '>') WHEN 1 THEN regexp_replace(c, '\\+ 1\\b', '- 1') WHEN 2 THEN regexp_replace(c, 'return True\\b', 'return False') ELSE c END AS broken FROM s)
SELECT doc_id, tier, length(x) AS chars, md5(x) AS digest FROM b, LATERAL (VALUES ('gold', c), ('mild', mild), ('severe', severe), ('broken', broken)) v(tier, x)""")
def degrade_corpus(t):
    docs = t.documents.select("doc_id", _code().alias("text"))
    return documents.degrade(docs).select("doc_id", "tier", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


_STYLE_SQL = {"prose": "SELECT text AS t FROM benchmark", "comments": "SELECT '# ' || replace(text, chr(10), chr(10) || '# ') FROM benchmark",
              "lorem": "SELECT array_to_string(list_sort(regexp_split_to_array(lower(text), '[ \\n]+')), ' ') FROM benchmark"}
_STYLE_SQL["mixed"] = " UNION ALL ".join(_STYLE_SQL.values())


@query("context_padding", "WITH " + ", ".join(f"""o_{style} AS (SELECT DISTINCT md5('42' || t) AS h, t FROM ({sql}) v(t) WHERE trim(t, E' \\t\\n\\r') <> ''),
 b_{style} AS (SELECT '{style}' AS style, left(repeat(string_agg(t, chr(10) || chr(10) ORDER BY h) || chr(10) || chr(10), 600 // sum(length(t) + 2)::INT + 1), 600) AS f
   FROM (SELECT * FROM o_{style} ORDER BY h LIMIT 201))""" for style, sql in _STYLE_SQL.items()) + """,
 p AS (SELECT style, conv_id, turn, CASE WHEN conv_id % 4 > 0 THEN '--- BEGIN BACKGROUND CONTEXT (for reference only) ---' || chr(10)
    || regexp_replace(left(f, (conv_id % 4) * 50 * 4), ' [^ ]*\\z', '') || chr(10) || '--- END BACKGROUND CONTEXT ---' || chr(10) || chr(10) || text ELSE text END AS prompt
  FROM conversations CROSS JOIN (""" + " UNION ALL ".join(f"SELECT * FROM b_{style}" for style in _STYLE_SQL) + """))
SELECT style, conv_id, turn, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def context_padding(t):
    prompts = t.conversations.select("conv_id", "turn", "text", ((F.col("conv_id") % 4) * 50).alias("tokens"))
    frames = [documents.pad_prompts(prompts, "tokens", "text", t.benchmark, style).select(
        F.lit(style).alias("style"), "conv_id", "turn", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))
        for style in documents.STYLES]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query("code_output_pick", """SELECT lang, CASE doc_id % 4 WHEN 0 THEN 'b.py:' || source WHEN 1 THEN 'b' WHEN 2 THEN '' ELSE 'z.py' END AS picked, count(*) AS n
FROM documents GROUP BY 1, 2""")
def code_output_pick(t):
    k = F.col("doc_id") % 4
    tagged = lambda name: F.concat(F.lit(name + ":"), "source")
    files = (F.when(k == 0, F.create_map(F.lit("a.md"), tagged("a.md"), F.lit("b.py"), tagged("b.py")))
             .when(k == 1, F.create_map(F.lit("b.txt"), F.lit("b"), F.lit("a.md"), tagged("a.md")))
             .when(k == 3, F.create_map(F.lit("z.py"), F.lit("z.py"), F.lit("a.py"), F.lit("later"))))
    return t.documents.groupBy("lang", tx.pick_output(files).alias("picked")).agg(F.count("*").alias("n"))


_PROFILE_SQL = """CASE WHEN doc_id % 3 > 0 THEN '---' || chr(10) || 'name: ' || source || chr(10) || 'description: \"About ' || lang || '\"' || chr(10) || '---' || chr(10) || text ELSE text END"""


@query("profile_dimension", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE 'doc-' || doc_id END AS name,
   CASE WHEN doc_id % 3 > 0 THEN 'About ' || lang ELSE 'Custom profile (doc-' || doc_id || '.md)' END AS description,
   length(trim(text, E' \\t\\n\\r')) AS body_chars, CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN 0 ELSE greatest(1, length(trim(text, E' \\t\\n\\r')) // 4) END AS tokens FROM documents""")
def profile_dimension(t):
    from ..sources import dimensions
    docs = t.documents.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.when(
        F.col("doc_id") % 3 > 0, F.concat(F.lit("---\nname: older\nname: "), "source", F.lit('\ndescription: "About '), "lang", F.lit('"\n---\n'), "text")
    ).otherwise(F.col("text")).alias("text"))
    out = dimensions.split_front_matter(docs.withColumn("file", F.concat("slug", F.lit(".md"))), "text", "slug", "file")
    return out.select("doc_id", "name", "description", F.length("content").cast("bigint").alias("body_chars"), "tokens")
