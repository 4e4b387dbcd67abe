"""Text jobs on small hand-made texts and against the standard library."""

import json
import random

import pytest

from pyspark.sql import functions as F

from scorewright.functions import text as tx
from scorewright.operators import documents


def test_approx_tokens_and_loc(spark):
    rows = [("",), ("  \n ",), ("abc",), ("x" * 9,), ("a = 1\n\n  # note\nb\r\n",)]
    got = spark.createDataFrame(rows, "t string").select(tx.approx_tokens("t"), tx.loc("t")).collect()
    assert [tuple(g) for g in got] == [(0, 0), (0, 0), (1, 1), (2, 1), (4, 2)]


def test_sessions(spark):
    rows = [(1, 0, "system", "x" * 8), (1, 1, "user", "x" * 4), (1, 2, "assistant", "first"), (1, 3, "assistant", "last"), (2, 0, "user", "hello")]
    got = {r.c: r for r in documents.session_result(spark.createDataFrame(rows, "c int, turn int, role string, text string"), "c", "turn").collect()}
    assert (got[1].turns, got[1].input_tokens, got[1].output_tokens, got[1].result_text, got[1].success) == (2, 3, 2, "last", True)
    assert (got[2].success, got[2].error) == (False, "No result message received")


def test_lint(spark):
    docs = spark.createDataFrame([(1, "ok\n" + "y" * 130 + "\nend \n\tcode\nwow!!!\n"), (2, "")], "id int, text string")
    got = {(r.id, r.rule): (r.violations, r.loc, r.lint_score) for r in documents.lint(docs).collect()}
    assert got[(1, "long_line")][0] == 1 and got[(1, "trailing_space")][0] == 1
    assert got[(1, "tab_indent")][0] == 1 and got[(1, "repeated_mark")][0] == 1
    assert got[(1, "long_line")][1:] == (5, 0.0) and got[(2, "long_line")] == (0, 0, 100.0)


def test_line_sets_of_diffs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(30):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.2] + [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        rows.append((i, "p", "q", "\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(rows, "id int, na string, nb string, a string, b string")
    sets = {r.id: r for r in documents.line_set_diff(df, ["id"], "a", "b").collect()}
    for i, _, _, a, b in rows:
        la, lb = a.split("\n"), b.split("\n")
        assert sets[i].additions == sum(max(lb.count(x) - la.count(x), 0) for x in set(la + lb))
        assert sets[i].unchanged == sum(min(lb.count(x), la.count(x)) for x in set(la + lb))


def test_judge_responses(spark):
    def doc(*entries):
        return json.dumps({"evaluations": [dict(zip(("criterion", "score", "reasoning"), e)) for e in entries]})

    good = doc(("a", 4, "fine"), ("b", 2, "less"))
    cases = {
        good: "ok", f"Sure:\n```json\n{good}\n```\nbye": "ok", f"I say {good} done": "ok",
        json.dumps({"structured_output": json.loads(good), "result": "no"}): "ok",
        json.dumps({"result": f"```\n{good}\n```"}): "ok", "": "empty_response", "no json": "invalid_json",
        '{"evaluations": []}': "no_evaluations", doc(("a", 6, "x"), ("b", 1, "y")): "invalid_score",
        doc(("a", "4", "x"), ("b", 1, "y")): "ok", doc(("a", 4.0, "x"), ("b", "2.0", "y")): "ok", doc(("a", "x", "x"), ("b", 2, "y")): "invalid_score", doc(("a", 4, " "), ("b", 1, "y")): "empty_reasoning",
        doc(("a", 4, "x")): "missing_criteria", '{"evaluations": [{"criterion": "a"}]}': "invalid_entry"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r for r in documents.parse_judgements(df, "t", ["a", "b"]).collect()}
    assert {k: v.verdict for k, v in got.items()} == cases
    assert (got[good].average, got[good].normalized) == (3.0, 50.0)
    assert got[""].normalized is None


def test_prompt(spark):
    df = spark.createDataFrame([("do it", "x" * 8001, "ref")], "task string, code string, ref string")
    crit = [("a", "first"), ("b", "second")]
    prompt, whole = df.select(tx.judge_prompt("task", "code", crit, "ref", limit=8000), tx.judge_prompt("task", "code", crit, "ref")).first()
    assert "x" * 8001 + "\n```" in whole
    assert "x" * 8000 + "\n[truncated]\n```" in prompt and "1. a: first\n2. b: second" in prompt
    assert prompt.index("## Task") < prompt.index("## Code") < prompt.index("## Reference") < prompt.index("## Required")
    files = spark.range(1).select(documents.concat_files(F.create_map(F.lit("b.py"), F.lit("B"), F.lit("a.py"), F.lit("A")))).first()[0]
    assert files == "# --- a.py ---\nA\n\n# --- b.py ---\nB"


def test_failed_tests(spark):
    report = json.dumps({"tests": [
        {"nodeid": "t/a.py::C::test_x", "outcome": "failed", "call": {"longrepr": "code\nE   first\n> x\n  E   last one  \nmore"}},
        {"nodeid": "plain", "outcome": "failed", "call": {"longrepr": "z" * 3000}}, {"nodeid": "t::ok", "outcome": "passed"},
        {"nodeid": "t::setup", "outcome": "failed"}]})
    df = spark.createDataFrame([(1, report), (2, "broken"), (3, None)], "id int, report string")
    got = [(r.name, r.error, len(r.detail)) for r in documents.test_failures(df, "report", ["id"], 200, 2000).collect()]
    assert max(len(r.detail) for r in documents.test_failures(df, "report", ["id"]).collect()) == 3000
    assert got == [("test_x", "last one", len("code\nE   first\n> x\n  E   last one  \nmore")), ("plain", "", 2000), ("setup", "", 0)]


def test_degrade(spark):
    code = 'def get_total(first_item: int, name: str) -> int:\n    """Doc."""\n    return first_item  # done\n'
    got = {r.tier: r.text for r in documents.degrade(spark.createDataFrame([(1, code)], "id int, text string")).collect()}
    assert got["gold"] == code
    assert got["mild"] == code.replace('    """Doc."""\n', "")
    assert got["severe"] == "def gt(fi, name):\n    return fi\n"
    assert got["broken"] == code  # no place for a mistake


def test_broken_tier_has_one_mistake(spark):
    texts = ["if a >= b: pass\n", "x = y + 1\nz = y + 1\n", "return True\n", "if a >= 1: return True\n", "s = 'a # b'  # c\n\'\'\'\n"]
    rows = documents.degrade(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    broken = {r.id: r.text for r in rows if r.tier == "broken"}
    assert broken[0] == "if a > b: pass\n" and broken[1] == "x = y - 1\nz = y + 1\n" and broken[2] == "return False\n" and broken[4] == texts[4]
    assert broken[3] in ("if a > 1: return True\n", "if a >= 1: return False\n")
    assert {r.text for r in rows if r.id == 4 and r.tier == "severe"} == {"s = 'a # b'\n\'\'\'\n"}


def test_padding(spark):
    paragraphs = spark.createDataFrame([(f"paragraph number {i} with a few more words in it",) for i in range(5)], "text string")
    prompts = spark.createDataFrame([(0, "ask"), (20, "ask"), (500, "ask")], "n int, text string")
    got = {r.n: r.text for r in documents.pad_prompts(prompts, "n", "text", paragraphs).collect()}
    assert got[0] == "ask"
    for n in (20, 500):
        assert got[n].startswith(documents.PADDING_BEGIN) and got[n].endswith(documents.PADDING_END + "ask")
        body = got[n][len(documents.PADDING_BEGIN):-len(documents.PADDING_END + "ask")]
        assert n * 4 - 20 < len(body) <= n * 4
    short = spark.createDataFrame([("a",), ("b b",), ("  ",)], "text string")
    for style in documents.STYLES:
        body = documents.pad_prompts(prompts, "n", "text", short, style).where("n = 500").first().text
        assert len(body) > 1900 and ("# a" in body) == (style in ("comments", "mixed"))
    with pytest.raises(Exception, match="no paragraph"):
        documents.pad_prompts(prompts, "n", "text", short.where("text = '  '")).collect()
    with pytest.raises(ValueError, match="unknown style"):
        documents.pad_prompts(prompts, "n", "text", short, "verse")


def test_pick_output(spark):
    files = lambda *names: F.create_map(*[F.lit(x) for n in names for x in (n, n[0])])
    row = spark.range(1).select(*[tx.pick_output(m) for m in (
        files("z.md", "b.py", "a.py"), files("z.md", "y.txt"), F.create_map().cast("map<string,string>"), F.lit(None).cast("map<string,string>"))]).first()
    assert list(row) == ["b", "z", "", ""]
