import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import pii, queries, toxicity, url_filter

# --- urls ---------------------------------------------------------------------------------------------------------------


def judge(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m.group(1)), m.group(2)) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


URLS = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/", "https://x.Example.com/en/1?q#f", "http://www.example.com/en/",
        "http://a.www.example.com/en/x", "ftp://notexample.com/en/", "http://b.net/es/1", "http://b.net/fr/2", "http://b.net/de/", "http://net/es/", "a://b://c.net/es/",
        "http://ÄÖ.net/es/", "http://x..net/fr/", "http://a\x00b.com/\x01", "http://com.evil.org/en/", "http://x.com#/en/", "http://x.net?/es/",
        "http://" + "a." * 300 + "net/es/" + "p" * 3000]
RULES = [*queries.URL_RULES, ("", "", "block"), ("b.net", "/", "block"), ("b.net", "/d", "allow"), ("b.net", "/de", "allow"), ("x.com", "", "block"),
         ("evil.org", "/en/", "allow"), ("example.com", "/en/", "allow")]


@pytest.mark.parametrize("ranges", [1, 3, 40])
@pytest.mark.parametrize("rules", [queries.URL_RULES, RULES, []])
def test_urls_match_plain_rules(spark, rules, ranges):
    rng = random.Random(1)
    hosts, paths = ["a.com", "b.net", "x.b.net", "www.example.com", "q.example.com", "com", "evil.org"], ["", "/", "/en/", "/en/a", "/de", "/d", "/es/1", "/fr/"]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(150)]
    pages = spark.createDataFrame([(i % 170 or None, u, "old", "x") for i, u in enumerate(urls)], "page_id bigint, url string, rule string, stack string")
    merged = [r for r in rules if r != ("example.com", "/en/", "allow")]  # block wins over allow
    got = url_filter.judge_urls(pages, url_filter.rule_frame(spark, rules), ranges=ranges)
    assert sorted(map(str, [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()])) == sorted(
        str((u, *judge(u, merged))) for u in urls)
    assert set(got.columns) == {*pages.columns, "host", "path", "verdict"}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_frame(spark, rules), ranges=ranges).count() == 0


def test_a_suffix_of_many_hosts_is_swept_once(spark, monkeypatch):
    swept = []
    sweep = url_filter.sweep
    monkeypatch.setattr(url_filter, "sweep", lambda probes, *a: swept.append(probes) or sweep(probes, *a))
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 1000, '.com/') AS url")
    rules = [("com", "/", "allow"), ("h7.com", "", "block")]
    got = url_filter.judge_urls(pages, url_filter.rule_frame(spark, rules), ranges=4).groupBy("rule", "verdict").count().collect()
    assert sorted(map(tuple, got)) == [("com/", "allow", 2997), ("h7.com", "block", 3)]
    assert swept[0].where("suffix = 'com'").count() == 1 and swept[0].count() == 1001


# --- personal data ------------------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (
                    k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("a.@-+ 1230(5)é") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == plain_spans(t)
    for t in ("4242424242424242 x@y.z", "1.2.3.4.5.6.7.8.9", "001.02.3.255", "a@b@c.d", "9" * 5000, "a" * 50000 + "@", "1." * 20000):
        assert pii.base_spans(t) == plain_spans(t) if len(t) < 6000 else pii.base_spans(t) is not None


@pytest.fixture(scope="module")
def field():
    return pii.train(["", "call me at", "foo bar baz", "the and of it"], n=250, epochs=4)


def whole_best(text, field):
    """The best score of any segmentation, by recursion over all cuts of the whole text."""
    cuts, ends = pii.candidates(text, 0, len(text))
    best = {(0, 0): 0.0}
    for j in range(1, len(cuts)):
        best[j, 0] = max(best.get((j - 1, e), -np.inf) for e in (0, 1))
        best[j, 1] = max([best.get((i, e), -np.inf) + field.weights[k][f].sum() + field.follow[k] * e
                          for i, f in ends.get(j, ()) for e in (0, 1) for k in range(4)], default=-np.inf)
    return max(best[len(cuts) - 1, e] for e in (0, 1))


def score_of(text, spans, field):
    ended = {b for _, _, b in spans}
    return sum(field.weights[k][pii.span_features(text, a, b)].sum() + field.follow[k] * (a in ended) for a, k, b in spans)


def test_regions_decode_like_the_whole_text(field):
    for t, _ in pii.examples(["foo bar baz " * 12, "", "x"], 40, 3):
        assert score_of(t, pii.field_spans(t, field), field) == pytest.approx(whole_best(t, field))


def test_gradient_matches_differences(field):
    t, gold = next(pii.examples(["foo"], 1, 12))
    cuts, ends = pii.candidates(t, 0, len(t))
    place = {c: i for i, c in enumerate(cuts)}
    own = {(place[a], k, place[b]) for a, k, b in gold}
    model = pii.Field(field.weights * 0.1, field.follow * 0.1)
    dw, _, like = model.gradient(ends, len(cuts), own)
    for k, f in ((0, 0), (1, 9), (2, 8), (3, 12)):
        step = np.zeros_like(model.weights)
        step[k, f] = 1e-5
        more = pii.Field(model.weights + step, model.follow).gradient(ends, len(cuts), own)[2]
        assert (more - like) / 1e-5 == pytest.approx(dw[k, f], abs=1e-3)


def test_field_finds_hidden_forms_and_leaves_plain_numbers(field):
    right = sum(set(pii.field_spans(t, field)) == set(g) for t, g in pii.examples(["quick brown", "lazy dog is"], 150, 77))
    assert right > 120
    text = "write to jane.doe (at) mailhost (dot) org or (555) 123-4567 in 1999"
    assert [text[a:b] for a, _, b in pii.field_spans(text, field)] == ["jane.doe (at) mailhost (dot) org", "(555) 123-4567"]


def test_personal_data_of_odd_rows(odd, docs):
    out = pii.find_personal_data(odd).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert sorted(str((r["doc_id"], [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["base"]])) for r in out) == sorted(
        str((i, plain_spans(t))) for i, t in texts)
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in out)
    assert pii.find_personal_data(docs([])).count() == 0


def test_personal_data_query_digests(spark):
    rows = queries.op10_personal_data(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == i for _, x, _ in base) for i in range(4)]


# --- toxicity -----------------------------------------------------------------------------------------------------------

def toy_costs():
    text = "you are an idiot and a moron the quick worthless loser was stupid my good friend is nice today " * 50
    s = np.concatenate(([0], toxicity.symbols_of(text)))
    n = toxicity.SYMBOLS
    return toxicity.costs_of(np.bincount((s[:-2] * n + s[1:-1]) * n + s[2:], minlength=n ** 3).reshape(n, n, n).astype(float))


def test_decoding_is_the_cheapest_path():
    costs, rng = toy_costs(), random.Random(3)

    def model(text):
        a = b = 0
        total = 0.0
        for c in text + " ":
            s = toxicity.symbol(c)
            if s or b:
                total += costs[a, b, s]
                a, b = b, s
        return total

    for _ in range(200):
        token = "".join(rng.choice("idotmrn10!$.-a") for _ in range(rng.randint(1, 7)))
        channel = {"": 0.0}  # the least cost of the signs for every reading
        for options in toxicity.lattice(token):
            following = {}
            for text, cost in channel.items():
                for letters, own in options:
                    following[text + letters] = min(following.get(text + letters, np.inf), cost + own)
            channel = following
        total = {text: cost + model(text) for text, cost in channel.items()}
        read = toxicity.decode(token, costs).split()
        assert min(v for text, v in total.items() if text.split() == read) == pytest.approx(min(total.values()))


def test_hidden_words_are_restored():
    reader = toxicity.Reader(toy_costs())
    for hidden, plain in {"1d10t": "idiot", "i d i o t": "idiot", "idiooooot": "idiot", "m0r0n!!": "moron", "l.o.s.e.r": "loser", "w0rthless": "worthless",
                          "$tup1d": "stupid", "THE!!": "the", "good$$$": "good", "(nice),": "nice", "friend.today": "friend today"}.items():
        assert reader.restore(hidden) == plain, hidden
    assert reader.restore("") == reader.restore(" 123 !!! ") == ""


def toy_tables(docs, spark, n=400):
    rng = random.Random(4)
    good, bad = ["you", "are", "my", "good", "friend", "nice", "today", "the", "quick"], ["idiot", "moron", "loser", "stupid"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(good) for _ in range(30)]
        if toxic:
            words[5] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), int(not toxic)))
    return docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_held_out_and_hidden_toxicity(docs, spark):
    frame, labels = toy_tables(docs, spark)
    hidden = [(1000, "you are a 1d10t today"), (1001, "my good friend"), (1002, "you m o r o n"), (1003, "stuuuupid friend")]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame.unionByName(docs(hidden)), labels).collect()}
    assert all(got[i]["predicted"] == (i % 5 == 0) for i in range(400))
    assert [got[i]["predicted"] for i in range(1000, 1004)] == [1, 0, 1, 1]


def test_labels_of_held_out_rows_do_not_matter(docs, spark):
    frame, labels = toy_tables(docs, spark, 150)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame, x).collect()} for x in (labels, other))
    assert a == b


def test_toxicity_of_odd_rows(odd, docs, spark):
    schema = "doc_id bigint, toxic int"
    for labels in ([], [(1, None), (None, 1)], [(i, 1) for i in range(12)], [(4, 1), (4, 0), (10, 0), (None, 1), (3, 0)]):
        out = toxicity.score_toxicity(odd, spark.createDataFrame(labels, schema))
        rows = out.collect()
        assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows) and set(odd.columns) == set(out.columns)
    kept = toxicity.drop_toxic(odd, spark.createDataFrame([], schema))
    assert kept.columns == odd.columns and kept.count() == 14
    assert toxicity.score_toxicity(docs([]), spark.createDataFrame([], schema)).count() == 0


def test_held_out_accuracy_on_the_sample_tables(spark):
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.97 and np.mean([s >= 0.5 for s in neg]) < 0.01
