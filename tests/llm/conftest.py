import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or (id, text, source), with a column whose name clashes with the operators' own."""
    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F
            for name in ("size", "target", "kept", "score", "fp", "mark", "key", "part", "sequence_id", "offset", "_id", "_text", "text_hash",
                         "n_removed", "component_id", "row_id", "predicted", "host", "rule", "path", "verdict", "_taken", "_size", "_same",
                         "_n", "_mine", "_pass", "_k_id", "_k_text", "_k_mark", "_k_n", "_spans", "_clean", "_row", "a.b"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


ODD = [(None, None), (None, "a b c"), (1, ""), (2, " \t\n"), (3, "Hello World again and again"), (3, "Hello World again and again"),
       (4, "hello world AGAIN and again"), (5, None), (6, "word " * 30000), (7, "x" * 20000), (8, "1" * 5000), (9, "émile@ü. ßtraße 日本語。テスト"),
       (10, "a@b.co +1 (555) 123-4567"), (11, "!!!")]


@pytest.fixture
def odd(docs):
    return docs(ODD, extra=True)
