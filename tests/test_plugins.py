from pyspark.sql import functions as F

from lawstrata.functions import plugins
from lawstrata.operators import chunker
from lawstrata.sources import sinks
from lawstrata.sources.sinks import merge_graph, read_buckets


def test_replies_and_retries(spark):
    def model(prompt):
        if prompt == "busy":
            raise plugins.Busy("503")
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("busy",), ("bad",), (None,)], "p string")
    got = {r.p: (r.reply, r.error) for r in plugins.with_replies(df, "p", model, tries=2, wait=0.0).collect()}
    assert got == {"a": ("A", None), "busy": (None, "busy: 503"), "bad": (None, "ValueError: no"), None: (None, None)}
    calls = []

    def later(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise plugins.Busy("x")
        return "ok"

    assert plugins.asked_model(later, "p", 3, 0.0) == ("ok", None) and len(calls) == 3


def test_tokenizer_and_scorer(spark):
    size = plugins.tokenizer(len)
    df = spark.createDataFrame([("ab", "abc"), (None, "x")], "a string, b string")
    assert [r.n for r in df.select(size(F.col("a")).alias("n")).collect()] == [2, None]
    score = plugins.scorer(lambda a, b: [len(x) / len(y) for x, y in zip(a, b)])
    assert [r.s for r in df.select(score(F.col("a"), F.col("b")).alias("s")).collect()] == [2 / 3, 0.0]
    docs = spark.createDataFrame([("d", "T", None, None, "[[ANCHOR:a]] " + "x" * 30, None)], "doc_id string, title string, metadata map<string,string>, summary_content string, main_content string, amendments array<struct<tip_id:string,bm_title:string,amended_content:string,amended_link:string>>")
    assert {r.chunk_type for r in chunker.chunk_documents(docs, size=size).collect()} == {"Document_Meta", "Preamble"}


def test_graph_sink(spark, tmp_path):
    nodes = spark.createDataFrame([("C", "1", "old", 1), ("C", "1", "new", 2), ("C", "2", None, 1)], "label string, key string, name string, o int")
    edges = spark.createDataFrame([("1", "2"), ("1", "2")], "src string, dst string")
    for _ in range(2):
        merge_graph(nodes, edges, str(tmp_path), ["label", "key"], F.col("o"))
        assert sorted(map(tuple, read_buckets(spark, f"{tmp_path}/nodes").collect())) == [("C", "1", "new", 2), ("C", "2", None, 1)]
        assert read_buckets(spark, f"{tmp_path}/edges").count() == 1
    more = spark.createDataFrame([("C", "2", "set", 5), ("D", "3", "x", 1), ("D", None, "y", 1)], nodes.schema)
    for _ in range(3):
        merge_graph(more, edges.limit(0), str(tmp_path), ["label", "key"], F.col("o"))
        got = read_buckets(spark, f"{tmp_path}/nodes").select("label", "key", "name", "o").collect()
        assert sorted(map(tuple, got), key=repr) == [("C", "1", "new", 2), ("C", "2", "set", 5), ("D", "3", "x", 1), ("D", None, "y", 1)]
        assert read_buckets(spark, f"{tmp_path}/edges").count() == 1
    assert max(len(v) for v in sinks._versions(spark, f"{tmp_path}/nodes").values()) <= sinks.KEPT
