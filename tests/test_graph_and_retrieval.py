import numpy as np
from pyspark.sql import functions as F

from lawstrata.operators import graph, retrieval, vectors
from lawstrata.sources import sinks
from lawstrata.sources.tables import CHUNK, json_records, table, url_list
from lawstrata.streaming.incremental import read_upserted, stream_table, upsert_stream, windowed_counts

COLS = [f.split(" ")[0] for f in CHUNK.split(", ")]


def chunk(**v):
    return tuple(v.get(c) for c in COLS)


def chunks(spark, *rows):
    return spark.createDataFrame([chunk(**r) for r in rows], CHUNK)


BASE = (
    {"chunk_id": "meta_d", "chunk_type": "Document_Meta", "doc_id": "d", "title": "T", "source_url": "u", "metadata": {"Người ký": "X"}, "content": "c", "content_embed": "c", "ord": 5},
    {"chunk_id": "s", "chunk_type": "Summary", "doc_id": "d", "parent_chunk_id": "d", "content": "x", "content_embed": "E\nx"},
    {"chunk_id": "a1", "chunk_type": "Điều", "doc_id": "d", "parent_chunk_id": "d", "content": "A", "amends": ["7", "7", None, ""]},
    {"chunk_id": "k1", "chunk_type": "Khoản", "doc_id": "d", "parent_chunk_id": "a1", "content": "K", "content_embed": "V\nK"},
    {"chunk_id": "k2", "chunk_type": "Khoản", "doc_id": "d", "parent_chunk_id": "gone", "content": "L"},
    {"chunk_id": "am", "chunk_type": "Amendment", "doc_id": "d", "tip_id": "7", "amended_link": "v?x=1#y", "content": "first \nsecond"},
    {"chunk_id": "am2", "chunk_type": "Amendment", "doc_id": "e", "tip_id": "7", "content": ""},
)


def test_edges_and_nodes(spark):
    c = chunks(spark, *BASE)
    triples = lambda df: sorted((r.src, r.rel, r.dst) for r in df.collect())
    assert triples(graph.amendment_edges(c)) == [("a1", "HAS_AMENDMENT", "am")]
    docs = spark.createDataFrame([("v", "dv"), ("v", "dv")], "source_url string, doc_id string")
    assert triples(graph.amended_documents(c, docs)) == [("am", "AMENDS_DOCUMENT", "dv")]
    assert triples(graph.structure_edges(c)) == [("a1", "CONTAINS", "k1"), ("d", "CONTAINS", "a1"), ("d", "HAS_METADATA", "meta_d"), ("d", "HAS_SUMMARY", "s")]
    assert sorted(r.chunk_id for r in graph.entity_targets(c).collect()) == ["am", "am2", "k1", "k2"]
    names = {r.chunk_id: r.name for r in graph.chunk_nodes(c).collect()}
    assert (names["am"], names["k1"], names["k2"]) == ("first", "V", "L")
    d = {r.doc_id: r for r in graph.document_nodes(c).collect()}
    assert (d["d"].title, d["d"].nguoi_ky, d["e"].title) == ("T", "X", None)
    assert graph.structure_edges(c.limit(0)).count() == 0


def test_dirty_chunks(spark):
    odd = ({"chunk_id": None, "chunk_type": "Khoản", "doc_id": "d", "parent_chunk_id": "a1"}, {"chunk_id": "t", "doc_id": "d", "parent_chunk_id": "d"}, {"chunk_id": "x", "chunk_type": "Khoản"}, BASE[2], BASE[2])
    c = chunks(spark, *BASE, *odd).withColumn("rel", F.lit("clash")).withColumn("src", F.lit(1))
    edges = graph.structure_edges(c).collect()
    assert len(edges) == len(set(edges)) == 4 and all(r.src and r.dst for r in edges)
    assert {r.chunk_id for r in graph.chunk_nodes(c).collect()} >= {"t", "x", None}
    assert graph.amendment_edges(c).count() == 1 and graph.entity_targets(c).where("chunk_id = 'x'").count() == 1
    for f in (graph.amendment_edges, graph.structure_edges, graph.entity_targets, graph.chunk_nodes, graph.document_nodes):
        assert f(c.limit(0)).count() == 0


def test_entities(spark):
    reply = '<think>a\n{"x"</think>```json\n{"subjects": ["A", " ", "A", 3], "penalties": [], "actions": "no", "things": ["T"]}\n```'
    df = spark.createDataFrame([("c", reply), ("d", "[1]"), ("e", "not json"), ("f", None), ("g", '{"penalties": ["P"]}')], "chunk_id string, entities string")
    got = {tuple(r) for r in graph.unpivot_entities(df).collect()}
    assert got == {("c", "Subject", "A"), ("c", "Subject", "3"), ("g", "Penalty", "P")}
    literal = {r.label for r in graph.unpivot_entities(df, None).collect()}
    assert literal == {"Subject", "Thing", "Penaltie"}
    text = spark.createDataFrame([("c", "Phạt tiền từ 1.000 đến 2.000 đồng đối với người điều khiển xe máy; chủ xe phải nộp phạt.")], "chunk_id string, text string")
    names = {(r.label, r.name) for r in graph.unpivot_entities(graph.extract_entities(text)).collect()}
    assert ("Penalty", "Phạt tiền từ 1.000 đến 2.000 đồng") in names and ("Subject", "người điều khiển") in names
    assert graph.entity_nodes(graph.unpivot_entities(df)).count() == 3 and graph.mention_edges(graph.unpivot_entities(df)).count() == 3


def test_embeddable_and_points(spark):
    p = {r.payload.chunk_id: r for r in vectors.points(chunks(spark, *BASE), 16).collect()}
    assert sorted(p) == ["am", "am2", "k1", "meta_d", "s"] and "content_embed" not in p["k1"].payload.asDict()
    assert abs(np.linalg.norm(p["k1"].vector) - 1) < 1e-6 and not any(p["am2"].vector)


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8))
    x[7] = x[3]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0]), (None, [1.0] * 8)], "i bigint, v array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 400, 20)] + [(1, None)], "q bigint, w array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4096, 4):
        got = {}
        for r in vectors.nearest(base, q, "i", "v", "q", "w", 5, block).collect():
            got.setdefault(r.q, []).append((r["rank"], r.i))
        assert len(got) == 20
        for k, hits in got.items():
            c = np.round(u @ u[k], 12)
            assert [i for _, i in sorted(hits)] == sorted(range(400), key=lambda i: (-c[i], i))[:5]


def test_latest_and_upsert(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, o int")
    new = spark.createDataFrame([("b", 3, 2), ("b", 4, 3), ("c", 5, 1)], "k string, v int, o int")
    assert sorted(map(tuple, sinks.upserted(now, new, "k", F.col("o")).collect())) == [("a", 1, 1), ("b", 4, 3), ("c", 5, 1)]
    assert sinks.upserted(now, new.limit(0), "k", F.col("o")).count() == 2


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "a b"), (2, " thoát "), (3, "  "), (4, None), (5, "zzz")], "question_id int, question string")
    assert [r.question_id for r in retrieval.asked(q, "question").collect()] == [1, 5]
    reply = F.lit("- x\n\n• y *\n z\nw")
    assert q.select(retrieval.expanded(F.col("question"), reply).alias("e")).first().e == ["a b", "x", "y", "z"]
    assert q.select(retrieval.expanded(F.col("question"), F.lit(None).cast("string")).alias("e")).first().e == ["a b"]
    hits = spark.createDataFrame([(1, 1, 1, "p", "a"), (1, 0, 2, "p", "a"), (1, 0, 1, "r", "a b"), (1, 0, 3, "s", "a")], "question_id int, query_ord int, rank int, point_id string, content string")
    first = {r.point_id: (r.query_ord, r["rank"]) for r in retrieval.first_hits(hits).collect()}
    assert first == {"p": (0, 2), "r": (0, 1), "s": (0, 3)}
    top = retrieval.reranked(retrieval.first_hits(hits).withColumn("question", F.lit("a b")), retrieval.overlap(F.col("question"), F.col("content")), 2)
    assert [r.point_id for r in top.orderBy("place").collect()] == ["r", "p"]
    c = retrieval.contexts(top.withColumn("title", F.lit(None).cast("string")))
    assert c.first().context == f"\n--- TÀI LIỆU 1: {retrieval.NO_TITLE} ---\na b\n\n--- TÀI LIỆU 2: {retrieval.NO_TITLE} ---\na\n"
    got = {r.question_id: r.answer for r in retrieval.answers(retrieval.asked(q, "question"), c).collect()}
    assert got[5] == retrieval.NO_ANSWER and got[1].startswith("--- TÀI LIỆU 1")


def test_answers_end_to_end(spark):
    pts = vectors.points(chunks(spark, *BASE, {"chunk_id": "z", "chunk_type": "Khoản", "doc_id": "d", "content": "xe đi sai làn", "content_embed": "xe đi sai làn", "title": "L"}), 32).select("point_id", "vector", "payload.content", "payload.title")
    q = spark.createDataFrame([(1, "đi sai làn")], "question_id int, question string")
    assert "xe đi sai làn" in retrieval.answer_questions(q, pts, F.lit(None).cast("string"), 32).first().answer


def test_sources_and_sinks(spark, tmp_path):
    c = chunks(spark, *BASE)
    sinks.write_bucketed(c, f"{tmp_path}/j", F.col("doc_id"), "json")
    (tmp_path / "j2").mkdir()
    (tmp_path / "j2/a.json").write_text('[{"chunk_id": "q"}]')
    (tmp_path / "j2/b.json").write_text("[]")
    (tmp_path / "j2/c.txt").write_text("x")
    back = json_records(spark, [f"{tmp_path}/j"], CHUNK)
    assert sorted(map(str, back.collect())) == sorted(map(str, c.collect()))
    assert [r.chunk_id for r in json_records(spark, [f"{tmp_path}/j2"], CHUNK, arrays=True).collect()] == ["q"]
    (tmp_path / "u.csv").write_text("n,url\n1,http://a\n2,\n3,http://b\n")
    urls = url_list(spark, f"{tmp_path}/u.csv")
    done = spark.createDataFrame([("http://a",)], "url string")
    assert [r.url for r in sinks.pending(urls, done).collect()] == ["http://b"]
    sinks.create_if_absent(spark, "t_points", spark.createDataFrame([([1.0],)], "vector array<float>"))
    sinks.create_if_absent(spark, "t_points", spark.createDataFrame([([1.0],)], "vector array<float>"), dim=3)
    assert spark.table("t_points").count() == 0
    spark.sql("drop table t_points")


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 7}", i, i % 5) for i in range(60)], "k string, v int, o int")
    df.repartition(6).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new and changes nothing
        upsert_stream(stream_table(spark, f"{tmp_path}/in", df, 2), f"{tmp_path}/out", "k", F.col("o") * 1000 + F.col("v"), f"{tmp_path}/cp").awaitTermination()
        got = {r.k: r.o for r in read_upserted(spark, f"{tmp_path}/out").collect()}
        assert sorted(got) == [f"k{i}" for i in range(7)]
    ev = spark.createDataFrame([(i,) for i in range(100)], "i int").select(F.timestamp_seconds(F.col("i") * 30).alias("ts"), F.lit("e").alias("kind"))
    ev.write.parquet(f"{tmp_path}/ev")
    q = windowed_counts(stream_table(spark, f"{tmp_path}/ev", ev), "ts", "kind", "10 minutes", "5 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n_rows), count(*) from w").first()[:2] == (100, 5)
    assert table  # the reader of Parquet tables is used by every query
