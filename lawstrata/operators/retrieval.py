"""Batches of questions: expansion, retrieval, de-duplication, reranking, context and answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawstrata.functions.text import strip
from lawstrata.operators.vectors import embed, hashed_words, nearest

QUERIES, HITS, TOP = 4, 6, 4
#: Texts of the answers.
NO_TITLE, NO_ANSWER = "Tài liệu không tên", "Không tìm thấy tài liệu liên quan để trả lời câu hỏi này."
BLOCK_HEAD = "--- TÀI LIỆU "
EXIT_WORDS = ("exit", "quit", "thoát")


def asked(questions: DataFrame, text_col: str) -> DataFrame:
    """Without blank lines and exit words."""
    x = F.lower(strip(F.col(text_col)))
    return questions.where(x.isNotNull() & (x != "") & ~x.isin(*EXIT_WORDS))


def expanded(question: Column, reply: Column, most: int = QUERIES) -> Column:
    """The question and the lines of a model's reply, list signs stripped, blank lines dropped; the first few.

    A failed reply (null) leaves the question alone."""
    lines = F.filter(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: strip(x) != "")
    lines = F.transform(lines, lambda x: F.btrim(x, F.lit("- •*")))
    return F.slice(F.concat(F.array(question), lines), 1, most)


def first_hits(hits: DataFrame, question: str = "question_id", point: str = "point_id") -> DataFrame:
    """A point found by several queries of a question once: at its first query and rank."""
    w = Window.partitionBy(question, point).orderBy("query_ord", "rank")
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overlap(a: Column, b: Column) -> Column:
    """The default rerank score: Jaccard similarity of the texts' distinct words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda x: x != ""))
    both = F.size(F.array_intersect(words(a), words(b)))
    either = F.size(F.array_union(words(a), words(b)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def reranked(hits: DataFrame, score: Column, top: int = TOP, question: str = "question_id") -> DataFrame:
    """The best few of each question by score; equal scores keep retrieval order."""
    w = Window.partitionBy(question).orderBy(F.desc("rerank_score"), "query_ord", "rank", "point_id")
    return hits.withColumn("rerank_score", score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def contexts(ranked: DataFrame, question: str = "question_id") -> DataFrame:
    """Numbered blocks of the ranked texts of each question."""
    title = F.coalesce("title", F.lit(NO_TITLE))
    block = F.concat(F.lit("\n" + BLOCK_HEAD), F.col("place").cast("string"), F.lit(": "), title, F.lit(" ---\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    rows = ranked.withColumn("block", block).groupBy(question).agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("b"))
    return rows.select(question, F.array_join(F.transform("b", lambda x: x["block"]), "").alias("context"))


def answers(questions: DataFrame, context: DataFrame, question: str = "question_id") -> DataFrame:
    """Every question with its context's extract as the default answer, or the fixed answer where nothing was found."""
    out = questions.join(context, question, "left")
    return out.withColumn("answer", F.when(F.col("context").isNull(), NO_ANSWER).otherwise(strip(F.col("context"))))


def answer_questions(questions: DataFrame, chunk_points: DataFrame, reply: Column, dim: int, hits: int = HITS, top: int = TOP, embedder=hashed_words) -> DataFrame:
    """question_id, question, answer, for a table of questions (question_id, question).

    ``chunk_points``: point_id, vector, content, title. ``reply`` is the expansion that a model gives (an
    expression on the questions; null for none).
    """
    q = asked(questions, "question").select("question_id", "question", F.posexplode(expanded(F.col("question"), reply)).alias("query_ord", "query"))
    q = embed(q.withColumn("qid", F.concat_ws(":", F.col("question_id").cast("string"), F.col("query_ord").cast("string"))), "query", dim, embedder)
    near = nearest(chunk_points, q, "point_id", "vector", "qid", "vector", hits)
    found = near.join(q.select("qid", "question_id", "question", "query_ord"), "qid").join(chunk_points.select("point_id", "content", "title"), "point_id")
    ranked = reranked(first_hits(found), overlap(F.col("question"), F.col("content")), top)
    return answers(asked(questions, "question"), contexts(ranked)).select("question_id", "question", "answer")


def report(ranked: DataFrame, question: str = "question_id", width: int = 120) -> DataFrame:
    """One line for each hit: place, score, title and the beginning of its text on one line."""
    preview = F.substring(F.replace(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit(" ")), 1, width)
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.format_number("rerank_score", 4), F.lit(" | "), F.coalesce("title", F.lit(NO_TITLE)), F.lit(" | "), preview, F.lit("..."))
    return ranked.select(question, "place", line.alias("line"))
