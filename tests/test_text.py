import hashlib
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawstrata.functions import text as t
from lawstrata.functions.links import absolute, compared_link

SITE = "https://host.example"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_emphasis(spark):
    assert one(spark, "**A** text **B**", t.strip_emphasis) == "*A text B*"
    assert one(spark, "**Điều 1. X**", t.strip_emphasis) == "*Điều 1. X*"
    assert one(spark, "* a\n* b", t.strip_emphasis) == " a\n b"
    assert one(spark, None, t.strip_emphasis) is None


def test_headings(spark):
    kinds = {"*Điều 1. X*": "Điều", "*Điều 1. X": "Điều", "*Chương I* x": "Chương", "*Mục 2 a\nb*": "Mục", "*Phần I": "other", "Điều 1. X": "other", "chương I": "other", "": "other"}
    for text, kind in kinds.items():
        assert one(spark, text, t.heading_kind) == kind, text
    assert one(spark, "Điều 7. X", lambda c: t.heading_kind(c, starred=False)) == "Điều"


def test_splits(spark):
    assert one(spark, "a\n1. b\nKhoản 2 c\n10.5 triệu", t.split_clauses) == ["a", "1. b", "Khoản 2 c", "10.5 triệu"]
    assert one(spark, "x\na) b\nđ) c\nê) d", t.split_points) == ["x", "a) b", "đ) c\nê) d"]
    assert one(spark, "x\nĐiều 1\nĐiềux", t.split_new_wording) == ["x", "Điều 1\nĐiềux"]


def test_lead_in(spark):
    assert one(spark, "sửa đổi NHƯ SAU: “abc”", t.strip_lead_in) == "abc”"
    assert one(spark, "a\nnhư sau: b", t.strip_lead_in) == "a\nnhư sau: b"
    assert one(spark, "“x", t.strip_lead_in) == "x"


def test_markers(spark):
    x = "[[ANCHOR:a_1]]  b [[AMENDMENT:t]] c\n\n\n d"
    assert one(spark, x, t.tidy) == "b [[AMENDMENT:t]] c\n d"
    assert one(spark, x, lambda c: t.marker_ids(c, "ANCHOR")) == ["a_1"]
    assert one(spark, "a [[AMENDMENT:t]] b", t.embed_text) == "a b"


def test_tokens_and_strip(spark):
    assert one(spark, " a b \n c ", t.tokens) == 3
    assert one(spark, "", t.tokens) == 0
    assert one(spark, None, t.tokens) is None
    assert one(spark, "\t 　x \x0b", t.strip) == "x"
    assert one(spark, " \t", t.norm_id) is None


def test_card(spark):
    df = spark.createDataFrame([("T", {"Người ký": "", "Loại văn bản": "Luật"}), ("U", None)], "t string, m map<string,string>")
    a, b = (r[0] for r in df.select(t.metadata_card(F.col("t"), F.col("m"))).collect())
    assert "- Người ký: \n" in a and "- Loại văn bản: Luật\n" in a and f"- Tình trạng: {t.CARD_NONE}\n" in a and len(a.splitlines()) == 10
    assert b.count(t.CARD_NONE) == 8


def test_keys(spark):
    names = ["a", "điều_1", "", "x" * 300, "😀"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    for r in df.select("x", t.point_key(F.col("x")).alias("p"), t.doc_key(F.col("x")).alias("d")).collect():
        assert r.p == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.x))
        assert r.d == hashlib.md5(r.x.encode()).hexdigest()[:16]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=['Cs']), max_size=12), max_size=5))
def test_point_keys_are_uuid5(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r[0] for r in df.select(t.point_key(F.col("x"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]



def test_links(spark):
    same = ["https://host.example/a/B.aspx", "http://HOST.example/a/B.aspx?x=1#y", "/a/B.aspx/", "  //host.example/a/B.aspx#z "]
    assert {one(spark, x, lambda c: compared_link(c, SITE)) for x in same} == {"host.example/a/B.aspx"}
    for x in ("", "  ", "#a", "javascript:void(0)", " JavaScript:x", None):
        assert one(spark, x, lambda c: compared_link(c, SITE)) is None
    assert one(spark, "/x", lambda c: absolute(c, SITE)) == SITE + "/x"
    assert one(spark, "x/y", lambda c: absolute(c, SITE)) == "x/y"
