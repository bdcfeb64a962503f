import time

from pyspark.sql import functions as F

from lawstrata.functions.html import finish, page_fields, parse_html, to_markdown
from lawstrata.operators.pages import accepted_page, parse_pages, split_ended

SITE = "https://h.example"
#: The pages' form: marks are classes, ids and styles; anything of the same look elsewhere does not count.
PAGE = """<html><table><tr><td><b>Ngoài:</b></td><td>x</td></tr></table>
<div id="tab-1" class="contentDoc"><h1> Luật <i>A</i> </h1>
<table><tr><td><b>Số:</b></td><td> 1 </td><td><b>Số:</b></td><td>2</td></tr><tr><td><b>Trống:</b></td><td> </td></tr><tr><td><b>Cuối:</b></td></tr></table>
<table><tr><td><b>Sau:</b></td><td>x</td></tr></table><div class="Tomtatvanban"><p>Tóm  tắt</p><p>hai</p></div></div>
<div class="Tomtatvanban">khác</div>
<ul class="muclucVB"><li><a class="amuclucvb" href="#d_1"> Điều 1 </a></li><li>x</li><li><a class="amuclucvb" href="/other">O</a></li><li><a class="amuclucvb" href="#id_2">2</a></li><li><a class="amuclucvb" href="#no">3</a></li></ul>
<div class="content1"><!-- c --><span> VABWxyz</span><table><tr><td>CỘNG<br>HÒA</td><td>độc lập</td></tr></table><table><tr><td>Nơi nhận:</td></tr></table><table><tr><td>giữ</td></tr></table>
<p><a name="d_1"></a><b>Điều 1.</b> <b>TÊN</b></p><p id="id_2">a <a atmm=".lqhlTootip-7">lần đầu</a> b <a atmm=".lqhlTootip-7">lần cuối</a></p><h2>H</h2><i>n\\_m</i> VABWAFAATABfx+/= VABWng</div>
<a atmm=".lqhlTootip-7">ngoài</a>
<div id="divltrLienQuanHieuLucTungPhan">
<div class="lqhlTip-7 x"><div id="bmTitle"> T <b>t</b></div><div id="bmContentOld"><p>cũ</p><p>hơn</p></div><div id="bmContent">C<a>y</a><a href="/x.aspx">xem</a><p>D</p></div></div>
<div class="lqhlTip-8"></div></div></html>"""
RELATED = """<div id="tab5" class="contentDoc"><div class="content-1" lawid="0"><div class="number"> 1</div><a href="/no">no</a><p class="nqTitle" lawid="9"><a href="/r"> R </a></p>
<p><span>Bên ngoài:</span> x</p><div class="right-col"><p><span>Ngày:</span> Ngày: 1/1</p><p><span>Trống:</span> </p><p>không</p></div></div><div class="content-2"></div></div><div class="content-3"></div>Không có văn bản"""
DIAGRAM = """<div class="ghd">Sai</div><div class="ct"><div class="dgc"><a href="/0">ngoài</a></div></div><div id="tab4" class="contentDoc"><div class="ghd">Căn cứ</div><div class="ct"><div class="dgc"><a href="/1">A</a></div></div>
<div class="ghd">Văn bản đang xem</div><div class="ct"><div class="dgc"><a href="/2">B</a></div></div>
<div class="ghd">Căn cứ</div><div class="ct"><a href="/x">x</a><div class="dgc"><a href="/3">C</a><div class="clsTooltip-3"><div style="color:red; background-color: #FFFBF4"> Tên 3 </div><div style="float:left">Số:</div><div style="float:left"> 5 </div><div style="float:left">Lẻ:</div></div></div></div>
<p><div class="ct"><div class="dgc"></div></div></p></div>""" + " " * 500


def test_page(spark):
    df = spark.createDataFrame([("u", PAGE, DIAGRAM, RELATED, None)], "source_url string, main_html string, luocdo_html string, hl_html string, nd_html string")
    r = parse_pages(df, SITE).first()
    assert (r.title, r.metadata, r.summary_content) == ("LuậtA", {"Số": "2"}, "Tóm tắt\n\nhai")
    assert [(x.title, x.href) for x in r.mucluc] == [("Điều 1", "#d_1"), ("O", "/other"), ("2", "#id_2"), ("3", "#no")]
    m = r.main_content
    assert m.count("[[ANCHOR:d_1]]") == m.count("[[ANCHOR:id_2]]") == 1 and "[[ANCHOR:no]]" not in m
    assert m.index("[[ANCHOR:d_1]]") < m.index("**Điều 1. TÊN**") < m.index("[[ANCHOR:id_2]]") < m.index("[[AMENDMENT:7]]") < m.index("lần đầu")
    assert m.count("[[AMENDMENT:7]]") == 1
    assert "VABWxyz" not in m and "VABWAFAA" not in m and "VABWng" in m and "độc lập" not in m and "Nơi nhận" not in m and "giữ" in m and "## H" in m and "n_m" in m and "<" not in m
    a, b = r.amendments
    assert tuple(a) == ("7", "lần cuối", "Tt", "cũ\nhơn", "C\ny\nD", SITE + "/x.aspx")
    assert tuple(b) == ("8", "", "", "", "", "")
    x, y = r.lienquan_hieuluc_list
    assert (x.number, x.lawid, x.title, x.href, [tuple(p) for p in x.attributes]) == ("1", "9", "R", "/r", [("Ngày", "1/1")])
    assert tuple(y) == (None, None, None, None, [])
    got = {d.category: [(e.title, e.href, [tuple(p) for p in e.metadata]) for e in d.documents] for d in r.luoc_do_list}
    assert got == {"Căn cứ": [("Tên 3", "/3", [("Số", "5")])], "Khác": [(None, None, [])]}


def test_empty_and_broken_pages(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "<div class=content1><p>x<b>y</div></p></table><td>"), (None, "<h1")], "source_url string, main_html string").withColumn("title", F.lit(1))
    got = {r.source_url: r for r in parse_pages(df, SITE).collect()}
    assert got["a"].title == got["b"].title == "" and got["a"].metadata == {} and got["b"].amendments == []
    assert "x" in got["c"].main_content and "y" in got["c"].main_content
    assert parse_pages(df.limit(0), SITE).count() == 0


def test_deep_and_long_pages():
    deep = '<div class="content1">' + "<div>" * 20_000 + "x" + "</div>" * 20_000 + "</div>"
    assert page_fields(deep, None, None, None, SITE)["main_content"] == "x"
    n = 4_000
    toc = "".join(f'<li><a class="amuclucvb" href="#d_{k}">x</a></li>' for k in range(n))
    body = "".join(f'<p><a name="d_{k}"></a><a atmm=".lqhlTootip-{k}">y</a></p>' for k in range(n))
    began = time.time()
    text = page_fields(f'<ul class="muclucVB">{toc}</ul><div class="content1">{body}</div>', None, None, None, SITE)["main_content"]
    assert text.count("[[ANCHOR:") == text.count("[[AMENDMENT:") == n and time.time() - began < 10


def test_rejections(spark):
    page = '<div id="tab-1" class="contentDoc"><table><tr><td><b>Tình trạng:</b></td><td>Đã biết</td></tr></table></div>'
    df = spark.createDataFrame([("a", page), ("b", "<p>x</p>")], "source_url string, main_html string")
    good, ended = split_ended(parse_pages(df, SITE))
    assert [r.source_url for r in good.collect()] == ["b"] and [r.source_url for r in ended.collect()] == ["a"]
    ok = spark.createDataFrame([("x" * 501,), ("Không có văn bản",), ("x",), (None,)], "h string").select(accepted_page(F.col("h")).alias("ok"))
    assert [r.ok for r in ok.collect()] == [True, True, False, None]
    short = RELATED.replace("Không có văn bản", "").replace("\n", "")[:490]
    df = spark.createDataFrame([("u", PAGE, short)], "source_url string, main_html string, hl_html string")
    assert parse_pages(df, SITE).first().lienquan_hieuluc_list == []


def test_markdown():
    assert to_markdown(parse_html("<p>a <b>b </b>c<br>d <i></i></p>")).strip() == "a **b** c\nd"
    assert finish("**Chương I** **TÊN**\n\n\n\nx \\_y") == "**Chương I - TÊN**\n\nx _y"
    assert finish("**điều 5** **TÊN**") == "**điều 5 TÊN**"
    assert to_markdown(parse_html("<pre>a\n  b</pre>")).strip() == "a\n  b"
