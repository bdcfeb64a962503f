"""The chunker against a plain reading of its rules, and the cases that are easily got wrong."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lawstrata.functions import text as t
from lawstrata.operators import chunker
from lawstrata.operators.pack import greedy_bins

AMEND = "array<struct<tip_id:string,bm_title:string,amended_content:string,amended_link:string>>"
DOC = f"doc_id string, title string, metadata map<string,string>, summary_content string, main_content string, amendments {AMEND}"


def doc(main="", title="T", summary="", amendments=(), key="d"):
    return (key, title, {"Người ký": "X"}, summary, main, list(amendments))


def run(spark, docs, **options):
    return {r.chunk_id: r for r in chunker.chunk_documents(spark.createDataFrame(docs, DOC), **options).collect()}


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


# ---- a plain reading -------------------------------------------------------------------------


def squeeze(x):
    x = re.sub(r"\[\[ANCHOR:[^\]]+\]\]\s*", "", x).strip()
    return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t\xa0]+", " ", x).strip())


def size(x):
    return len(x.split())


class Reader:
    """Chunks of one body, read top to bottom; (id, type, parent, content)."""

    def __init__(self, key, body, limit, least):
        self.key, self.limit, self.out, self.open = key, limit, [], []
        self.level = {"Phần": key, "Chương": key, "Mục": key}
        cut = [m.start() for m in re.finditer(r"\[\[ANCHOR:[^\]]+\]\]", body)]
        edges = sorted({0, *cut, len(body)})
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            self.segment(i, re.sub(r"\*([^*]+)\*", r"\1", body[a:b].strip()), least)
        self.close()

    def bins(self, items):
        group, used, all_groups = [], 0, []
        for item in items:
            n = size(item[1])
            if group and used + n > self.limit and used:
                all_groups.append(group)
                group, used = [], 0
            group.append(item)
            used += n
        return all_groups + [group] if group else all_groups

    def merge(self, items, kind, parent, sep):
        for g in self.bins(items):
            self.out.append((g[0][0] + ("_gop" if len(g) > 1 else ""), kind, parent or g[0][2], sep.join(x[1] for x in g)))

    def close(self):
        self.merge(self.open, "Điều", None, "\n\n")
        self.open = []

    def segment(self, i, raw, least):
        clean = squeeze(raw)
        if size(clean) < least:
            return
        anchor = re.search(r"\[\[ANCHOR:([^\]]+)\]\]", raw)
        me = f"{self.key}_{anchor[1] if anchor else f'seg_{i}'}"
        bare = re.sub(r"\[\[.*?\]\]\s*", "", clean).strip()
        head = re.match(r"\*(Phần|Chương|Mục)\s+[^*]*\*", bare)
        if head:
            self.close()
            above = {"Phần": self.key, "Chương": self.level["Phần"], "Mục": self.level["Chương"]}[head[1]]
            self.out.append((me, head[1], above, clean))
            names = ["Phần", "Chương", "Mục"]
            for lower in names[names.index(head[1]) :]:
                self.level[lower] = me
        elif re.match(r"\*Điều\s+\d+\.", bare):
            self.article(me, raw, clean)
        else:
            self.paragraphs(me, raw, "Preamble", "_p")

    def article(self, me, raw, clean):
        if size(clean) <= self.limit:
            self.open.append((me, clean, self.level["Mục"]))
            return
        self.close()
        body = re.sub(r"\[\[ANCHOR:[^\]]+\]\]\s*", "", raw).strip()
        parts = re.split(r"\n(?=Khoản\s+\d+|\d+\.)", body)
        if len(parts) == 1:
            self.paragraphs(me, raw, "Điều_Split", "_part")
            return
        self.out.append((me, "Điều", self.level["Mục"], squeeze(parts[0])))
        run = []
        for j, part in enumerate(parts[1:], 1):
            if size(part) <= self.limit:
                run.append((f"{me}_k{j}", squeeze(part), me))
                continue
            self.merge(run, "Khoản", me, "\n\n")
            run = []
            self.clause(f"{me}_k{j}", me, part)
        self.merge(run, "Khoản", me, "\n\n")

    def clause(self, me, parent, part):
        points = re.split(r"\n(?=[a-zđ]\))", part)
        lead, rest = (squeeze(points[0]), points[1:]) if len(points) > 1 else ("", points)
        self.out.append((me, "Khoản", parent, lead))
        run = []
        for k, p in enumerate(rest):
            item = (f"{me}_d{k}", squeeze(p), me)
            if size(p) > self.limit:
                self.merge(run, "Điểm", me, "\n")
                self.merge([item], "Điểm", me, "\n")
                run = []
            else:
                run.append(item)
        self.merge(run, "Điểm", me, "\n")

    def paragraphs(self, me, raw, kind, suffix):
        body = re.sub(r"\[\[ANCHOR:[^\]]+\]\]\s*", "", raw).strip()
        items = [(None, p, None) for p in re.split(r"\n\n+", body) if p.strip()]
        for n, g in enumerate(self.bins(items), 1):
            self.out.append((f"{me}{suffix}{n}", kind, self.level["Mục"], squeeze("\n\n".join(x[1] for x in g))))


def random_body(rng):
    out = []
    for k in range(rng.randint(1, 14)):
        r = rng.random()
        anchor = f"[[ANCHOR:a{k}]] " if rng.random() < 0.85 else f"[[ANCHOR:a{k}]]\n\n"
        if r < 0.25:
            out.append(f"{anchor}**{rng.choice(['Phần', 'Chương', 'Mục'])} {k} {words(rng.randint(1, 8), 'h')}**")
        elif r < 0.8:
            text = f"{anchor}**Điều {k}. {words(rng.randint(1, 12))}**"
            for j in range(rng.choice([0, 0, 2, 5])):
                text += f"\n{j}. [[AMENDMENT:t{j}]] {words(rng.randint(1, 25))}"
                for c in "abcđê"[: rng.choice([0, 0, 3, 5])]:
                    text += f"\n{c}) {words(rng.randint(1, 28))}"
            out.append(text + ("\n\n" + words(rng.randint(1, 30)) if rng.random() < 0.3 else ""))
        else:
            out.append(anchor + "\n\n".join(words(rng.randint(1, 30)) for _ in range(rng.randint(1, 4))))
    return ("x y z " if rng.random() < 0.5 else "") + " ".join(out)


@pytest.mark.parametrize("limit", [25, 60])
def test_bodies_against_plain_reading(spark, limit):
    rng = random.Random(limit)
    docs = [doc(random_body(rng), key=f"d{k}") for k in range(40)]
    got = chunker.body_chunks(spark.createDataFrame(docs, DOC), limit, 5).select("chunk_id", "chunk_type", "parent_chunk_id", "content").collect()
    want = [row for d in docs for row in Reader(d[0], d[4], limit, 5).out]
    assert sorted(map(tuple, got)) == sorted(want)


def test_partitions_do_not_matter(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([doc(random_body(rng), key=f"d{k}") for k in range(20)], DOC)
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted((tuple(r) for r in chunker.chunk_documents(docs, 40, 40, 5).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_parents_exist(spark):
    rng = random.Random(2)
    docs = [doc(random_body(rng), key=f"d{k}") for k in range(20)]
    got = run(spark, docs, limit=30, least=5)
    ids = set(got) | {d[0] for d in docs} | {r.chunk_id.removesuffix("_gop") for r in got.values()}
    assert all(r.parent_chunk_id is None or r.parent_chunk_id in ids for r in got.values())


def test_part_chapter_part_article(spark):
    body = f"[[ANCHOR:p1]] **Phần I {words(10)}** [[ANCHOR:c1]] **Chương I {words(10)}** [[ANCHOR:p2]] **Phần II {words(10)}** [[ANCHOR:d1]] **Điều 1. {words(12)}**"
    got = run(spark, [doc(body)])
    assert got["d_d1"].parent_chunk_id == "d_p2" and got["d_c1"].parent_chunk_id == "d_p1" and got["d_p2"].parent_chunk_id == "d"


def test_short_heading_is_dropped(spark):
    got = run(spark, [doc(f"[[ANCHOR:c1]] **Chương I** [[ANCHOR:d1]] **Điều 1. {words(12)}**")])
    assert "d_c1" not in got and got["d_d1"].parent_chunk_id == "d"


def test_packing_passes_over_preambles(spark):
    art = lambda k, n: f"[[ANCHOR:d{k}]] **Điều {k}. {words(n - 2)}**"
    got = run(spark, [doc(f"{art(1, 300)} [[ANCHOR:x]] {words(20)} {art(2, 400)} {art(3, 200)}")])
    assert got["d_d1_gop"].content.count("Điều") == 2 and "d_d3" in got and got["d_x_p1"].chunk_type == "Preamble"


def test_markers(spark):
    got = run(spark, [doc(f"[[ANCHOR:d1]] **Điều 1. [[AMENDMENT:t1]] {words(12)}**")])["d_d1"]
    assert "[[AMENDMENT:t1]]" in got.content and "[[" not in got.content_embed and (got.anchors, got.amends) == (["d1"], ["t1"])


def test_summary_and_amendments(spark):
    same = ("1", " B ", "sửa NHƯ SAU: “x y”", "/l")
    long = ("2", "B", f"Điều 1 {words(20)}\nĐiều 2 {words(20)}\nKhoản 3 {words(5)}", "/l")
    got = run(spark, [doc("", summary=f"{words(30)}\n\n{words(30)}\n\n{words(5)}", amendments=[same, same, long, ("3", None, None, None)])], limit=50, limit_amendment=39)
    assert got["summary_d_part1"].content == words(30) and got["summary_d_part2"].content == f"{words(30)}\n\n{words(5)}"
    assert got["amend_d_1"].content == f"{t.AMENDMENT_HEAD}\nB\n\n{t.NEW_WORDING}:**\nx y”"
    assert [k for k in sorted(got) if k.startswith("amend_d_2")] == ["amend_d_2_part_1", "amend_d_2_part_2"] and t.CONTINUED in got["amend_d_2_part_2"].content
    assert got["amend_d_3"].bm_title == "" and sum(k.startswith("amend_d_1") for k in got) == 1
    assert got["meta_d"].parent_chunk_id == "d"


def test_nulls_and_nothing(spark):
    docs = [("e", None, None, None, None, None), doc("", key="f"), doc(" \n", key="g")]
    assert sorted(run(spark, docs)) == ["meta_e", "meta_f", "meta_g"]
    assert chunker.chunk_documents(spark.createDataFrame([], DOC)).count() == 0


def test_greedy_bins(spark):
    data = [("a", i, n) for i, n in enumerate([3, 4, 2, 9, 0, 1, None, 5])] + [("b", 0, 100), (None, 1, 1)]
    df = spark.createDataFrame(data, "k string, o int, n int").withColumn("bin", F.lit(9)).withColumn("extra", F.create_map(F.lit("x"), F.lit(1)))
    got = {(r.k, r.o): r.bin for r in greedy_bins(df, ["k"], "o", F.col("n"), 7).collect()}
    assert [got["a", i] for i in range(8)] == [0, 0, 1, 2, 3, 3, 3, 3] and got["b", 0] == got[None, 1] == 0


def count(x):
    """A size by which joined texts are not the sum of their parts."""
    return (len(x) + 6) // 7


def remeasured(parts, limit, sep, first="", later="", shown=str):
    out, held = [], ""
    for part in parts:
        joined = f"{held}{sep}{part}".strip() if held else part
        if held and count(shown((later if out else first) + joined)) > limit:
            out.append(held)
            joined = part
        held = joined
    return [*out, held] if held else out


def test_packing_by_measuring_the_joined_text(spark):
    rng = random.Random(4)
    docs, want = [], {}
    for k in range(25):
        paragraphs = [words(rng.randint(1, 12), rng.choice("abc")) for _ in range(rng.randint(1, 9))]
        tips = [("t", "B", "\n".join(f"Khoản {i} {words(rng.randint(1, 9))}" for i in range(rng.randint(1, 9))), None)]
        docs.append(doc("\n\n".join(paragraphs), summary="\n\n".join(paragraphs[::-1]), amendments=tips, key=f"d{k}"))
        if count(squeeze(docs[-1][4])) >= 5:
            want |= {f"d{k}_seg_0_p{n}": squeeze(x) for n, x in enumerate(remeasured(paragraphs, 40, "\n\n", shown=squeeze), 1)}
        head = f"{t.SUMMARY_HEAD}T\n\n"
        if count(head + docs[-1][3]) > 40:
            want |= {f"summary_d{k}_part{n}": x for n, x in enumerate(remeasured(paragraphs[::-1], 40, "\n\n", head, head), 1)}
        first, later = (f"{t.AMENDMENT_HEAD}\nB\n\n{t.NEW_WORDING}{x}:**\n" for x in ("", t.CONTINUED))
        body = tips[0][2]
        if count(first + body) > 30:
            want |= {f"amend_d{k}_t_part_{n}": (later if n > 1 else first) + x for n, x in enumerate(remeasured(body.split("\n"), 30, "\n", first, later), 1)}
    got = run(spark, docs, limit=40, limit_amendment=30, least=5, count=lambda x: (len(x) + 6) // 7)
    made = {k: r.content for k, r in got.items() if "_p" in k}
    assert made == want and len(want) > 25


def test_every_chunk_has_its_document(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([doc(random_body(rng), title="*T* k", summary=words(90), amendments=[(None, "B", "x", None)] * 2 + [(None, "C", "y", None)], key=f"d{k}") for k in range(6)], DOC).withColumn("source_url", F.concat(F.lit("u/"), "doc_id"))
    rows = chunker.chunk_documents(docs, 30, 40, 5).collect()
    assert all((r.title, r.source_url, r.metadata) == ("T k", f"u/{r.doc_id}", {"Người ký": "X"}) for r in rows)
    for key in {r.doc_id for r in rows}:
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.ord)
        assert [r.ord for r in own] == list(range(len(own))) and own[0].chunk_type == "Document_Meta"
        assert [r.chunk_id for r in own][-2:] == [f"amend_{key}_unknown_0", f"amend_{key}_unknown_1"]  # numbered once duplicates are gone
        assert [r.chunk_type == "Summary_Split" or r.chunk_type == "Summary" for r in own].index(True) == 1
