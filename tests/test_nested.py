import json

from lawstrata.operators.nested import flatten, flatten_records, read_json, routed_tables, state_of, subtype_tables


CHILD = {"metadata_entry": "metadata", "metadata_field": "metadata", "amendment": "amendment", "title": "bm_title"}


def cases(doc):
    rows = flatten(1, doc if isinstance(doc, str) else json.dumps(doc))
    return {(CHILD[r[3]], r[5], r[6]) for r in rows if r[3] in CHILD and (r[3] != "amendment" or r[6])}


def test_metadata_shapes():
    want = {("metadata", "", "Người ký"), ("metadata", "Người ký", "họ tên"), ("metadata", "", "Số")}
    flat = {"Người ký : ": {"họ tên": "A", "chức vụ": None, "x": " "}, "Số:": 7, "Nơi": " ", "Ngày": None, "L": [], "M": [None, ""]}
    assert cases({"metadata": flat}) == want
    assert cases({"metadata": json.dumps(flat)}) == want
    assert cases({"metadata": [[k, v] for k, v in flat.items()]}) == want
    assert cases({"metadata": [{"key": k, "value": v} for k, v in flat.items()]}) == want
    assert cases({"metadata": [dict(list(flat.items())[:2]), dict(list(flat.items())[2:])]}) == want
    assert cases({"metadata": None}) == cases({}) == set()


def test_amendment_shapes():
    inner = {"tip_id": 3, "bm_title": ["T3", None, " "]}
    want = {("amendment", "", "1"), ("bm_title", "1", "T1"), ("amendment", "1", "3"), ("bm_title", "3", "T3")}
    for child in ([inner], inner, [[], [inner]], [None, inner], {"3": {"bm_title": "T3"}}, json.dumps([inner])):
        for name in ("amendments", "children"):
            assert cases({"amendments": [{"tip_id": " 1", "bm_title": "T1 ", name: child}]}) == want
    deep = {"phu_luc": {"so": 1, "noi_dung": {"amendments": inner}}, "tip_id": "1", "bm_title": "T1"}
    assert cases({"amendments": deep}) == want
    assert cases({"amendments": {"1": {"bm_title": "T1", "children": inner}}}) == want


def test_amendments_without_tip():
    doc = {"amendments": [{"tip_id": None, "bm_title": "A", "amendments": [{"tip_id": "2"}]}, {}, None, "", {"bm_title": " "}]}
    assert cases(doc) == {("bm_title", "", "A"), ("amendment", "", "2")}


def test_states():
    assert [state_of(x) for x in (None, " ", "a", 1, [], [None], ["a"], [["k", "v"]], {"key": 1, "value": 2}, {"a": "b"}, {"tip_id": 1}, {"9": {"bm_title": "x"}}, [[{"tip_id": 1}]], '{"a": 1}')] == [
        "blank", "blank", "scalar", "scalar", "blank", "blank", "texts", "entries", "entry", "fields", "record", "filed", "records", "fields",
    ]


def test_broken_deep_and_long():
    for body, why in (('{"metadata": {"a": ', "not whole JSON"), (None, "null"), ("", "not whole JSON"), ("[1] x", "not whole JSON")):
        assert [r[3:5] for r in flatten(1, body)] == [("unreadable", why)]
    deep = {"tip_id": "0"}
    for k in range(1, 400):
        deep = {"tip_id": str(k), "amendments": [deep]}
    rows = flatten(1, json.dumps({"amendments": [deep]}))
    assert sum(r[3] == "amendment" for r in rows) == 400
    long = {"amendments": [{"tip_id": str(k), "bm_title": "x" * 1000} for k in range(3000)]}
    assert len(flatten(1, json.dumps(long))) == 6001


def test_links_and_subtypes(spark):
    body = json.dumps({"metadata": {"Người ký": {"họ tên": "A"}}, "amendments": [{"tip_id": "1", "bm_title": "T", "amended_content": "c", "children": {"2": {"bm_title": ["U"]}}}]})
    df = spark.createDataFrame([(1, body, "x"), (None, body, "x"), (2, "{", "x"), (3, None, "x"), (1, body, "x")], "rid bigint, b string, child string")
    rows = flatten_records(df, "rid", "b").cache()
    assert rows.where("record_id is null").count() * 2 == rows.where("record_id = 1").count()
    one = {(r.node_id): r for r in rows.where("record_id is null").collect()}
    for r in one.values():
        assert r.parent_node_id is None or one[r.parent_node_id].node_id < r.node_id
    parts = {k: v.count() for k, v in subtype_tables(rows.where("record_id is null")).items()}
    assert parts == {"record": 1, "metadata_entry": 1, "metadata_field": 1, "amendment": 2, "title": 2, "unreadable": 0}
    routed = routed_tables(df, "rid", "b")
    assert {k: v.count() for k, v in routed.items()} == {"record": 3, "metadata_entry": 3, "metadata_field": 3, "amendment": 6, "title": 6, "unreadable": 2}
    assert [r.variant for r in routed["unreadable"].orderBy("record_id").collect()] == ["not whole JSON", "null"]
    assert flatten_records(df.limit(0), "rid", "b").count() == 0


def test_deep_values():
    for n in (3_000, 60_000):
        deep = '{"a": ' * n + "1" + "}" * n
        lists = "[" * n + '"t"' + "]" * n
        body = f'{{"metadata": {{"x": {deep}, "y": "z"}}, "amendments": [{{"tip_id": "1", "bm_title": {lists}}}]}}'
        assert cases(body) >= {("metadata", "", "x"), ("metadata", "", "y"), ("bm_title", "1", "t"), ("amendment", "", "1")}
        assert len(flatten(2, deep)) == 1 and flatten(3, f'{{"metadata": {lists}}}')
        chain = '{"tip_id": "k", "amendments": [' * n + "]}" * n
        assert sum(r[3] == "amendment" for r in flatten(4, f'{{"amendments": {chain}}}')) == n
        assert [r[3] for r in flatten(5, "[" * n)] == ["unreadable"]


def test_reader_of_deep_json():
    n = 60_000
    for text in ('"a\\u0041\\n"', "-1.5e3", "0", "12", "true", "false", "null", "{}", "[]", '{"a": [1, {"b": null}], "c": ""}', '[[], {}, "x"]', " [1 , 2 ] "):
        value = read_json("[" * n + text + "]" * n)
        for _ in range(n):
            (value,) = value
        assert value == json.loads(text)
    for bad in ("", "x", "1 2", "[1,]", '{"a"}', '{"a": }', "{1: 2}", '{"a": 1,}', '"a', "01", "[1 2]", "{,}"):
        for text in (bad, "[" * n + bad + "]" * n):
            if bad or text:
                try:
                    value = read_json(text)
                except ValueError:
                    continue
                assert bad == "" and text, text[:20] + "..." + bad
