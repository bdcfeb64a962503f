"""Deeply nested records of uneven shape to related flat tables.

A tree automaton reads every record's JSON tree twice. Bottom-up, each node's state follows from its own
kind, its field names and the states of its children:

    blank    null, an empty or white text, or a container without anything else
    scalar   a text, number or truth value
    texts    an array of scalars
    pair     an array [name, value]
    entry    an object {key, value}
    entries  an array of entries, or of objects that hold named scalars
    fields   an object that holds named values
    record   an object with fields of a record
    filed    an object that files records under their names
    records  an array of records (at any nesting of arrays)

A text that itself is whole JSON takes the state of what it holds. Top-down, a node's state and the route
by which its parent was taken decide its own route (``ROUTES``), and the routes of rows are the subtypes:
each row goes to the typed table of its subtype, and all tables keep the supertype keys record_id, node_id,
parent_node_id. Field names are a parameter (``Shape``). Neither pass, nor the reader, recurses: records may
be of any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawstrata.session import Scratch


@dataclass(frozen=True)
class Shape:
    """Field names of the records: those that only a record has, those that hold records, and those that rows are made of."""

    record_fields: frozenset[str] = frozenset({"tip_id", "bm_title", "amended_content", "original_content", "anchor_text", "amended_link", "links", "phu_luc"})
    containers: frozenset[str] = frozenset({"amendments", "children"})
    metadata: str = "metadata"
    titles: str = "bm_title"
    tip: str = "tip_id"
    content: str = "amended_content"
    entry: frozenset[str] = frozenset({"key", "value"})


LAW = Shape()
ROWS = "record_id bigint, node_id int, parent_node_id int, subtype string, variant string, parent_key string, child_key string, content string"
SUBTYPES = ("record", "metadata_entry", "metadata_field", "amendment", "title", "unreadable")

_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?")
_WHITE = re.compile(r"[ \t\n\r]*")
_WORDS = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def read_json(text: str) -> Any:
    """``json.loads`` for values of any depth; ValueError for anything but whole JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    at = _WHITE.match(text, 0).end()
    open_: list[tuple[Any, str | None]] = []  # container, the key its next value goes to
    while True:
        c = text[at : at + 1]
        if c and c in "{[":
            box: Any = {} if c == "{" else []
            at = _WHITE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key = None
                if c == "{":
                    key, at = _key(text, at)
                open_.append((box, key))
                continue
            value, at = box, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1)
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            m = None if word else _NUMBER.match(text, at)
            if word is None and not m:
                raise ValueError(f"no value at {at}")
            value = _WORDS[word] if word else float(m[0]) if m[2] or m[3] else int(m[0])
            at += len(word) if word else len(m[0])
        while True:
            at = _WHITE.match(text, at).end()
            if not open_:
                if at != len(text):
                    raise ValueError(f"more at {at}")
                return value
            box, key = open_.pop()
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = _WHITE.match(text, at).end()
                if isinstance(box, dict):
                    key, at = _key(text, at)
                open_.append((box, key))
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"no end at {at}")
            value = box


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    key, at = scanstring(text, at + 1)
    at = _WHITE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no value at {at}")
    return key, _WHITE.match(text, at + 1).end()


def opened(value: Any) -> Any:
    """What a text of whole JSON holds; any other value as it is."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return read_json(value)
        except ValueError:
            return value
    return value


def text_of(value: Any) -> str:
    """A scalar as trimmed text; '' for null and anything that is no scalar."""
    if value is None or isinstance(value, dict | list):
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value).strip()


def entry_name(name: Any) -> str:
    name = text_of(name)
    return name[:-1].rstrip() if name.endswith(":") else name


@dataclass
class Nodes:
    """A record's tree in order, parents before children; ``raw`` is a value before it was opened."""

    value: list[Any] = field(default_factory=list)
    raw: list[Any] = field(default_factory=list)
    label: list[str | None] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    state: list[str] = field(default_factory=list)


def states(root: Any, shape: Shape = LAW) -> Nodes:
    """The tree and the automaton's state of each node, from its children's states."""
    t = Nodes()
    stack: list[tuple[Any, str | None, int]] = [(root, None, -1)]
    while stack:
        raw, label, parent = stack.pop()
        value = opened(raw)
        k = len(t.value)
        t.value.append(value)
        t.raw.append(raw)
        t.label.append(label)
        t.children.append([])
        if parent >= 0:
            t.children[parent].append(k)
        if isinstance(value, dict):
            stack += [(v, n, k) for n, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(v, None, k) for v in reversed(value)]
    t.state = [""] * len(t.value)
    for k in range(len(t.value) - 1, -1, -1):
        t.state[k] = _state(t.value[k], {t.state[c] for c in t.children[k]} - {"blank"}, shape)
    return t


def _state(value: Any, inner: set[str], shape: Shape) -> str:
    if isinstance(value, dict):
        if not shape.record_fields.isdisjoint(value) or not shape.containers.isdisjoint(value):
            return "record"
        if value.keys() == shape.entry:
            return "entry"
        if not inner:
            return "blank"
        return "filed" if inner <= {"record", "records"} else "fields"
    if isinstance(value, list):
        if not inner:
            return "blank"
        if len(value) == 2 and isinstance(value[0], str):
            return "pair"
        if inner <= {"record", "records", "filed"}:
            return "records"
        if inner <= {"entry", "entries", "fields", "pair"}:
            return "entries"
        return "texts" if inner == {"scalar"} else "fields"
    return "scalar" if text_of(value) else "blank"


def state_of(value: Any) -> str:
    return states(value).state[0]


#: Top-down transitions: by route and state, (what the node is, the route of its children). Within a record or a
#: document some fields have routes of their own (``_field_route``). States that are not named take '*'.
ROUTES = {
    ("document", "*"): ("record", "search"),
    # looking for what holds records, below fields of any name
    ("search", "*"): (None, "search"),
    # what a field of records holds: arrays of them, objects that file them under names, or one of them
    ("hold", "record"): ("amendment", "search"), ("hold", "records"): (None, "hold"), ("hold", "texts"): (None, "hold"), ("hold", "entries"): (None, "hold"), ("hold", "pair"): (None, "hold"),
    ("hold", "filed"): (None, "member"), ("hold", "fields"): (None, "member"), ("hold", "entry"): (None, "member"), ("hold", "blank"): (None, "member"), ("hold", "scalar"): (None, "stop"),
    # what is filed under a name is a record, or an array of records of that name
    ("member", "scalar"): (None, "stop"), ("member", "*"): ("amendment", "search"),
    ("titles", "scalar"): ("title", "stop"), ("titles", "*"): (None, "titles"),
    # metadata: arrays of arrays of entries, pairs, or objects of named values
    ("metadata", "entry"): ("metadata_entry", "stop"), ("metadata", "scalar"): (None, "stop"), ("metadata", "*"): (None, "metadata"),
    ("named", "blank"): (None, "stop"), ("named", "*"): ("metadata_entry", "named_field"),
    ("named_field", "blank"): (None, "stop"), ("named_field", "*"): ("metadata_field", "stop"),
    ("stop", "*"): (None, "stop"),
}


def flatten(record_id: int | None, body: str | None, shape: Shape = LAW) -> list[tuple]:
    """ROWS of one record; an ``unreadable`` row if the body is null or not whole JSON."""
    rows: list[tuple] = []

    def add(parent: int | None, subtype: str, variant: str, parent_key: str, child_key: str, content: str | None = None) -> int:
        rows.append((record_id, len(rows), parent, subtype, variant, parent_key, child_key, content))
        return len(rows) - 1

    try:
        doc = None if body is None else read_json(body)
    except ValueError:
        add(None, "unreadable", "not whole JSON", "", str(record_id))
        return rows
    if body is None:
        add(None, "unreadable", "null", "", str(record_id))
        return rows
    t = states(doc, shape)
    # (node, route, name it is filed under, parent's row, key of the nearest record or entry)
    stack: list[tuple[int, str, str, int | None, str]] = [(0, "document", "", None, "")]
    while stack:
        k, route, name, row, key = stack.pop()
        value, state, own = t.value[k], t.state[k], t.children[k]
        box = isinstance(value, dict | list)
        if isinstance(value, list) and route in ("hold", "member"):
            stack += [(c, route, name, row, key) for c in reversed(own)]
            continue
        subtype, onward = ROUTES.get((route, state)) or ROUTES[route, "*"]
        if route == "metadata" and box:
            stack += reversed(_entries(t, k, row, shape))
            continue
        if not box and subtype in ("amendment", "record") and route != "document":
            continue
        here, tip = row, key
        if subtype == "record":
            here = add(None, "record", state, "", str(record_id))
        elif subtype == "amendment":
            held = text_of(value.get(shape.tip))
            tip = held or name.strip()
            here = add(row, "amendment", "record" if held or not tip else "filed", key, tip, text_of(value.get(shape.content)) or None)
        elif subtype == "title":
            add(row, "title", name, key, text_of(value))
        elif subtype == "metadata_entry":
            here, tip = add(row, "metadata_entry", key, "", name, text_of(value) or None), name
            if not isinstance(value, dict):
                continue
        elif subtype == "metadata_field":
            add(row, "metadata_field", "fields", key, name, text_of(value) or None)
        if onward == "stop":
            continue
        for c in reversed(own):
            label = t.label[c]
            to = onward
            if onward == "search" and label is not None:
                to = _field_route(label, subtype, shape)
            under = name if onward == "titles" else label if onward == "member" else entry_name(label) if onward == "named_field" else ""
            if to == "titles" and onward == "search":
                under = "texts" if isinstance(t.value[c], list) else "scalar"
            stack.append((c, to, under, here, tip))
    return rows


def _field_route(label: str, within: str | None, shape: Shape) -> str:
    """The route of a field of a document, of a record, or of an object below them."""
    if label in shape.containers:
        return "hold"
    if label == shape.metadata and within in ("record", "amendment"):
        return "metadata" if within == "record" else "stop"
    return "titles" if label == shape.titles and within == "amendment" else "search"


def _entries(t: Nodes, k: int, row: int | None, shape: Shape) -> list[tuple[int, str, str, int | None, str]]:
    """The places from a container of metadata onward; of its own entries the key carries the variant."""
    value, own = t.value[k], t.children[k]
    if isinstance(value, dict):
        if t.state[k] == "entry" or value.keys() == shape.entry:
            at = {t.label[c]: c for c in own}
            return [(at["value"], "named", entry_name(value["key"]), row, "entry")]
        return [(c, "named", entry_name(t.label[c]), row, "fields") for c in own]
    out: list[tuple[int, str, str, int | None, str]] = []
    for c in own:
        raw = t.raw[c]
        if isinstance(raw, list) and len(raw) == 2 and isinstance(raw[0], str):
            out.append((t.children[c][1], "named", entry_name(raw[0]), row, "pair"))
        else:
            out.append((c, "metadata", "", row, ""))
    return out


def flatten_records(df: DataFrame, id_col: str, body_col: str, shape: Shape = LAW) -> DataFrame:
    """ROWS: one row for each record, metadata entry and field, amendment and title, with links to the parent's row.

    * A body that is null, or not whole JSON, gives an ``unreadable`` row. Repeated records give repeated rows.
    * Metadata entries with a null or blank value give no row; a list counts as blank if all of it is.
    * An amendment without a tip keeps its row, so that the tree is whole; its key is ''.
    * ``parent_key`` is the key of the nearest enclosing amendment, or ''.
    * A null id is kept as null. Other columns of ``df`` are ignored, whatever their names.
    """
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [r for i, b in zip(pdf["i"], pdf["b"], strict=True) for r in flatten(None if pd.isna(i) else int(i), b, shape)]
            pdf = pd.DataFrame(out, columns=names)
            yield pdf.astype({"record_id": "Int64", "node_id": "int32", "parent_node_id": "Int32"})

    return df.select(F.col(id_col).cast("bigint").alias("i"), F.col(body_col).alias("b")).mapInPandas(run, ROWS)


def subtype_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The typed tables of ``flatten_records``, by subtype; each keeps record_id, node_id and parent_node_id."""
    keys = ["record_id", "node_id", "parent_node_id"]
    part = lambda subtype: rows.where(F.col("subtype") == subtype)
    none = lambda c: F.nullif(c, F.lit(""))
    return {
        "record": part("record").select(*keys, "variant"),
        "metadata_entry": part("metadata_entry").select(*keys, "variant", F.col("child_key").alias("name"), F.col("content").alias("value")),
        "metadata_field": part("metadata_field").select(*keys, F.col("parent_key").alias("entry"), F.col("child_key").alias("name"), F.col("content").alias("value")),
        "amendment": part("amendment").select(*keys, "variant", none("child_key").alias("tip_id"), none("parent_key").alias("within_tip"), F.col("content").alias("amended_content")),
        "title": part("title").select(*keys, "variant", none("parent_key").alias("tip_id"), F.col("child_key").alias("bm_title")),
        "unreadable": part("unreadable").select(*keys, "variant"),
    }


def routed_tables(df: DataFrame, id_col: str, body_col: str, shape: Shape = LAW) -> dict[str, DataFrame]:
    """The typed tables of ``df``, written once in a folder for each subtype, so that each is read by itself."""
    rows = Scratch(df.sparkSession, "nested").cut(flatten_records(df, id_col, body_col, shape), "rows", by="subtype")
    return subtype_tables(rows)
