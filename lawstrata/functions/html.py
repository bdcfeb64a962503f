"""Pages of HTML to document fields: one lenient parser, applied to Arrow batches.

Each page is parsed once; what needs a tree (positions, nesting, attributes) is taken there, the
rest is left to built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Marks of boilerplate and of session pages in the pages' language.
STATE_HEAD, STATE_MOTTO, RECEIVERS = "CỘNG HÒA", "ĐỘC LẬP", "NƠI NHẬN:"
JUNK_SPANS = ("VABW", "LdAB")
DIAGRAM_SELF, DIAGRAM_OTHER = "Văn bản đang xem", "Khác"
TIP_PREFIX, TIP_BODY = ".lqhlTootip-", "lqhlTip-"
#: The classes, ids and styles by which the pages mark their parts.
MAIN_TAB, DIAGRAM_TAB, VALIDITY_TAB, CONTENT_TAB, TAB_CLASS = "tab-1", "tab4", "tab5", "tab6", "contentDoc"
TOC_LIST, TOC_LINK, BODY, SUMMARY, TIP_ATTRIBUTE, TIPS = "muclucVB", "amuclucvb", "content1", "Tomtatvanban", "atmm", "divltrLienQuanHieuLucTungPhan"
TIP_TITLE, TIP_ORIGINAL, TIP_TEXT = "bmTitle", "bmContentOld", "bmContent"
RELATED_CLASS, RELATED_NUMBER, RELATED_TITLE, RELATED_SIDE = "content-", "number", "nqTitle", "right-col"
DIAGRAM_SECTION, DIAGRAM_HEADING, DIAGRAM_ENTRY, DIAGRAM_TIP, DIAGRAM_TITLE_STYLE, DIAGRAM_ROW_STYLE = "ct", "ghd", "dgc", "clsTooltip-", "background-color: #FFFBF4", "float:left"


class Node:
    """An element, or a text when ``name`` is empty."""

    __slots__ = ("name", "attrs", "children", "parent", "text")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None, text: str = ""):
        self.name, self.attrs, self.parent, self.text = name, attrs, parent, text
        self.children: list[Node] = []

    def walk(self) -> Iterator[Node]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            yield x
            stack.extend(reversed(x.children))

    def find(self, name: str | None = None, **attrs: str) -> Iterator[Node]:
        """Descendants by name and attributes; ``cls`` is one of the class names, ``cls_prefix`` a beginning of one."""
        for x in self.walk():
            if not x.name or (name and x.name != name):
                continue
            classes = x.attrs.get("class", "").split()
            if "cls" in attrs and attrs["cls"] not in classes:
                continue
            if "cls_prefix" in attrs and not any(c.startswith(attrs["cls_prefix"]) for c in classes):
                continue
            if all(x.attrs.get(k) == v for k, v in attrs.items() if k not in ("cls", "cls_prefix")):
                yield x

    def first(self, name: str | None = None, **attrs: str) -> Node | None:
        return next(self.find(name, **attrs), None)

    def strings(self) -> Iterator[str]:
        """The texts below, trimmed, without empty ones and without scripts."""
        for x in self.walk():
            if not x.name and x.parent.name not in ("script", "style") and (text := x.text.strip()):
                yield text

    def text_of(self, between: str = "") -> str:
        return between.join(self.strings())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "p": ("p",)}.get(tag, ())
        while self.at.name in closes:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x is not None and x.name != tag:
            x = x.parent
        if x is not None and x.parent is not None:  # an end tag without a start is ignored
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(Node("", {}, self.at, data))


def parse_html(page: str | None) -> Node:
    builder = _Builder()
    if page:
        builder.feed(page)
        builder.close()
    return builder.root


# ---- Markdown ---------------------------------------------------------------------------------

_BLOCKS = frozenset("p div section article table tr ul ol blockquote pre header footer main".split())


def to_markdown(node: Node) -> str:
    """Headings with hashes, bold with two stars, italics with one; other elements keep their text. Of any depth."""
    frames: list[tuple[Node, int, bool, list[str]]] = [(node, 0, False, [])]
    while True:
        x, k, pre, out = frames.pop()
        if k < len(x.children):
            frames.append((x, k + 1, pre, out))
            child = x.children[k]
            if not child.name:
                out.append(child.text if pre else re.sub(r"\s+", " ", child.text))
            else:
                frames.append((child, 0, pre or child.name in ("pre", "code"), []))
        elif frames:
            frames[-1][3].append(_as_markdown(x.name, "".join(out), pre))
        else:
            return "".join(out)


def _as_markdown(name: str, text: str, pre: bool) -> str:
    if name in ("script", "style"):
        return ""
    if name == "br":
        return "\n"
    if name in ("b", "strong", "i", "em"):
        mark = "**" if name in ("b", "strong") else "*"
        bare = text.strip()
        return f"{' ' if text[:1].isspace() else ''}{mark}{bare}{mark}{' ' if text[-1:].isspace() else ''}" if bare else text
    if re.fullmatch(r"h[1-6]", name):
        return f"\n\n{'#' * int(name[1])} {text.strip()}\n\n"
    if name == "li":
        return f"\n* {text.strip()}"
    if name in ("td", "th"):
        return f" {text.strip()} |"
    return f"\n\n{text if pre else text.strip()}\n\n" if name in _BLOCKS else text


#: A heading or an article in bold that its title follows in bold, and beginnings of encoded junk.
JOINED_HEADING = re.compile(r"(\*\*(?:Chương|Phần|Mục|Phụ lục)\s+[A-Za-z0-9IVX]+)\*\*\s+\*\*", re.I)
JOINED_ARTICLE = re.compile(r"(\*\*Điều\s+\d+\.?)\*\*\s+\*\*", re.I)
JUNK_TOKENS = re.compile(r"(?:VABWAFAATABf|LdABoAHUAdgBp)[A-Za-z0-9+/=]+")


def squeeze(markdown: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", markdown)).strip()


def finish(markdown: str) -> str:
    """Joins headings with their titles, drops junk, squeezes empty lines."""
    x = JOINED_HEADING.sub(r"\1 - ", markdown.replace("\\_", "_"))
    return squeeze(JUNK_TOKENS.sub("", JOINED_ARTICLE.sub(r"\1 ", x)))


# ---- the parts of a page ----------------------------------------------------------------------


def table_of_contents(root: Node) -> list[dict]:
    ul = root.first("ul", cls=TOC_LIST)
    links = [li.first("a", cls=TOC_LINK) for li in ul.find("li")] if ul else []
    return [{"title": a.text_of(), "href": a.attrs.get("href")} for a in links if a]


def main_text(root: Node, toc: list[dict]) -> str:
    """Body as Markdown with a marker before each target of the contents and each amendment's first link."""
    body = root.first("div", cls=BODY)
    if body is None:
        return ""
    junk = [x for x in body.find("span") if x.text_of().startswith(JUNK_SPANS)]
    for x in body.find("table"):
        upper = x.text_of(" ").upper()
        if (STATE_HEAD in upper and STATE_MOTTO in upper) or RECEIVERS in upper:
            junk.append(x)
    for x in junk:
        _remove(x)
    by_name: dict[str, Node] = {}
    by_id: dict[str, Node] = {}
    links = []
    for x in body.walk():
        if x.name:
            by_name.setdefault(x.attrs.get("name", ""), x)
            by_id.setdefault(x.attrs.get("id", ""), x)
            if x.name == "a":
                links.append(x)
    before: dict[int, tuple[Node, list[str]]] = {}  # by element, what stands before it
    for entry in toc:
        if entry["href"] and entry["href"].startswith("#") and (key := entry["href"].replace("#", "")):
            target = by_name.get(key) or by_id.get(key)
            if target is not None:
                before.setdefault(id(target), (target, []))[1].append(f"[[ANCHOR:{key}]]")
    seen: set[str] = set()
    for a in links:
        tip = a.attrs.get(TIP_ATTRIBUTE, "")
        if tip.startswith(TIP_PREFIX) and (tip := tip.replace(TIP_PREFIX, "")) not in seen:
            seen.add(tip)
            before.setdefault(id(a), (a, []))[1].append(f"[[AMENDMENT:{tip}]]")
    parents: dict[int, Node] = {id(x.parent): x.parent for x, _ in before.values()}
    for parent in parents.values():
        children = []
        for x in parent.children:
            children += [Node("", {}, parent, f" {mark} ") for mark in before.get(id(x), (x, ()))[1]]
            children.append(x)
        parent.children = children
    return finish(to_markdown(body))


def _remove(node: Node) -> None:
    node.parent.children = [x for x in node.parent.children if x is not node]


def metadata_pairs(tab: Node | None) -> list[dict]:
    """Of the first table of the main tab: key in bold, value in the next cell; pairs with an empty side are left out."""
    table = tab.first("table") if tab else None
    out = []
    for row in table.find("tr") if table else ():
        cells = list(row.find("td"))
        for cell, value in zip(cells, cells[1:], strict=False):
            bold = cell.first("b")
            if bold is not None and (key := bold.text_of().replace(":", "")) and (text := value.text_of()):
                out.append({"key": key, "value": text})
    return out


def amendments(root: Node, base: str) -> list[dict]:
    """Tooltip bodies left-joined with the text of the last link of each tip; the first link of a body is cut out of its text."""
    texts = {}
    body = root.first("div", cls=BODY)
    for a in body.find("a") if body else ():
        tip = a.attrs.get(TIP_ATTRIBUTE, "")
        if tip.startswith(TIP_PREFIX):
            texts[tip.replace(TIP_PREFIX, "")] = a.text_of()
    holder = root.first("div", id=TIPS)
    out = []
    for tip in holder.find("div", cls_prefix=TIP_BODY) if holder else ():
        key = tip.attrs["class"].split()[0].replace(TIP_BODY, "")
        title, original, new = (tip.first("div", id=x) for x in (TIP_TITLE, TIP_ORIGINAL, TIP_TEXT))
        link = next((a for a in new.find("a") if "href" in a.attrs), None) if new else None
        href = ""
        if link is not None:
            href = link.attrs["href"]
            _remove(link)
        out.append({
            "tip_id": key, "anchor_text": texts.get(key, ""), "bm_title": title.text_of() if title else "", "original_content": original.text_of("\n") if original else "",
            "amended_content": new.text_of("\n") if new else "", "amended_link": base + href if href.startswith("/") else href,
        })
    return out


def _pairs(found: dict[str, str]) -> list[dict]:
    return [{"key": k, "value": v} for k, v in found.items()]


def related(root: Node, tab: str) -> list[dict]:
    """Related documents of a tab; the first span of a paragraph is its key, every occurrence of which is cut from the value."""
    holder = root.first("div", id=tab, cls=TAB_CLASS)
    out = []
    for div in holder.find("div", cls_prefix=RELATED_CLASS) if holder else ():
        number, title, side = div.first("div", cls=RELATED_NUMBER), div.first("p", cls=RELATED_TITLE), div.first("div", cls=RELATED_SIDE)
        link = title.first("a") if title else None
        attributes: dict[str, str] = {}
        for p in side.find("p") if side else ():
            span = p.first("span")
            if span is not None:
                name = span.text_of()
                key, value = name.replace(":", ""), (p.text_of().replace(name, "") if name else p.text_of()).strip()
                if key and value:
                    attributes[key] = value
        out.append({
            "number": number.text_of() if number else None, "lawid": title.attrs.get("lawid") if title else None, "title": link.text_of() if link else None,
            "href": link.attrs.get("href") if link else None, "attributes": _pairs(attributes),
        })
    return out


def diagram(root: Node) -> list[dict]:
    """Relation diagram: entries by the nearest heading before them; a repeated category is replaced by its later section."""
    sections: dict[str, list[dict]] = {}
    tab = root.first("div", id=DIAGRAM_TAB, cls=TAB_CLASS)
    headings: dict[int, dict[int, str]] = {}  # by parent, the heading in force at each section
    for section in tab.find("div", cls=DIAGRAM_SECTION) if tab else ():
        parent = section.parent
        if id(parent) not in headings:
            now, own = DIAGRAM_OTHER, headings.setdefault(id(parent), {})
            for x in parent.children:
                own[id(x)] = now
                if x.name == "div" and DIAGRAM_HEADING in x.attrs.get("class", "").split():
                    now = x.text_of()
        category = headings[id(parent)][id(section)]
        if category == DIAGRAM_SELF:
            continue
        entries = []
        for entry in section.find("div", cls=DIAGRAM_ENTRY):
            link, tip = entry.first("a"), entry.first("div", cls_prefix=DIAGRAM_TIP)
            styled = lambda style, tip=tip: [x for x in tip.find("div") if style in x.attrs.get("style", "")] if tip else []
            title, rows = styled(DIAGRAM_TITLE_STYLE), styled(DIAGRAM_ROW_STYLE)
            found: dict[str, str] = {}
            for k, v in zip(rows[::2], rows[1::2], strict=False):
                if (key := k.text_of().replace(":", "")) and (value := v.text_of()):
                    found[key] = value
            entries.append({"title": title[0].text_of() if title else None, "href": link.attrs.get("href") if link else None, "metadata": _pairs(found)})
        sections[category] = entries
    return [{"category": k, "documents": v} for k, v in sections.items()]


def page_fields(main: str | None, diagram_page: str | None, validity_page: str | None, content_page: str | None, base: str) -> dict:
    """All fields of a document from its four pages; missing pages give empty fields."""
    root = parse_html(main)
    tab = root.first("div", id=MAIN_TAB, cls=TAB_CLASS)
    h1 = tab.first("h1") if tab else None
    summary = tab.first("div", cls=SUMMARY) if tab else None
    toc, pairs = table_of_contents(root), metadata_pairs(tab)
    body = main_text(root, toc)
    return {
        "title": h1.text_of() if h1 else "", "metadata": pairs, "summary_content": squeeze(to_markdown(summary)) if summary else "", "mucluc": toc, "main_content": body,
        "amendments": amendments(root, base), "lienquan_hieuluc_list": related(parse_html(validity_page), VALIDITY_TAB), "related_noidung_list": related(parse_html(content_page), CONTENT_TAB),
        "luoc_do_list": diagram(parse_html(diagram_page)),
    }
