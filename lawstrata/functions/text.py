"""Scalar text functions: Column in, Column out; all stay on the JVM, but for ``tidy_text`` which Arrow batches use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(col, F.lit(WHITE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def norm_id(col: Column) -> Column:
    """Ids are compared trimmed and in lower case; blank ones count as null."""
    return F.lower(blank_to_null(col))


def tokens(col: Column) -> Column:
    """The default size of a text: its words between white space."""
    return F.when(col.isNotNull(), F.size(F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")))


def strip_emphasis(col: Column) -> Column:
    """``*x*`` to ``x``, leftmost first and across lines; ``**x**`` keeps one pair of stars."""
    return F.regexp_replace(col, r"\*([^*]+)\*", "$1")


def marker_ids(col: Column, kind: str) -> Column:
    """All ids of ``[[kind:id]]`` markers, in order."""
    return F.regexp_extract_all(col, F.lit(rf"\[\[{kind}:([^\]]+)\]\]"), 1)


def drop_markers(col: Column, kind: str) -> Column:
    return strip(F.regexp_replace(col, rf"(?U)\[\[{kind}:[^\]]+\]\]\s*", ""))


def tidy(col: Column) -> Column:
    """Without anchor markers, blanks squeezed, empty lines removed; amendment markers stay."""
    x = strip(F.regexp_replace(drop_markers(col, "ANCHOR"), "[ \t ]+", " "))
    return F.regexp_replace(x, "\n{2,}", "\n")


def tidy_text(text: str) -> str:
    """``tidy`` of a string."""
    x = re.sub(r"\[\[ANCHOR:[^\]]+\]\]\s*", "", text).strip()
    return re.sub(r"\n{2,}", "\n", re.sub("[ \t\xa0]+", " ", x).strip())


def embed_text(col: Column) -> Column:
    return drop_markers(col, "AMENDMENT")


def bare(col: Column) -> Column:
    """Without any ``[[...]]`` marker; the text that headings are told by."""
    return strip(F.regexp_replace(col, r"(?U)(?d)\[\[.*?\]\]\s*", ""))


def url_hash(url: Column) -> Column:
    return F.md5(F.encode(url, "UTF-8"))


def doc_key(url: Column) -> Column:
    """The first 16 hex digits of the URL's hash."""
    return F.substring(url_hash(url), 1, 16)


def point_key(key: Column) -> Column:
    """uuid5 of a key in the DNS namespace, from built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(key, "UTF-8")))
    variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("bigint").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(h, 19, 2)), F.substring(h, 21, 12))


#: The words by which structure is told.
HEADINGS = ("Phần", "Chương", "Mục")
ARTICLE, CLAUSE, LEAD_IN = "Điều", "Khoản", "như sau"


def heading_kind(text: Column, starred: bool = True) -> Column:
    """``Phần``, ``Chương``, ``Mục``, ``Điều`` or ``other`` of a segment without markers. ``starred``: a
    heading must stand in stars, as converted pages have it; else stars may be missing."""
    star, rest = (r"\*", r"\s+[^\*]*\*") if starred else (r"\*?", r"\s")
    kind = F.when(text.rlike(rf"(?U)^{star}{ARTICLE}\s+\d+\."), ARTICLE).otherwise("other")
    for h in reversed(HEADINGS):
        kind = F.when(text.rlike(rf"(?U)^{star}{h}{rest}"), h).otherwise(kind)
    return kind


def split_clauses(col: Column) -> Column:
    """Before every line that starts with a clause number."""
    return F.split(col, rf"(?U)\n(?=(?:{CLAUSE}\s+\d+|\d+\.))")


def split_points(col: Column) -> Column:
    """Before every line that starts with a lettered point; accented letters but ``đ`` do not count."""
    return F.split(col, r"\n(?=[a-zđ]\))")


def split_paragraphs(col: Column) -> Column:
    return F.split(col, r"\n\n+")


def split_new_wording(col: Column) -> Column:
    return F.split(col, rf"(?U)\n(?=(?:Chương|{ARTICLE}|Mục|{CLAUSE})\s)")


def strip_lead_in(col: Column) -> Column:
    """Without what precedes and includes the first lead-in of the first line, and without an opening quote."""
    x = strip(F.regexp_replace(col, rf"(?iuUd)^.*?(?:{LEAD_IN}:|{LEAD_IN})\s*[“\"”]?\s*", ""))
    return strip(F.regexp_replace(x, "^[“\"”]", ""))


#: The metadata card.
CARD_KEYS = ("Loại văn bản", "Nơi ban hành", "Người ký", "Ngày ban hành", "Ngày hiệu lực", "Tình trạng", "Số công báo", "Ngày công báo")
CARD_HEAD, CARD_TITLE, CARD_NONE = "Thông tin chung (Metadata) của văn bản pháp luật:", "Tên văn bản", "Không có thông tin"
DOCUMENT_HEAD, WITHIN_HEAD, SUMMARY_HEAD = "Văn bản: ", "Thuộc: ", "Tóm tắt nội dung văn bản: "
AMENDMENT_HEAD, NEW_WORDING, CONTINUED = "**SỬA ĐỔI, BỔ SUNG**", "**Nội dung mới", " (tiếp theo)"


def metadata_card(title: Column, metadata: Column) -> Column:
    """One line for the title and each key of the card; a missing key has the default, an empty one stays empty."""
    value = lambda k: metadata[k]
    lines = [F.lit(CARD_HEAD), F.concat(F.lit(f"- {CARD_TITLE}: "), title), *(F.concat(F.lit(f"- {k}: "), F.coalesce(value(k), F.lit(CARD_NONE))) for k in CARD_KEYS)]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))
