"""Line and text predicates, all plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that section headings carry, by kind, in the order in which they are tried.
SECTION_KINDS = [
    ("abstract", r"^(abstract|summary|概要|要旨|zusammenfassung)$"),
    ("introduction", r"^(introduction|はじめに|序論|einleitung)$"),
    ("related_work", r"^(related work|background|関連研究|verwandte arbeiten)"),
    ("method", r"^(methods?|methodology|apparatus|approach|方法|手法|装置|methoden?|aufbau)"),
    ("results", r"^(results?|findings|evaluation|結果|評価|ergebnisse)"),
    ("discussion", r"^(discussion|考察|議論|diskussion|limitations?|限界|grenzen)"),
    ("conclusion", r"^(conclusions?|結論|まとめ|おわりに|fazit|schluss)"),
    ("references", r"^(references|bibliography|参考文献|literatur)"),
]


def plain_heading(c: Column) -> Column:
    """A heading without its number."""
    return F.trim(F.regexp_replace(F.trim(c), r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s+", ""))


def section_kind(c: Column) -> Column:
    """The first kind whose names match, else other."""
    h = F.lower(plain_heading(c))
    out = F.lit("other")
    for kind, pattern in reversed(SECTION_KINDS):
        out = F.when(h.rlike(pattern), kind).otherwise(out)
    return F.when(c.isNotNull(), out)


def figure_caption(c: Column) -> Column:
    return c.rlike(r"^\s*(?:(?:Figure|Fig\.|Abb\.|Abbildung)\s*\d+[.:]?\s|図\s*\d+)")


def table_caption(c: Column) -> Column:
    return c.rlike(r"^\s*(?:(?:Table|Tab\.|Tabelle)\s*\d+[.:]\s|表\s*\d+[.:：　\s])")


def caption_label(c: Column) -> Column:
    """The label of a caption (``Figure 3``), null for other text."""
    x = F.regexp_extract(c, r"^\s*((?:Figure|Fig\.|Abb\.|Table|Tab\.|Tabelle|図|表)\s*\d+)", 1)
    return F.when(x != "", x)


def caption_body(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\s*(?:Figure|Fig\.|Abb\.|Table|Tab\.|Tabelle|図|表)\s*\d+[.:：　\s]*", ""))


def url_like(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*(https?://|www\.)\S+\s*$")


def email_like(c: Column) -> Column:
    return c.rlike(r"^\s*[\w.+-]+@[\w-]+(\.[\w-]+)+\s*$")


def person_name(c: Column) -> Column:
    """Two to four capitalised words or initials, no figures."""
    return c.rlike(r"^\s*(?:\p{Lu}\.|\p{Lu}[\p{L}'’-]+)(?:\s+(?:\p{Lu}\.|\p{Lu}[\p{L}'’-]+)){1,3}\s*$")


def equation_like(c: Column) -> Column:
    """Mathematical signs without the words of a sentence."""
    signs = F.length(c) - F.length(F.regexp_replace(c, r"[=+−×÷∑∫√≤≥≠∈∂±^_]", ""))
    return (signs >= 2) & (F.size(F.split(F.trim(c), r"\s+")) <= 14) & ~c.rlike(r"(?i)\b(the|and|of|was|were|with|is|that)\b|[p-t] [<=>]")


def copyright_like(c: Column) -> Column:
    return c.rlike(r"(?i)©|copyright|permission to make digital|all rights reserved")


def bibliography_like(c: Column) -> Column:
    """Authors with initials, a year in brackets, pages or a volume."""
    return c.rlike(r"^\s*(?:\[\d+\]\s*)?\p{Lu}[\p{L}'’-]+, (?:\p{Lu}\.[ ,&]*)+.*\((?:18|19|20)\d{2}[a-z]?\)") & c.rlike(r"\d+[–-]\d+|\d+\(\d+\)|pp?\. \d+")


def numbered_heading(c: Column) -> Column:
    return c.rlike(r"^\s*\d+(?:\.\d+)*\.?\s+\p{L}[^.!?。]{0,60}$")


def named_heading(c: Column) -> Column:
    return section_kind(c) != "other"


def line_role(text: Column, font: Column, body_font: Column) -> Column:
    """Ordered classification of a line."""
    return (
        F.when(F.trim(text) == "", "blank").when(copyright_like(text), "copyright").when(figure_caption(text), "figure_caption").when(table_caption(text), "table_caption")
        .when(url_like(text) | email_like(text), "link").when(named_heading(text) | (numbered_heading(text) & (F.length(text) < 60)), "heading").when(bibliography_like(text), "reference")
        .when(equation_like(text), "equation").when(text.rlike(r"^[\d.,%\s-]+$"), "number").when(font > body_font * 1.3, "title").when(font < body_font * 0.82, "footnote").otherwise("body")
    )
