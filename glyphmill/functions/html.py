"""HTML to document fields, as Columns.

A page is cut into comments, titles, tags and text by one regular expression.
Script and style suppression, which depends on the tags before a text, is worked
out on a string of one letter a segment, so that no page is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TITLE = r"<[tT][iI][tT][lL][eE](?![a-zA-Z0-9])[^>]*>.*?(?:</title>|</TITLE>)"
SEGMENTS = rf"(?s)<!--.*?(?:-->|\z)|{_TITLE}|<[^>]*>|<[^>]*|[^<]+"
#: The entities that are decoded, in an order that makes chained
#: replacement the same as one pass.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
SPACE = r"[ \t\n\x0B\f\r]"


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def segments(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(SEGMENTS), F.lit(0))


def _named(segment: Column, name: str, closing: bool = False) -> Column:
    return segment.rlike(rf"^(?i)<{'/' if closing else ''}{name}(?![a-zA-Z0-9])")


def title(html: Column) -> Column:
    """The last title with an end tag, else the default."""
    found = F.filter(segments(html), lambda s: s.rlike(rf"(?s)^{_TITLE}$"))
    inner = F.regexp_replace(F.regexp_replace(F.element_at(found, -1), r"^<[^>]*>", ""), r"(?i)</title>$", "")
    return F.when(F.size(found) > 0, trim_space(decode_entities(inner))).otherwise("Untitled Document")


def tags(html: Column) -> Column:
    """All complete tags outside comments and titles, in order."""
    return F.filter(segments(html), lambda s: s.startswith("<") & s.endswith(">") & ~s.startswith("<!--") & ~s.rlike(rf"(?s)^{_TITLE}$"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, decoded and trimmed; null if it is absent."""
    pattern = rf"""{SPACE}{name}{SPACE}*={SPACE}*(?:"([^"]*)"|'([^']*)'|([^ \t\n\x0B\f\r>"'][^ \t\n\x0B\f\r>]*))"""
    return F.when(tag.rlike(pattern), trim_space(decode_entities(F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3))))))


def metas(html: Column, name: str) -> Column:
    """The contents of the meta tags of a name, in order."""
    own = F.filter(tags(html), lambda t: _named(t, "meta") & (F.lower(attribute(t, "name")) == name))
    return F.filter(F.transform(own, lambda t: attribute(t, "content")), lambda c: c.isNotNull())


def meta(html: Column, name: str, default: str) -> Column:
    found = metas(html, name)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(default)


def keywords(html: Column) -> Column:
    parts = F.flatten(F.transform(metas(html, "keywords"), lambda c: F.split(c, ",")))
    return F.filter(F.transform(parts, trim_space), lambda k: k != "")


def headings(html: Column) -> Column:
    """Inner HTML of every h0 to h9 up to its own end tag, decoded and trimmed."""
    bare = F.array_join(F.filter(segments(html), lambda s: ~s.startswith("<!--") & ~s.rlike(rf"(?s)^{_TITLE}$")), "")
    found = F.regexp_extract_all(bare, F.lit(r"(?s)<([hH][0-9][a-zA-Z0-9]*)[^>]*>(?=(.*?)</\1>)"), F.lit(2))
    return F.filter(F.transform(found, lambda h: trim_space(decode_entities(h))), lambda h: h != "")


def links(html: Column) -> Column:
    own = F.filter(tags(html), lambda t: _named(t, "a"))
    return F.filter(F.transform(own, lambda t: attribute(t, "href")), lambda h: h.isNotNull())


def body_text(html: Column) -> Column:
    """Text outside tags, comments, title, script and style; white space runs are
    one space, and nothing is inserted at tags."""
    parts = segments(html)

    def letter(s: Column) -> Column:
        return (
            F.when(~s.startswith("<"), "t")
            .when(s.startswith("<!--") | ~s.endswith(">"), "x")
            .when(_named(s, "script"), "s").when(_named(s, "script", True), "S")
            .when(_named(s, "style"), "y").when(_named(s, "style", True), "Y")
            .otherwise("x")
        )

    codes = F.array_join(F.transform(parts, letter), "")
    # texts after an opening tag, up to the closing one, lose their letter
    for opened, closed in ("sS", "yY"):
        codes = F.regexp_replace(codes, rf"({opened}|(?!^)\G)([^t{closed}]*)t", "$1$2x")
    kept = F.zip_with(parts, F.split(codes, ""), lambda s, c: F.when(c == "t", s).otherwise(""))
    spaced = F.regexp_replace(F.array_join(kept, ""), f"{SPACE}+", " ")
    return trim_space(decode_entities(F.regexp_replace(spaced, "^ ", "")))
