"""All fields of an HTML page in one walk, in plain Python for Arrow batches.

The rules are those of ``html``, whose Columns cut the page anew for every field.
"""

from __future__ import annotations

import re

import pyarrow as pa

from . import html as H

_SPACE = " \t\n\x0b\f\r"
_RUNS = re.compile(f"[{_SPACE}]+")
_SEGMENTS = re.compile(H.SEGMENTS.replace(r"\z", r"\Z"))
_TITLE = re.compile(H._TITLE, re.S)
_OPENING, _CLOSING = re.compile("^<[^>]*>"), re.compile("</title>$", re.I | re.A)
_NAMED = {n: re.compile(f"<{n}(?![a-zA-Z0-9])", re.I | re.A) for n in ("meta", "a", "script", "/script", "style", "/style")}
_HEADING = re.compile(r"<([hH][0-9][a-zA-Z0-9]*)[^>]*>(?=(.*?)</\1>)", re.S)
_ATTRIBUTE = {n: re.compile(rf"""{H.SPACE}{n}{H.SPACE}*={H.SPACE}*(?:"([^"]*)"|'([^']*)'|([^ \t\n\x0B\f\r>"'][^ \t\n\x0B\f\r>]*))""") for n in ("name", "content", "href")}
TYPE = "struct<title: string, description: string, category: string, keywords: array<string>, headings: array<string>, links: array<string>, body_text: string>"
_LIST = pa.list_(pa.string())
_ARROW = pa.struct({"title": pa.string(), "description": pa.string(), "category": pa.string(), "keywords": _LIST, "headings": _LIST, "links": _LIST, "body_text": pa.string()})


def _clean(text: str) -> str:
    if "&" in text:
        for name, char in H.ENTITIES:
            text = text.replace(name, char)
    return text.strip(_SPACE)


def _attribute(tag: str, name: str) -> str | None:
    found = _ATTRIBUTE[name].search(tag)
    return _clean("".join(g or "" for g in found.groups())) if found else None


def parse(html: str) -> dict[str, object]:
    title, body, bare, links = None, [], [], []
    metas: dict[str, list[str]] = {"description": [], "category": [], "keywords": []}
    hidden = {"script": False, "style": False}
    for s in _SEGMENTS.findall(html):
        if s[0] != "<":
            bare.append(s)
            if not (hidden["script"] or hidden["style"]):
                body.append(s)
        elif s.startswith("<!--"):
            continue
        elif s[:6].lower() == "<title" and _TITLE.fullmatch(s):
            title = s
        else:
            bare.append(s)
            if s[-1] != ">":
                continue
            for name in hidden:
                if _NAMED[name].match(s):
                    hidden[name] = True
                elif _NAMED["/" + name].match(s):
                    hidden[name] = False
            if _NAMED["a"].match(s):
                links.append(_attribute(s, "href"))
            elif _NAMED["meta"].match(s):
                own, content = metas.get((_attribute(s, "name") or "").lower()), _attribute(s, "content")
                if own is not None and content is not None:
                    own.append(content)
    text = _RUNS.sub(" ", "".join(body))
    return {
        "title": "Untitled Document" if title is None else _clean(_CLOSING.sub("", _OPENING.sub("", title))),
        "description": metas["description"][-1] if metas["description"] else "", "category": metas["category"][-1] if metas["category"] else "General",
        "keywords": [k for c in metas["keywords"] for k in (x.strip(_SPACE) for x in c.split(",")) if k],
        "headings": [h for h in (_clean(m[2]) for m in _HEADING.finditer("".join(bare))) if h],
        "links": [x for x in links if x is not None], "body_text": _clean(text.removeprefix(" ")),
    }


def fields(html: pa.Array) -> pa.Array:
    return pa.array([parse((b or b"").decode(errors="replace")) for b in html.cast(pa.binary()).to_pylist()], _ARROW)
