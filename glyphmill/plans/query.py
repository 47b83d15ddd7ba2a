"""The query language: a recursive-descent parser on the driver.

or := and (OR and)* ; and := not ((AND)? not)* ; not := NOT primary | primary ;
primary := ( or ) | "phrase" | field:term | term
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import MAX_BYTES, MIN_BYTES

MAX_QUERY_BYTES, MAX_DEPTH, MAX_TERM_BYTES = 256, 20, 127
_SPACE = " \t\n\x0b\f\r"
_DELIMITERS = re.compile(r"""[ \t\n\x0B\f\r.,;:!?()\[\]{}"/\\<>=+*&|^%$#@~`]+""")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# The texts of the errors, which clients know.
EMPTY, TOO_LONG, TOO_DEEP = "Empty query string", "Query length exceeds maximum allowed limit", "Maximum query nesting depth exceeded."
NO_PARENTHESIS, NO_QUOTE = "Unbalanced parentheses: missing ')'", "Unterminated phrase: missing closing quote '\"'"


class QueryError(ValueError):
    """The query's syntax is wrong; ``position`` is where that was seen."""

    def __init__(self, message: str, position: int):
        super().__init__(message)
        self.position = position


@dataclass
class Node:
    kind: str  # term, phrase, field, and, or, not
    value: str = ""
    terms: list[str] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def _undouble(w: str) -> str:
    same = _size(w) >= 3 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiou" and w[-1].isascii()
    return w[:-1] if same else w


def stem(word: str) -> str:
    """The stemmer of ``functions.text`` for the few words of a query."""
    n = _size(word)
    if n > 5 and word.endswith("ing"):
        return _undouble(word[:-3])
    if n > 5 and word.endswith("tion"):
        return word[:-4]
    if n > 4 and word.endswith("ed"):
        return _undouble(word[:-2])
    if n > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if n > 4 and word.endswith("es"):
        return word[:-2]
    return word[:-1] if n > 3 and word.endswith("s") and not word.endswith("ss") else word


def tokenize(text: str) -> list[str]:
    """Terms of a text, stemmed, without a stop-word filter."""
    raw = [w for w in _DELIMITERS.split(text.translate(_FOLD)) if MIN_BYTES <= _size(w) <= MAX_BYTES]
    return [t for t in map(stem, raw) if _size(t) >= MIN_BYTES]


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in _SPACE:
            self.at += 1

    def word(self, name: str) -> bool:
        """Takes an operator word if a blank, parenthesis or the end follows."""
        self.blanks()
        end = self.at + len(name)
        if self.text[self.at : end].upper() != name or self.text[end : end + 1] not in ("", "(", *_SPACE):
            return False
        self.at = end
        return True

    def either(self) -> Node | None:
        left = self.both()
        while left and self.word("OR"):
            right = self.both()
            left = Node("or", left=left, right=right) if right else left
        return left

    def both(self) -> Node | None:
        left = self.negated()
        while left:
            self.blanks()
            mark = self.at
            if self.at >= len(self.text) or self.text[self.at] == ")":
                break
            if self.word("OR"):
                self.at = mark
                break
            self.word("AND")
            right = self.negated()
            if right is None:
                break
            left = Node("and", left=left, right=right)
        return left

    def negated(self) -> Node | None:
        if self.word("NOT"):
            inner = self.primary()
            return Node("not", left=inner) if inner else None
        return self.primary()

    def primary(self) -> Node | None:
        self.blanks()
        if self.at >= len(self.text):
            return None
        c = self.text[self.at]
        if c == "(":
            self.depth += 1
            self.at += 1
            if self.depth > MAX_DEPTH:
                raise QueryError(TOO_DEEP, self.at)
            inner = self.either()
            self.blanks()
            if self.text[self.at : self.at + 1] != ")":
                raise QueryError(NO_PARENTHESIS, self.at)
            self.at += 1
            self.depth -= 1
            return inner
        if c == '"':
            end = self.text.find('"', self.at + 1)
            if end < 0:
                raise QueryError(NO_QUOTE, self.at + 1)
            phrase, self.at = self.text[self.at + 1 : end], end + 1
            return Node("phrase", phrase, tokenize(phrase))
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in _SPACE + '()"':
            self.at += 1
        raw = self.text[start : self.at].encode()[:MAX_TERM_BYTES].decode("utf-8", "ignore")
        if not raw:
            return None
        name, colon, value = raw.partition(":")
        if colon:
            return Node("field", name, left=Node("term", stem(value.translate(_FOLD))))
        return Node("term", stem(raw.translate(_FOLD)))


def parse(text: str) -> Node | None:
    """The tree of a query; None if it holds no term. Raises QueryError."""
    if not text:
        raise QueryError(EMPTY, 0)
    if _size(text) > MAX_QUERY_BYTES:
        raise QueryError(TOO_LONG, MAX_QUERY_BYTES)
    return _Parser(text).either()


def bag(node: Node | None) -> list[str]:
    """The terms that ranked evaluation scores, in order and with repeats: a
    field's term counts twice, negated terms count like others."""
    if node is None:
        return []
    own = [node.value] if node.kind == "term" else node.terms if node.kind == "phrase" else []
    if node.kind == "field":
        own = bag(node.left)
    return [*own, *bag(node.left), *bag(node.right)]


def positive(node: Node | None) -> list[str]:
    """The terms that boolean evaluation scores: once each, none negated."""
    if node is None or node.kind == "not":
        return []
    own = [node.value] if node.kind == "term" else node.terms if node.kind == "phrase" else []
    return list(dict.fromkeys([*own, *positive(node.left), *positive(node.right)]))
