"""Parsing and compiling search queries: once a query, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quern.functions.chains import NAMED_ENDINGS
from quern.functions.numerals import NUMERAL, chinese_number
from quern.functions.text import DASHES, cleaned, normalize_text

#: How article numbers are written in queries, and what may stand before a bare one.
_POSTFIXED = re.compile(rf"({NUMERAL})\s*條之\s*({NUMERAL})")
_EXPLICIT = re.compile(rf"第\s*({NUMERAL})(?:\s*(?:之|-)\s*({NUMERAL}))?\s*(?P<unit>[條點])(?:\s*之\s*({NUMERAL}))?")
_SECTION = re.compile(r"§\s*(\d{1,4})(?:-(\d+))?")
_TRAILING = re.compile(rf"({NUMERAL})(?:\s*(?:之|-)\s*({NUMERAL}))?\s*(條)?$")
_NAME_BEFORE = re.compile(r"(?:法|條例|辦法|規則|編|建技|室裝|室装|變使|公安|危老|都更)$")


@dataclass(frozen=True)
class Term:
    """A search word, what it is an alias of, and the known words it is made of."""

    literal: str
    value: str
    parts: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys([self.literal, self.value, *self.parts]))


@dataclass(frozen=True)
class Query:
    terms: tuple[Term, ...]
    article: str
    text: str

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(w for t in self.terms for w in t.words))


@dataclass
class Vocabulary:
    """Aliases (short -> full name) and known words."""

    aliases: dict[str, str] = field(default_factory=dict)
    words: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self._longest = sorted({normalize_text(w) for w in (*self.words, *self.aliases)}, key=lambda w: (-len(w), w))

    def canonical(self, word: str) -> str:
        return self.aliases.get(word) or word

    def pieces(self, term: str) -> tuple[str, ...]:
        """The term as two or more known words, longest first from the left; empty if it is not made of them."""
        found, rest = [], term
        while rest:
            word = next((w for w in self._longest if rest.startswith(w)), None)
            if word is None:
                return ()
            found.append(self.canonical(word))
            rest = rest[len(word) :]
        return tuple(found) if len(found) > 1 else ()

    def named(self, term: Term) -> bool:
        """Whether a term names a law."""
        return term.literal in self.aliases or term.value.endswith(NAMED_ENDINGS)


def _trailing(q: str) -> re.Match | None:
    """A bare number at the end that may be an article's: short, after nothing, a space or a law's name."""
    m = _TRAILING.search(q)
    if not m:
        return None
    before = q[: m.start()]
    placed = not before or before[-1].isspace() or m[3] or _NAME_BEFORE.search(before)
    arabic = re.search(r"\d", m[1]) or m[2] or m[3]
    return m if len(chinese_number(m[1])) <= 4 and placed and not re.search(r"[.\d-]$", before) and arabic else None


def parse_query(value: str) -> tuple[list[str], str]:
    """(normalised terms, article number or empty)."""
    q = DASHES.sub("-", cleaned(value).replace("条", "條").replace("ㄧ", "一")).strip()
    q = _POSTFIXED.sub(r"\1之\2條", q)
    article, explicit = "", list(_EXPLICIT.finditer(q))
    if explicit:
        m = explicit[-1]
        base, sub, unit = m[1], m[4] or m[2], m["unit"]
    else:
        m = _SECTION.search(q) or _trailing(q)
        base, sub, unit = (m[1], m[2], "條") if m else ("", "", "")
    if m:
        article = f"第{chinese_number(base)}{f'-{chinese_number(sub)}' if sub else ''}{unit}"
        q = f"{q[: m.start()]} {q[m.end() :]}"
    return [normalize_text(t) for t in re.split(r"[\s,，、;；]+", q) if t], article


def compile_query(value: str, vocabulary: Vocabulary | None = None) -> Query:
    vocabulary = vocabulary or Vocabulary()
    terms, article = parse_query(value)
    return Query(tuple(Term(t, vocabulary.canonical(t), vocabulary.pieces(t)) for t in terms), article, normalize_text(value))
