"""Boolean predicates over terms, and two grammars for them.

Infix: AND and OR (upper case) share one precedence and group to the left, so
`a OR b AND c` is `(a OR b) AND c`; NOT, which neither grammar originally has,
binds tightest. Prefix: `+x rest` is x AND rest, `x rest` is x OR rest, each
taking all that stands to its right; a group may only come last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.text.tokenize import query_terms


class QueryError(ValueError):
    """The text is no query, or the predicate can't be built."""


class Predicate:
    """A boolean expression over terms."""

    def with_must(self, other: Predicate) -> Predicate:
        return And((self, other))

    def with_should(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def without(self, other: Predicate) -> Predicate:
        return And((self, Not(other)))

    def build(self) -> Predicate:
        """The normal form: nested ANDs and ORs flattened, repeats dropped, double negation gone."""
        return normalise(self)

    def terms(self) -> set[str]:
        raise NotImplementedError

    def column(self, has) -> Column:
        """The predicate as a column; has(term) says whether a document has it."""
        raise NotImplementedError

    def positive(self) -> bool:
        """False if a document without any of the terms can match."""
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Predicate):
    term: str

    def terms(self):
        return {self.term}

    def column(self, has):
        return has(self.term)

    def positive(self):
        return True

    def __str__(self):
        return self.term


@dataclass(frozen=True)
class _Many(Predicate):
    parts: tuple[Predicate, ...]

    def terms(self):
        return set().union(*(p.terms() for p in self.parts))


@dataclass(frozen=True)
class And(_Many):
    def column(self, has):
        out = self.parts[0].column(has)
        for p in self.parts[1:]:
            out = out & p.column(has)
        return out

    def positive(self):
        return any(p.positive() for p in self.parts)

    def __str__(self):
        return "(" + " & ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Or(_Many):
    def column(self, has):
        out = self.parts[0].column(has)
        for p in self.parts[1:]:
            out = out | p.column(has)
        return out

    def positive(self):
        return all(p.positive() for p in self.parts)

    def __str__(self):
        return "(" + " | ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Xor(_Many):
    """True where an odd number of the parts is."""

    def column(self, has):
        out = self.parts[0].column(has)
        for p in self.parts[1:]:
            out = out != p.column(has)
        return out

    def positive(self):
        return sum(not p.positive() for p in self.parts) % 2 == 0

    def __str__(self):
        return "(" + " ^ ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def terms(self):
        return self.part.terms()

    def column(self, has):
        return ~self.part.column(has)

    def positive(self):
        return not self.part.positive()

    def __str__(self):
        return f"!{self.part}"


def normalise(p: Predicate) -> Predicate:
    if isinstance(p, Not):
        inner = normalise(p.part)
        return inner.part if isinstance(inner, Not) else Not(inner)
    if isinstance(p, Xor):
        return Xor(tuple(map(normalise, p.parts)))
    if isinstance(p, And | Or):
        flat: dict[Predicate, None] = {}
        for part in map(normalise, p.parts):
            for x in part.parts if type(part) is type(p) else (part,):
                flat[x] = None
        return next(iter(flat)) if len(flat) == 1 else type(p)(tuple(flat))
    return p


def word(text: str) -> Predicate:
    """A query word: one term, or the AND of the terms it is cut into."""
    found = query_terms(text)
    if not found:
        raise QueryError(f"no term in {text!r}")
    return Term(found[0]) if len(found) == 1 else And(tuple(map(Term, found)))


def _several(words: list[str], kind: type) -> Predicate:
    if len(words) < 2:
        raise QueryError("at least two terms are needed")
    out = word(words[0])
    for w in words[1:]:
        out = kind((out, word(w)))
    return out


def must(words: list[str]) -> Predicate:
    """All of two or more words."""
    return _several(words, And)


def should(words: list[str]) -> Predicate:
    """Any of two or more words."""
    return _several(words, Or)


def must_not(words: list[str]) -> Predicate:
    """None of one or more words."""
    return Not(word(words[0]) if len(words) == 1 else should(words))


def xor(a: Predicate, b: Predicate) -> Predicate:
    """Exactly one of the two."""
    return Xor((a, b))


_INFIX_WORD = re.compile(r"[a-zA-Z0-9_'.\-]+")
_PREFIX_WORD = re.compile(r"[a-zA-Z0-9_.]+")


class _Infix:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def parse(self) -> Predicate:
        out = self.chain()
        if self.at != len(self.text):
            raise QueryError(f"unexpected {self.text[self.at :]!r}")
        return out

    def chain(self) -> Predicate:
        out = self.factor()
        while m := re.compile(r"\s*(AND|OR)\s*").match(self.text, self.at):
            self.at = m.end()
            out = (And if m[1] == "AND" else Or)((out, self.factor()))
        return out

    def factor(self) -> Predicate:
        if m := re.compile(r"NOT\s+").match(self.text, self.at):
            self.at = m.end()
            return Not(self.factor())
        if self.text.startswith("(", self.at):
            self.at += 1
            out = self.chain()
            if not self.text.startswith(")", self.at):
                raise QueryError("missing )")
            self.at += 1
            return out
        m = _INFIX_WORD.match(self.text, self.at)
        if not m:
            raise QueryError(f"no term at {self.text[self.at :]!r}")
        self.at = m.end()
        return word(m[0])


def parse_infix(text: str) -> Predicate:
    return _Infix(text).parse()


def parse_prefix(text: str) -> Predicate:
    """Clauses from right to left: what stands left decides how it joins the rest."""

    def clause(at: int) -> tuple[Predicate, int]:
        required = text.startswith("+", at)
        at += required
        if text.startswith("(", at):
            inner, at = clause(at + 1)
            if not text.startswith(")", at):
                raise QueryError("missing )")
            return inner, at + 1
        m = _PREFIX_WORD.match(text, at)
        if not m:
            raise QueryError(f"no term at {text[at:]!r}")
        left, at = word(m[0]), m.end()
        blank = re.compile(r"\s+").match(text, at)
        if not blank or blank.end() == len(text) or text.startswith(")", blank.end()):
            return left, at
        rest, at = clause(blank.end())
        return (And if required else Or)((left, rest)), at

    out, at = clause(0)
    if at != len(text):
        raise QueryError(f"unexpected {text[at:]!r}")
    return out


def parse(text: str) -> Predicate:
    """A query string: infix if it parses so, else prefix. Normal form."""
    try:
        found = parse_infix(text)
    except QueryError:
        found = parse_prefix(text)
    return normalise(found)


def array_has(terms_column: str = "terms"):
    """For Predicate.column: membership in an array of terms."""
    return lambda term: F.array_contains(terms_column, term)
