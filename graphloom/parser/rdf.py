"""RDF texts: N-Triples and N-Quads line by line, Turtle and TriG by document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, RDF, RDF_TYPE, Term, literal, ntriples, parse_stored
from .sparql import unescape, unquote

Quad = tuple[str | None, str, str, str]


class Malformed(ValueError):
    """Text that isn't in its format."""


_IRI = r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"
_LABEL = r"_:[\w](?:[\w.·-]*[\w·-])?"
_STRING = r'"(?:[^"\\\n\r]|\\.)*"'
_LINE_TOKEN = re.compile(rf"\s*(?:(?P<iri>{_IRI})|(?P<bnode>{_LABEL})|(?P<string>{_STRING})(?:(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^(?P<type>{_IRI}))?|(?P<open><<\()|(?P<close>\)>>)|(?P<dot>\.)|(?P<comment>\#.*))")


def _line_term(line: str, at: int, names: str) -> tuple[str, int]:
    m = _LINE_TOKEN.match(line, at)
    if not m:
        raise Malformed(f"unexpected {line[at : at + 20]!r}")
    if m["open"]:
        parts = []
        at = m.end()
        for _ in range(3):
            part, at = _line_term(line, at, names)
            parts.append(part)
        m = _LINE_TOKEN.match(line, at)
        if not m or not m["close"]:
            raise Malformed("an open triple term")
        return f"<<( {' '.join(parts)} )>>", m.end()
    if m["iri"]:
        value = unescape(m["iri"][1:-1])
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value):
            raise Malformed(f"a relative IRI {m['iri']}")
        return f"<{value}>", m.end()
    if m["bnode"]:
        return f"_:{names}{m['bnode'][2:]}", m.end()
    if m["string"]:
        kind = unescape(m["type"][1:-1]) if m["type"] else ""
        return literal(unescape(m["string"][1:-1]), kind, m["lang"][1:] if m["lang"] else "").stored, m.end()
    raise Malformed(f"unexpected {m[0]!r}")


def parse_line(line: str, names: str = "") -> Quad | None:
    """The quad of a line of N-Triples or N-Quads; None for an empty one."""
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    terms, at = [], 0
    while True:
        m = _LINE_TOKEN.match(text, at)
        if m and m["dot"]:
            rest = text[m.end() :].strip()
            if rest and not rest.startswith("#"):
                raise Malformed(f"text after the end: {rest[:20]!r}")
            break
        term, at = _line_term(text, at, names)
        terms.append(term)
    if len(terms) not in (3, 4):
        raise Malformed(f"{len(terms)} terms")
    s, p, o = terms[:3]
    g = terms[3] if len(terms) == 4 else None
    if not s.startswith(("<", "_:")) or s.startswith("<<(") or not p.startswith("<") or p.startswith("<<(") or g is not None and (not g.startswith(("<", "_:")) or g.startswith("<<(")):
        raise Malformed("a term in a place that it can't have")
    return g, s, p, o


def parse_lines(text: str, names: str = "") -> Iterator[Quad]:
    for number, line in enumerate(text.splitlines(), 1):
        try:
            quad = parse_line(line, names)
        except ValueError as fault:
            raise Malformed(f"line {number}: {fault}") from None
        if quad:
            yield quad


_TURTLE = re.compile(
    rf"""
    (?P<space>\s+|\#[^\n]*)
  | (?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
  | (?P<string>"{{3}}(?:(?:"|"")?(?:[^"\\]|\\.))*"{{3}}|'{{3}}(?:(?:'|'')?(?:[^'\\]|\\.))*'{{3}}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<bnode>{_LABEL})
  | (?P<number>[+-]?(?:(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<name>(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:(?:[\w:·]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:·-]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:·-]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<mark>\^\^|<<\(|\)>>|[.;,()\[\]{{}}])
    """,
    re.X | re.S,
)


class Turtle:
    """Turtle, and TriG with ``graphs``; blank node labels get ``names`` in front, so that documents don't share them.

    A part of a document gets a ``mark`` of its own, which tells the nodes without labels of the parts apart.
    """

    def __init__(self, text: str, base: str = "", names: str = "", graphs: bool = False, prefixes: dict[str, str] | None = None, mark: str = ""):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TURTLE.match(text, at)
            if not m:
                raise Malformed(f"unexpected {text[at : at + 20]!r} at {at}")
            at = m.end()
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
        self.tokens.append(("end", ""))
        self.at, self.base, self.names, self.graphs = 0, base, names, graphs
        self.prefixes = dict(prefixes or {})
        self.fresh, self.graph, self.part = 0, None, mark
        self.out: list[Quad] = []

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def mark(self, text: str) -> bool:
        if self.tokens[self.at] == ("mark", text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.mark(text):
            raise Malformed(f"expected {text}, found {self.tokens[self.at][1]!r}")

    def quads(self) -> list[Quad]:
        while self.tokens[self.at][0] != "end":
            kind, text = self.tokens[self.at]
            if kind == "at" and text in ("@prefix", "@base") or kind == "word" and text.upper() in ("PREFIX", "BASE"):
                self.directive()
            elif self.graphs and (self.tokens[self.at] == ("mark", "{") or kind == "word" and text.upper() == "GRAPH" or self.tokens[self.at + 1] == ("mark", "{")):
                self.block()
            else:
                self.triples()
                self.need(".")
        return self.out

    def directive(self) -> None:
        _, word = self.next()
        if word.lower().endswith("prefix"):
            kind, name = self.next()
            if kind != "name" or not name.endswith(":"):
                raise Malformed(f"bad prefix {name!r}")
            self.prefixes[name[:-1]] = self.resolve(self.next()[1])
        else:
            self.base = self.resolve(self.next()[1])
        if word.startswith("@"):
            self.need(".")

    def block(self) -> None:
        if self.tokens[self.at][0] == "word":
            self.next()
        if not self.mark("{"):
            self.graph = self.term()
            self.need("{")
        while not self.mark("}"):
            self.triples()
            if not self.mark("."):
                self.need("}")
                break
        self.graph = None

    def resolve(self, token: str) -> str:
        value = unescape(token[1:-1])
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value):
            return value
        if not self.base:
            raise Malformed(f"a relative IRI without base: {token}")
        return urljoin(self.base, value)

    def new(self) -> str:
        self.fresh += 1
        return f"_:{self.names}.{self.part}{self.fresh}"

    def emit(self, s: str, p: str, o: str) -> None:
        self.out.append((self.graph, s, p, o))

    def triples(self) -> None:
        alone = self.tokens[self.at] == ("mark", "[")
        subject = self.term()
        if subject.startswith(('"', "<<(")):
            raise Malformed("a subject that is a literal or triple")
        if alone and self.tokens[self.at] in (("mark", "."), ("mark", "}")):
            return
        self.predicates(subject)

    def predicates(self, subject: str) -> None:
        while True:
            kind, text = self.tokens[self.at]
            if (kind, text) == ("word", "a"):
                self.next()
                verb = RDF_TYPE
            elif kind in ("iri", "name"):
                verb = self.term()
            else:
                raise Malformed(f"expected a predicate, found {text!r}")
            self.emit(subject, verb, self.term())
            while self.mark(","):
                self.emit(subject, verb, self.term())
            if not self.mark(";"):
                return
            while self.mark(";"):
                pass
            if self.tokens[self.at] in (("mark", "."), ("mark", "]"), ("mark", "}"), ("end", "")):
                return

    def term(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            return f"<{self.resolve(text)}>"
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise Malformed(f"unknown prefix {prefix}:")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        if kind == "bnode":
            return f"_:{self.names}{text[2:]}"
        if kind == "number":
            return literal(text, DOUBLE if re.search("[eE]", text) else DECIMAL if "." in text else INTEGER).stored
        if kind == "word" and text in ("true", "false"):
            return literal(text, BOOLEAN).stored
        if kind == "string":
            value = unquote(text)
            if self.tokens[self.at][0] == "at":
                return literal(value, lang=self.next()[1][1:]).stored
            if self.mark("^^"):
                return literal(value, parse_stored(self.term()).value).stored
            return literal(value).stored
        if (kind, text) == ("mark", "["):
            node = self.new()
            if not self.mark("]"):
                self.predicates(node)
                self.need("]")
            return node
        if (kind, text) == ("mark", "("):
            items = []
            while not self.mark(")"):
                items.append(self.term())
            head = f"<{RDF}nil>"
            for item in reversed(items):
                cell = self.new()
                self.emit(cell, f"<{RDF}first>", item)
                self.emit(cell, f"<{RDF}rest>", head)
                head = cell
            return head
        if (kind, text) == ("mark", "<<("):
            parts = [self.term() for _ in range(3)]
            self.need(")>>")
            return f"<<( {' '.join(parts)} )>>"
        raise Malformed(f"unexpected {text!r}")


FORMATS = {"nt": "lines", "ntriples": "lines", "nt11": "lines", "nq": "lines", "nquads": "lines", "ttl": "turtle", "turtle": "turtle", "n3": "turtle", "trig": "trig"}


def parse(text: str, form: str = "turtle", base: str = "", names: str = "") -> list[Quad]:
    """Quads of a document in a named format."""
    how = FORMATS.get(form.lower())
    if how is None:
        raise Malformed(f"no format {form}")
    if how == "lines":
        return list(parse_lines(text, names))
    return Turtle(text, base, names, graphs=how == "trig").quads()


def to_turtle(triples: list[tuple[str, str, str]], prefixes: dict[str, str] | None = None) -> str:
    """Triples in Turtle, by subject and predicate, with the prefixes that are given."""
    prefixes = prefixes or {}

    def short(term: str) -> str:
        if term == RDF_TYPE:
            return "a"
        if term.startswith("<") and not term.startswith("<<("):
            for name, space in sorted(prefixes.items(), key=lambda kv: -len(kv[1])):
                local = term[1:-1].removeprefix(space)
                if local != term[1:-1] and re.fullmatch(r"[A-Za-z_](?:[\w-]*)|", local):
                    return f"{name}:{local}"
        return ntriples(term)

    lines = [f"@prefix {n}: <{s}> ." for n, s in sorted(prefixes.items())]
    by: dict[str, dict[str, list[str]]] = {}
    for s, p, o in sorted(set(triples)):
        by.setdefault(s, {}).setdefault(p, []).append(o)
    for s, preds in by.items():
        parts = [f"{short(p)} {', '.join('<' + RDF + 'type>' if o == RDF_TYPE else short(o) for o in objects)}" for p, objects in preds.items()]
        subject = f"<{RDF}type>" if s == RDF_TYPE else short(s)
        lines.append(f"{subject} " + " ;\n    ".join(parts) + " .")
    return "\n".join(lines) + "\n"


def to_ntriples(triples: list[tuple[str, str, str]]) -> str:
    return "".join(f"{ntriples(s)} {ntriples(p)} {ntriples(o)} .\n" for s, p, o in triples)


__all__ = ["FORMATS", "Malformed", "Term", "Turtle", "parse", "parse_line", "parse_lines", "to_ntriples", "to_turtle"]
