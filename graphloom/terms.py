"""RDF terms: the Python value, the string that stores it, and Columns over that string.

A term is stored as one string, which is its identity: ``<iri>``, ``_:label``,
``"lexical"`` with ``@lang`` or ``^^<datatype>`` behind it, or ``<<( s p o )>>``. The
lexical form is raw, not escaped: language tags and IRIs hold no quotation
mark, so it ends at the last one. ``xsd:string`` is left out.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
RDF_TYPE = f"<{RDF}type>"
INTEGER, DECIMAL, DOUBLE, BOOLEAN, DATE_TIME, STRING = (XSD + n for n in ("integer", "decimal", "double", "boolean", "dateTime", "string"))
LANG_STRING = RDF + "langString"
#: The numeric datatypes.
NUMERIC = tuple(
    XSD + n
    for n in (
        "integer", "decimal", "float", "double", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte",
        "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger",
    )
)


class Term(NamedTuple):
    """``kind`` is iri, bnode, literal or triple; ``value`` the IRI, label or lexical form (of a triple: its stored string)."""

    kind: str
    value: str
    datatype: str = ""
    lang: str = ""

    @property
    def stored(self) -> str:
        if self.kind == "iri":
            return f"<{self.value}>"
        if self.kind == "bnode":
            return f"_:{self.value}"
        if self.kind == "triple":
            return self.value
        if self.lang:
            return f'"{self.value}"@{self.lang}'
        return f'"{self.value}"' + (f"^^<{self.datatype}>" if self.datatype and self.datatype != STRING else "")


class Var(NamedTuple):
    name: str


def iri(value: str) -> Term:
    return Term("iri", value)


def literal(value: object, datatype: str = "", lang: str = "") -> Term:
    if isinstance(value, bool):
        return Term("literal", str(value).lower(), BOOLEAN)
    if isinstance(value, int):
        return Term("literal", str(value), INTEGER)
    if isinstance(value, float):
        return Term("literal", repr(value), DOUBLE)
    return Term("literal", str(value), datatype, lang.lower() if lang else "")


_LITERAL = re.compile(r'"(.*)"(?:@([^"]*)|\^\^<([^"]*)>)?', re.S)


def parse_stored(text: str) -> Term:
    """The term that a stored string stands for."""
    if text.startswith("<<("):
        return Term("triple", text)
    if text.startswith("<"):
        return Term("iri", text[1:-1])
    if text.startswith("_:"):
        return Term("bnode", text[2:])
    m = _LITERAL.fullmatch(text)
    if not m:
        raise ValueError(f"not a term: {text!r}")
    return Term("literal", m[1], m[3] or "", m[2] or "")


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def ntriples(text: str) -> str:
    """A stored term in N-Triples."""
    if not text.startswith('"'):
        return text
    end = text.rindex('"')
    return '"' + re.sub(r'[\\"\n\r\t]', lambda m: _ESCAPES[m[0]], text[1:end]) + text[end:]


def ntriples_column(term: Column) -> Column:
    """The same over a column, without leaving the JVM."""
    lex = lexical(term)
    for char, escape in _ESCAPES.items():
        lex = F.replace(lex, F.lit(char), F.lit(escape))
    return F.when(is_literal(term), F.concat(F.lit('"'), lex, F.lit('"'), suffix(term))).otherwise(term)


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_iri(term: Column) -> Column:
    return term.startswith("<") & ~term.startswith("<<(")


def is_bnode(term: Column) -> Column:
    return term.startswith("_:")


def lexical(term: Column) -> Column:
    """Lexical form of literals, IRI text, blank node label."""
    return (
        F.when(is_literal(term), F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1))
        .when(is_iri(term), F.substring(term, F.lit(2), F.length(term) - 2))
        .when(is_bnode(term), F.substring(term, 3, 1 << 30))
        .otherwise(term)
    )


def suffix(term: Column) -> Column:
    """What stands behind a literal's last quotation mark."""
    return F.regexp_extract(term, r'(?s)^".*"([^"]*)$', 1)


def language(term: Column) -> Column:
    return F.regexp_extract(term, r'(?s)^".*"@([^"]*)$', 1)


def datatype(term: Column) -> Column:
    """A literal's datatype IRI, without brackets."""
    behind = suffix(term)
    return F.when(behind == "", F.lit(STRING)).when(behind.startswith("@"), F.lit(LANG_STRING)).otherwise(F.regexp_extract(behind, r"^\^\^<(.*)>$", 1))


#: What a number looks like; Spark's cast takes more (a type suffix) and less (signs of infinity).
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_of(lex: Column) -> Column:
    """The double that a lexical form stands for, or null."""
    t = F.trim(lex)
    special = F.lower(t)
    return (
        F.when(t.rlike(NUMBER), t.try_cast("double"))
        .when(special.rlike(r"^[+]?(inf|infinity)$"), F.lit(float("inf")))
        .when(special.rlike(r"^-(inf|infinity)$"), F.lit(float("-inf")))
        .when(special.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )
