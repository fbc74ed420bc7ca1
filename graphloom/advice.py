"""Where learned components may advise: each does nothing unless it is given, what it says is checked, and all of it is on record."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from .algebra import Refused
from .parser.sparql import parse_query


class CandidateGenerator(Protocol):
    """Mappings worth asserting: ``(s, p, o, confidence)``."""

    def candidates(self, limit: int) -> Iterable[tuple[str, str, str, float]]: ...


class PlanAdvisor(Protocol):
    """Passes to switch off for a query."""

    def disable(self, query: str) -> Iterable[str]: ...


class HotSetAdvisor(Protocol):
    """Predicates worth keeping in memory."""

    def hot(self, limit: int) -> Iterable[str]: ...


class Translator(Protocol):
    """SPARQL for a question."""

    def translate(self, question: str) -> str: ...


@dataclass(frozen=True)
class Entry:
    number: int
    at: float
    what: str
    given: str
    said: str
    taken: bool


@dataclass
class Audit:
    """What was asked and said, oldest first, by pages."""

    entries: list[Entry] = field(default_factory=list)

    def record(self, what: str, given: str, said: str, taken: bool) -> None:
        self.entries.append(Entry(len(self.entries), time.time(), what, given, said, taken))

    def page(self, after: int = -1, size: int = 50) -> list[Entry]:
        return [e for e in self.entries if e.number > after][:size]


@dataclass
class Advisors:
    """The advisors that there are. Advice is taken only if it holds: it never changes results."""

    candidates: CandidateGenerator | None = None
    plans: PlanAdvisor | None = None
    hot_set: HotSetAdvisor | None = None
    translator: Translator | None = None
    audit: Audit = field(default_factory=Audit)

    def mappings(self, limit: int = 100, least: float = 0.5) -> list[tuple[str, str, str, float]]:
        if self.candidates is None:
            return []
        out = []
        for c in list(self.candidates.candidates(limit))[:limit]:
            good = 0 < c[3] <= 1 and c[3] >= least and c[0].startswith("<") and c[1].startswith("<")
            self.audit.record("candidate", str(limit), str(c), good)
            out += [c] if good else []
        return out

    def disabled(self, query: str) -> tuple[str, ...]:
        from .plans.rewrite import PASSES

        if self.plans is None:
            return ()
        said = list(self.plans.disable(query))
        good = tuple(p for p in said if p in PASSES)
        self.audit.record("plan", query, ",".join(said), len(good) == len(said))
        return good

    def hot(self, limit: int = 10) -> list[str]:
        if self.hot_set is None:
            return []
        said = list(self.hot_set.hot(limit))[:limit]
        self.audit.record("hot set", str(limit), ",".join(said), True)
        return said

    def question(self, text: str) -> str | None:
        """A query for a question, if it is one that the engine takes; only reading forms are."""
        if self.translator is None:
            return None
        said = self.translator.translate(text)
        try:
            parse_query(said)
        except Refused:
            self.audit.record("question", text, said, False)
            return None
        self.audit.record("question", text, said, True)
        return said
