"""Rule tables of the scanner: the built-in ones, or a DataFrame of a user's own.

A pattern comes with literals of which a text must hold one to match at all. So texts meet only the few patterns
whose literal they have, and a rule table of hundreds costs as many searches for plain substrings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as grammar

from pyspark.sql import DataFrame, SparkSession

from cipherlode import rules

TABLES = ("import", "operation", "pattern", "call")
SCHEMA = "table string, ord int, rule string, algorithm string, primitive string, confidence double"
Rule = tuple[str, str, str | None, float]


def _sequence(items) -> list[str] | None:
    """Literals of which one is in every text that a parsed sequence matches; None where nothing is sure."""
    found: list[list[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if name == "AT":
            continue  # a place has no width
        if run:
            found.append([run])
            run = ""
        inner = None
        if name == "SUBPATTERN":
            inner = _sequence(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _sequence(value[2])
        elif name == "ATOMIC_GROUP":
            inner = _sequence(value)
        elif name == "BRANCH":
            parts = [_sequence(b) for b in value[1]]
            inner = None if None in parts else sorted({x for p in parts for x in p})
        if inner:
            found.append(inner)
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def literals(pattern: str) -> list[str]:
    """Lower-case texts of which one is in whatever a pattern matches; the empty text where that can't be told."""
    try:
        return _sequence(grammar.parse(pattern, re.IGNORECASE)) or [""]
    except (re.error, RecursionError):
        return [""]


@dataclass(frozen=True)
class Rulebook:
    """(pattern or function name, algorithm, primitive, confidence) in the order of matching.

    imports and operations are for Java files; the first operation's first group names a key's algorithm. calls are function names.
    """

    imports: tuple[Rule, ...] = rules.IMPORTS
    operations: tuple[Rule, ...] = rules.OPERATIONS
    patterns: tuple[Rule, ...] = rules.PATTERNS
    calls: tuple[Rule, ...] = rules.CALLS

    @classmethod
    def of(cls, table: DataFrame) -> Rulebook:
        """From a table of rules (SCHEMA). Rules are few: they are read by the driver and become part of the plan."""
        rows = sorted(table.select(*(c.split()[0] for c in SCHEMA.split(", "))).collect(), key=lambda r: (r["table"], r["ord"]))
        for r in rows:
            if r["table"] not in TABLES:
                raise ValueError(f"no rule table {r['table']!r}; there are {', '.join(TABLES)}")
            if r["table"] == "call" and not re.fullmatch(r"\w+", r["rule"]):
                raise ValueError(f"not a function name: {r['rule']!r}")
        return cls(*(tuple((r["rule"], r["algorithm"], r["primitive"], float(r["confidence"])) for r in rows if r["table"] == t) for t in TABLES))

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as a table, to be changed and read again."""
        rows = [(t, i, *r) for t, part in zip(TABLES, (self.imports, self.operations, self.patterns, self.calls)) for i, r in enumerate(part)]
        return spark.createDataFrame(rows, SCHEMA)


BUILT_IN = Rulebook()
