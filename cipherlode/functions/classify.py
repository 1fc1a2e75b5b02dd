"""Scalar classifiers as Column expressions: risk, type, functions, family, category, PQC status.

All are CASE expressions that whole-stage code generation compiles; none looks at other rows.
Confidences and scores are doubles throughout, added in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cipherlode import rules


def any_of(name: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def first_of(*cases: tuple[Column, Column | str], default) -> Column:
    """The value of the first case that holds."""
    out = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# Fixed value: white space at a text's ends.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's too. Only the ends are looked at, however long the text."""
    return F.btrim(c, F.lit(WHITE))


def _risk_part(name: Column, at: int) -> Column:
    known = F.create_map(*[F.lit(x) for r in rules.RISKS for x in (r[0], r[1 + at])])
    return F.coalesce(F.try_element_at(known, name), F.lit(rules.UNKNOWN_RISK[at]))


def base_risk(name: Column) -> Column:
    return _risk_part(name, 0)


def pqc_compliance(name: Column) -> Column:
    return _risk_part(name, 1)


def risk_status(name: Column) -> Column:
    return _risk_part(name, 2)


def final_risk(name: Column, key_length: Column | None = None) -> Column:
    """base * 0.7 + compliance * 0.3, more for keys under 128 bits, less over 256, 100 at most."""
    risk = base_risk(name) * F.lit(0.7) + pqc_compliance(name) * F.lit(0.3)
    if key_length is not None:
        key = F.coalesce(key_length, F.lit(0))
        risk = F.when((key != 0) & (key < 128), risk + 15.0).when(key > 256, risk - 5.0).otherwise(risk)
    return F.least(risk, F.lit(100.0))


def recommendation(risk: Column) -> Column:
    *levels, (_, last) = rules.RECOMMENDATIONS
    return first_of(*[(risk >= level, text) for level, text in levels], default=last)


def mitigation(status: Column) -> Column:
    return first_of(*[(status == s, text) for s, text in rules.MITIGATIONS.items()], default=F.lit(None).cast("string"))


def risk_level(risk: Column) -> Column:
    return first_of((risk >= 80, "critical"), (risk >= 60, "high"), (risk >= 40, "medium"), default="low")


def priority(risk: Column) -> Column:
    return first_of((risk >= 80, "critical_issues"), (risk >= 60, "high_priority"), (risk >= 40, "medium_priority"), default="low_priority")


def is_pqc_safe(name: Column) -> Column:
    return pqc_compliance(name) > 50


def pqc_label(name: Column) -> Column:
    return F.when(pqc_compliance(name) > 80, "standardized").otherwise("legacy")


def by_parts(name: Column, table, default) -> Column:
    """The value of a rule table's first row of which the name has a part."""
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return first_of(*[(any_of(name, *parts), value(v)) for v, parts in table], default=default if isinstance(default, Column) else value(default))


def primitive_type(name: Column) -> Column:
    return by_parts(F.lower(name), rules.PRIMITIVE_TYPES, rules.PRIMITIVE_DEFAULT)


def crypto_functions(name: Column) -> Column:
    """Array of likely functions; an algorithm family outweighs the kind of derivation."""
    return by_parts(F.lower(name), rules.FUNCTIONS, rules.FUNCTIONS_DEFAULT)


def family(name: Column) -> Column:
    return by_parts(F.upper(name), rules.FAMILIES, name)


def category(name: Column) -> Column:
    return by_parts(F.upper(name), rules.CATEGORIES, rules.UNKNOWN)


def pqc_status(name: Column) -> Column:
    return by_parts(F.upper(name), rules.PQC_STATUSES, rules.UNKNOWN)


def normal_name(name: Column) -> Column:
    out = F.upper(strip(name))
    for old, new in rules.SYNONYMS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def issue_key(issue: Column) -> Column:
    return F.replace(F.upper(strip(F.when(F.coalesce(issue, F.lit("")) == "", "UNKNOWN").otherwise(issue))), F.lit("-"), F.lit("_"))


def issue_severity(issue: Column) -> Column:
    """The severity that the issue view shows, by parts of the name."""
    n = F.lower(issue)
    return first_of((any_of(n, "cross_algorithm", "invalid", "contamination"), "high"), (any_of(n, "removed", "not_allowed", "not_supported"), "medium"), default="low")


SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def size_text(n: Column, units: tuple[str, ...] = SIZE_UNITS) -> Column:
    """A number of whole bytes in the first unit of which it has less than 1024, else in the last one; null stays null.

    Hundredths are rounded half-even on the exact value. format_string would round a double's shortest decimal form, and halves up.
    """
    n = n.cast("double")

    def in_unit(power: int) -> Column:
        x, one = n / F.lit(1024.0**power), F.lit(1024**power)
        whole = F.floor(x)
        part = ((x - whole) * one).cast("long") * 100  # exact: a division by a power of two, then whole numbers
        cents, left = F.floor(part / one), part % one * 2
        cents = cents + ((left > one) | ((left == one) & (cents % 2 == 1))).cast("long")
        return F.format_string(f"%d.%02d {units[power]}", whole + (cents == 100).cast("long"), cents % 100)

    last = len(units) - 1
    return first_of((n.isNull(), F.lit(None).cast("string")), *[(n < 1024.0 ** (power + 1), in_unit(power)) for power in range(last)], default=in_unit(last))


def is_json(text: Column) -> Column:
    """Whether all of a text is one JSON value. The parser stops after a value; inside both brackets what follows can't pass."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()


def github_ok(url: Column) -> Column:
    """https://github.com/ with an owner and a repository."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/+|/+$", "")
    parts = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == "github.com") & (parts >= 2)


def safe_name(label: Column, default: str = "run") -> Column:
    out = F.regexp_replace(F.regexp_replace(label, r"[^a-zA-Z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(default)).otherwise(out)


def example_band(risk: Column) -> Column:
    """Bands of the risk example: strictly above each limit."""
    return first_of((risk > 80, "critical"), (risk > 60, "high"), (risk > 40, "medium"), default="low")


def fit_band(r2: Column) -> Column:
    return first_of((r2 > 0.9, "very high"), (r2 > 0.8, "high"), (r2 > 0.7, "medium"), default="low")


def target_type(file_type: Column) -> Column:
    return F.when(file_type.isin("ELF", "PE"), "binary").otherwise("source-code")


def merged_maps(a: Column, b: Column, overwrite: bool = True) -> Column:
    """Two maps of strings as one; where both have a key, the second one's value, or the first one's."""
    first, second = (b, a) if overwrite else (a, b)
    return F.map_concat(first, F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)))
