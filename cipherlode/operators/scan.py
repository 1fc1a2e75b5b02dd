"""Text scanner: rule hits with line numbers, context and first-wins order.

The rules of a table are one constant array (rulebook.py). A text is tested only for those patterns whose literals
it has, and only those that match are looked for. Where matches lie follows from
setting a mark before each: a line has as many matches as it has marks then.
All of that, and the context of a hit, is linear in the text, and computed before hits become
rows, which are narrow. One shuffle, by file, orders the hits of a file and drops those that an
earlier rule has on the same line.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherlode import rules
from cipherlode.functions.classify import any_of, strip
from cipherlode.operators.rulebook import BUILT_IN, Rulebook, literals
from cipherlode.runtime import ship

FLAGS = "(?iuU)"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
HIT = ("phase", "detector", "rule_ord", "match_ord", "name", "algorithm", "primitive", "confidence", "line")
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType())]))


MARK, OTHER = "\x01", "\x02"
NONE = "cast(array() as array<int>)"

# Tables of dozens of rules are written as SQL text: one expression is parsed at once, where as many
# Column calls would each go to the JVM.
# Upper, then lower case: what the patterns' case-blind letters match becomes the plain letter.
LOW = "lower(upper(content))"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _line_counts(marked: str) -> str:
    """The line numbers, from 1, of a text's marks: one for each mark, in order."""
    lines = f"transform(split({marked}, '\\n', -1), (x, i) -> if(contains(x, {quoted(MARK)}), named_struct('line', i + 1, 'n', length(x) - length(replace(x, {quoted(MARK)}, ''))), null))"
    return f"flatten(transform(filter({lines}, p -> p is not null), p -> array_repeat(p.line, p.n)))"


def _marked(content: str, rx: str) -> str:
    """A text with a mark before each match and nowhere else; rx is a SQL expression."""
    return f"regexp_replace(replace({content}, {quoted(MARK)}, {quoted(OTHER)}), {rx}, {quoted(MARK + '$0')})"


def _match_lines(content: str, rx: str) -> str:
    return f"if(rlike({content}, {rx}), {_line_counts(_marked(content, rx))}, {NONE})"


def match_lines(content: str, rx: str) -> Column:
    """Line numbers, from 1, of all matches of a pattern in a column."""
    return F.expr(_match_lines(content, quoted(rx)))


def _facts(algorithm: str, primitive: str, confidence: float) -> str:
    return f"named_struct('algorithm', {algorithm}, 'primitive', {quoted(primitive)}, 'confidence', {confidence}D)"


def _hit(phase: int, detector: str, rule_ord: str, at: str, name: str, facts: str, line: str) -> str:
    return f"named_struct('phase', {phase}, 'detector', '{detector}', 'rule_ord', {rule_ord}, 'match_ord', {at}, 'name', {name}, 'algorithm', {facts}.algorithm, 'primitive', {facts}.primitive, 'confidence', {facts}.confidence, 'line', {line})"


def _exploded(files: DataFrame, hits: str) -> DataFrame:
    rows = files.withColumn("_h", F.explode(F.expr(hits)))
    return rows.select(*files.columns, "_h.*")


def pattern_array(content: str, low: str, table, phase: int, detector: str, start: int = 0) -> str:
    """Hits of a rule table in a text: one for each match of the rules that match at all. low: the text in plain lower case."""
    if not table:
        return "array()"
    entry = lambda i, rx, a, p, c: f"named_struct('i', {i}, 'rx', {quoted(FLAGS + rx)}, 'has', array({', '.join(map(quoted, literals(rx)))}), 'r', {_facts(quoted(a), p, c)})"
    rows = ", ".join(entry(i, *r) for i, r in enumerate(table))
    matching = f"filter(filter(array({rows}), r -> exists(r.has, h -> contains({low}, h))), r -> rlike({content}, r.rx))"
    found = f"transform({matching}, r -> named_struct('i', r.i, 'r', r.r, 'lines', {_line_counts(_marked(content, 'r.rx'))}))"
    return f"flatten(transform({found}, f -> transform(f.lines, (line, k) -> {_hit(phase, detector, f'f.i + {start}', 'k', 'f.r.algorithm', 'f.r', 'line')})))"


def pattern_hits(files: DataFrame, table, phase: int, detector: str) -> DataFrame:
    return _exploded(files.withColumn("_low", F.expr(LOW)), pattern_array("content", "_low", table, phase, detector)).drop("_low")


def _numbered(content: str, rx: str, *groups: int) -> str:
    """Structs of each match's groups, by number from 0, and its line; rx is a SQL expression."""
    parts = [f"regexp_extract_all({content}, {rx}, {g})" for g in groups]
    names = ", ".join(f"'g{k}', m['{k}']" for k in range(len(groups)))
    return f"transform(arrays_zip({', '.join([*parts, _match_lines(content, rx)])}), (m, i) -> named_struct({names}, 'line', m['{len(groups)}'], 'i', i))"


def call_array(content: str, low: str, table) -> str:
    """Calls of known functions: of those whose names a text has at all, all places in one search."""
    if not table:
        return "array()"
    known = ", ".join(f"{quoted(name.lower())}, named_struct('ord', {i}, 'name', {quoted(name)}, 'algorithm', {quoted(a)}, 'primitive', cast(null as string), 'confidence', {c}D)" for i, (name, a, _, c) in enumerate(table))
    names = f"filter(array({', '.join(quoted(name.lower()) for name, *_ in table)}), n -> contains({low}, n))"
    tokens = f"transform({_numbered(content, 'rx', 1)}, t -> named_struct('r', try_element_at(map({known}), lower(t.g0)), 'line', t.line, 'i', t.i))"
    hits = f"transform(filter({tokens}, t -> t.r is not null), t -> {_hit(4, 'source_symbol', 't.r.ord', 't.i', 't.r.name', 't.r', 't.line')})"
    search = f"transform({names}, n -> n)"
    # a search without any name finds nothing
    return f"flatten(transform(filter(array(concat({quoted('(?iuU)' + chr(92) + 'b(')}, array_join({search}, '|'), {quoted(')' + chr(92) + 's*+' + chr(92) + '(')})), rx -> not contains(rx, '()')), rx -> {hits}))"


def call_hits(files: DataFrame, table=BUILT_IN.calls) -> DataFrame:
    return _exploded(files.withColumn("_low", F.expr(LOW)), call_array("content", "_low", table)).drop("_low")


def string_constants(content: str) -> Column:
    """Map of Java String constants; the last assignment wins."""
    rx = quoted(FLAGS + rules.STRING_CONSTANT)
    pairs = f"transform(arrays_zip(regexp_extract_all({content}, {rx}, 1), regexp_extract_all({content}, {rx}, 2)), (p, i) -> named_struct('k', p['0'], 'i', i, 'v', p['1']))"
    # sorted by name and place, a name's last value is the one before another name
    last = f"transform(array(array_sort({pairs})), s -> filter(s, (p, i) -> not get(s, i + 1).k <=> p.k))[0]"
    return F.expr(f"map_from_entries(transform({last}, p -> struct(p.k, p.v)))")


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '(?U)^\\\\s+|\\\\s+$', '')"


def resolved(argument: str, constants: str) -> str:
    """A literal's text, else the constant of that name or of its last part, else empty."""
    literal = f"regexp_extract(x, '^\"([^\"]+)\"$', 1)"
    token = _stripped("element_at(split(x, '\\\\.'), -1)")
    value = f"if({literal} <> '', {literal}, coalesce(try_element_at({constants}, x), try_element_at({constants}, {token}), ''))"
    return f"transform(array({_stripped(argument)}), x -> {value})[0]"


def classify_get_instance(api: str, n: str) -> str:
    """Struct (algorithm, primitive, confidence) of a getInstance call with an upper-case argument; an unknown API, in another case too, is generic."""
    by_api: dict = {}
    for name, test, algorithm, primitive, confidence in rules.GET_INSTANCE_RULES:
        kind, _, value = test.partition(":")
        head, _, rest = value.partition("+")
        holds = {"has": f"contains({n}, '{value}')", "starts": f"startswith({n}, '{head}') and contains({n}, '{rest}')", "is": f"{n} = '{value}'", "any": "true"}[kind]
        by_api.setdefault(name, []).append(f"when {holds} then {_facts(quoted(algorithm), primitive, confidence)}")
    other = _facts("'generic-crypto'", "encryption", 0.6)
    return f"case {api} " + " ".join(f"when '{name}' then case {' '.join(cases)} else {other} end" for name, cases in by_api.items()) + f" else {other} end"


def jca_array(content: str, constants: str) -> str:
    """Java getInstance calls with literal or constant arguments."""
    named = f"transform({_numbered(content, quoted(FLAGS + rules.GET_INSTANCE), 1, 2)}, m -> named_struct('api', m.g0, 'n', upper({resolved('m.g1', constants)}), 'line', m.line, 'i', m.i))"
    facts = f"transform({named}, m -> named_struct('r', {classify_get_instance('m.api', 'm.n')}, 'line', m.line, 'i', m.i))"
    return f"transform({facts}, m -> {_hit(2, 'java_jca_resolver', '0', 'm.i', 'm.r.algorithm', 'm.r', 'm.line')})"


def jca_hits(files: DataFrame) -> DataFrame:
    return _exploded(files.withColumn("_constants", string_constants("content")), jca_array("content", "_constants")).drop("_constants")


def operation_array(content: str, low: str, constants: str, table) -> str:
    """Java constructors and operations; a key's algorithm is resolved like a getInstance argument."""
    if not table:
        return "array()"
    (key_rx, *_), *others = table
    named = f"transform({_numbered(content, quoted(FLAGS + key_rx), 1)}, m -> named_struct('n', upper({resolved('m.g0', constants)}), 'line', m.line, 'i', m.i))"
    kind = (
        f"case when contains(m.n, 'AES') then {_facts(quoted('AES'), 'block-cipher', 0.9)} when contains(m.n, 'RSA') then {_facts(quoted('RSA'), 'asymmetric', 0.9)} when contains(m.n, 'CHACHA') then {_facts(quoted('ChaCha20'), 'stream-cipher', 0.9)} "
        f"when m.n <> '' then {_facts('m.n', 'block-cipher', 0.82)} else {_facts(quoted('generic-symmetric-key'), 'block-cipher', 0.7)} end"
    )
    facts = f"transform({named}, m -> named_struct('r', {kind}, 'line', m.line, 'i', m.i))"
    keys = f"transform({facts}, m -> {_hit(2, 'java_jca_resolver', '1', 'm.i', 'm.r.algorithm', 'm.r', 'm.line')})"
    return f"concat({keys}, {pattern_array(content, low, others, 2, 'java_jca_resolver', 2)})"


def operation_hits(files: DataFrame, table=BUILT_IN.operations) -> DataFrame:
    rows = files.withColumns({"_constants": string_constants("content"), "_low": F.expr(LOW)})
    return _exploded(rows, operation_array("content", "_low", "_constants", table)).drop("_constants", "_low")


def function_ranges(files: DataFrame) -> DataFrame:
    """Adds the Python functions' line ranges, outer ones first; null for other languages.

    Parsing needs Python's own parser: an Arrow-batched UDF, which gets no text of other files.
    """
    ship(files.sparkSession)

    @F.pandas_udf(RANGES)
    def ranges(code: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                tree = ast.parse(text)
            except Exception:
                return []
            return [{"start": n.lineno, "end": n.end_lineno, "name": n.name} for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]

        return code.map(one)

    return files.withColumn("ranges", ranges(F.when(F.lower("path").endswith(".py"), F.col("content"))))


def with_context(hits: Column, lines: Column, ranges: Column, window: int = 2) -> Column:
    """Each hit of an array with snippet, context_before, context_after and function_name."""

    def one(h: Column) -> Column:
        line = h["line"]
        first = F.greatest(line - window, F.lit(1))
        before = F.when(line > first, strip(F.array_join(F.slice(lines, first, line - first), "\n"))).otherwise("")
        after = strip(F.array_join(F.slice(lines, line + 1, window), "\n"))
        inside = F.get(F.filter(ranges, lambda r: (r["start"] <= line) & (line <= r["end"])), F.lit(0))["name"]
        return F.struct(*[h[c].alias(c) for c in HIT], strip(F.coalesce(F.get(lines, line - 1), F.lit(""))).alias("snippet"), before.alias("context_before"), after.alias("context_after"), inside.alias("function_name"))

    return F.transform(hits, one)


def scan_text(files: DataFrame, book: Rulebook = BUILT_IN) -> DataFrame:
    """All hits of text files (file_id, path, content, and others), first ones only for each (name, line).

    Java files also go through imports, getInstance calls and operations. SQL lines are no
    elliptic curves; a generic cipher gives way to a specific one on its line. Null and empty
    texts have no hits. book: the rules, for one's own see Rulebook.of.
    """
    java = F.lower("path").endswith(".java")
    files = function_ranges(files.withColumn("content", F.regexp_replace("content", "\r\n?", "\n")))
    rows = files.withColumns({"_java": java, "_lines": F.split("content", LINE_ENDS, -1), "_low": F.expr(LOW)})
    rows = rows.withColumn("_constants", F.when(F.col("_java") & F.contains("_low", F.lit("string")), string_constants("content")))
    only = [pattern_array("content", "_low", book.imports, 1, "java_import_signal"), jca_array("content", "_constants"), operation_array("content", "_low", "_constants", book.operations)]
    every = [pattern_array("content", "_low", book.patterns, 3, "source_pattern"), call_array("content", "_low", book.calls)]
    rows = rows.withColumn("_hits", F.expr(f"concat(if(_java, concat({', '.join(only)}), array()), {', '.join(every)})"))
    kept = [c for c in files.columns if c not in ("content", "ranges")]
    hits = rows.select(*kept, F.explode(with_context(F.col("_hits"), F.col("_lines"), F.col("ranges"))).alias("_h")).select(*kept, "_h.*")
    hits = hits.repartition("file_id")  # all windows below are within a file
    key = F.when(F.col("phase") == 4, F.col("name")).otherwise(F.col("algorithm"))
    order = ("phase", "rule_ord", "match_ord")
    hits = hits.withColumn("key", key).withColumn("rank", F.row_number().over(Window.partitionBy("file_id", "line", "key").orderBy(*order)))
    specific = (F.col("phase") == 2) & (F.col("rank") == 1) & (F.col("algorithm") != "generic-cipher")
    hits = hits.withColumn("specific", F.max(specific.cast("int")).over(Window.partitionBy("file_id", "line")))
    low, up = F.lower("snippet"), F.upper("snippet")
    sql = (F.col("phase") == 3) & (F.col("algorithm") == "ECC") & low.contains("ec.") & any_of(low, "select ", " from ", " join ", " where ", "insert ", "update ")
    generic = (F.col("phase") == 3) & (F.col("algorithm") == "generic-cipher") & F.col("snippet").contains("Cipher.getInstance")
    weak = generic & ((F.col("specific") == 1) | any_of(up, "AES/", "RSA/", "CHACHA20", "DES/"))
    hits = hits.where(~sql & ~weak).withColumn("rank", F.row_number().over(Window.partitionBy("file_id", "line", "key").orderBy(*order)))
    return hits.where("rank = 1").drop("key", "rank", "specific")


def fold_assets(hits: DataFrame, *by: str) -> DataFrame:
    """One row for each file and algorithm: occurrences, best confidence, locations in order of detection."""
    order = F.struct("phase", "rule_ord", "match_ord")
    found = hits.groupBy("file_id", "path", *by, "algorithm").agg(
        F.count("*").alias("occurrences"), F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"), F.min(order).alias("first"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat(F.lit("Line "), F.col("line")).alias("at")))).alias("places"), F.collect_set("detector").alias("detectors"),
    )
    return found.withColumn("locations", F.array_compact(F.transform("places", lambda p: p["at"]))).drop("places")
