"""Mixing sources to target weights: budgets down a domain-language-source tree.

A node's budget goes to its children by weight, but no child gets more than its subtree can
give (its tokens times MAX_EPOCHS). What a child can't take goes to its siblings by their
weights; only what the whole family can't take has been left to the family's own siblings, one
level up. A leaf's budget is then a prefix of its tokens in seeded epochs: each epoch is an own
permutation of the leaf's documents, and the last document taken may be cut.

All of it is DataFrame functions. A leaf may hold most rows: a permutation is never sorted as a
whole. Hash ranges are summed; the one in which the budget ends is divided again, RANGE_LEVELS
times in all, and only what is then left of it is put in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherlode.runtime import stored

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_LEAVES = 100_000
"""Leaves of some 100 bytes each that are broadcast; more are joined."""
RANGE_DIGITS, RANGE_LEVELS = 2, 3
"""A hash range is divided into 16**RANGE_DIGITS; after the last division it holds one in 16 million rows of a leaf."""


@dataclass(frozen=True)
class Mix:
    """Integer weights by level and name (1 for others), the budget as a share of all tokens."""

    share: tuple[int, int] = (3, 4)
    epochs: int = 4
    seed: int = 17
    weights: dict = field(default_factory=lambda: {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}})


LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The tables name no domains: the sources are dealt to four by their number, those without one to another."""
    return F.coalesce(F.concat(F.lit("domain"), (F.try_to_number(F.nullif(F.substring(F.regexp_extract(source, "([0-9]+)", 1), 1, 9), F.lit("")), F.lit("999999999")).cast("long") % 4).cast("string")), F.lit("other"))


def measured(docs: DataFrame) -> DataFrame:
    """m_domain, m_lang, m_source, m_tokens, m_name and m_key of each row that has words, and the row itself as m_doc.

    Null languages and sources are `none`. m_name tells the rows apart by id, those without one by text.
    """
    text, source = F.col("m_doc.text").cast("string"), F.coalesce(F.col("m_doc.source").cast("string"), F.lit("none"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_doc"))
    rows = rows.select(
        "m_doc", domain_of(source).alias("m_domain"), F.coalesce(F.col("m_doc.lang").cast("string"), F.lit("none")).alias("m_lang"), source.alias("m_source"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("m_tokens"),
        F.md5(text.cast("binary")).alias("m_key"),
    )
    name = F.coalesce(F.col("m_doc.doc_id").cast("string"), F.concat(F.lit("null:"), F.col("m_key")))
    return rows.where("m_tokens > 0").withColumn("m_name", name)


def _weight(level: str, mix: Mix) -> Column:
    known = mix.weights.get(level, {})
    out = F.lit(1).cast("long")
    for name, w in sorted(known.items()):
        out = F.when(F.col(f"m_{level}") == name, F.lit(w).cast("long")).otherwise(out)
    return out


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Budget `b` of each node (columns: parents, name, cap, w, total: the parent's budget).

    In the order of cap / w a node is full if the budget left, shared by the weights left, covers
    its cap. The others share the rest in whole tokens that add up exactly.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    up = group.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    down = group.orderBy("ratio", name).rowsBetween(0, Window.unboundedFollowing)
    rows = nodes.withColumn("ratio", F.expr("(cap * 1000) div w")).withColumn("before", F.coalesce(F.sum("cap").over(up), F.lit(0))).withColumn("left", F.sum("w").over(down))
    rows = rows.withColumn("full", big("cap") * big("left") <= (big("total") - big("before")) * big("w"))
    rows = rows.withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group))
    rows = rows.withColumn("open", F.when(F.col("full"), 0).otherwise(F.col("w")))
    rows = rows.withColumn("all", F.sum("open").over(group)).withColumn("upto", F.sum("open").over(group.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, 0)))
    part = F.expr("(cast(rest as decimal(20,0)) * upto) div all - (cast(rest as decimal(20,0)) * (upto - open)) div all")
    return rows.withColumn("b", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), part))).drop("ratio", "before", "left", "full", "rest", "open", "all", "upto", "total")


def budgets(rows: DataFrame, mix: Mix) -> DataFrame:
    """(m_domain, m_lang, m_source, tokens, b) of each leaf; rows: what measured gives."""
    names = [f"m_{x}" for x in LEVELS]
    leaves = stored(rows.groupBy(*names).agg(F.sum("m_tokens").alias("tokens")), "leaves")
    whole = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = min(whole * mix.share[0] // mix.share[1], whole * mix.epochs)
    above, parents = None, []
    for depth, level in enumerate(LEVELS):
        keys = names[: depth + 1]
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * mix.epochs).alias("cap")).withColumn("w", _weight(level, mix))
        nodes = nodes.withColumn("total", F.lit(budget).cast("long")) if above is None else nodes.join(above, parents)
        above = share_out(nodes, parents, keys[-1]).select(*keys, F.col("b").alias("total"))
        parents = keys
    return stored(above.withColumnRenamed("total", "b").join(leaves, names), "budgets")


NAMES = [f"m_{x}" for x in LEVELS]
NARROW = [*NAMES, "m_tokens", "m_name", "m_key"]


def _selected(rows: DataFrame, narrow: DataFrame, mix: Mix) -> DataFrame:
    """rows with epoch and m_taken, one row for each epoch; narrow: the columns NARROW of rows."""
    leaves = budgets(narrow, mix)
    small = leaves.count() <= BROADCAST_LEAVES
    ends = leaves.where("tokens > 0").select(*NAMES, F.expr("b div tokens").alias("m_full"), F.expr("b % tokens").alias("m_rest"))

    def placed(rows: DataFrame, leaf: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(leaf) if small else leaf, NAMES)
        return joined.withColumn("m_hash", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("m_full").cast("string"), F.col("m_name")).cast("binary")))

    last = ends.where("m_rest > 0").withColumns({"m_last": F.lit(""), "m_before": F.lit(0).cast("long")})
    for level in range(RANGE_LEVELS):
        inside = placed(narrow, last).where(F.substring("m_hash", 1, RANGE_DIGITS * level) == F.col("m_last"))
        sums = inside.groupBy(*NAMES, "m_full", "m_rest", "m_before", F.substring("m_hash", 1, RANGE_DIGITS * (level + 1)).alias("range")).agg(F.sum("m_tokens").alias("s"))
        order = Window.partitionBy(*NAMES).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # at most 16**RANGE_DIGITS rows a leaf
        upto = sums.withColumn("upto", F.col("m_before") + F.sum("s").over(order)).where("upto >= m_rest")
        found = upto.groupBy(*NAMES, "m_full", "m_rest").agg(F.min(F.struct("range", (F.col("upto") - F.col("s")).alias("before"))).alias("x"))
        last = stored(found.select(*NAMES, "m_full", "m_rest", F.col("x.range").alias("m_last"), F.col("x.before").alias("m_before")), "ends")
    found = placed(rows, ends.join(last.drop("m_full", "m_rest"), NAMES, "left"))
    own = F.substring("m_hash", 1, RANGE_DIGITS * RANGE_LEVELS)
    found = found.withColumn("m_part", F.when((F.col("m_rest") == 0) | (own > F.col("m_last")), F.lit("out")).when(own < F.col("m_last"), F.lit("in")).otherwise(F.lit("end")))
    order = Window.partitionBy(*NAMES).orderBy("m_hash", "m_name", "m_key").rowsBetween(Window.unboundedPreceding, -1)
    end = found.where("m_part = 'end'").withColumn("m_ahead", F.col("m_before") + F.coalesce(F.sum("m_tokens").over(order), F.lit(0)))
    end = end.withColumn("m_taken", F.least("m_tokens", F.greatest(F.lit(0), F.col("m_rest") - F.col("m_ahead")))).withColumn("epoch", F.col("m_full")).where("m_taken > 0")
    whole = found.withColumn("m_n", F.col("m_full") + F.when(F.col("m_part") == "in", 1).otherwise(0)).where("m_n > 0")
    whole = whole.withColumn("epoch", F.explode(F.expr("sequence(0L, m_n - 1)"))).withColumn("m_taken", F.col("m_tokens"))
    out = [*rows.columns, "epoch", "m_taken"]
    return whole.select(*out).unionByName(end.select(*out))


OWN = (*NAMES, "m_tokens", "epoch", "m_taken")


def select_epochs(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs (doc_id, text, lang, source and any others) with m_domain, m_lang, m_source, m_tokens, epoch and m_taken.

    One row for each epoch in which a document is taken, m_taken of its m_tokens words. Texts
    without words, null ones too, take no budget and are not returned; an empty table gives an
    empty one. Rows that repeat are separate documents that come next to each other; rows with one
    id or none are told apart by their texts, so the result doesn't depend on the layout.
    Columns of docs with one of the added names are replaced.
    """
    rows = measured(docs)
    narrow = stored(rows.select(*NARROW), "measured")
    return _selected(rows, narrow, mix).select(*[F.col(f"m_doc.`{c}`").alias(c) for c in docs.columns if c not in OWN], *OWN)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed documents with the columns of docs, whatever their names: cut texts keep their first words, joined by one space.

    Null texts and texts without words are not returned; an empty table gives an empty one;
    rows that repeat, or share an id, are taken and cut separately.
    """
    rows = measured(docs)
    taken = _selected(rows, stored(rows.select(*NARROW), "measured"), mix)
    cut, text = F.col("m_taken") < F.col("m_tokens"), F.col("m_doc.text").cast("string")
    first = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.col("m_taken").cast("int")), " ")
    changed = {"text": F.when(cut, first).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(first).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("m_doc.n_chars"))
    return taken.select(*[changed.get(c, F.col(f"m_doc.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document are taken in which epoch, with the default weights."""
    rows = measured(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    narrow = stored(rows.select(F.col("m_doc.doc_id").alias("doc_id"), *NARROW), "measured")
    return _selected(narrow, narrow, Mix()).select("doc_id", F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), "epoch", F.col("m_tokens").alias("n_tokens"), F.col("m_taken").alias("n_taken"))


def _share_sql(name: str, of: str, parents: str, key: str, weight: str, above: str) -> str:
    by = f"partition by {parents} " if parents else ""
    join = f"join {above} using ({parents})" if parents else f"cross join {above}"
    keys = f"{parents}, {key}" if parents else key
    return f"""
{name}_n as (select {keys}, sum(tokens)::hugeint * 4 as cap, ({weight})::hugeint as w from leaves group by {keys}),
{name}_a as (select n.*, b as total, cap * 1000 // w as ratio from {name}_n n {join}),
{name}_b as (select *, coalesce(sum(cap) over ({by}order by ratio, {key} rows between unbounded preceding and 1 preceding), 0) as before, sum(w) over ({by}order by ratio, {key} rows between current row and unbounded following) as lft from {name}_a),
{name}_c as (select *, cap::hugeint * lft <= (total - before)::hugeint * w as is_full from {name}_b),
{name}_d as (select *, total - sum(case when is_full then cap else 0 end) over ({by.strip()}) as rest, case when is_full then 0 else w end as op from {name}_c),
{name}_e as (select *, sum(op) over ({by.strip()}) as al, sum(op) over ({by}order by ratio, {key} rows between unbounded preceding and current row) as upto from {name}_d),
{name} as (select {keys}, case when is_full then cap else least(cap, (rest::hugeint * upto::hugeint) // al::hugeint - (rest::hugeint * (upto - op)::hugeint) // al::hugeint) end as b from {name}_e)"""


SQL = rf"""
with rows as (
  select doc_id, md5(text) as text_key, coalesce(source, 'none') as source, coalesce(lang, 'none') as lang,
    case when regexp_matches(coalesce(source, 'none'), '[0-9]') then 'domain' || (left(regexp_extract(source, '[0-9]+'), 9)::bigint % 4) else 'other' end as domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::hugeint as n_tokens
  from documents),
leaves as (select domain, lang, source, sum(n_tokens) as tokens from rows group by all),
root as (select least(sum(tokens)::hugeint * 3 // 4, sum(tokens)::hugeint * 4) as b from leaves),
{_share_sql("d", "leaves", "", "domain", "case domain when 'domain0' then 4 when 'domain1' then 3 when 'domain2' then 2 else 1 end", "root")},
{_share_sql("l", "leaves", "domain", "lang", "case lang when 'en' then 5 when 'de' then 2 when 'fr' then 2 else 1 end", "d")},
{_share_sql("s", "leaves", "domain, lang", "source", "case source when 'src0' then 2 else 1 end", "l")},
ends as (select domain, lang, source, b // tokens::hugeint as m, b % tokens::hugeint as rest from s join leaves using (domain, lang, source) where tokens > 0),
placed as (select r.*, m, rest, sum(n_tokens) over (partition by domain, lang, source order by md5('17:' || m || ':' || coalesce(doc_id::varchar, 'null:' || text_key)), doc_id, text_key rows between unbounded preceding and current row) - n_tokens as ahead
  from rows r join ends using (domain, lang, source) where n_tokens > 0),
part as (select *, least(n_tokens, greatest(0, rest - ahead)) as taken from placed),
out as (
  select doc_id, domain, lang, source, unnest(range(m::bigint)) as epoch, n_tokens, n_tokens as n_taken from part where m > 0
  union all
  select doc_id, domain, lang, source, m::bigint, n_tokens, taken from part where taken > 0)
select doc_id, domain, lang, source, epoch::bigint as epoch, n_tokens::bigint as n_tokens, n_taken::bigint as n_taken from out
"""
