"""The prefix trie of conversations: one row for each distinct beginning, with counts of its subtree.

A turn is named by the SHA-256 of role and text, so the trie is made of names, not of texts. Equal
conversations become one path first, and the ids of those that end at a node are hashed from sorted
pieces of PIECE ids each, so a conversation that is repeated any number of times weighs little.

Paths are dealt by their first turn, many first turns to a bucket. Each becomes a dictionary trie inside applyInPandas; nodes
are made before their children, so that going through them backwards is a postorder without recursion. A group with
more than MOST_TURNS turns is dealt again by the next turn, and so on: what all its paths share is a chain, and
paths are dealt by the turn behind it. Chains get their counts from sums over the subtries above them,
whose number is not bounded; no task holds them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import flat
from cipherlode.runtime import ship, stored

MOST_TURNS = 2_000
"""Turns of a group that is built in one piece."""
TOGETHER = 20_000
"""Turns of the groups that one call of applyInPandas gets, on average; single groups are no larger than MOST_TURNS."""
PIECE = 512
"""Ids that become one text before they are hashed."""
FEW = 20_000
"""So many oversized groups at most are broadcast, of some 200 bytes each."""
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up string, top boolean"


def turn_key(role: Column, text: Column) -> Column:
    """A turn's name: its role's length keeps role and text apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (key, words)) of rows (conv_id, turn, role, text).

    Turns are in order of turn, a missing one first; those with one number by role and text. Null roles and
    texts are empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    tied = stored(named.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", "turn"), "tied")
    # only turns that share their number need their texts to be put in order
    order = F.lit("") if tied.isEmpty() else F.concat("role", F.lit("\0"), "text")
    entry = F.struct("turn", order.alias("order"), turn_key(F.col("role"), F.col("text")).alias("key"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    return named.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))  # of one conversation


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, n, least, ends) of pieces that come by path, then number."""
    last, held = None, None
    done: list = []
    for batch in batches:
        for path, n, least, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if path != last:
                if held:
                    done.append((last, held[0], held[1], held[2].hexdigest()))
                last, held = path, [0, least, hashlib.sha256()]
            held[2].update((b"," if held[0] else b"") + ids.encode())
            held[0] += n
        if done:
            yield _table(done)
            done = []
    if held:
        yield _table([(last, held[0], held[1], held[2].hexdigest())])


def _table(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "n", "least", "ends"])


def paths(convs: DataFrame) -> DataFrame:
    """(keys, words, n, least, ends) of each distinct sequence of turns: conversations, the least id, the hash of all ids."""
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    convs = stored(convs.withColumn("path", F.sha2(F.array_join(F.transform("turns", lambda t: t["key"]), ""), 256)), "convs")
    one = convs.groupBy("path").agg(F.first("turns").alias("turns"))
    pieces = convs.groupBy("path", F.floor(F.col("conv_id") / PIECE).alias("at")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))  # PIECE ids at most
    dealt = pieces.repartition(parts, "path").sortWithinPartitions("path", "at").select("path", "n", "least", "ids")
    ends = dealt.mapInArrow(flat.lean(_hashed), "path string, n long, least long, ends string")
    return one.join(ends, "path").select(F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words"), "n", "least", "ends")


def subtrie(keys: list, words: list, n: list[int], least: list[int], ends: list[str], depth: int, above: int | None) -> list[tuple]:
    """The nodes of the trie of paths that share their first `depth` turns, from that node on.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); above: the top's parent's id.
    """
    after: list[dict] = [{}]
    up, deep, size, count, low, tail = [-1], [depth], [words[0][depth - 1]], [0], [None], [NOTHING]
    for path, own, times, first, end in zip(keys, words, n, least, ends):
        at = 0
        for i in range(depth, len(path)):
            node = after[at].get(path[i])
            if node is None:
                node = after[at][path[i]] = len(after)
                after.append({})
                up.append(at)
                deep.append(i + 1)
                size.append(own[i])
                count.append(0)
                low.append(None)
                tail.append(NOTHING)
            at = node
        count[at], low[at], tail[at] = times, first, end
    leaves, saved = [0] * len(after), [0] * len(after)
    for v in range(len(after) - 1, -1, -1):
        leaves[v] = leaves[v] or 1
        saved[v] += (count[v] - 1) * size[v]
        if v:
            p = up[v]
            count[p] += count[v]
            leaves[p] += leaves[v]
            saved[p] += saved[v]
            low[p] = low[v] if low[p] is None else min(low[p], low[v])
    return [(low[v], deep[v], low[up[v]] if v else above, count[v], len(after[v]), leaves[v], saved[v], tail[v]) for v in range(len(after))]


def _build(bucket: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all groups that were dealt to one bucket."""
    names = [c.split()[0] for c in NODE.split(", ")]
    groups: dict[str, list] = {}
    for gid, depth, up, above, *path in zip(*(bucket[c].tolist() for c in ("gid", "depth", "up", "above", "keys", "words", "n", "least", "ends"))):
        groups.setdefault(gid, [depth, up, None if pd.isna(above) else int(above), []])[3].append(path)
    out = []
    for depth, up, above, rows in groups.values():
        out += [(*node, up, node[1] == depth) for node in subtrie(*zip(*rows), depth, above)]
    done = pd.DataFrame(out, columns=names)
    done["parent_conv_id"] = done["parent_conv_id"].astype("Int64")
    return done


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that all paths of an oversized group share: from its depth to where it was dealt again."""
    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.string(), pa.bool_()]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            saved = r["saved"]
            for depth in range(r["shared"], r["depth"] - 1, -1):
                end = depth == r["shared"]
                saved += (r["n"] - 1) * r["words"][depth - r["depth"]]
                out.append((r["least"], depth, r["above"] if depth == r["depth"] else r["least"], r["n"], r["children"] if end else 1, r["leaves"], saved, r["ends"] if end else NOTHING, r["up"], depth == r["depth"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)


def trie(convs: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """One row for each node of the trie of convs (conv_id, turns: array of (key, words)).

    conv_id: the least of the conversations that begin with the node's turns; depth: their number, 0 for the root;
    parent_conv_id, n_convs, n_children, n_leaves; saved_tokens: words of last turns that need no second
    reading, over the subtree; ends_sha256: of the ids of the conversations that end there. Conversations without turns
    end at the root. Without conversations there is no node, not even the root.
    """
    spark = convs.sparkSession
    ship(spark)
    all_paths = stored(paths(convs), "paths")
    facts = all_paths.agg(F.min("least").alias("least"), F.sum(F.size("keys")).alias("turns")).first()
    least = facts["least"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(facts["turns"] or 0) // TOGETHER))
    rows = all_paths.where(F.size("keys") > 0).select("keys", "words", "n", "least", "ends", F.get("keys", F.lit(0)).alias("gid"), F.lit(1).alias("depth"), F.lit("").alias("up"), F.lit(least).cast("long").alias("above"))
    built, big = [], []
    while True:
        groups = rows.groupBy("gid").agg(F.sum(F.size("keys") - F.col("depth") + 1).alias("turns"), F.min("keys").alias("lo"), F.max("keys").alias("hi"), F.min("least").alias("low"), F.sum("n").alias("all"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("above").alias("above"), F.first("words").alias("words"))
        other = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
        shared = F.when(other > 0, other - 1).otherwise(F.size("lo")).cast("int")
        over = stored(groups.where(F.col("turns") > most).select("gid", "low", "all", "depth", "up", "above", shared.alias("shared"), F.slice("words", F.col("depth"), shared - F.col("depth") + 1).alias("words")), "oversized")
        n = over.count()
        if not n:
            built.append(rows)
            break
        hint = F.broadcast if n <= FEW else lambda df: df
        built.append(rows.join(hint(over.select("gid")), "gid", "left_anti"))
        inside = rows.drop("depth", "up", "above").join(hint(over.select("gid", "shared", "low")), "gid")
        ended = stored(inside.where(F.size("keys") == F.col("shared")).select("gid", F.col("n").alias("n_ended"), "ends"), "ended")
        big.append((over, ended, hint))
        below = F.sha2(F.array_join(F.slice("keys", 1, F.col("shared") + 1), ""), 256)
        rows = stored(inside.where(F.size("keys") > F.col("shared")).select("keys", "words", "n", "least", "ends", below.alias("gid"), (F.col("shared") + 1).alias("depth"), F.col("gid").alias("up"), F.col("low").alias("above")), "deeper")
    nodes = None
    for part in built:
        made = part.groupBy(F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("bucket")).applyInPandas(_build, NODE)
        nodes = made if nodes is None else nodes.unionByName(made)
    nodes = stored(nodes, "nodes")
    for over, ended, hint in reversed(big):
        sums = nodes.where("top").groupBy(F.col("up").alias("gid")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        facts = over.join(sums, "gid", "left").join(ended, "gid", "left").select("up", "above", "depth", "shared", "words", F.col("low").alias("least"), F.col("all").alias("n"), F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("ends", F.lit(NOTHING)).alias("ends"))
        nodes = nodes.unionByName(stored(facts.mapInArrow(flat.lean(_chains), NODE), "chains"))
    if least is None:
        return nodes.drop("up", "top")
    tops = nodes.where("top and up = ''").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    own = all_paths.agg(F.sum("n").alias("n"), F.max(F.when(F.size("keys") == 0, F.col("ends"))).alias("ends")).first()
    values = (least, 0, None, own["n"], tops["kids"], tops["leaves"] or 1, tops["saved"] or 0, own["ends"] or NOTHING)
    root = spark.range(1).select(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(values, (c.split() for c in NODE.split(", ")))])
    return nodes.drop("up", "top").unionByName(root)


def conversation_trie(turns: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text); other columns are not looked at. See conversations and trie."""
    return trie(conversations(turns), most)


def regrouped(convs: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """Every conversation with its first turns, as many as crc32 of its id says, from the first one of its group of ids."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared - 1).alias("head"))
    own = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h})
    none = F.slice("turns", 1, 0)
    return own.join(heads, "base", "left").select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0)))).alias("turns"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each begun as the query's contract says; see trie."""
    return trie(regrouped(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = f"""with crc as (select list(list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b.x) order by b.x) as t from (select unnest(range(0, 256))::bigint as x) b),
own as (select conv_id, list(row(coalesce(role, ''), coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns from conversations where conv_id is not null group by conv_id),
begun as (select o.conv_id, o.turns, xor(list_reduce(list_transform(string_split(o.conv_id::varchar, ''), lambda c: ord(c)::bigint), lambda a, c: xor(a >> 8, crc.t[(xor(a, c) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 4 as h from own o, crc),
convs as (select b.conv_id, list_concat(coalesce(p.turns[1:b.h], []), b.turns[b.h + 1:]) as turns from begun b left join own p on p.conv_id = b.conv_id - b.conv_id % 20),
prefixes as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from convs),
named as (select conv_id, depth, turns[1:depth] as path, len(turns) = depth as ended from prefixes),
nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ended), '')) as ends_sha256,
  case when depth = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(path[depth][2], '[^\\x20\\x09-\\x0D]+')) end as saved from named group by path, depth),
kids as (select path[1:depth - 1] as path, count(*) as n from nodes where depth > 0 group by 1),
full_ as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k on k.path = n.path),
below as (select unnest(range(0, depth + 1)) as d, path, saved, n_children = 0 as leaf from full_),
sums as (select path[1:d] as path, sum(saved)::bigint as saved_tokens, count(*) filter (where leaf) as n_leaves from below group by 1)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
from full_ f join sums s on s.path = f.path left join nodes p on f.depth > 0 and p.path = f.path[1:f.depth - 1]"""
