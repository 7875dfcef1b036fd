"""Prefix trie of turn sequences by van Emde Boas recursion.

A range of depths 2L is cut in the middle: the prefixes that reach the cut are named, the upper trie spans the first L turns, and
every name is the root of a lower trie over the next L. Upper tries and lower forests of one level are cut again together, so
log2(depth) rounds reach single turns. Going up, the totals of each lower trie are grafted onto the node that is its root
and onto that node's ancestors inside the upper trie, level by level, until the whole trie is joined again.

Everything is a row: a turn, a block of turns, a node. No sequence, prefix or group of equal sequences is ever gathered in one
place, so one sequence, first turn or copied conversation may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footstats.llm.common import cut
from footstats.operators.dedup import salted_join
from footstats.operators.sequences import with_position

#: Ids of one piece of text on the way to a digest; turn numbers of one task when turns are put in order.
CHUNK_IDS, CHUNK_TURNS = 4096, 4096
_WORD = r"[^\x20\x09-\x0D]+"


def digest(*parts: Column) -> Column:
    """32 bytes for the parts, which are digests themselves or may hold no colon."""
    return F.unhex(F.sha2(F.concat_ws(":", *[F.hex(p) for p in parts]), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, sym, words): turns in order, ``sym`` a digest of role and text.

    By turn (null first), then role and text; null role or text are empty. Rows with a null conv_id are left out.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # Null first: the bucket of null turns comes before all others.
    bucket = F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 62)).cast("long"))
    placed = with_position(rows, ["conv_id"], [F.asc_nulls_first("turn"), "role", "text"], bucket)
    sym = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), sym.alias("sym"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"))


def share_openings(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(sequences, turns) where conversation c begins with the first h turns of conversation c - c % ``group``, then
    has its own turns after its first h; h is crc32(c) % ``most``. ``turns`` as ``ordered_turns`` gives them.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    base = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    convs = cut(convs.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("taken")))
    # Few turns of few conversations, each of which opens less than 2 x ``group`` others.
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    opening = convs.join(heads, "base").where(F.col("pos") <= F.col("taken")).select("conv_id", "pos", "sym", "words")
    own = salted_join(turns.where(F.col("pos") > h), convs.select("conv_id", (F.col("taken") - F.col("h")).alias("shift")), "conv_id", ["pos"])
    rest = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "sym", "words")
    return convs.select("conv_id"), opening.unionByName(rest)


def name_prefixes(ids: DataFrame, turns: DataFrame, levels: int) -> DataFrame:
    """(conv_id, depth, name) for every prefix, depth 0 included; equal prefixes have equal names, others different ones.

    Blocks of 2, 4, 8 ... turns are named from their halves. A cut at half of a range of depths then names the prefix that reaches
    it by the name of its trie's root and the block of turns between; both halves are cut again in the next round.
    """
    blocks = [turns.select("conv_id", (F.col("pos") - 1).alias("block"), F.col("sym").alias("content"))]
    for _ in range(1, levels):
        half = F.col("block") % 2
        pairs = blocks[-1].groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(
            F.max(F.when(half == 0, F.col("content"))).alias("a"), F.max(F.when(half == 1, F.col("content"))).alias("b")
        )
        blocks.append(cut(pairs.where("b IS NOT NULL").select("conv_id", "block", digest(F.col("a"), F.col("b")).alias("content"))))
    names = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), digest(F.lit("root")).alias("name"))
    for level in reversed(range(levels)):
        length = 1 << level
        upper = blocks[level].where(F.col("block") % 2 == 0).select("conv_id", (F.col("block") * length).alias("depth"), "content")
        cut_name = F.struct((F.col("depth") + length).alias("depth"), digest(F.col("name"), F.col("content")).alias("name"))
        both = F.array(F.struct("depth", "name"), F.when(F.col("content").isNotNull(), cut_name))
        names = names.join(upper, ["conv_id", "depth"], "left").select("conv_id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x"))
        names = names.select("conv_id", "x.*")
    return cut(names)


def graft_totals(nodes: DataFrame, prefixes: DataFrame, levels: int) -> DataFrame:
    """(name, depth, leaves, saved) for all nodes but the root: sums over subtrees of the nodes' own values.

    ``nodes``: (name, parent, parent_conv_id, depth, leaves, saved).
    """
    totals = nodes.where("depth > 0")
    for level in range(levels):
        length = 1 << level
        # Tries of this level hang on cuts whose depth is an odd multiple of its length; their totals are complete.
        root = F.col("depth") - 1
        roots = totals.where((root > 0) & (root.bitwiseAND(-root) == length)).groupBy("parent").agg(
            F.first("parent_conv_id").alias("conv_id"), F.first(root).alias("root"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        above = roots.select("conv_id", F.explode(F.sequence(F.col("root") - (length - 1), F.col("root"))).alias("depth"), "leaves", "saved")
        grafts = above.join(prefixes, ["conv_id", "depth"]).groupBy("name").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        totals = cut(totals.join(grafts, "name", "left").select(
            "name", "parent", "parent_conv_id", "depth",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ))
    return totals


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id): SHA-256 of the ids, ascending, joined by commas.

    The ids are joined in pieces of ``CHUNK_IDS``, in parallel. SHA-256 itself runs through the pieces of one name in order; only names
    with several pieces are read by a Python task, which holds one piece at a time.
    """
    ranges = cut(ends.repartitionByRange("name", "conv_id").withColumn("part", F.spark_partition_id()))
    number = F.row_number().over(Window.partitionBy("part", "name").orderBy("conv_id"))
    chunks = cut(ranges.withColumn("chunk", F.floor((number - 1) / CHUNK_IDS)).groupBy("name", "part", "chunk").agg(
        F.min("conv_id").alias("least"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text")
    ))
    pieces = chunks.groupBy("name").agg(F.count("*").alias("pieces"), F.min("text").alias("text"))
    short = pieces.where("pieces = 1").select("name", F.sha2("text", 256).alias("ends_sha256"))
    # A name of several pieces has thousands of ids: these names are few against the ids, but not bounded, so nothing is broadcast.
    long = chunks.join(pieces.where("pieces > 1").select("name"), "name", "left_semi")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, sha = None, None
        for batch in batches:
            for at, text in zip(batch["name"], batch["text"]):
                if at == name:
                    sha.update(b",")
                else:
                    if sha:
                        yield pd.DataFrame({"name": [name], "ends_sha256": [sha.hexdigest()]})
                    name, sha = at, hashlib.sha256()
                sha.update(text.encode())
        if sha:
            yield pd.DataFrame({"name": [name], "ends_sha256": [sha.hexdigest()]})

    streamed = long.repartition("name").sortWithinPartitions("name", "least").select("name", "text").mapInPandas(stream, "name binary, ends_sha256 string")
    return short.unionByName(streamed)


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``ids``: (conv_id) of all sequences, each once, also of those without turns; ``turns``: (conv_id, pos from 1 without gaps, sym, words).
    A node stands for one distinct sequence of first turns and is known by its smallest member and its depth; the parent of
    the root is null. Without ids there are no nodes. Symbols and names are SHA-256 digests and taken as equal only for equal turns.
    """
    turns = cut(turns)
    longest = turns.agg(F.max("pos")).first()[0] or 0
    levels = int(longest).bit_length()
    prefixes = name_prefixes(ids, turns, levels)

    found = cut(prefixes.groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")))
    last = turns.select("conv_id", F.col("pos").alias("depth"), "words")
    above = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    linked = cut(found.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left"))
    children = linked.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    heads = found.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = salted_join(linked, heads, "parent", ["name"], "left").join(children, "name", "left")
    nodes = cut(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn(
        "leaves", (F.col("n_children") == 0).cast("long")
    ).withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))))

    totals = graft_totals(nodes.select("name", "parent", "parent_conv_id", "depth", "leaves", "saved"), prefixes, levels)
    whole = totals.where("depth = 1").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = nodes.where("depth = 0").select("name", F.col("leaves").alias("own")).join(F.broadcast(whole)).select(
        "name", F.greatest("own", F.coalesce("leaves", F.lit(0))).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")
    )
    sums = totals.select("name", "leaves", "saved").unionByName(root)
    ends = prefixes.groupBy("conv_id").agg(F.max_by("name", "depth").alias("name"))
    return nodes.drop("leaves", "saved").join(sums, "name").join(ends_digests(ends), "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of ``conversations`` (conv_id, turn, role, text) after ``share_openings``; other columns aren't read.

    Repeated rows are turns each; turns of equal number go by role and text; texts are taken whole. An empty table has no nodes.
    """
    ids, turns = share_openings(cut(ordered_turns(conversations)))
    return prefix_trie(ids, turns)


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT c, pos, sha256(length(role)::VARCHAR || ':' || role || text) AS sym,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM t),
i AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(1, length(c::VARCHAR) + 1), lambda n: ascii(substr(c::VARCHAR, n::INT, 1))::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
    4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM s)),
o AS (
  SELECT i.c, 0 AS part, s.pos, sym, words FROM i JOIN s ON s.c = i.base AND s.pos <= i.h
  UNION ALL SELECT i.c, 1, s.pos, sym, words FROM i JOIN s ON s.c = i.c AND s.pos > i.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, sym, words FROM o),
p AS (
  SELECT c, 0 AS d, '' AS node, 0 AS words FROM i
  UNION ALL SELECT c, d, string_agg(sym, '') OVER (PARTITION BY c ORDER BY d), words FROM r),
n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY ALL),
k AS (SELECT left(node, (d - 1) * 64) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (
  SELECT p.node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * f.words)::BIGINT AS saved_tokens
  FROM f JOIN p ON p.c = f.conv_id AND p.d <= f.d GROUP BY 1),
e AS (
  SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256
  FROM (SELECT c, arg_max(node, d) AS node FROM p GROUP BY 1) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, m.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves, saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN u USING (node) LEFT JOIN n m ON f.d > 0 AND m.node = left(f.node, (f.d - 1) * 64) LEFT JOIN e ON e.node = f.node
"""
