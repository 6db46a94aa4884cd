"""Conversation prefix trie (operator 12): block digests first, turns only where siblings diverge.

1. A conversation's turns, in order, become 128-bit digests of (role, text) with the text's bytes;
   texts are read once and never shuffled.  ``rebuilt`` gives each conversation the turns that it
   is looked at with.
2. ``chains``: the digest after each turn names the whole prefix.  Equal conversations become
   one class (its least conv_id, its number of members), so copies cost one row.
3. A block is ``BLOCK`` successive turns.  Classes are grouped by (digest before the block, digest
   after it).  Where all classes that go on from a prefix share one whole block, nothing
   diverges inside: its nodes have the same members, and one class speaks for all.
4. Only the other blocks are refined turn by turn.
5. A node's sums over its subtree come from the classes that pass through it, so no walk
   down or up the trie is needed.  Distinct turns: the node belongs to the class with its least
   conv_id; a class owns the nodes of its path from some depth on, so the bytes of the distinct
   turns below a node are, over its classes, those owned at its depth or deeper.

Digests stand for prefixes: among 10^12 nodes a clash has a chance of about 10^-15.  The digests of
one conversation (16 bytes and a size a turn) are held together in a task.

Nulls: a null role or text is empty, a null turn comes first, rows with a null conv_id belong to no
conversation.  Rows with equal turns are ordered by their digest, and repeated rows are turns of their own.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches
from tidewire.session import dematerialize, materialize

BLOCK = 4
#: Conversations c are rebuilt on c - c % GROUP, with crc32(c) % HEADS turns of that.
GROUP, HEADS = 5, 9
#: Ids of one end are hashed in chunks of conv_ids that are equal but for so many low bits.
CHUNK_BITS = 12
ROOT = b"\0" * 16


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (digest, bytes), in order) of each conversation."""
    text, role = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("text", "role"))
    size = F.octet_length(text).cast("long")
    digest = F.substring(F.unhex(F.sha2(F.concat(size.cast("string"), F.lit(":"), text, role).cast("binary"), 256)), 1, 16)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("t"), digest.alias("d"), size.alias("b")).where("conv_id IS NOT NULL")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "d", "b"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda x: F.struct(x["d"].alias("d"), x["b"].alias("b"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Each conversation with the first turns of its group's first one in place of its own."""
    base = lists.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("theirs"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.coalesce(F.slice("theirs", 1, h), F.array().cast("array<struct<d:binary,b:bigint>>"))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    rows = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base", "left")
    return rows.select("conv_id", F.concat(head, tail).alias("turns"))


def chains(lists: DataFrame) -> DataFrame:
    """(conv_id, depth, last, path, below): ``path[d]`` names the first d turns (``path[0]`` the root),
    ``below[d]`` are the bytes of turn d and all after it, ``last`` ends the path."""
    bounded_batches(lists.sparkSession)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, ds, bs in zip(pdf["conv_id"], pdf["ds"], pdf["bs"], strict=True):
                path = [ROOT]
                for d in ds:
                    path.append(hashlib.blake2b(path[-1] + bytes(d), digest_size=16).digest())
                sizes = np.array([0, *bs], np.int64)
                rows.append((c, len(ds), path[-1], path, np.cumsum(sizes[::-1])[::-1]))
            yield pd.DataFrame(rows, columns=["conv_id", "depth", "last", "path", "below"])

    rows = lists.select("conv_id", F.col("turns.d").alias("ds"), F.col("turns.b").alias("bs"))
    return rows.mapInPandas(chain, "conv_id long, depth int, last binary, path array<binary>, below array<long>")


def end_digests(chained: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the ids that end at each node, ascending, comma-joined.
    Ids are joined to chunks of bounded size where they are; a node's chunks, sorted, run through one
    hash a piece at a time, as the digest demands, however many there are."""
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    joined = chained.groupBy(F.col("last").alias("node"), chunk).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for pdf in batches:
            done = []
            for n, ids in zip(pdf["node"], pdf["ids"], strict=True):
                if n == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    ordered = joined.repartition("node").sortWithinPartitions("node", "chunk")
    return ordered.select("node", "ids").mapInPandas(digest, "node binary, ends_sha256 string")


def classes_of(chained: DataFrame) -> DataFrame:
    """(cls, n, depth, last, path, below): one row per distinct conversation, named by its least conv_id."""
    same = chained.groupBy("last").agg(F.min("conv_id").alias("cls"), F.count("*").alias("n"))
    return chained.withColumnRenamed("conv_id", "cls").join(same.drop("last"), "cls").select("cls", "n", "depth", "last", "path", "below")


def block_rows(classes: DataFrame, *columns: str) -> DataFrame:
    """Each class once per block of its path: (before, after, path, below: the block's part of them, from
    the digest before it on, top: depth before it) and ``columns``."""
    def cut(k: Column) -> Column:
        top = k * BLOCK
        end = F.least(F.col("depth"), top + BLOCK)
        part = lambda c: F.slice(c, top + 1, end - top + 1).alias(c)
        return F.struct(F.get("path", top).alias("before"), F.get("path", end).alias("after"), top.alias("top"), part("path"), part("below"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("depth") - 1) / BLOCK).cast("int")), cut)
    return classes.where("depth > 0").select(F.explode(blocks).alias("block"), *columns).select("block.*", *columns)


def turn_rows(blocks: DataFrame, *columns: str) -> DataFrame:
    """Each row of ``block_rows`` once per turn: (node, parent, d, here: bytes from that turn on)."""
    i = F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i")
    at = lambda c, j: F.get(c, F.col("i") - j)
    return blocks.select("*", i).select(at("path", 0).alias("node"), at("path", 1).alias("parent"), (F.col("top") + F.col("i")).alias("d"), at("below", 0).alias("here"), *columns)


def nodes_of(classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, parent, d, cls, n_cls, n_convs): every node with its least conv_id, classes and members."""
    rows = block_rows(classes, "cls", "n")
    quiet = rows.drop("n").join(blocks.where("quiet").select("before", "cls", "n_cls", "n_convs"), ["before", "cls"])
    calm = turn_rows(quiet, "cls", "n_cls", "n_convs").drop("here")
    split = turn_rows(rows.join(blocks.where("NOT quiet").select("before").distinct(), "before", "left_semi"), "cls", "n")
    members = [F.min("cls").alias("cls"), F.count("*").alias("n_cls"), F.sum("n").alias("n_convs")]
    # a chained digest names its parent too
    split = split.groupBy("node", "parent", "d").agg(*members)
    root = classes.agg(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("d"), *members).where("n_cls > 0")
    return root.unionByName(calm).unionByName(split)


def subtree_sums(weighed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, n_leaves, spent, held): bytes of all members' turns from the node down, and of the distinct
    ones.  In a quiet block both only shrink, turn by turn, by what the first class says."""
    columns = ["node", "n_leaves", "spent", "held"]
    leaves = F.sum("leaf").alias("n_leaves")
    root = weighed.agg(F.lit(ROOT).alias("node"), leaves, F.sum(F.col("n") * F.get("below", F.lit(0))).alias("spent"), F.sum("own").alias("held")).where("n_leaves > 0")
    rows = block_rows(weighed, "cls", "n", "leaf", "owns", "own").withColumn("start", F.get("below", F.lit(1)))
    first = blocks.where("quiet").select("before", F.col("cls").alias("first"))
    inside = rows.select("before", "cls", "n", "leaf", "own", "start").join(first, "before")
    others = F.when(F.col("cls") != F.col("first"), F.col("own")).otherwise(0)
    inside = inside.groupBy("before").agg(leaves, F.sum("n").alias("n_convs"), F.sum(F.col("n") * F.col("start")).alias("spent"), F.sum(others).alias("held"))
    calm = turn_rows(rows.join(first.withColumnRenamed("first", "cls"), ["before", "cls"]), "before", "start").join(inside, "before")
    calm = calm.select("node", "n_leaves", (F.col("spent") - F.col("n_convs") * (F.col("start") - F.col("here"))).alias("spent"), (F.col("held") + F.col("here")).alias("held"))
    split = turn_rows(rows.join(blocks.where("NOT quiet").select("before").distinct(), "before", "left_semi"), "n", "leaf", "owns", "own")
    held = F.when(F.col("d") >= F.col("owns"), F.col("here")).otherwise(F.col("own"))
    split = split.groupBy("node").agg(leaves, F.sum(F.col("n") * F.col("here")).alias("spent"), F.sum(held).alias("held"))
    return root.select(columns).unionByName(calm.select(columns)).unionByName(split.select(columns))


def trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  ``rebuild``: op12's own turns (``rebuilt``), else the conversations as they are."""
    lists = materialize(turn_lists(conversations), "turn-lists")
    chained = materialize(chains(rebuilt(lists) if rebuild else lists), "turn-chains")
    classes = materialize(classes_of(chained), "turn-classes")
    blocks = block_rows(classes, "cls", "n").groupBy("before", "after").agg(F.min("cls").alias("cls"), F.count("*").alias("n_cls"), F.sum("n").alias("n_convs"))
    siblings = blocks.groupBy("before").agg(F.count("*").alias("siblings"))
    blocks = materialize(blocks.join(siblings, "before").select("before", "cls", "n_cls", "n_convs", (F.col("siblings") == 1).alias("quiet")), "turn-blocks")
    nodes = materialize(nodes_of(classes, blocks), "turn-nodes")
    # of each class: from which depth on it owns its path, and whether no other goes on from its end
    owned = nodes.groupBy("cls").agg(F.min("d").alias("owns"))
    ends = nodes.where("n_cls = 1").select(F.col("node").alias("last"), F.lit(1).alias("leaf"))
    owns = F.coalesce("owns", F.col("depth") + 1)
    weighed = classes.join(ends, "last", "left").join(owned, "cls", "left").select("cls", "n", "depth", "path", "below", F.coalesce("leaf", F.lit(0)).alias("leaf"), owns.alias("owns"))
    weighed = materialize(weighed.withColumn("own", F.coalesce(F.get("below", "owns"), F.lit(0))), "turn-weights")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("cls").alias("parent_conv_id"))
    out = nodes.join(subtree_sums(weighed, blocks), "node").join(children, "node", "left").join(end_digests(chained), "node", "left").join(parents, "parent", "left")
    result = out.select(F.col("cls").alias("conv_id"), F.col("d").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                        F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("spent") - F.col("held")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    done = materialize(result, "turn-trie")
    dematerialize(lists, chained, classes, blocks, nodes, weighed)
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the nodes of the trie of the rebuilt conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same in SQL: turn numbers by window, prefixes as chained texts, subtrees by prefix joins.  crc32 is
#: run bit by bit: -1 shifts, any other element is a byte.
SQL = f"""
WITH RECURSIVE own AS (
  SELECT conv_id, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS b,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT i.conv_id, 0 AS o, t.p, t.m, t.b FROM ids i JOIN own t ON t.conv_id = i.conv_id - i.conv_id % {GROUP} AND t.p <= i.h
  UNION ALL SELECT i.conv_id, 1, t.p, t.m, t.b FROM ids i JOIN own t ON t.conv_id = i.conv_id AND t.p > i.h),
turns AS (SELECT conv_id, m, b, row_number() OVER (PARTITION BY conv_id ORDER BY o, p) AS d FROM parts),
paths AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS node, NULL::VARCHAR AS parent, 0::BIGINT AS b FROM ids
  UNION ALL SELECT t.conv_id, t.d, md5(p.node || t.m), p.node, t.b FROM paths p JOIN turns t ON t.conv_id = p.conv_id AND t.d = p.d + 1),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(d) AS d, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n FROM paths GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT node AS top, node FROM nodes
  UNION ALL SELECT b.top, n.node FROM below b JOIN nodes n ON n.parent = b.node),
sums AS (
  SELECT top AS node, count(*) FILTER (k.k IS NULL) AS n_leaves, sum((n.n - 1) * n.b) AS saved
  FROM below JOIN nodes n USING (node) LEFT JOIN kids k USING (node) GROUP BY top),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, d) AS node FROM paths GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
