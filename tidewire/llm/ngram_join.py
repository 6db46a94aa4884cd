"""N-gram Jaccard join (operator 7): components of similar texts by a prefix-tree join.

A text's set holds its distinct 4-word shingles (64-bit hashes; A-Z lowered); a text of fewer words has
the whole sequence as its only element, one without words an empty set that links with
nothing.  Two texts link when 100 * intersection >= 85 * union.  4 and 85 are op7's; ``components``
and ``keep_one`` take others.

1. Equal sets become one node, so exact copies cost one row each and no pair.
2. Candidates by the prefix filter: under one global order of shingles, linked sets
   share one of their first n - ceil(0.85 n) + 1.  The order: shingles whose hash falls into
   one quarter of the hash space first, by the number of nodes that hold them; then the others, by hash.
   Any order keeps the join exact; counting a quarter is enough for a rare prefix.
3. Nodes that share prefix shingles, directly or through others, form a block; linked nodes
   are always in the same block.  In large tables chance joins many short texts to one block, so
   blocks beyond ``WHOLE_PARTS`` times ``BLOCK_NODES`` nodes or ``BLOCK_SHINGLES`` shingles are split again: sets are cut
   into buckets by hash, and linked sets have so many equal buckets (``buckets``) that the prefix
   filter holds for whole buckets, of which unlike texts hardly share any.  A block's texts go to
   one task, or, beyond one of the bounds, are dealt to parts, and each pair of parts goes to one.
4. There the sets are stored in a prefix tree (common shingles first, so that paths are
   shared).  A set descends it with the overlap so far; a subtree is left when even its
   remaining length can't reach the needed overlap, when its sizes don't fit, or when all its
   sets are already connected with the probing one.  So near copies of one text cost
   about one path each, and never all pairs.

Nodes are 64-bit hashes of whole sets; among 10^8 different sets a clash has a chance of 0.03 %.

Nulls: a null text has an empty set; a null doc_id links like any other but names no component while
another id does.  Repeated rows are equal sets.  Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, documents, id_text, mix, sealed, unsealed, windows, word_hashes
from tidewire.llm.components import connected_components
from tidewire.llm.line_dedup import bounded_broadcast
from tidewire.session import materialize

SHINGLE = 4
#: Similarity, per cent, of op7.
PERCENT = 85
QUARTER = np.uint64(3)
BLOCK_NODES = 3000
BLOCK_SHINGLES = 3_000_000
#: Parts up to which a block is dealt as it is: a split is many short jobs.
WHOLE_PARTS = 4


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    # of bytes, lower() knows A-Z only
    ws = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else ()
    if not len(ws):
        return np.zeros(0, np.uint64)
    return np.unique(windows(ws, min(size, len(ws))))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def classes(n: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """The size class of a set of n shingles, the class's largest size and the next one's.  Linked
    sets are in one class or in neighbouring ones."""
    c, top = 0, 0
    while top < n:
        c, top = c + 1, 100 * (top + 1) // percent
    return c, top, 100 * (top + 1) // percent


def buckets(s: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, keep, hashes of whole buckets) of a set of n shingles, for the group of its size class and that
    of the next.  Linked sets x and y of a group differ in at most k = (100 - p) (n_x + n_y) / (100 + p) shingles and
    so in at most k of the group's buckets; under any one order of buckets they share one of their first k + 1 (keep)."""
    n, (c, *tops) = len(s), classes(len(s), percent)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
    for group, top in zip((c, c + 1), tops, strict=True):
        k = (100 - percent) * (n + min(100 * n // percent, top)) // (100 + percent)
        count = 3 * ((100 - percent) * 2 * top // (100 + percent)) // 2 + 1
        cuts = np.searchsorted(s >> np.uint64(32), (np.arange(count + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(count))
        number = np.arange(count, dtype=np.uint64) + (np.uint64(group) << np.uint64(32))
        yield group, k + 1, mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(number))


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, n, node, first, extra): a hash of the text, then the shingles that come
    first in the global order, and, where they are fewer than the prefix, those after them."""
    bounded_batches(docs.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingles(text, size)
                in_first = (s & QUARTER) == 0
                first, missing = s[in_first], max(0, prefix_length(len(s), percent) - int(in_first.sum())) if len(s) else 0
                rows.append((len(s), node_of(s), first.view(np.int64), s[~in_first][:missing].view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "node", "first", "extra"])
            yield out.assign(doc_id=pdf["doc_id"].array, h=pdf["h"].array)

    rows = sealed(id_text(docs)).withColumn("h", F.xxhash64("text"))
    made = rows.mapInPandas(build, "doc_id long, h long, n long, node long, first array<long>, extra array<long>")
    return unsealed(made).withColumn("node", F.when(F.col("n") > 0, F.col("node")))


def prefix_postings(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, node) of prefix shingles that two nodes or more hold; ``nodes``: node, n, first, extra."""
    keep = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("long") + 1
    return rare_postings(nodes.select("node", keep.alias("keep"), "first", "extra"))


def rare_postings(nodes: DataFrame) -> DataFrame:
    """(token, node) of the ``keep`` rarest of first, then of extra, that two nodes or more hold."""
    held = nodes.select("node", F.explode("first").alias("token")).repartition("token")
    shared = held.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    sizes = nodes.select("node", "keep", F.size("first").alias("k"), "extra")
    both = sizes.join(lists, "node", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<df:bigint,token:bigint>>")))
    # the shingles that only this node holds come first and match nothing
    room = F.col("keep") - (F.col("k") - F.size("shared"))
    both = both.withColumn("room", F.greatest(room, F.lit(0)).cast("int"))
    tokens = F.concat(F.transform(F.slice("shared", 1, F.col("room")), lambda x: x["token"]), F.col("extra"))
    posts = both.select("node", F.explode(tokens).alias("token"))
    return posts.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1").select("token", "node")


class Trie:
    """Prefix tree of token rank arrays; connects similar sets as they are added."""

    class Node:
        __slots__ = ("ends", "kids", "least", "most", "rest", "seg", "who")

        def __init__(self, seg, who):
            self.seg, self.kids, self.ends = seg, {}, []  # own ranks, children by first rank, sets that end here
            self.least, self.most, self.rest, self.who = 1 << 62, 0, 0, who  # sizes below, longest rest, a set of the only component

    def __init__(self, ranks: list[np.ndarray], sizes: list[int], total: int, percent: int = PERCENT):
        self.ranks, self.sizes, self.percent = ranks, sizes, percent
        self.up = list(range(len(sizes)))
        self.mark = np.zeros(total, bool)
        self.root = self.Node(np.zeros(0, np.int64), None)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def probe(self, x: int) -> None:
        """Connect x with every similar set in the tree that it isn't connected with."""
        xs, n, p = self.ranks[x], self.sizes[x], self.percent
        low, high = -(-p * n // 100), 100 * n // p
        self.mark[xs] = True
        stack = [(kid, 0) for kid in self.root.kids.values()]
        while stack:
            node, o = stack.pop()
            if node.most < low or node.least > high or (node.who is not None and self.find(node.who) == self.find(x)):
                continue
            o += int(np.count_nonzero(self.mark[node.seg]))
            rest = min(len(xs) - int(np.searchsorted(xs, node.seg[-1], "right")), node.rest)
            if (100 + p) * (o + rest) < p * (n + max(node.least, low)):
                continue
            for y in node.ends:
                if (100 + p) * o >= p * (n + self.sizes[y]):
                    a, b = self.find(x), self.find(y)
                    self.up[max(a, b)] = min(a, b)
            stack.extend((kid, o) for kid in node.kids.values())
        self.mark[xs] = False

    def add(self, x: int) -> None:
        xs, n, at, node, mine = self.ranks[x], self.sizes[x], 0, self.root, self.find(x)
        while at < len(xs):
            kid = node.kids.get(int(xs[at]))
            if kid is None:
                kid = self.Node(xs[at:], x)
                node.kids[int(xs[at])] = kid
                same = len(kid.seg)
            else:
                m = min(len(kid.seg), len(xs) - at)
                differ = np.flatnonzero(kid.seg[:m] != xs[at : at + m])
                same = int(differ[0]) if len(differ) else m
                if same < len(kid.seg):  # split the edge
                    top = self.Node(kid.seg[:same], kid.who)
                    top.least, top.most, top.rest = kid.least, kid.most, kid.rest + len(kid.seg) - same
                    kid.seg = kid.seg[same:]
                    top.kids[int(kid.seg[0])] = kid
                    node.kids[int(xs[at])] = kid = top
            at += same
            kid.least, kid.most, kid.rest = min(kid.least, n), max(kid.most, n), max(kid.rest, len(xs) - at)
            if kid.who is not None and self.find(kid.who) != mine:
                kid.who = None
            node = kid
        if len(xs):
            node.ends.append(x)


def join_block(all_sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """For each set of a block the number of the first set that it is connected with."""
    if not all_sets:
        return []
    tokens, where, counts = np.unique(np.concatenate(all_sets), return_inverse=True, return_counts=True)
    order = np.lexsort((tokens, -counts))
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(tokens))
    shared = int((counts > 1).sum())  # others only count in sizes
    cuts, ranks = np.cumsum([0, *map(len, all_sets)]), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        r = np.sort(rank[where[a:b]])
        ranks.append(r[r < shared])
    trie = Trie(ranks, [len(s) for s in all_sets], shared, percent)
    for x in range(len(all_sets)):
        trie.probe(x)
        trie.add(x)
    return [trie.find(x) for x in range(len(all_sets))]


def link_blocks(texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) that connect the linked nodes of each task; ``texts``: task columns, node, text."""
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {}
        for n, t in zip(pdf["node"], pdf["text"], strict=True):
            if n not in own and node_of(s := shingles(t, size)) == n:  # rows that repeat a doc_id bring other texts along
                own[n] = s
        node = np.array(sorted(own), np.int64)
        first = join_block([own[n] for n in node.tolist()], percent)
        return pd.DataFrame({"u": node, "v": node[first]})[lambda e: e["u"] != e["v"]]

    return texts.groupBy("block", "i", "j").applyInPandas(link, "u long, v long")


def blocks_of(postings: DataFrame) -> DataFrame:
    """(node, block) of the nodes that share tokens, directly or through others."""
    posts = materialize(postings, "ngram-postings")
    least = posts.groupBy("token").agg(F.min("node").alias("v"))
    blocks = connected_components(posts.join(least, "token").select(F.col("node").alias("u"), "v"), "ngram-blocks")
    return materialize(blocks.select("node", F.col("root").alias("block")), "ngram-block-nodes")


def with_parts(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, block, n, ...) and the parts that their block is dealt to."""
    sizes = nodes.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    return nodes.join(sizes, "block")


def bucket_postings(docs: DataFrame, wide: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(token, node) of rare buckets that two nodes or more of a block hold; ``wide``: node, block, doc_id, h."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for block, n, t in zip(pdf["block"], pdf["node"], pdf["text"], strict=True):
                if node_of(s := shingles(t, size)) == n:  # rows that repeat a doc_id bring other texts along
                    rows += [(block, n, group, keep, b.view(np.int64)) for group, keep, b in buckets(s, percent)]
            yield pd.DataFrame(rows, columns=["block", "node", "grp", "keep", "first"])

    once = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    asked = materialize(wide.select("doc_id", "h", "node", "block", once.alias("tasks")), "ngram-wide")
    made = fetch(docs, asked).select("block", "node", "text").mapInPandas(build, "block long, node long, grp long, keep long, first array<long>")
    made = made.groupBy("node", "grp").agg(*(F.first(c).alias(c) for c in ("block", "keep", "first")))
    tokens = F.transform("first", lambda t: F.xxhash64("block", t))
    none = F.array().cast("array<long>")
    sets = materialize(made.select(F.struct("node", "grp").alias("node"), "keep", tokens.alias("first"), none.alias("extra")), "ngram-buckets")
    return rare_postings(sets).select("token", F.col("node.node").alias("node"))


def rooted_rows(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, n, root) of every row: root names its component; null without words."""
    made = materialize(sets(docs, size, percent), "ngram-sets")
    nodes = made.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.first("extra").alias("extra"))
    blocks = blocks_of(prefix_postings(nodes, percent))
    owners = made.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("d"), F.first("n").alias("n"))
    mine = blocks.join(owners, "node").select("node", "block", "n", F.col("d.doc_id").alias("doc_id"), F.col("d.h").alias("h"))
    mine = materialize(with_parts(mine), "ngram-members")
    wide = mine.where(F.col("parts") > WHOLE_PARTS)
    if not wide.isEmpty():
        finer = blocks_of(bucket_postings(docs, wide, size, percent))
        split = wide.drop("block", "parts").join(finer, "node").select("node", "block", "n", "doc_id", "h")
        mine = mine.where(F.col("parts") <= WHOLE_PARTS).unionByName(with_parts(split))
    mine = mine.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("i"), F.greatest(q, F.col("part")).alias("j")))
    dealt = materialize(mine.select("doc_id", "h", "node", "block", pairs.alias("tasks")), "ngram-tasks")
    roots = connected_components(link_blocks(fetch(docs, dealt), size, percent), "ngram-links")
    rooted = made.select("doc_id", "h", "n", "node").join(roots, "node", "left")
    return materialize(rooted.select("doc_id", "h", "n", F.coalesce("root", "node").alias("root")), "ngram-rooted")


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rooted = rooted_rows(docs, size, percent)
    names = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(names, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that have the least doc_id (then text hash) of their component, with
    their own columns; of rows with the same doc_id and text, one."""
    rooted = rooted_rows(docs, size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
    first = rooted.where("n > 0").groupBy("root").agg(F.min(order).alias("first"))
    marked = rooted.where("n > 0").join(first, "root").groupBy("doc_id", "h").agg(F.max(order != F.col("first")).alias("go"), F.count("*").alias("times"))
    gone = materialize(marked.where("go").select("doc_id", "h"), "ngram-gone")
    again = materialize(marked.where("NOT go AND times > 1").select("doc_id", "h"), "ngram-repeated")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    same = [F.col("_id").eqNullSafe(F.col("k.doc_id")), F.col("_h") == F.col("k.h")]
    out = rows.join(bounded_broadcast(gone).alias("k"), same, "left_anti")
    if again.count():
        twice = bounded_broadcast(again).alias("k")
        out = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["_id", "_h"]))
    return out.select("_row.*")


def fetch(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """The text of each node's owner, once for each of its tasks.  Owners are known by their id and a hash of
    their text, so rows without an id meet their own nodes only."""
    own = dealt.select(F.col("doc_id").alias("_owner"), F.col("h").alias("_h"), "block", "tasks", "node")
    rows = id_text(docs).withColumn("h", F.xxhash64("text")).join(bounded_broadcast(own, dealt), F.col("doc_id").eqNullSafe(F.col("_owner")) & (F.col("h") == F.col("_h")))
    return rows.select("block", F.explode("tasks").alias("t"), "node", "text").select("block", "t.i", "t.j", "node", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the component of every document."""
    return components(documents(spark, sf_dir))
