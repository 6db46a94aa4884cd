"""Line dedup (operator 8): exact set-similarity join of lines, in DataFrame functions.

A line's tokens are its distinct lowered words.  A line goes when an earlier line
(by document, see below, then line number) has a Jaccard similarity of THRESHOLD or more with it;
an earlier line counts whether or not it stays itself.  Lines without a word
always stay and match nothing.

1. Tokens are ordered by rarity: the frequency class of the token's hash bucket over the
   whole corpus (``BUCKETS`` counts, whatever its size), then the token's hash.  Any one order keeps
   the join exact; a rarer prefix only makes it cheaper.
2. Of equal sets all but the first line go.
3. Prefix filter: similar sets of sizes n share a token among their first
   n - ceil(t n) + 1.  In each token's group, in the order of the lines, a line first meets the
   ``LEADERS`` lines that come first.  Pairs that pass the length, positional and bitmap filters are verified on
   whole sets.  (Bitmap: each token flips one of 64 bits, of 128 in large sets; two sets differ in
   no fewer tokens than their bitmaps do in bits.)
4. Lines that are similar to none of them meet all other earlier lines of their groups.  A line that goes needs one
   similar line and no more, so a family of near copies costs a few pairs a line, in whichever of its
   groups a member leads, and no pair is left out for a line that stays.

Nulls: a null text stays null; a null doc_id comes first.  Rows that share a doc_id, or have none, are
rows of their own, ordered by a hash of their text; of rows with the same doc_id and text all but one
lose every line with a word.  Empty tables give empty results.  ``dedup_lines`` keeps other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import SPACES, documents, split_words
from tidewire.session import dematerialize, materialize, written_bytes

THRESHOLD = 0.8
BUCKETS = 1 << 18
LEADERS = 3
#: Sets of so many tokens have a bitmap of 128 bits; smaller ones tell apart by 64.
LONG = 60
#: Bytes of Parquet up to which a written table of line places is broadcast; beyond, it is shuffled.
BROADCAST_BYTES = 16 << 20
MIN_ID = -(1 << 63)


def bounded_broadcast(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Broadcast a written table (or ``df``, that is ``table`` under other names) if its files are small; else
    leave the join to Spark."""
    return F.broadcast(df) if written_bytes(df if table is None else table) <= BROADCAST_BYTES else df


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line of (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def rarity(docs: DataFrame) -> Column:
    """Foldable array: frequency class (binary logarithm) of each bucket's tokens.
    A token's bucket is its hash's low bits.  The classes stand in one plan, that of ``keyed_lines``."""
    h = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")
    n = docs.select(F.explode(F.split(F.lower("text"), f"[{SPACES}]", -1)).alias("w")).where("w <> ''").groupBy(h).agg(F.floor(F.log2(F.count("*"))).cast("int").alias("c"))
    classes = [0] * BUCKETS
    for b, c in n.toLocalIterator():  # at most BUCKETS rows
        classes[b] = c
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")


def token_set(line: Column, classes: Column) -> Column:
    """Distinct tokens as longs, rarest first: class in the top 7 bits, then 57 bits of hash."""
    hashes = F.transform(split_words(F.lower(line)), lambda w: F.xxhash64(w))

    def key(h: Column) -> Column:
        c = F.coalesce(F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("long"))  # never null: so longs are sorted, not objects
        return F.shiftleft(c, 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    return F.sort_array(F.transform(F.array_distinct(hashes), key))


def parity(keys: Column) -> Column:
    """Bitmap of 64 bits: each token flips one."""
    one = F.lit(1).cast("long")
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int"))))


def keyed_lines(docs: DataFrame, classes: Column) -> DataFrame:
    """(doc_id, line_no, n, h1, h2, bits, high, prefix) of every line with a word; from LONG
    tokens on, half of the tokens flip bits of ``high`` instead of ``bits``."""
    # a filter on the set itself would be moved below the columns, and each set made twice
    worded = explode_lines(docs).where(F.col("line").rlike(f"[^{SPACES}]"))
    lines = worded.withColumn("keys", token_set(F.col("line"), classes)).drop("line").withColumn("n", F.size("keys"))
    lines = lines.withColumn("high", F.when(F.col("n") >= LONG, parity(F.filter("keys", lambda k: k.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long")))
    prefix = F.slice("keys", 1, F.col("n") - F.ceil(F.lit(THRESHOLD) * F.col("n") - 1e-9).cast("int") + 1)
    return lines.select("doc_id", "line_no", "n", F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(7), "keys").alias("h2"), parity(F.col("keys")).bitwiseXOR(F.col("high")).alias("bits"), "high", prefix.alias("prefix"))


def needed_overlap(n: Column, m: Column) -> Column:
    """Least intersection of sets of n and m tokens with the wanted similarity."""
    return F.ceil(F.lit(THRESHOLD) * (n + m) / (1 + THRESHOLD) - 1e-9)


def may_match(x: Column, y: Column) -> Column:
    """Length, positional and bitmap filters of postings x and y that share a token, x at
    an earlier place."""
    need = needed_overlap(x["n"], y["n"])
    bits, high = x["bits"].bitwiseXOR(y["bits"]), x["high"].bitwiseXOR(y["high"])
    long = F.least(x["n"], y["n"]) >= LONG  # else one of them has a single bitmap
    differ = F.when(long, F.bit_count(bits) + F.bit_count(high)).otherwise(F.bit_count(bits.bitwiseXOR(high)))
    return ((F.least(x["n"], y["n"]) >= THRESHOLD * F.greatest(x["n"], y["n"]) - 1e-9)
            & (1 + F.least(x["n"] - x["i"] - 1, y["n"] - y["i"] - 1) >= need) & (differ <= x["n"] + y["n"] - 2 * need) & (x["at"] < y["at"]))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (x: place of the earlier line, y: of the later) that are similar, by
    their whole sets.  Lines are fetched by their places."""
    pairs = materialize(pairs, "line-pairs")
    places = materialize(pairs.select("x.*").union(pairs.select("y.*")).distinct(), "line-places")
    wanted = bounded_broadcast(materialize(places.groupBy("doc_id").agg(F.collect_set("line_no").alias("nos")), "line-docs"))
    lines = explode_lines(docs.join(wanted, "doc_id").select("doc_id", "text"))
    keyed = lines.join(bounded_broadcast(places), ["doc_id", "line_no"]).select("doc_id", "line_no", F.array_distinct(F.transform(split_words(F.lower("line")), lambda w: F.xxhash64(w))).alias("keys"))
    sets = materialize(keyed.groupBy("doc_id", "line_no").agg(F.collect_set("keys").alias("sets")), "line-sets")
    side = lambda s: sets.select(F.struct("doc_id", "line_no").alias(s), F.col("sets").alias(f"{s}_sets"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")

    def similar(a: Column, b: Column) -> Column:
        inter = F.size(F.array_intersect(a, b))
        return inter >= needed_overlap(F.size(a), F.size(b))

    return both.where(F.exists("x_sets", lambda a: F.exists("y_sets", lambda b: similar(a, b)))).select("x", "y")


def met_postings(firsts: DataFrame) -> DataFrame:
    """(token, p: place, size, position and bitmaps, rank, x) of prefix tokens of lines that a line of other tokens can be
    similar to.  rank: the posting's number in its token's group, in the order of the lines.  A posting has a row for each of the
    group's leaders that it may match, x: the leader's place, and one without x if it is not among the leaders itself; so
    tokens of one line have none."""
    pairable = F.floor(F.col("n") / THRESHOLD + 1e-9) > F.col("n")
    rows = firsts.where(pairable).select(F.posexplode("prefix").alias("i", "token"), "doc_id", "line_no", "n", "bits", "high")
    at = F.struct("doc_id", "line_no")  # made behind the exchange, which carries plain columns
    posts = rows.repartition("token").select("token", F.struct(at.alias("at"), "n", "i", "bits", "high").alias("p"))
    group = Window.partitionBy("token").orderBy("p.at")
    leaders = (F.nth_value("p", k + 1).over(group.rowsBetween(Window.unboundedPreceding, 0)).alias(f"leader{k}") for k in range(LEADERS))
    ranked = posts.select("token", "p", F.row_number().over(group).alias("rank"), *leaders)
    # rows, not array functions: the filters of pairs are compiled once and run once a pair
    each = ranked.select("token", "p", "rank", F.posexplode(F.array(*(f"leader{k}" for k in range(LEADERS)), F.lit(None))).alias("k", "x"))
    own = (F.col("k") == LEADERS) & (F.col("rank") > LEADERS)
    return each.where(own | ((F.col("k") < F.col("rank") - 1) & may_match(F.col("x"), F.col("p")))).select("token", "p", "rank", F.col("x.at").alias("x"))


def similar_firsts(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """(y, x): places of lines and of an earlier line that is similar to them, the first of those found.
    ``posts``: the written ``met_postings`` of keyed lines, one for each distinct set."""
    led = posts.where("x IS NOT NULL").select("x", F.col("p.at").alias("y")).distinct()
    one = materialize(verified(led, docs), "line-matches")
    # lines that are similar to no leader: against all other earlier lines
    gone = materialize(one.select("y.*").distinct().withColumn("gone", F.lit(True)), "line-matched")
    rest = posts.where("x IS NULL").select("token", "rank", "p.at.*", "p.n", "p.i", "p.bits", "p.high")
    marked = rest.join(bounded_broadcast(gone), ["doc_id", "line_no"], "left")
    # ``rank`` tells as well whether a line is open: so both sides of the join read the same columns, and share one exchange
    marked = marked.select("token", (F.col("rank") * 2 + F.col("gone").isNull().cast("int")).alias("rank"), "doc_id", "line_no", "n", "i", "bits", "high").repartition("token")
    p = F.struct(F.struct("doc_id", "line_no").alias("at"), "n", "i", "bits", "high").alias("p")
    x, y = (marked.select("token", "rank", p).alias(s) for s in "xy")
    later = F.shiftright("x.rank", 1) < F.shiftright("y.rank", 1) * F.col("y.rank").bitwiseAND(F.lit(1))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & later & may_match(F.col("x.p"), F.col("y.p")))
    two = verified(pairs.select(F.col("x.p.at").alias("x"), F.col("y.p.at").alias("y")).distinct(), docs)
    return one.unionByName(two).groupBy("y").agg(F.min("x").alias("x"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no) of the lines that go; ``docs``: (doc_id, text), where doc_id is a key
    that no two rows share: a long, or the struct of ``keyed_rows``."""
    classes = rarity(docs)
    lines = materialize(keyed_lines(docs, classes), "keyed-lines")
    at = F.struct("doc_id", "line_no")
    first = lines.groupBy("h1", "h2").agg(F.min(at).alias("first"))
    again = materialize(lines.select("doc_id", "line_no", "h1", "h2").join(first, ["h1", "h2"]).where(at > F.col("first")).select("doc_id", "line_no").distinct(), "equal-lines")
    firsts = lines.join(bounded_broadcast(again), ["doc_id", "line_no"], "left_anti")
    posts = materialize(met_postings(firsts), "line-postings")
    dematerialize(lines)
    best = similar_firsts(posts, docs).select("y.doc_id", "y.line_no")
    # lines equal to an earlier line, and first lines of their set that are similar to an earlier line
    return again.union(best).distinct()


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(_row: the row itself, _key, text, _again) of every row of ``docs``.  _key: the doc_id, or,
    where ids repeat, (doc_id, hash of the text); _again: an earlier row has this _key."""
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_ID)), F.col("text").cast("string")
    repeats = not docs.groupBy(key.alias("id")).count().where("count > 1").isEmpty()
    if repeats:
        key = F.struct(key.alias("id"), F.xxhash64(text).alias("h"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), key.alias("_key"), text.alias("text"))
    once = rows.withColumn("_again", F.lit(False))
    if not repeats:
        return once
    pairs = materialize(rows.groupBy("_key").count().where("count > 1").select("_key"), "line-pairs-of-rows")
    if pairs.isEmpty():
        return once
    pairs = bounded_broadcast(pairs)
    # numbered in a written table, so every read sees the same row first
    twins = materialize(rows.join(pairs, "_key", "left_semi").withColumn("_n", F.monotonically_increasing_id()), "line-twins")
    first = materialize(twins.groupBy("_key").agg(F.min("_n").alias("_first")), "line-first-twins")
    twins = twins.join(bounded_broadcast(first), "_key").withColumn("_again", F.col("_n") > F.col("_first"))
    return once.join(pairs, "_key", "left_anti").unionByName(twins.select("_row", "_key", "text", "_again"))


def gone_lists(rows: DataFrame) -> DataFrame:
    """(doc_id: _key, gone: line numbers, ascending) of the keys of ``keyed_rows`` that lose a line."""
    docs = rows.where("NOT _again").select(F.col("_key").alias("doc_id"), "text")
    return materialize(removed_lines(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("gone")), "removed-lines")


def per_document(docs: DataFrame) -> DataFrame:
    """(doc_id: key of the row, gone: line numbers, ascending) of the documents that lose a line."""
    return gone_lists(keyed_rows(docs))


def worded_lines(text: Column) -> Column:
    """Numbers of the lines with a word; null without any."""
    at = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.size(split_words(x)) > 0, i))
    at = F.filter(at, lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, at)


def keep_lines(text: Column, gone: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(lines, "\n"))


def with_gone(docs: DataFrame) -> DataFrame:
    """(_row: the row itself, text, gone) of every row of ``docs``."""
    rows = keyed_rows(docs)
    lists = gone_lists(rows)
    gone = bounded_broadcast(lists.withColumnRenamed("doc_id", "_key"), lists)
    mine = F.when(F.col("_again"), worded_lines(F.col("text"))).otherwise(F.col("gone"))
    return rows.join(gone, "_key", "left").select("_row", "text", mine.alias("gone"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the lines that go; documents that lose their last word go too."""
    out = with_gone(docs).withColumn("text", keep_lines(F.col("text"), F.col("gone")))
    if drop_emptied:
        out = out.where(F.col("gone").isNull() | F.col("text").rlike(f"[^{SPACES}]"))
    return out.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: for each document its lines, the numbers of those that go, and the text left."""
    out = with_gone(documents(spark, sf_dir).select("doc_id", "text")).withColumn("doc_id", F.col("_row.doc_id").cast("long"))
    left = keep_lines(F.col("text"), F.col("gone"))
    return out.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"), F.sha2(F.coalesce(left, F.lit("")).cast("binary"), 256).alias("text_sha256"))
