"""Sharding (operator 4): hierarchical weighted hash tree.

Shards sit in racks, racks in regions.  A row descends region, rack and shard: at
each node every child draws ``-ln(u) / weight`` from a hash of (doc_id, child) and
the smallest draw wins.  A child whose weight grows can only win rows, one whose
weight shrinks can only lose rows, and nothing moves among children whose weights
stay: movement is confined to the subtrees whose weights change.

Law ``key``: doc_id and the tree decide.  ``grow`` hangs every new shard into a
region of its own under the root, so no other subtree's weight changes and the new
shard is the only place that takes rows.

Nulls: a null doc_id is a key like any other; a null text has no bytes (size 16,
crc 0).  Rows that repeat a doc_id go to the same shard; rows alike in doc_id, crc and size
take neighbouring slots.  Ties between draws go to the smaller child.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewire.llm.common import documents, id_text
from tidewire.session import materialize

SHARDS, REGIONS, RACKS = 40, 4, 2
ROW_BYTES = 16
#: Rows that one slot-numbering bucket holds on average.
BUCKET_ROWS = 50_000
#: Copies of a row that one array lists when they are written out again.
RUN = 100_000

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]


def tree(shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> Tree:
    """Equal weights; shards are dealt evenly over racks."""
    out: Tree = {}
    for s in range(shards):
        rack = s * regions * racks // shards
        out.setdefault(rack // racks, {}).setdefault(rack, {})[s] = 1.0
    return out


def grow(t: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and rack of its own."""
    region = 1 + max(t, default=-1)
    rack = 1 + max((r for racks in t.values() for r in racks), default=-1)
    return {**t, region: {rack: {shard: weight}}}


def _draw(key, level: str, children: list[tuple[int, float]]):
    """The child with the smallest weighted draw."""
    def one(child: int, weight: float):
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{level}{child}"))), 1, 12), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / float(1 << 48)) / weight).alias("draw"), F.lit(child).alias("child"))

    live = [(c, w) for c, w in children if w > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.least(*(one(c, w) for c, w in live))["child"]


def place(df: DataFrame, t: Tree, to: str, id_col: str = "doc_id") -> DataFrame:
    """Add column ``to``: the shard of each row."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    weight = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in t.items()}
    df = df.withColumn("_region", _draw(key, "region", [(r, sum(w.values())) for r, w in weight.items()]))
    rack = shard = F.lit(None).cast("int")
    for r, racks in t.items():
        rack = F.when(F.col("_region") == r, _draw(key, "rack", list(weight[r].items()))).otherwise(rack)
    df = df.withColumn("_rack", rack)
    for racks in t.values():
        for k, shards in racks.items():
            shard = F.when(F.col("_rack") == k, _draw(key, "shard", list(shards.items()))).otherwise(shard)
    return df.withColumn(to, shard.cast("int")).drop("_region", "_rack")


@F.pandas_udf(LongType())
def crc32_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")) if t else 0).astype("int64")


def slots(df: DataFrame, shard: str, order: list[str], rows: int) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard.  Equal rows are counted first and
    written out again at the end in runs of bounded length, so no task holds a hot row's copies;
    different ones are numbered in hash buckets of bounded size, whose offsets come from the table
    of bucket counts."""
    buckets = 1 + rows // BUCKET_ROWS
    kept = df.columns
    df = df.groupBy(*kept).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_all"))
    ahead = counts.select(F.col(shard), "_bucket", (F.sum("_all").over(Window.partitionBy(shard).orderBy("_bucket")) - F.col("_all")).alias("_ahead"))
    inside = F.sum("_n").over(Window.partitionBy(shard, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    df = df.withColumn("_first", inside).join(ahead, [shard, "_bucket"]).withColumn("_first", F.col("_first") + F.col("_ahead"))
    runs = df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    at = F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN, F.col("_n")) - 1))
    return runs.withColumn("_at", at).select(*kept, (F.col("_first") + F.col("_at")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, t: Tree, grown: Tree) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = id_text(docs).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
                                crc32_text("text").alias("text_crc32"), F.lit("key").alias("law"))
    rows = materialize(place(place(rows, t, "shard"), grown, "grown_shard"), "shards")
    out = slots(rows, "shard", ["doc_id", "text_crc32", "size"], rows.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents into 40 shards, and where 41 would put them."""
    t = tree()
    return shard_documents(documents(spark, sf_dir), t, grow(t, SHARDS))
