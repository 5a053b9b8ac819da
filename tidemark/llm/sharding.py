"""Sharding by a k-d tree over document metadata, balanced by bytes.

Documents with equal texts form one group and never part.  The tree starts with
all groups and splits each node at a distributed weighted median along its widest
metadata dimension until every leaf has its share of the bytes.  A median is found
by radix refinement: histograms of 1,024 bins over the next ten bits of each
group's position, summed up per node in Spark; what reaches the driver, and is broadcast back, is one
row a node (``MAX_SHARDS`` leaves at most).  Each step is one pass over the narrow
group table.  Groups of over 1 % of a node's bytes stand first in its order, so the
cut falls among small groups and leaves end near equal even with hot copies.

Law: ``bytes``.  All work is done by DataFrame expressions.

Defined results
---------------
* null text: size 1, CRC-32 0, grouped with empty texts (whose size is also 1).
* null metadata, or a metadata column that the table lacks: position 0 on that dimension.
* null ids: position 0; rows keep the null.
* repeated rows and ties: rows of one text share a shard and get slots of their own;
  equal positions are ordered by the text's hash and never part.
* very long texts: whole; only their size and hashes are shuffled.
* empty table: empty result.
* a single group larger than a shard's share stays whole and makes its shard larger.
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import join_counted, table

BITS, STEPS = 10, 5
#: Rows of a shard that are ranked together for their slots, on average, and hash buckets at least.
SLOT_ROWS, SLOT_BUCKETS = 1_000_000, 256
#: Leaves of a tree; split the corpus by a column first for more.
MAX_SHARDS = 1 << 18


def _unit(c: Column, low, high) -> Column:
    span = float(high - low) if low is not None and high is not None and high > low else 1.0
    return F.coalesce((c.cast("double") - F.lit(float(low or 0))) / F.lit(span), F.lit(0.0))


def _per_node(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A broadcast table of one row a node, given as one literal."""
    text = F.lit(json.dumps(rows))
    return F.broadcast(spark.range(1).select(F.explode(F.from_json(text, f"array<struct<{fields}>>")).alias("x")).select("x.*"))


def _position(dims: list[str]) -> Column:
    """50 bits: hot groups first, then the node's widest dimension (place ``dim``), then the text's hash."""
    along = F.floor(F.get(F.array(*dims), F.col("dim")) * F.lit((1 << 20) - 1)).cast("long")
    spread = F.when(F.col("bytes") > F.col("hot"), F.lit(0)).otherwise(F.lit(1 << 20) + along)
    return F.shiftleft(spread.cast("long"), 29) + F.expr("shiftrightunsigned(h, 35)")


def _crossing(g: DataFrame, cuts: DataFrame, shift: int) -> DataFrame:
    """``node, bin, before, b``: of each node's bins behind its prefix the one where its bytes reach the goal, or the last."""
    inside = g.join(cuts, "node").filter(F.shiftright("pos", shift + BITS) == F.col("prefix"))
    bins = inside.groupBy("node", F.shiftright("pos", shift).alias("bin"), "below", "goal").agg(F.sum("bytes").alias("b"))
    # 1,024 rows a node at most
    run = F.sum("b").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    at = F.struct("bin", (F.col("run") - F.col("b")).alias("before"), "b")
    bins = bins.withColumn("run", run).groupBy("node").agg(F.min(F.when(F.col("below") + F.col("run") >= F.col("goal"), at)).alias("hit"), F.max(at).alias("end"))
    return bins.select("node", F.coalesce("hit", "end").alias("x")).select("node", "x.*")


def kd_tree(groups: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """``groups`` (``h`` long, ``bytes`` long, ``dims`` doubles in 0..1) with ``shard``."""
    if leaves > MAX_SHARDS:
        raise ValueError(f"{leaves} shards; a tree has {MAX_SHARDS} at most")
    spark = groups.sparkSession
    share = {0: (0, leaves)}  # node -> its first leaf, how many leaves
    g = groups.withColumn("node", F.lit(0).cast("long"))
    while any(n > 1 for _, n in share.values()):
        stats = {
            r["node"]: r
            for r in g.groupBy("node").agg(F.sum("bytes").alias("b"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()
        }
        live = [k for k, (_, n) in share.items() if n > 1 and k in stats]
        if not live:
            break
        wide = lambda k: max(range(len(dims)), key=lambda i: (stats[k][f"hi_{dims[i]}"] - stats[k][f"lo_{dims[i]}"], -i))
        plan = _per_node(spark, [{"node": k, "dim": wide(k), "hot": stats[k]["b"] // 100} for k in live], "node:long,dim:int,hot:long")
        g = g.join(plan, "node", "left").withColumn("pos", _position(dims)).drop("dim", "hot")
        # radix refinement of the cut: ``below`` bytes lie before ``prefix``
        cut = {k: {"node": k, "prefix": 0, "below": 0, "goal": stats[k]["b"] * (share[k][1] // 2) / share[k][1]} for k in live}
        for step in range(STEPS):
            cuts = _per_node(spark, list(cut.values()), "node:long,prefix:long,below:long,goal:double")
            for r in _crossing(g, cuts, BITS * (STEPS - 1 - step)).collect():
                c = cut[r["node"]]
                c["prefix"], c["below"] = r["bin"], c["below"] + r["before"]
                if step == STEPS - 1 and c["goal"] - c["below"] > c["below"] + r["b"] - c["goal"]:
                    c["prefix"] += 1  # the bin is nearer to the left
        cuts = _per_node(spark, [{"node": k, "cut": c["prefix"]} for k, c in cut.items()], "node:long,cut:long")
        child = 2 * F.col("node") + 1 + (F.col("pos") >= F.col("cut")).cast("long")
        g = table(g.join(cuts, "node", "left").withColumn("node", F.when(F.col("cut").isNotNull(), child).otherwise(F.col("node"))).drop("pos", "cut"))
        for k in live:
            first, n = share.pop(k)
            share[2 * k + 1], share[2 * k + 2] = (first, n // 2), (first + n // 2, n - n // 2)
    return g.join(_per_node(spark, [{"node": k, "shard": first} for k, (first, _) in share.items()], "node:long,shard:int"), "node").drop("node")


def shard_documents(df: DataFrame, shards: int = 8, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text",
                    metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``target_bytes`` in place of ``shards``: as many leaves as bring each to that size or less on average.
    ``metadata`` names string columns; they count by a hash, beside size and smallest id.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    there = {c.lower() for c in df.columns}
    docs = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("h"),
        F.substring(F.md5(t.cast("binary")), 1, 16).alias("m"),
        *[(F.crc32(F.coalesce(F.col(c).cast("string") if c.lower() in there else F.lit(""), F.lit("")).cast("binary")) / F.lit(float(1 << 32))).alias(f"x{i}") for i, c in enumerate(metadata)],
    )
    docs = table(docs)
    groups = docs.groupBy("h", "m").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min("size").alias("one"), *[F.min(f"x{i}").alias(f"x{i}") for i in range(len(metadata))]
    )
    groups = table(groups)
    r = groups.agg(F.min("first"), F.max("first"), F.min("one"), F.max("one"), F.sum("bytes"), F.sum("copies")).first()
    if target_bytes:
        shards = max(1, -(-int(r[4] or 0) // target_bytes))
    logs = F.log(F.col("one").cast("double"))
    lo, hi = (float(log(max(1, x))) for x in (r[2] or 1, r[3] or 1))
    placed = groups.select("h", "m", "copies", "bytes", _unit(F.col("first"), r[0], r[1]).alias("d0"), _unit(logs, lo, hi).alias("d1"), *[F.col(f"x{i}").alias(f"d{i + 2}") for i in range(len(metadata))])
    leaf = kd_tree(placed, [f"d{i}" for i in range(2 + len(metadata))], shards).select("h", "m", "copies", "shard")
    buckets = max(SLOT_BUCKETS, (r[5] or 0) // (shards * SLOT_ROWS))
    out = join_counted(docs, leaf, ["h", "m"], "copies").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    out = table(out.select("doc_id", "size", "text_crc32", "shard", "bucket"))
    # one row for SLOT_ROWS rows, shards x SLOT_BUCKETS at least
    counts = out.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    out = out.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(start), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


