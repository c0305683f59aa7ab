"""Sharding (operator 2) by extendible hashing.

A directory is indexed by the leading bits of a row's hash; a bucket above the byte limit splits on one more bit while the
others stay as they are, until every shard fits. Rows are first summed into cells of ``STEP`` leading bits; every cell
adds to its prefixes of each length, and a shard is the shortest prefix that fits. Cells that are still too large go on with
their next bits. Rows of one whole hash cannot be told apart by bits: they fill numbered overflow pages of the limit each.
Only a row that is larger than the limit by itself makes a larger shard.

Defined results: a null text has no bytes; null doc_ids share one hash; repeated rows are placed one by one; an empty
table has no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, whole_text

#: Bytes of a shard at most.
LIMIT = 256 << 20
HASH_BITS = 60
#: Bits by which a round refines its buckets.
STEP = 12


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, h) of every row; h are the first 60 bits of the MD5 of doc_id in decimal."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    return rows.withColumn("h", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long"))


def _refine(cells: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of cells (prefix of ``high`` bits, bytes): shards (depth, prefix, shard_bytes) of low..high bits, and the cells too large at ``high``."""
    depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    sums = cells.select(depths, "prefix", "bytes").select("depth", F.expr(f"shiftright(prefix, {high} - depth)").alias("prefix"), "bytes").groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
    sums = cut(sums)
    over = sums.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = sums.where(F.col("shard_bytes") <= limit).withColumn("parent", F.shiftright("prefix", 1))
    first = fits.where(F.col("depth") == low).drop("parent")
    split = fits.where(F.col("depth") > low).join(over, ["depth", "parent"], "left_semi").drop("parent")
    return first.unionByName(split), sums.where((F.col("depth") == high) & (F.col("shard_bytes") > limit)).select("prefix")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, prefix, shard_bytes) of the shards of rows (h, n_bytes); hashes too large by themselves have depth 60 and all their bytes."""
    per_hash = rows.groupBy("h").agg(F.sum("n_bytes").alias("bytes"))
    low, high, live, out = 0, STEP, per_hash, None
    while True:
        cells = live.groupBy(F.shiftright("h", HASH_BITS - high).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        shards, large = _refine(cells, low, high, limit)
        out = shards if out is None else out.unionByName(shards)
        large = cut(large)
        if large.isEmpty():
            return out
        at_end = high == HASH_BITS
        live = live.join(large, F.shiftright("h", HASH_BITS - high) == F.col("prefix"), "left_semi")
        if at_end:
            return out.unionByName(live.groupBy(F.lit(HASH_BITS).alias("depth"), F.col("h").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes")))
        # A cell's own prefix was too large, so its parts begin one bit further on.
        low, high = high + 1, min(high + STEP, HASH_BITS)


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, shard_bytes) of every row of docs.

    shard is the hash prefix as a binary string ("" while one shard holds all), followed by "#page" for overflow pages.
    """
    rows = hashed(docs)
    shards = cut(directory(rows, limit))
    depths = [r.depth for r in shards.select("depth").distinct().collect()]  # at most 61 numbers
    if not depths:
        return rows.select("doc_id", "n_bytes", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes")).where("false")
    options = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", HASH_BITS - d).alias("prefix")) for d in sorted(depths)])
    # A row is in the one shard whose prefix it has: most rows are told by a lookup of each depth in use.
    placed = rows.groupBy("h").agg(F.count("*").alias("n")).select("h", F.explode(options).alias("x")).select("h", "x.depth", "x.prefix").join(shards, ["depth", "prefix"]).select(F.col("h").alias("at"), "depth", "prefix", "shard_bytes")
    named = rows.join(placed, F.col("h") == F.col("at")).withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')")))
    fit = named.where(F.col("shard_bytes") <= limit).select("doc_id", "n_bytes", "shard", "shard_bytes")
    # Rows of one hash above the limit: equal rows are counted, counts are cut into pages, and pages give their rows back.
    rest = named.where(F.col("shard_bytes") > limit).groupBy("shard", "doc_id", "n_bytes").agg(F.count("*").alias("n"))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), "n_bytes")).cast("long"))
    pages = rest.withColumn("per_page", per_page).select("*", F.explode(F.expr("sequence(0L, cast(floor((n - 1) / per_page) as bigint))")).alias("page")).repartition("shard", "doc_id", "n_bytes", "page")
    paged = pages.withColumn("rows", F.least("per_page", F.col("n") - F.col("page") * F.col("per_page"))).select(
        "doc_id", "n_bytes", F.concat_ws("#", "shard", F.concat_ws(".", F.col("n_bytes").cast("string"), F.col("page").cast("string"))).alias("shard"), (F.col("rows") * F.col("n_bytes")).alias("shard_bytes"), F.explode(F.expr("sequence(1L, rows)")).alias("copy")
    )
    return fit.unionByName(paged.drop("copy"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write docs as Parquet, a folder per shard; each shard is written by the task of its name.

    Where doc_id is not unique, its rows go together into the shard of the first of them.
    """
    shards = assign(docs, limit).groupBy(F.col("doc_id").alias("__doc")).agg(F.min("shard").alias("shard"))
    out = docs.drop("shard").join(shards, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc"))).drop("__doc")
    out.repartition("shard").write.partitionBy("shard").parquet(path)
