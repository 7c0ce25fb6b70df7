"""Sharding by extendible hashing, in DataFrame operations alone.

A row's 100 bits are 40 of the MD5 of its key and then 60 of a hash of its text and of its number among the
rows of equal key and text, so that rows of one key, however many, can still be told apart. They don't depend
on how the table is partitioned. The directory is indexed by bit prefixes. A bucket is split on its next bit
only while it exceeds the byte limit and holds more than one row; so every shard fits, or is a single row
that alone exceeds the limit.

The directory is found from byte counts of prefixes, not by moving rows: one histogram of prefixes some bits
deeper than the average bucket, summed up over the levels just above; only prefixes that still fit at the
uppermost of these are summed up further, and only leaves that are still too large get a deeper histogram.
Equal rows are counted before they are numbered, and joins are of plain tables that Spark may split; nothing
is broadcast.

Defined results: a null key counts as the empty string and a null text as 0 bytes; repeated rows
are rows of their own; an empty table has no shards; other columns are ignored. Rows that share all 100 bits
stay together, with ``oversized`` true, as is a single row above the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import save, union

KEY_BITS, ROW_BITS, MORE_BITS = 40, 20, 40
#: Bits in the first and in both of the numbers that hold a row's bits.
HIGH = KEY_BITS + ROW_BITS
BITS = HIGH + MORE_BITS
#: Bits by which the histogram is deeper than an average bucket, by which it deepens at once, and levels summed up at once.
SPARE, STEP, LEVELS = 6, 8, 10
#: Equal rows numbered at once.
RUN = 1 << 16


def numbered(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, n_bytes, high, low) of each row."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(text).alias("h"))
    many = rows.groupBy("key", "n_bytes", "h").agg(F.count("*").alias("m"))
    runs = many.select("key", "n_bytes", "h", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {RUN}"))).alias("run"))
    last = F.least(F.col("m") - 1, F.col("run") * RUN + RUN - 1)
    # Most rows are their only one; the runs of many equal rows are dealt out before they are numbered.
    one = runs.where("m = 1").select("key", "n_bytes", "h", F.lit(0).cast("long").alias("number"))
    more = runs.where("m > 1").repartition("key", "h", "run").select("key", "n_bytes", "h", F.explode(F.sequence(F.col("run") * RUN, last)).alias("number"))
    of_key = F.conv(F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")
    of_row = F.xxhash64("h", "number")
    high = F.shiftleft(of_key, ROW_BITS).bitwiseOR(F.shiftrightunsigned(of_row, 64 - ROW_BITS))
    low = F.shiftrightunsigned(of_row, 64 - ROW_BITS - MORE_BITS).bitwiseAND((1 << MORE_BITS) - 1)
    return one.unionByName(more).select("key", "n_bytes", high.alias("high"), low.alias("low"))


def _prefix(depth: str, high: str = "high", low: str = "low"):
    """The first ``depth`` of the bits, as two numbers."""
    one = F.expr(f"shiftright({high}, greatest({HIGH} - cast({depth} as int), 0))")
    two = F.expr(f"if({depth} > {HIGH}, shiftright({low}, least({BITS} - cast({depth} as int), {MORE_BITS - 1})), 0L)")
    return one.alias("p1"), two.alias("p2")


def _upper(depth: str, of: int):
    """The first ``depth`` bits of a prefix (p1, p2) of ``of`` bits."""
    high, low = max(0, HIGH - of), max(0, min(MORE_BITS, BITS - of))
    return _prefix(depth, f"shiftleft(p1, {high})", f"shiftleft(p2, {low})" if of > HIGH else "0L")


def leaves(rows: DataFrame, limit: int) -> DataFrame:
    """(leaf_depth, p1, p2, depth, shard_bytes, shard_docs) of every leaf of the directory.

    A leaf is a prefix of leaf_depth bits whose bucket is its first ``depth`` bits. rows: n_bytes, high, low.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top, deep = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    found = []
    while True:
        sums = [F.sum("b").alias("b"), F.sum("n").alias("n")]
        nodes = save(rows.select(*_prefix(str(deep)), F.col("n_bytes").alias("b"), F.lit(1).cast("long").alias("n")).groupBy("p1", "p2").agg(*sums), "histogram")
        over, at = None, deep
        while True:
            low = max(top, at - LEVELS)
            levels = nodes.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(at)))).select(F.col("p1").alias("l1"), F.col("p2").alias("l2"), "b", "n", "d", *_upper("d", at))
            every = levels.groupBy("d", "p1", "p2").agg(*sums)
            fits = (F.col("b") <= limit) | (F.col("n") == 1)
            fits = fits | (F.col("d") == BITS) if at == BITS else fits
            best = F.min_by(F.struct("d", "b", "n"), "d").alias("x")
            chosen = levels.select("l1", "l2", "d", "p1", "p2").join(every.where(fits), ["d", "p1", "p2"]).groupBy("l1", "l2").agg(best)
            part = nodes.select(F.col("p1").alias("l1"), F.col("p2").alias("l2")).join(chosen, ["l1", "l2"], "left")
            part = save(part.select(F.lit(at).alias("leaf_depth"), F.col("l1").alias("p1"), F.col("l2").alias("p2"), F.col("x.d").alias("depth"), F.col("x.b").alias("shard_bytes"), F.col("x.n").alias("shard_docs")), "leaves")
            up = part.where(F.col("depth") == low) if low > top else part.where("false")
            if over is None:
                over = part.where("depth is null").select("p1", "p2")
            found.append(part.where(F.col("depth") > low) if low > top else part.where("depth is not null"))
            if low == top or up.isEmpty():
                break
            # These fit as a whole at the uppermost level: perhaps together with others above.
            nodes = save(up.select(*_upper(str(low), at), F.col("shard_bytes").alias("b"), F.col("shard_docs").alias("n")).distinct(), "upper")
            at = low
        if over.isEmpty():
            return union(found)
        rows = save(rows.select("n_bytes", "high", "low", *_prefix(str(deep))).join(over, ["p1", "p2"], "left_semi").select("n_bytes", "high", "low"), "oversized")
        top, deep = deep + 1, min(BITS, deep + STEP)


def assign_shards(df: DataFrame, limit: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, shard, depth, n_bytes, shard_bytes, shard_docs, oversized) of each row.

    shard is the bucket's bit prefix as a string of 0 and 1, empty for an undivided directory.
    """
    rows = save(numbered(df, key, text_col), "rows")
    tree = save(leaves(rows.select("n_bytes", "high", "low"), limit), "directory")
    depths = sorted(r[0] for r in tree.select("leaf_depth").distinct().collect())  # one per deepening, some dozens at most
    found = [rows.select("*", *_prefix(str(d))).join(tree.where(F.col("leaf_depth") == d).hint("merge"), ["p1", "p2"]) for d in depths or [0]]
    name = f"""CASE WHEN depth = 0 THEN '' WHEN depth <= {HIGH} THEN lpad(bin(shiftright(high, {HIGH} - depth)), depth, '0')
               ELSE concat(lpad(bin(high), {HIGH}, '0'), lpad(bin(shiftright(low, least({BITS} - depth, {MORE_BITS - 1}))), depth - {HIGH}, '0')) END"""
    return union(found).select(F.col("key").alias(key), F.expr(name).alias("shard"), F.col("depth").cast("int"), "n_bytes", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(df: DataFrame, path: str, limit: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes df under path, one folder ``shard=...`` of one file for each shard; keys must be distinct. Returns the assignment."""
    assigned = save(assign_shards(df, limit, key, text_col), "assigned")
    name = F.concat(F.lit("b"), F.col("shard"))
    df.join(assigned.select(key, name.alias("shard")), key).repartition("shard").write.partitionBy("shard").parquet(path)
    return assigned


def oracle(limit: int, key: str = "doc_id", levels: int = 40) -> str:
    """DuckDB SQL for assign_shards over documents with distinct keys that need ``levels`` bits at most."""
    return f"""
    WITH d AS (
      SELECT {key}, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
             CAST(('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 10)) AS BIGINT) AS bits FROM documents),
    l AS (SELECT d.{key}, d.n_bytes, g.depth, bits >> (40 - g.depth) AS p FROM d, (SELECT CAST(unnest(range({levels + 1})) AS INTEGER) AS depth) g),
    s AS (SELECT depth, p, sum(n_bytes) AS b, count(*) AS n FROM l GROUP BY 1, 2),
    c AS (SELECT l.{key}, l.n_bytes, l.depth, l.p, s.b, s.n FROM l JOIN s USING (depth, p) WHERE s.b <= {limit} OR s.n = 1
          QUALIFY row_number() OVER (PARTITION BY l.{key} ORDER BY l.depth) = 1)
    SELECT {key}, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard, depth, n_bytes,
           CAST(b AS BIGINT) AS shard_bytes, n AS shard_docs, b > {limit} AS oversized FROM c"""
