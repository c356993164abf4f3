"""Exact dedup by deterministic block naming (DataFrame operations only).

A normalised text is cut into blocks of a fixed number of bytes.  Equal blocks get
the same integer name, different blocks different ones; then adjacent pairs of names
are named in the same way, level by level, until each document has one integer.  Two
documents with the same number of blocks have the same integer exactly if their texts
are the same, so no hash collision can merge different texts.

How a name is given: the distinct (digest, block) rows are formed with a map-side
combine, so a block that a third of all rows hold is sent once a task.  A digest that
covers one block only is that block's sort key, and rows fetch the name by the digest.
A digest that covers several different blocks is resolved by the block itself.
Digests only carry the rows to their name; equality is always decided on the bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.storage import dropped, need, read_table, written

BLOCK_BYTES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null is empty; only A-Z is lower-cased.  For pure ASCII ``lower`` does just that."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _numbered(keys: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """A distinct integer ``name`` for each row of ``keys``: position in its bucket, then bucket.

    Rows are sorted inside many buckets, never in one task."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    return (
        keys.withColumn("_bucket", bucket)
        .withColumn("name", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)).cast("long") * buckets + F.col("_bucket"))
        .drop("_bucket")
    )


def block_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest=F.xxhash64, buckets: int = 4096) -> DataFrame:
    """(doc_id, text_sha256, n_blocks, identity) for each row of ``docs``.

    ``digest`` maps a block to a long; any function gives right results, a poor one only
    sends more blocks through the second way (the tests use a constant-like one)."""
    need(docs, "doc_id", "text")
    text = docs.select("doc_id", normalised(F.col("text")).alias("_text")).select("doc_id", F.col("_text"), F.encode("_text", "UTF-8").alias("_bytes"))
    n = F.greatest(F.ceil(F.length("_bytes") / F.lit(block_bytes)), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = text.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", F.sha2("_bytes", 256).alias("text_sha256"), n.alias("n_blocks"), cut.alias("_cut"))
    # The row number is fixed by writing it before anything refers to it.
    heads = written(rows.select("_rid", "doc_id", F.unhex("text_sha256").alias("_sha"), "n_blocks", F.transform("_cut", lambda b: digest(b)).alias("_digests")), "blocks")
    distinct = text.select(F.explode(cut).alias("_block")).select(digest(F.col("_block")).alias("_digest"), "_block").distinct()
    many = written(distinct.groupBy("_digest").agg(F.count(F.lit(1)).alias("_variants")), "digests")
    names = written(_numbered(many.select("_digest", "_variants"), ["_digest"], buckets), "names")

    parts = heads.select("_rid", "n_blocks", F.posexplode("_digests").alias("_pos", "_digest"))
    at = parts.join(names, "_digest", "left").select("_rid", "n_blocks", "_pos", "name", "_digest", "_variants")
    extra: list[DataFrame] = [heads, many, names]
    clashes = many.where("_variants > 1")
    if not clashes.isEmpty():
        at = written(at, "named")
        extra.append(at)
        # Blocks under a shared digest: named by their bytes, above all names given so far.
        top = names.agg(F.max("name")).first()[0] + 1
        shared = distinct.join(clashes.select("_digest"), "_digest", "left_semi")
        by_bytes = _numbered(shared, ["_digest", "_block"], buckets).withColumn("name", F.col("name") + top)
        # Positions are found again by the whole text's digest list, so rows need no stable order.
        keyed = docs.select(normalised(F.col("text")).alias("_text")).select(F.encode("_text", "UTF-8").alias("_bytes")).distinct()
        blocks = keyed.select(F.unhex(F.sha2("_bytes", 256)).alias("_sha"), F.posexplode(cut).alias("_pos", "_block")).select("_sha", "_pos", "_block", digest(F.col("_block")).alias("_digest"))
        found = blocks.join(by_bytes, ["_digest", "_block"]).select("_sha", "_pos", F.col("name").alias("_by_bytes"))
        at = (
            at.join(heads.select("_rid", "_sha"), "_rid")
            .join(found, ["_sha", "_pos"], "left")
            .select("_rid", "n_blocks", "_pos", F.coalesce("_by_bytes", "name").alias("name"))
        )
    level = written(at.select("_rid", "n_blocks", "_pos", "name"), "level")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done = level.where("n_blocks = 1").select("_rid", F.col("name").alias("identity"))
    finished = [done]
    extra.append(level)
    for depth in range(1, math.ceil(math.log2(most)) + 1 if most > 1 else 1):
        # A document with b blocks has one name after ceil(log2(b)) levels.
        left = level.where(F.col("n_blocks") > F.lit(1 << (depth - 1)))
        pairs = left.groupBy("_rid", "n_blocks", F.expr("_pos div 2").cast("int").alias("_pos")).agg(
            F.max(F.when(F.col("_pos") % 2 == 0, F.col("name"))).alias("_a"), F.coalesce(F.max(F.when(F.col("_pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("_b")
        )
        pairs = written(pairs, "pairs")
        named = written(_numbered(pairs.select("_a", "_b").distinct(), ["_a", "_b"], buckets), "names")
        level = written(pairs.join(named, ["_a", "_b"]).select("_rid", "n_blocks", "_pos", "name"), "level")
        finished.append(level.where((F.col("n_blocks") > F.lit(1 << (depth - 1))) & (F.col("n_blocks") <= F.lit(1 << depth))).select("_rid", F.col("name").alias("identity")))
        extra += [pairs, named, level]
    identity = finished[0]
    for part in finished[1:]:
        identity = identity.unionByName(part)
    out = heads.select("_rid", "doc_id", F.lower(F.hex("_sha")).alias("text_sha256"), "n_blocks").join(identity, "_rid").drop("_rid")
    out = written(out, "identities")
    dropped(*extra)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_blocks, identity.

    Of equal texts (null is empty, A-Z lower-cased) the row with the largest doc_id stays.
    Repeated rows of that doc_id all carry ``kept``; a null doc_id stays only if its whole
    group has none.  Other columns of the input are not read.  Empty table: empty result."""
    rows = block_identities(docs, block_bytes, digest)
    groups = rows.groupBy("n_blocks", "identity").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A text that occurs once needs no look-up; the table of the others is joined with skew handling.
    shared = written(groups.where("group_size > 1"), "groups")
    out = rows.join(shared, ["n_blocks", "identity"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        F.col("n_blocks").cast("long").alias("n_blocks"),
        "identity",
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("n_blocks", "identity")


SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
