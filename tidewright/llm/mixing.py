"""Mixing sources to target weights by temperature (DataFrame operations only).

A source's share of tokens is raised to an exponent and normalised.  The exponent is found
by bisection so that the weights meet a target: a given entropy, or the largest flattening
under which no source is repeated more often than a limit.  The weights and a budget give
each source a number of tokens, realised as permutations of the source's blocks: whole
passes over all blocks, then blocks in an order keyed by (seed, source, pass), then single
documents of the block in which the budget ends.

Documents of a source are dealt into blocks by a keyed hash, so a source with a third of all
rows is many groups; block totals are summed in slices, and only slice totals meet in a source's window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.storage import need, read_table, written

BLOCK_TOKENS = 1 << 18
REPEAT_LIMIT = 2.0
SEED = 20
#: The exponent is known to FAN to the power of minus STEPS.
STEPS, FAN = 8, 32
SLICE = 4096


def token_count(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _low_enough(shares: DataFrame, exponents: list[float], ends, target_entropy, repeat_limit, budget, total) -> list[bool]:
    """For each exponent whether it can go down further: one pass over the sources, a row an exponent comes back.

    Raised to an exponent a of at most 1, the largest share is passed through least, the smallest most often."""
    raised = shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("x", F.pow("p", "a"))
    sums = raised.groupBy("a").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.log2("p")).alias("l")).collect()
    out = {}
    for r in sums:
        most = ends[0] ** (r["a"] - 1) / r["s"]
        passes = most * budget / total if budget is not None else (ends[0] / ends[1]) ** (r["a"] - 1)
        entropy = math.log2(r["s"]) - r["a"] / r["s"] * r["l"]
        out[r["a"]] = entropy < target_entropy if target_entropy is not None else passes <= repeat_limit
    return [out[a] for a in exponents]


def mixing_weights(sources: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT, budget: int | None = None, steps: int = STEPS) -> DataFrame:
    """(source, tokens, share, alpha, weight, budget_tokens, epochs) from (source, tokens).

    ``target_entropy`` in bits: the exponent in [0, 1] whose weights have that entropy (the
    nearest end if none has).  Else the smallest exponent under which no source gets more than
    ``repeat_limit`` passes.  ``budget``: total tokens; null means just as many as let every
    source be passed through at least once, so that no document is lost.  Sources without a
    token get weight 0 and one pass.  The exponent is bisected ``FAN`` ways a step; sources stay a
    distributed table, however many they are."""
    need(sources, "source", "tokens")
    live = sources.where("tokens > 0")
    known = live.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    lo, hi = 0.0, 1.0
    total = known["t"] or 1
    ends = ((known["least"] or 1) / total, (known["most"] or 1) / total)
    shares = live.withColumn("p", F.col("tokens") / F.lit(total))
    if known["t"] and (target_entropy is not None or repeat_limit is not None):
        for _ in range(steps):
            tried = [lo + (hi - lo) * k / FAN for k in range(FAN)]
            low = _low_enough(shares, tried, ends, target_entropy, repeat_limit, budget, total)
            if low[0]:
                hi = lo
                break
            k = max(i for i, x in enumerate(low) if not x)
            lo, hi = tried[k], tried[k + 1] if k + 1 < FAN else hi
    alpha = hi
    norm = shares.agg(F.sum(F.pow("p", F.lit(alpha)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(alpha)) / F.lit(norm)).otherwise(0.0)
    # Passes through the largest source, if no budget is given, are exactly one.
    unit = F.lit(float(budget)) / F.lit(total) / F.lit(norm) if budget is not None else F.lit(float(ends[1] ** (1 - alpha)))
    epochs = F.when(F.col("tokens") > 0, F.greatest(F.pow(F.col("tokens") / F.lit(total), F.lit(alpha - 1)) * unit, F.lit(0.0 if budget is not None else 1.0))).otherwise(1.0)
    out = sources.select("source", "tokens", (F.col("tokens") / F.lit(total)).alias("share"), F.lit(alpha if known["t"] else None).cast("double").alias("alpha"), weight.alias("weight"), epochs.alias("epochs"))
    return out.withColumn("budget_tokens", F.round(F.col("epochs") * F.col("tokens")).cast("long"))


def mix(docs: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``docs`` with n_tokens, alpha, weight, epochs and copies: how often each row is taken.

    Rows need doc_id, text, source; a null source is a source of its own, a null text has no
    token.  Whole passes give every row of a source ``floor(epochs)`` copies; the rest of the
    budget goes to whole blocks in keyed order and, in the block where it ends, to rows in keyed
    order while the running sum is within it.  Repeated rows are dealt like others; the order of
    rows that agree in doc_id and text is that of nothing else, so they count as one sum.
    Columns of the added names are replaced.  Empty table: empty result."""
    need(docs, "doc_id", "text", "source")
    added = ["n_tokens", "alpha", "weight", "epochs", "copies"]
    rows = docs.drop(*added).withColumn("n_tokens", token_count(F.col("text")))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    # One narrow table holds what all later steps need; whole texts are read once for it and once for the result.
    narrow = written(rows.select("source", "n_tokens", key.alias("_key")), "tokens")
    totals = written(narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    weights = written(mixing_weights(totals, target_entropy, repeat_limit, budget), "weights")
    plan = weights.select(
        F.col("source").alias("_source"), "alpha", "weight", "epochs", F.floor("epochs").cast("int").alias("_whole"), (F.col("budget_tokens") - F.floor("epochs") * F.col("tokens")).alias("_rest"), F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("long").alias("_blocks")
    )

    def with_plan(df: DataFrame) -> DataFrame:
        # One row a source: broadcast by Spark only under its checked threshold, else joined with skew handling.
        joined = df.join(plan, df["source"].eqNullSafe(plan["_source"])).drop("_source")
        return joined.withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")))

    order = F.xxhash64(F.lit(seed + 1), "source", "_whole", "_block")
    blocks = with_plan(narrow).groupBy("source", "_whole", "_rest", "_blocks", "_block").agg(F.sum("n_tokens").alias("_size"))
    # Prefix sums on two levels: slices of the keyed order, about SLICE blocks each, then blocks inside a slice.
    slices = F.ceil(F.col("_blocks") / SLICE)
    blocks = written(blocks.withColumn("_order", order).withColumn("_slice", F.floor((F.col("_order") / F.lit(2.0**64) + 0.5) * slices)), "mixorder")
    per_slice = blocks.groupBy("source", "_slice").agg(F.sum("_size").alias("_n"))
    begins = per_slice.select(F.col("source").alias("_of"), F.col("_slice").alias("_at"), (F.sum("_n").over(W.partitionBy("source").orderBy("_slice")) - F.col("_n")).alias("_begin"))
    blocks = blocks.join(begins, blocks["source"].eqNullSafe(begins["_of"]) & (blocks["_slice"] == begins["_at"]))
    ends = F.col("_begin") + F.sum("_size").over(W.partitionBy("source", "_slice").orderBy("_order", "_block"))
    blocks = written(blocks.withColumn("_end", ends).withColumn("_left", F.col("_rest") - (F.col("_end") - F.col("_size"))).select(F.col("source").alias("_source"), F.col("_block").alias("_b"), "_size", "_left").where("_left > 0"), "mixblocks")
    # Only the one block of a source in which the budget ends is looked at row by row.
    cut = blocks.where("_left < _size")
    dealt = with_plan(narrow)
    inside = dealt.join(cut, dealt["source"].eqNullSafe(cut["_source"]) & (dealt["_block"] == cut["_b"])).groupBy("source", "_block", "_left", "_key").agg(F.sum("n_tokens").alias("_n"))
    running = F.sum("_n").over(W.partitionBy("source", "_block").orderBy(F.xxhash64(F.lit(seed + 2), "_key"), "_key"))
    picked = inside.withColumn("_run", running).where("_run <= _left").select(F.col("source").alias("_ps"), F.col("_key").alias("_pk"))
    full = blocks.where("_left >= _size").select("_source", "_b")
    out = with_plan(rows.withColumn("_key", key))
    out = out.join(full, out["source"].eqNullSafe(full["_source"]) & (out["_block"] == full["_b"]), "left")
    out = out.join(picked, out["source"].eqNullSafe(picked["_ps"]) & (out["_key"] == picked["_pk"]), "left")
    copies = F.col("_whole") + (F.col("_b").isNotNull() | F.col("_pk").isNotNull()).cast("int")
    return out.withColumn("copies", copies).select(*rows.columns, "alpha", "weight", "epochs", "copies")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "n_tokens", "alpha", "weight", "epochs", "copies")
