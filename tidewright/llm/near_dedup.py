"""MinHash near-dedup by ProbMinHash over weighted shingles.

A document is its five-word shingles, each weighted by how often it occurs.  Every shingle is a
Poisson process whose rate is its weight; each arrival falls into one of REGISTERS registers,
which keep the shingle of the earliest arrival.  A shingle stops as soon as its next arrival is
later than every register of its document (early termination).  Two documents agree in a register
with the probability Jaccard similarity of their weighted shingles, so BANDS bands of ROWS
registers bring similar documents into common buckets.  Candidates are verified by the exact
probability Jaccard similarity of whole texts; classes are the components of verified links.

Equal texts are one node, however many rows they have.  A bucket is compared with a leader (drawn
by a hash of band and node, so that buckets differ).  A family is all nodes that buckets connect.
Where a family holds several classes afterwards, the members outside its largest class are compared
with all members of other classes that share a band, block against block: sketches (a byte a
register) rule out most, the others are compared exactly in place.  So any two members of a bucket
are in one class or have been compared; nothing is capped, and only links are emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.components import components
from tidewright.llm.exact_dedup import normalised
from tidewright.llm.memory import returning
from tidewright.llm.storage import dropped, free_shuffles, need, read_table, settings, written
from tidewright.llm.substring_dedup import BATCH, hash_words, mixed

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 40
ROWS = 6
SEED = 1
BLOCK = 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
GOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def weighted_shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight), sorted by text then hash.  A text of fewer words is one shingle of all
    its words; a text without words is one shingle as well."""
    words = [words_of(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    length = np.maximum(n, size)  # short texts are filled up with a word that no text has
    coded = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    h = np.full(int(length.sum()), np.uint64(0x51ED270B9F2A5C3D))
    starts = np.cumsum(length) - length
    if n.sum():
        h[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())] = hash_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    total = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        total += h[k : k + len(total)] * np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64))
    owner = np.repeat(np.arange(len(words)), length)[: len(total)]
    inside = np.arange(len(total)) + size <= (starts + length)[owner]
    # One sort of a combined number: 44 bits of the hash under the text's number.
    key = np.sort(owner[inside].astype(np.uint64) << np.uint64(44) | mixed(total[inside]) >> np.uint64(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), np.diff(np.append(at, len(new)))


def _named(codes: np.ndarray, more: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Integers 0 ... that are the same exactly where both numbers are the same."""
    names, at = np.unique(codes * np.int64(width) + more, return_inverse=True)
    return at.reshape(-1), len(names)


def named_shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``weighted_shingles``, but a shingle's number is the same in two texts exactly if its words are:
    words are named by a dictionary, pairs of names by integers, so no hash decides."""
    words = [words_of(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    length = np.maximum(n, size)
    coded = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    own = np.zeros(int(length.sum()), np.int64)  # 0 fills up short texts
    starts = np.cumsum(length) - length
    if n.sum():
        own[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    kinds = len(coded.dictionary) + 1
    total, many = own, kinds
    for k in range(1, size):
        total = total[: max(0, len(own) - k)]
        if many * kinds >= 1 << 62:
            total, many = _named(total, np.zeros(1, np.int64), 1)
        total, many = total * np.int64(kinds) + own[k : k + len(total)], many * kinds
    owner = np.repeat(np.arange(len(words)), length)[: len(total)]
    inside = np.arange(len(total)) + size <= (starts + length)[owner]
    total, owner = total[inside], owner[inside]
    if many * len(words) >= 1 << 62:
        total, many = _named(total, np.zeros(1, np.int64), 1)
    key = np.sort(owner * np.int64(many) + total)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return key // many, key % many, np.diff(np.append(at, len(new)))


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, registers: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """ProbMinHash signatures [text, register] of weighted shingles: the earliest arrival's hash."""
    first, sig = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint64)
    x = np.zeros(len(value))
    base = mixed(value + np.uint64(seed) * GOLD)
    k = 0
    while len(value):
        k += 1
        draw = mixed(base + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        x = x - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        register = owner * registers + (mixed(draw ^ GOLD) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, register, x)
        won = first[register] == x
        sig[register[won]] = value[won]
        last = first.reshape(texts, registers).max(1)
        go = x < last[owner]
        owner, value, weight, base, x = owner[go], value[go], weight[go], base[go], x[go]
    return sig.reshape(texts, registers)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated probability Jaccard similarity of two signatures (or of their sketches)."""
    return float((a == b).mean())


def sketches(sig: np.ndarray) -> np.ndarray:
    """One byte a register: enough to estimate with."""
    return (mixed(sig) >> np.uint64(56)).astype(np.uint8)


def least_estimate(threshold: float, registers: int) -> float:
    """4.5 standard deviations under the threshold: a pair just at it is estimated lower three times in
    a million, a more similar one far more seldom."""
    return threshold - 4.5 * (threshold * (1 - threshold) / registers) ** 0.5


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    part = sig.reshape(len(sig), bands, rows)
    total = np.zeros(part.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64) * GOLD
    for r in range(rows):
        total = mixed(total ^ part[:, :, r]) + np.uint64(r + 1)
    return total.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets (sorted hashes, weights): the sum over common elements d
    of 1 / sum over all d' of max(wa(d') / wa(d), wb(d') / wb(d))."""
    every = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(every)), np.zeros(len(every))
    wa[np.searchsorted(every, a[0])], wb[np.searchsorted(every, b[0])] = a[1], b[1]
    both = np.flatnonzero((wa > 0) & (wb > 0))
    if not len(both):
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    above = np.append(np.cumsum(wa[order][::-1])[::-1], 0.0)
    below = np.concatenate([[0.0], np.cumsum(wb[order])])
    rho = ratio[both]
    at = np.searchsorted(sorted_ratio, rho, "left")
    return float((wa[both] / (above[at] + rho * below[at])).sum())


def _signed(bands: int, rows: int, size: int, seed: int):
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            begin = 0
            while begin < len(texts):
                stop, held = begin, 0
                while stop < len(texts) and (stop == begin or held + len(texts[stop] or "") <= 2 << 20) and stop - begin < 2000:
                    held += len(texts[stop] or "")
                    stop += 1
                sig = signatures(*weighted_shingles(texts[begin:stop], size), stop - begin, bands * rows, seed)
                keys = band_keys(sig, bands, rows)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                sketch = pa.array([x.tobytes() for x in sketches(sig)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(begin, stop - begin) for c in ("_rid", "doc_id", "_key")), sketch, column], ["_rid", "doc_id", "_key", "sketch", "bands"])
                begin = stop

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _promising(least: float):
    def run(batches):
        for b in batches:
            keep = pa.array((_matrix(b.column("sa")) == _matrix(b.column("sb"))).mean(1) >= least) if b.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


def _across(least: float, threshold: float, size: int):
    """Links between a block of outsiders (side 0) and a block of members (side 1) of one family: pairs
    that share a band and are estimated high enough are compared exactly, unless links found before
    already put them into one class.  Only links are emitted."""

    def run(key, table):
        side, rid, c = (table.column(x).to_numpy() for x in ("side", "_rid", "c"))
        c = c.copy()
        sketch = _matrix(table.column("sketch").combine_chunks())
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rid), -1)
        owner, value, weight = named_shingles(table.column("text").to_pylist(), size)
        begin = np.searchsorted(owner, np.arange(len(rid) + 1))
        n = np.diff(begin)
        plain = np.maximum.reduceat(weight, begin[:-1]) == 1
        local = np.unique(value, return_inverse=True)[1]
        mark = np.zeros(int(local.max()) + 1, bool)
        x, out = np.flatnonzero(side == 1), []
        for i in np.flatnonzero(side == 0):
            near = x[c[x] != c[i]]
            near = near[(bands[near] == bands[i]).any(1)]
            near = near[(sketch[near] == sketch[i]).mean(1) >= least]
            if not len(near):
                continue
            own = slice(begin[i], begin[i + 1])
            mark[local[own]] = True
            common = np.array([np.count_nonzero(mark[local[begin[j] : begin[j + 1]]]) for j in near])
            mark[local[own]] = False
            alike = np.where(plain[near] & plain[i], common / (n[near] + n[i] - common), -1.0)
            for j, s in zip(near.tolist(), alike.tolist(), strict=True):
                if c[j] == c[i]:
                    continue
                if s < 0:
                    other = slice(begin[j], begin[j + 1])
                    s = probability_jaccard((value[own], weight[own]), (value[other], weight[other]))
                if s >= threshold:
                    out.append((min(rid[i], rid[j]), max(rid[i], rid[j])))
                    c[c == c[j]] = c[i]
        both = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return run


def _verified(size: int, threshold: float):
    def run(batches):
        for b in batches:
            found = [exact_similarity(*pair, size) >= threshold for pair in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)]
            keep = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


def exact_similarity(a: str | None, b: str | None, size: int = SHINGLE) -> float:
    """Probability Jaccard similarity of two texts, decided on their words."""
    owner, value, weight = named_shingles([a, b], size)
    cut = int(np.searchsorted(owner, 1))
    return probability_jaccard((value[:cut], weight[:cut]), (value[cut:], weight[cut:]))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = SEED, block: int = BLOCK, stats: dict | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of its class), class_size (rows),
    kept (one row of each class: that of the smallest doc_id), text_sha256 (of the lower-cased text, so that
    rows which share an id can be told apart).  Other columns, whatever their names, are not looked at.

    Texts that agree after lower-casing A-Z are one node; null text is empty; texts without words
    are alike.  A null doc_id is the largest; of repeated rows with the smallest doc_id one is
    kept.  Empty table: empty result.  ``stats``: gets the number of pairs and of links."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    least = least_estimate(threshold, bands * rows)
    source = docs.select("doc_id", "text").withColumn("_key", F.unhex(F.sha2(normalised(F.col("text")), 256)))
    with settings(spark, **BATCH):
        signed = written(source.select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), "_key", "text").mapInArrow(returning(_signed(bands, rows, size, seed)), "_rid bigint, doc_id bigint, _key binary, sketch binary, bands array<bigint>"), "signed")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "_rid", "doc_id"))
    groups = written(signed.groupBy("_key").agg(first.alias("m"), F.count(F.lit(1)).alias("n")), "nodes")
    nodes = groups.select("_key", F.col("m._rid").alias("_rid"), F.xxhash64("m.doc_id").alias("_id"), "m", "n")

    # Buckets: one leader each, drawn by band, so that a node has other leaders in other bands.
    entries = signed.join(nodes.select("_rid"), "_rid", "left_semi").select("_rid", F.posexplode("bands").alias("band", "h"))
    draw = F.struct(F.xxhash64("band", "_rid"), "_rid")
    heads = written(entries.groupBy("band", "h").agg(F.min(draw).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "h", F.col("m._rid").alias("leader")), "buckets")
    members = written(entries.join(heads, ["band", "h"]).select("band", "h", "_rid", "leader"), "members")
    free_shuffles(spark)
    drawn = written(members.where("leader <> _rid").select(F.least("leader", "_rid").alias("a"), F.greatest("leader", "_rid").alias("b")).distinct(), "drawn")
    dropped(members)
    # A family: the nodes that buckets connect.  Whole texts are fetched once, for families alone; the
    # id finds a text, its digest tells rows of one id apart.
    families = components(drawn).withColumnRenamed("c", "f")
    wanted = families.select(F.col("v").alias("_rid")).join(nodes.select("_rid", "_id", F.col("_key").alias("_wanted")), "_rid")
    fetched = docs.select(F.xxhash64("doc_id").alias("_id"), "text").join(wanted, "_id").where(F.unhex(F.sha2(normalised(F.col("text")), 256)) == F.col("_wanted"))
    texts = written(fetched.groupBy("_rid").agg(F.first("text").alias("text")), "texts")
    free_shuffles(spark)
    sketch = signed.select("_rid", "sketch")
    sketched = drawn.join(sketch.select(F.col("_rid").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("_rid").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = written(sketched.select("a", "b", "sa", "sb").mapInArrow(returning(_promising(least)), "a bigint, b bigint"), "pairs")
    both = pairs.join(texts.select(F.col("_rid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("_rid").alias("b"), F.col("text").alias("tb")), "b")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="256"):  # whole texts: few rows at once
        links = written(both.select("a", "b", "ta", "tb").mapInArrow(returning(_verified(size, threshold)), "a bigint, b bigint"), "links")
    labels = components(links)

    # Families that hold several classes: members outside the largest class (outsiders) meet all members
    # of other classes, block by block; blocks bound what a task holds.
    now = written(families.withColumnRenamed("v", "_rid").join(labels.withColumnRenamed("v", "_rid"), "_rid", "left").withColumn("c", F.coalesce("c", "_rid")), "classed")
    per_class = now.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n"))
    per_family = per_class.groupBy("f").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n")).where("n > m.n")
    mixed_up = written(per_family.select("f", F.col("m.c").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil((F.col("n") - F.col("m.n")) / block).cast("int").alias("ub")), "mixed")
    rest = now.join(mixed_up, "f").join(signed.select("_rid", "sketch", "bands"), "_rid").join(texts, "_rid")
    fall = F.xxhash64("_rid")
    columns = ("_rid", "c", "sketch", "bands", "text")
    outside = rest.where("c <> main").select("f", F.pmod(fall, "ub").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(0).alias("side"), *columns)
    inside = rest.select("f", F.explode(F.sequence(F.lit(0), F.col("ub") - 1)).alias("i"), F.pmod(fall, "nb").cast("int").alias("j"), F.lit(1).alias("side"), *columns)
    more = written(outside.unionByName(inside).groupBy("f", "i", "j").applyInArrow(_across(least, threshold, size), "a bigint, b bigint"), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    if stats is not None:
        stats.update(drawn=drawn.count(), pairs=pairs.count(), more=more.count(), links=links.count())
    dropped(texts)

    by_class = nodes.join(labels.select(F.col("v").alias("_rid"), "c"), "_rid", "left").withColumn("c", F.coalesce("c", "_rid"))
    classes = written(by_class.groupBy("c").agg(F.min("m").alias("best"), F.sum("n").alias("class_size")), "classes")
    named = written(by_class.select("_key", "c").join(classes, "c").select("_key", F.col("best.doc_id").alias("class_id"), F.col("best._rid").alias("_kept"), "class_size"), "named")
    return signed.select("_rid", "doc_id", "_key").join(named, "_key").select("doc_id", "class_id", "class_size", (F.col("_rid") == F.col("_kept")).alias("kept"), F.lower(F.hex("_key")).alias("text_sha256"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))
