"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams, a linear layer and a
softmax follow.  Embeddings and layer are trained by stochastic gradient descent in numpy
on a bounded sample of labelled documents (``per_language`` expected documents for each of
at most ``MAX_LANGUAGES`` languages, chosen by a hash of the id).  A held-back fifth of the
sample calibrates a temperature and the rejection threshold.  As the layer is linear, the
class scores of every n-gram are one small table, so a text costs one look-up an n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.memory import returning
from tidewright.llm.storage import held_out, need, read_table

BITS = 14
DIM = 16
PER_LANGUAGE = 300
MAX_LANGUAGES = 256
REJECT_SHARE = 0.002
SEED = 17
UNKNOWN = "und"


def _folded() -> np.ndarray:
    """Byte map: A-Z to a-z, other ASCII that is not a letter to a space."""
    table = np.arange(256, dtype=np.uint32)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else 32
    return table


FOLD = _folded()


def ngram_ids(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-byte n-grams of all texts, each text between spaces: (ids, starts).

    Ids of text k are ids[starts[k]:starts[k + 1]]; every text has at least one."""
    data = FOLD[np.frombuffer(b" " + b"  ".join(texts) + b"  ", dtype=np.uint8)]
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    h2 = data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA77)
    h3 = h2[:-1] * np.uint32(0xC2B2AE3D) + data[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    shift = np.uint32(32 - bits)
    both = np.empty((len(h3), 2), dtype=np.uint32)  # the last pair of each text carries its 3-gram into the gap: a space follows
    both[:, 0], both[:, 1] = (h2[:-1] ^ (h2[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, (h3 ^ (h3 >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
    starts = np.concatenate([[0], np.cumsum(lengths)])
    keep = np.ones(len(both), dtype=bool)
    keep[starts[1:-1] - 1] = False  # would span two texts
    begin = np.concatenate([[0], np.cumsum(lengths - 1)]) * 2
    return both[keep].reshape(-1), begin


def _features(batches):
    for b in batches:
        texts = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
        ids, starts = ngram_ids(texts)
        index, count = [], []
        for k in range(len(texts)):
            u, c = np.unique(ids[starts[k] : starts[k + 1]], return_counts=True)
            index.append(u.astype("<u2").tobytes())
            count.append((c / c.sum()).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("_key"), pa.array(index, pa.binary()), pa.array(count, pa.binary())], ["lang", "_key", "ids", "weights"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 8, rate: float = 0.5, reject_share: float = REJECT_SHARE) -> dict:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang); null lang, null text and
    null doc_id are not learned from.  Without labelled rows the model knows no language; more than
    MAX_LANGUAGES languages are refused.  Repeated rows count as often as they occur."""
    need(docs, "doc_id", "text", "lang")
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages are labelled")
    if not counts:
        return {"languages": [], "table": np.zeros((1 << BITS, 0)), "bias": np.zeros(0), "temperature": 1.0, "threshold": 0.0}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["n"]))])
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED))
    drawn = known.select("lang", "text", key.alias("_key")).where(F.pmod("_key", F.lit(1 << 40)) < F.get(F.array(F.element_at(share, F.col("lang"))), F.lit(0)) * (1 << 40))
    rows = sorted(drawn.mapInArrow(returning(_features), "lang string, _key long, ids binary, weights binary").collect(), key=lambda r: (r["_key"], r["lang"], r["ids"]))
    languages = sorted({r["lang"] for r in rows})
    label = np.array([languages.index(r["lang"]) for r in rows])
    data = [(np.frombuffer(r["ids"], "<u2").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(np.float64)) for r in rows]
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    held, train = (order[: len(rows) // 5], order[len(rows) // 5 :]) if len(rows) >= 10 else (order, order)
    n = len(languages)
    embed, layer, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), rng.normal(0, 0.1, (DIM, n)), np.zeros(n)
    per_class = np.bincount(label[train], minlength=n).clip(1)
    balance = len(train) / (n * per_class)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            ids, w = data[i]
            mean = w @ embed[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            p *= balance[label[i]]
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            embed[ids] -= step * 20 * np.outer(w, back)  # ids are distinct here
    table = embed @ layer
    z = np.array([data[i][1] @ table[data[i][0]] + bias for i in held])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 5, 41):
        s = z / t
        s = s - s.max(1, keepdims=True)
        nll = np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), label[held]]) if len(held) else 0.0
        best = min(best, (nll, float(t)))
    t = best[1]
    s = z / t
    top = (np.exp(s - s.max(1, keepdims=True)) / np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)).max(1)
    return {"languages": languages, "table": table, "bias": bias, "temperature": t, "threshold": float(min(0.5, 0.9 * np.quantile(top, reject_share)))}


def scores(texts: list[str], model: dict, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, its probability) for each text; ``chunk`` bounds the bytes at once."""
    best, prob, part, size = [], [], [], 0

    def flush():
        if not part:
            return
        ids, starts = ngram_ids(part)
        z = np.empty((len(part), len(model["languages"])))
        for c in range(z.shape[1]):
            z[:, c] = np.add.reduceat(model["columns"][c][ids], starts[:-1]) / np.diff(starts)
        z = (z + model["bias"]) / model["temperature"]
        e = np.exp(z - z.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        best.append(e.argmax(1))
        prob.append(e.max(1))

    for t in texts:
        raw = t.encode("utf-8", "replace")
        part.append(raw)
        size += len(raw)
        if size >= chunk:
            flush()
            part, size = [], 0
    flush()
    return (np.concatenate(best), np.concatenate(prob)) if best else (np.zeros(0, int), np.zeros(0))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; only ``text`` is looked at.

    Null text or text without a letter: ``und``, score 0, rejected.  So is all text if the model
    knows no language.  Rejected otherwise: the probability is under the calibrated threshold.
    Columns of these names in the input are replaced.  Rows are judged one by one: repeated rows stay repeated, an
    empty table gives an empty result."""
    need(docs, "text")
    rest = docs.drop("lang_pred", "score", "rejected", "_has")
    marked = rest.withColumn("_has", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema)}, lang_pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = rest.columns

    def judged(batches):
        m = dict(shared.value)
        m["columns"] = [np.ascontiguousarray(m["table"][:, c]) for c in range(len(m["languages"]))]
        for b in batches:
            has = np.array(b.column("_has").to_pylist(), dtype=bool)
            lang, score = np.full(b.num_rows, UNKNOWN, dtype=object), np.zeros(b.num_rows)
            if m["languages"] and has.any():
                texts = b.column("text").filter(pa.array(has)).to_pylist()
                at, p = scores(texts, m)
                lang[has], score[has] = np.array(m["languages"], dtype=object)[at], p
            rejected = (lang == UNKNOWN) | (score < m["threshold"])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected.astype(bool))], [*names, "lang_pred", "score", "rejected"])

    return marked.mapInArrow(returning(judged), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3)
    model = fit(docs.where(~out))
    return identify(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
