"""Substring dedup: suffix automata of reference shards give matching statistics of documents.

A word goes if it lies in a run of WINDOW words that also occurs in a document with a smaller id.

Every shard's automaton against every document would cost the square of the corpus, so documents
are first routed to the shard they match: every window of every document is hashed; a window's
owner is the smallest document that has it.  A document's windows with a smaller owner form
spans; each span goes to its owner's shard, which holds the owner's shared passages.  There a
suffix automaton of those passages reads the span word by word, and the length of the longest
match that ends at each word (the matching statistic) decides exactly which words go; a hash
alone removes nothing.  Where a span holds a window that its owner's automaton lacks (two windows
share a hash), that window's true owner may be another document: all windows with such a hash are
gathered by their words, and the smallest document of each word sequence settles them.

Hot passages: inside a task only the smallest document's windows are sent on (the others are
known to have an owner already), so a window costs one entry a task; a shard with very many
spans is held by several tasks, each with its own copy of the automaton.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidewright.llm.memory import release, returning
from tidewright.llm.storage import dropped, free_shuffles, need, read_table, settings, written
from tidewright.llm.words import runs

WINDOW = 13
SPANS_A_TASK = 20_000
#: Bytes of text whose windows meet in one bucket, and rows and bytes of a batch of documents.
BUCKET_BYTES = 12 << 20
MIN_BUCKETS = 64
BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": "2500", "spark__sql__execution__arrow__maxBytesPerBatch": str(8 << 20)}
STEP = 0xD6E8FEB86659FD93


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "replace").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of a large_binary array; callers pass distinct words."""
    return np.fromiter(map(xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


def window_hashes(texts: pa.Array, window: int, hashed=hash_words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every window of every text."""
    words, sizes = runs(texts)
    coded = words.dictionary_encode()
    h = hashed(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if sizes.sum() else np.zeros(0, np.uint64)
    n = max(0, len(h) - window + 1)
    total = np.zeros(n, np.uint64)
    for k in range(window):
        total += h[k : k + n] * np.uint64(pow(STEP, k, 1 << 64))
    owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
    place = np.arange(n) - (np.cumsum(sizes) - sizes)[owner] if n else np.zeros(0, np.int64)
    whole = place + window <= sizes[owner] if n else np.zeros(0, bool)
    return mixed(total[whole]), owner[whole], place[whole]


# ---- windows of a bucket, packed --------------------------------------------------------------


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, first bytes together, so that equal ones compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


#: kind 0: windows of a bucket; kind 1: marks of a document that need no bucket.
ENTRIES = "bucket int, kind int, doc_id bigint, check bigint, a binary, b binary, c binary, d binary"
MARKS = "doc_id bigint, check bigint, cover binary, owners binary, refs binary"


def _entry(bucket, kind, doc=None, check=None, a=b"", b=b"", c=b"", d=b""):
    return bucket, kind, doc, check, a, b, c, d


def _mark_rows(owner_of: np.ndarray, pos: np.ndarray, text: np.ndarray, is_ref: np.ndarray):
    """(text, cover positions, owners, ref positions) for each text that has any."""
    order = np.lexsort((pos, text))
    text, pos, owner_of, is_ref = text[order], pos[order], owner_of[order], is_ref[order]
    for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1) if len(text) else []:
        ref = is_ref[part]
        yield int(text[part[0]]), pos[part][~ref].astype("<u4").tobytes(), owner_of[part][~ref].astype("<i8").tobytes(), np.unique(pos[part][ref]).astype("<u4").tobytes()


def _split(window: int, buckets: int, hashed):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            check = batch.column("check").to_numpy(zero_copy_only=False).astype(np.int64)[by_id]
            h, text, pos = window_hashes(batch.column("text").take(pa.array(by_id)), window, hashed)
            order = np.argsort(h, kind="stable")  # texts come in ascending id
            h, text, pos = h[order], text[order], pos[order]
            del order
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            group = np.cumsum(new) - 1
            least = ids[text[np.flatnonzero(new)]][group] if len(h) else ids[:0]
            lead = ids[text] == least
            rows = []
            followed = np.zeros(int(group[-1]) + 1 if len(h) else 0, bool)
            followed[group[~lead]] = True
            refs = lead & followed[group] if len(h) else lead
            some = ~lead | refs
            for t, cover, owners, ref in _mark_rows(least[some], pos[some], text[some], refs[some]):
                rows.append(_entry(int(ids[t]) % buckets, 1, int(ids[t]), int(check[t]) & 0xFFFF, cover, owners, ref))
            h, text, pos = h[lead], text[lead], pos[lead]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((pos, text, bucket))
            h, text, pos, bucket = h[order], text[order], pos[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                s = slice(edges[k], edges[k + 1])
                t, p = text[s], pos[s]
                first = np.concatenate([[True], t[1:] != t[:-1]])
                starts = np.flatnonzero(first)
                n = np.diff(np.append(starts, len(t)))
                docs = struct.pack("<q", len(starts)) + _planes(np.diff(ids[t[starts]], prepend=0).view(np.uint64), 8) + _planes((check[t[starts]] & 0xFFFF).astype(np.uint64), 2) + _planes(n.astype(np.uint64), 4)
                delta = np.where(first, p, p - np.concatenate([[0], p[:-1]]))
                rows.append(_entry(int(k), 0, None, None, _planes(h[s], 8), docs, _planes(delta.astype(np.uint64), 4)))
            names = [f.split()[0] for f in ENTRIES.split(", ")]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def _owners(key, table):
    """Marks of one bucket's windows; marks that came along are passed on."""
    kind = table.column("kind").to_numpy()
    out = [[], [], [], [], []]
    hashes, ids, checks, places = [], [], [], []
    for row in table.filter(pa.array(kind == 0)).select(["a", "b", "c"]).to_pylist():
        (k,) = struct.unpack_from("<q", row["b"])
        docs = [np.cumsum(_unplanes(row["b"][8 : 8 + 8 * k], 8).view(np.int64)), _unplanes(row["b"][8 + 8 * k : 8 + 10 * k], 2).astype(np.int64)]
        delta = _unplanes(row["c"], 4).astype(np.int64)
        n = _unplanes(row["b"][8 + 10 * k :], 4).astype(np.int64)
        first = np.cumsum(n) - n
        run = np.cumsum(delta)
        hashes.append(_unplanes(row["a"], 8))
        ids.append(np.repeat(docs[0], n))
        checks.append(np.repeat(docs[1].astype(np.uint16), n))
        places.append((run - np.repeat(run[first] - delta[first], n)).astype(np.int32))
    if hashes:
        h, d, c, p = map(np.concatenate, (hashes, ids, checks, places))
        del hashes, ids, checks, places
        order = np.lexsort((d, h))
        h = h[order]
        d, c, p = d[order], c[order].astype(np.int64), p[order].astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        del h, order
        group = np.cumsum(new) - 1
        least = d[np.flatnonzero(new)][group]
        many = np.zeros(int(group[-1]) + 1, bool)
        many[group[d != least]] = True
        some = many[group]
        d, c, p, least = d[some], c[some], p[some], least[some]
        del group, new, many, some
        pairs, text = np.unique(np.stack([d, c], 1), axis=0, return_inverse=True)
        for t, cover, owners, ref in _mark_rows(least, p, text.reshape(-1), d == least):
            for k, v in enumerate((int(pairs[t][0]), int(pairs[t][1]), cover, owners, ref)):
                out[k].append(v)
    made = pa.table([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[f.split()[0] for f in MARKS.split(", ")])
    passed = table.filter(pa.array(kind == 1)).select(["doc_id", "check", "a", "b", "c"]).rename_columns(["doc_id", "check", "cover", "owners", "refs"])
    release()
    return pa.concat_tables([made, passed.cast(made.schema)])


# ---- automaton --------------------------------------------------------------------------------


class SuffixAutomaton:
    """All substrings of several word sequences; no match spans two of them."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0  # a generalised automaton: each sequence starts at the root
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, w)
                continue
            now = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = now
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[now] = q if length[p] + 1 == length[q] else self._clone(p, q, w)
            last = now

    def _clone(self, p: int, q: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def matching(self, words) -> list[int]:
        """Length of the longest substring that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(w)
            if to is not None:
                state, n = to, n + 1
            out.append(n)
        return out


def covered_by(automaton: SuffixAutomaton, words: list, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(True for each word in a run of ``window`` words that the automaton has, starts of the runs that it lacks)."""
    ends = np.array(automaton.matching(words), np.int64) >= window
    gain = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(ends)
    np.add.at(gain, at - window + 1, 1)
    np.add.at(gain, at + 1, -1)
    return np.cumsum(gain[:-1]) > 0, np.flatnonzero(~ends[window - 1 :])


# ---- stages -----------------------------------------------------------------------------------


def _runs(pos: np.ndarray) -> list[np.ndarray]:
    return np.split(pos, np.flatnonzero(np.diff(pos) != 1) + 1) if len(pos) else []


SPAN = pa.list_(pa.struct([("owner", pa.int64()), ("start", pa.int32()), ("words", pa.binary())]))


def _spans(window: int):
    """Documents with their marks -> the result where nothing is covered, else text, spans and passages."""

    def run(batches):
        for b in batches:
            n_words, sha, spans, refs, rows = [], [], [], [], b.num_rows
            lists = [b.column(c).to_pylist() for c in ("text", "cover", "owners", "refs")]
            for text, cover, owners, ref in zip(*lists, strict=True):
                words = words_of(text)
                n_words.append(len(words))
                pos = np.concatenate([np.frombuffer(x, "<u4") for x in cover or [b""]]).astype(np.int64)
                own = np.concatenate([np.frombuffer(x, "<i8") for x in owners or [b""]])
                # Rows that repeat an id may share marks: a place that this row has not got is none of its own.
                own, pos = own[pos + window <= len(words)], pos[pos + window <= len(words)]
                if len(pos):
                    order = np.lexsort((pos, own))
                    pos, own = pos[order], own[order]
                    cut = np.flatnonzero((np.diff(pos) != 1) | (np.diff(own) != 0)) + 1
                    spans.append([{"owner": int(own[g[0]]), "start": int(pos[g[0]]), "words": b" ".join(words[pos[g[0]] : pos[g[-1]] + window])} for g in np.split(np.arange(len(pos)), cut)])
                    sha.append(None)
                else:
                    spans.append([])
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                where = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in ref or [b""]])).astype(np.int64)
                where = where[where + window <= len(words)]
                refs.append([b" ".join(words[r[0] : r[-1] + window]) for r in _runs(where)])
            text = [t if s is None else None for t, s in zip(lists[0], sha, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_rid"), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array(spans, SPAN), pa.array(refs, pa.list_(pa.binary()))], ["doc_id", "_rid", "n_words", "kept_sha256", "text", "spans", "refs"])
            del rows

    return run


def _verify(window: int):
    """Rows in the order (owner, salt, kind): passages build the automaton, spans are read by it."""

    def run(batches):
        shard, automaton = None, None
        for b in batches:
            rid, start, cover, lacking = [], [], [], []
            for owner, salt, kind, r, s, words in zip(*(b.column(c).to_pylist() for c in ("owner", "salt", "kind", "_rid", "start", "words")), strict=True):
                if (owner, salt) != shard:
                    shard, automaton = (owner, salt), SuffixAutomaton()
                if kind == 0:
                    automaton.add(words.split())
                    continue
                rid.append(r)
                start.append(s)
                words = words.split()
                found, lacks = covered_by(automaton, words, window)
                cover.append(np.packbits(found).tobytes())
                lacking.append([b" ".join(words[k : k + window]) for k in lacks.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(start, pa.int32()), pa.array(cover, pa.binary()), pa.array(lacking, pa.list_(pa.binary()))], ["_rid", "start", "cover", "lacking"])

    return run


def _gathered(hashes: np.ndarray, window: int, hashed):
    """(words, doc_id, _rid, start) of every window whose hash is one of ``hashes`` (ascending)."""

    def run(batches):
        for b in batches:
            h, text, pos = window_hashes(b.column("text"), window, hashed)
            at = np.flatnonzero(np.isin(h, hashes))
            words = {t: words_of(b.column("text")[t].as_py()) for t in np.unique(text[at]).tolist()}
            found = [b" ".join(words[t][p : p + window]) for t, p in zip(text[at].tolist(), pos[at].tolist(), strict=True)]
            take = pa.array(text[at])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column("doc_id").take(take), b.column("_rid").take(take), pa.array(pos[at].astype(np.int32))], ["words", "doc_id", "_rid", "start"])

    return run


def _settled(parts: DataFrame, rows: DataFrame, lacking: list[bytes], window: int, hashed) -> DataFrame:
    """Spans (_rid, start, cover) of the windows that share a hash with one of ``lacking``: their owner is the
    smallest document with the same words."""
    h = np.unique(window_hashes(pa.array([w.decode("utf-8") for w in lacking], pa.string()), window, hashed)[0])
    spark = parts.sparkSession
    with settings(spark, **BATCH):
        seen = written(parts.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "_rid", "text").mapInArrow(_gathered(h, window, hashed), "words binary, doc_id bigint, _rid bigint, start int"), "settled")
    # Documents without a covered word keep no text in ``parts``; they can be owners all the same.
    named = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lit(-1).cast("long").alias("_rid"), "text")
    least = named.mapInArrow(_gathered(h, window, hashed), "words binary, doc_id bigint, _rid bigint, start int").groupBy("words").agg(F.min("doc_id").alias("owner"))
    whole = F.lit(np.packbits(np.ones(window, bool)).tobytes())
    return seen.join(least, "words").where("owner < doc_id").select("_rid", "start", whole.alias("cover"))


def _kept(batches):
    for b in batches:
        removed, sha = [], []
        for text, starts, cover in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "covers")), strict=True):
            words = words_of(text)
            gone = np.zeros(len(words) + 8, bool)
            for s, c in zip(starts or [], cover or [], strict=True):
                bits = np.unpackbits(np.frombuffer(c, np.uint8)).astype(bool)
                gone[s : s + len(bits)] |= bits[: len(gone) - s]
            gone = gone[: len(words)]
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, hashed=hash_words, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space
    between them); other columns, whatever their names, are not looked at.  Null text has no words.  A row
    with a null doc_id has no place in the order: it loses nothing and takes nothing.  Rows that repeat a
    doc_id are not smaller than each other.  Empty table: empty result.  ``hashed`` names distinct words; a
    poor one costs time, never a result.  The number of buckets follows the bytes of text."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(MIN_BUCKETS, -(-size // bucket_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(F.coalesce("text", F.lit(""))) % 65536).alias("check"))
    entries = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(returning(_split(window, buckets, hashed)), ENTRIES)
    with settings(spark, **BATCH):
        marks = written(entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_owners, MARKS), "marks")
    free_shuffles(spark)
    grouped = marks.groupBy("doc_id", "check").agg(*(F.collect_list(c).alias(c) for c in ("cover", "owners", "refs")))
    joined = rows.join(grouped, ["doc_id", "check"], "left").withColumn("_rid", F.monotonically_increasing_id())
    parts = joined.select("doc_id", "_rid", "text", "cover", "owners", "refs").mapInArrow(_spans(window), "doc_id bigint, _rid bigint, n_words bigint, kept_sha256 string, text string, spans array<struct<owner:bigint,start:int,words:binary>>, refs array<binary>")
    with settings(spark, **BATCH):
        parts = written(parts, "spans")
    free_shuffles(spark)
    spans = parts.select("_rid", F.explode("spans").alias("s")).select("s.owner", "_rid", "s.start", "s.words")
    refs = parts.select(F.col("doc_id").alias("owner"), F.explode("refs").alias("words"))
    hot = written(spans.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPANS_A_TASK).select("owner", F.ceil(F.col("n") / SPANS_A_TASK).cast("int").alias("copies")), "hot")
    copies = F.coalesce("copies", F.lit(1))
    salted = spans.join(hot, "owner", "left").select("owner", F.pmod(F.xxhash64("_rid", "start"), copies).cast("int").alias("salt"), F.lit(1).alias("kind"), "_rid", "start", "words")
    shards = refs.join(hot, "owner", "left").select("owner", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("_rid"), F.lit(None).cast("int").alias("start"), "words")
    dealt = shards.unionByName(salted).repartition("owner", "salt").sortWithinPartitions("owner", "salt", "kind")
    checked = written(dealt.mapInArrow(_verify(window), "_rid bigint, start int, cover binary, lacking array<binary>"), "checked")
    # With a 64-bit hash this list is empty but for a chance in millions; it is as long as the clashes are many.
    lacking = [r["w"] for r in checked.select(F.explode("lacking").alias("w")).distinct().collect()]
    covers = checked.select("_rid", "start", "cover")
    if lacking:
        covers = covers.unionByName(_settled(parts.where("kept_sha256 IS NULL"), rows, lacking, window, hashed))
    verified = written(covers.groupBy("_rid").agg(F.collect_list("start").alias("starts"), F.collect_list("cover").alias("covers")), "verified")
    touched = parts.where("kept_sha256 IS NULL").select("_rid", "doc_id", "n_words", "text").join(verified, "_rid", "left")
    dropped(checked)
    changed = touched.select("doc_id", "n_words", "text", "starts", "covers").mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    whole = parts.where("kept_sha256 IS NOT NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    dropped(marks)
    return whole.unionByName(changed)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w) t),
f AS (SELECT k, min(doc_id) AS o FROM win GROUP BY k),
hit AS (SELECT win.doc_id, win.i FROM win JOIN f ON win.k = f.k WHERE f.o < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit CROSS JOIN (SELECT unnest(range(0, 13)) AS j) t),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
k AS (SELECT e.doc_id, count(gone.p) AS n_removed, coalesce(array_to_string(list(e.x ORDER BY e.p) FILTER (WHERE gone.p IS NULL), ' '), '') AS t
      FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.p = gone.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
