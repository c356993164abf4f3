"""Every stage on odd tables, and operators against plain loops."""

import collections
import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import ODD, SCHEMA, lower
from tidewright.llm import iso_media, language_id, mixing, near_dedup, piece_codec, url_filter
from tidewright.llm.storage import held_out, read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*ODD, (None, "ab C", "en", "a", 4, None, None, None), (None, "other words", "en", "a", 4, None, None, None)], SCHEMA)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, odd, name, stage):
    got = stage(spark, odd, SF)
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0
    if name != "pieces":
        assert tuple(got.columns) == corpus_pipeline.COLUMNS
    rows, texts = got.collect(), [lower(r.text) for r in odd.collect()]
    if name in ("exact_dedup", "near_dedup"):
        # Texts without words are alike for near dedup.
        named = (lambda t: " ".join(t.split())) if name == "near_dedup" else (lambda t: t)
        assert sorted(named(lower(r.text)) for r in rows) == sorted(set(map(named, texts)))
        null = [r.text for r in rows if r.doc_id is None]
        assert null.count("other words") == 1 and (name == "near_dedup" or len(null) == 1)
    if name == "mixing":
        assert {lower(r.text) for r in rows} == set(texts) and len(rows) >= len(texts)
    if name == "language_id":
        assert all(any(ch.isalpha() for ch in r.text) for r in rows)


def test_near_copies_of_null_id_go(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (None, " ".join([*base[:100], "x", *base[101:]])), (None, "a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near(spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in got} == {rows[0], rows[2]}


def test_languages_of_held_out_rows(spark):
    docs = read_table(spark, SF, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 3)))
    got = language_id.identify(docs.where(held_out(F.col("doc_id"), 3)).where("lang IS NOT NULL AND text IS NOT NULL"), model)
    n, right = got.where("lang_pred <> 'und'").agg(F.count(F.lit(1)), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 200 and right / n > 0.97


def test_verdicts_on_held_out_urls(spark):
    rows = url_filter.labelled_urls()
    told, kept = [r for k, r in enumerate(rows) if k % 5], rows[::5]
    weights = url_filter.train(spark.createDataFrame(told, "url string, label int"))
    got = url_filter.judge(spark.createDataFrame(kept, "url string, label int"), weights, rules=()).collect()
    assert sum((r.verdict == "block") == bool(r.label) for r in got) / len(got) > 0.9


def test_equally_long_rules_take_the_first(spark):
    rules = (("a.org", "/xy", "allow"), ("org", "/xyzw", "block"), ("a.org", "/xy", "block"))
    page = spark.createDataFrame([("http://a.org/xyzw",)], "url string")
    weights = [0.0] * (url_filter.BUCKETS + 1)
    for given in (rules, rules[::-1], (rules[1], rules[0], rules[2])):
        r = url_filter.judge(page, weights, given).first()
        assert (r.rule, r.verdict) == (given[0][0] + given[0][1], given[0][2])


def test_scores_are_those_of_a_loop(spark):
    import zlib

    weights = np.random.default_rng(2).normal(0, 3, url_filter.BUCKETS + 1).tolist()
    for r in url_filter.judge(spark.createDataFrame([("http://Ab-cd.example.org/en/é?x",), ("http://x",), (None,)], "url string"), weights, rules=()).collect():
        grams = [zlib.crc32(t[i : i + n].encode()) % url_filter.BUCKETS for t in (f"<{r.host}>", f"[{r.path}]") for n in url_filter.SIZES for i in range(len(t) - n + 1)]
        z = sum(weights[g] for g in grams) / max(1, len(grams)) + weights[-1]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_mixing_is_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), "abcde"[min(4, int(rng.expovariate(1.2)))]) for i in range(500)]
    for block, limit, budget in ((60, 2.0, None), (100000, 1.7, None), (50, 3.0, 9000)):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=block, repeat_limit=limit, budget=budget).collect()
        tokens = collections.Counter()
        for _, t, s in rows:
            tokens[s] += len(t.split())
        total = sum(tokens.values())

        def passes(a):
            raised = {s: (n / total) ** a for s, n in tokens.items()}
            ratio = {s: raised[s] / sum(raised.values()) / (tokens[s] / total) for s in tokens}
            unit = budget / total if budget else 1 / min(ratio.values())
            return {s: r * unit for s, r in ratio.items()}

        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if max(passes(mid).values()) <= limit else (mid, hi)
        want = passes(0.0 if lo < 1e-12 else hi)
        for s in tokens:
            own = [r for r in got if r.source == s]
            assert all(abs(r.epochs - want[s]) < 1e-6 for r in own)
            taken = sum(r.n_tokens * r.copies for r in own)
            # A budget ends inside a block, whose documents are taken in order while they fit.
            assert round(want[s] * tokens[s]) - 30 <= taken <= round(want[s] * tokens[s]) + 1
            assert max(r.copies for r in own) - min(r.copies for r in own) <= 1


def splitmix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_agenda(c, unit, variant, dropout, seed):
    """The lowest rank first, ties from the left, over and over; a skipped candidate is no candidate."""
    spans = []
    for i, ch in enumerate(unit):
        piece = int(c.char[piece_codec.SPACE if ch == " " else ord(ch)]) if ch != chr(piece_codec.SPACE) else -1
        spans.append((piece if piece >= 0 else c.size + ord(ch), i, i + 1))
    while True:
        found = []
        for k, ((a, start, mid), (b, _, end)) in enumerate(zip(spans, spans[1:])):
            rank = int(c._rank(np.array([a]), np.array([b]), np.array([0]), np.array([0]), np.array([0]), np.array([0]), 0, 0)[0])
            h = splitmix(splitmix((a << 32 | b) + seed) ^ splitmix(((start << 42 ^ mid << 21 ^ end) + (variant << 56) + 0x632BE59BD9B4E019) % 2**64))
            if rank != piece_codec.NONE and (h >> 11) >= dropout * 2**53:
                found.append((rank, k))
        if not found:
            return [s[0] for s in spans]
        rank, k = min(found)
        spans[k : k + 2] = [(int(c.piece_of_rank[rank]), spans[k][1], spans[k + 1][2])]


def test_dropout_is_a_plain_agenda():
    c, rng = piece_codec.codec(piece_codec.default_model()), random.Random(6)
    units = [" " + "".join(rng.choices("theinganderouos", k=rng.randrange(0, 30))) for _ in range(60)] + ["  the▁x", " naïve😀", " " + "internationalization" * 6]
    variants = np.arange(len(units)) % 8
    for dropout in (0.0, 0.1, 0.5):
        symbols, starts = c.segment(units, variants, dropout, 4)
        for k, unit in enumerate(units):
            assert symbols[starts[k] : starts[k + 1]].tolist() == plain_agenda(c, unit, int(variants[k]), dropout, 4)


def media(*tracks, moofs=(), tail=b""):
    b, f = iso_media.box, iso_media.full
    return b(b"ftyp", b"isom\0\0\0\0") + b(b"moov", *tracks, b(b"udta", tail)) + b"".join(moofs)


def trak(number, table, codec=b"mp4a"):
    b, f = iso_media.box, iso_media.full
    mdhd = f(b"mdhd", 0, struct.pack(">IIII", 0, 0, 1000, 0), b"\0" * 4)
    stsd = f(b"stsd", 0, struct.pack(">I", 1), b(codec, b"\0" * 28))
    return b(b"trak", f(b"tkhd", 0, struct.pack(">III", 0, 0, number), b"\0" * 68), b(b"mdia", mdhd, f(b"hdlr", 0, struct.pack(">I4s", 0, b"vide")), b(b"minf", b(b"stbl", stsd, *table))))


def test_fragments_are_samples():
    b, f = iso_media.box, iso_media.full
    none = [f(b"stts", 0, struct.pack(">I", 0)), f(b"stsc", 0, struct.pack(">I", 0)), f(b"stsz", 0, struct.pack(">II", 0, 0)), f(b"stco", 0, struct.pack(">I", 0))]
    trex = b(b"mvex", f(b"trex", 0, struct.pack(">5I", 2, 1, 40, 7, 0x10000)))
    head = b(b"ftyp", b"isom\0\0\0\0") + b(b"moov", trak(1, none), trak(2, none, b"avc1"), trex)

    def moof(offset):
        run = struct.pack(">I", 0x205) + struct.pack(">IiI", 3, offset, 0) + struct.pack(">III", 5, 6, 7)
        second = struct.pack(">I", 0) + struct.pack(">I", 2)
        return b(b"moof", f(b"mfhd", 0, b"\0" * 4), b(b"traf", b(b"tfhd", struct.pack(">II", 0x20000, 2)), b(b"trun", run), b(b"trun", second)))

    size = len(moof(0))
    raw = head + moof(size + 8) + b(b"mdat", bytes(range(32)))
    one, two = iso_media.parse_media(raw)
    assert len(one["sizes"]) == 0 and two["codec"] == "avc1"
    assert two["sizes"].tolist() == [5, 6, 7, 7, 7] and two["ticks"] == 200 and two["keys"].tolist() == [0]
    assert iso_media.payload_of(raw, two) == bytes(range(32))


def test_quicktime_ends_and_narrow_sizes():
    b, f = iso_media.box, iso_media.full

    def table(offset):
        return [f(b"stts", 0, struct.pack(">III", 1, 3, 10)), f(b"ctts", 0, struct.pack(">III", 1, 3, 5)), f(b"stsc", 0, struct.pack(">4I", 1, 1, 3, 1)), f(b"stz2", 0, struct.pack(">II", 4, 3), bytes([0x34, 0x50])), f(b"stco", 0, struct.pack(">II", 1, offset))]

    size = len(media(trak(1, table(0)), tail=b"\0" * 4))
    raw = media(trak(1, table(size + 8)), tail=b"\0" * 4) + b(b"mdat", b"abcdefghijkl")
    (track,) = iso_media.parse_media(raw)
    assert track["sizes"].tolist() == [3, 4, 5] and iso_media.payload_of(raw, track) == b"abcdefghijkl"
    assert track["shifts"].tolist() == [[3, 5]] and track["ticks"] == 30


def test_media_of_the_table_is_what_was_stored(spark):
    got = {r.doc_id: r for r in iso_media.op8_media_columns(spark, "/root/testdata/sf0.001").collect()}
    rows = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        payload = iso_media.padded((r.text or "").encode())
        have = got[r.doc_id]
        assert (have.n_bytes, have.payload_bytes, have.payload_sha256) == (len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert have.media_sha256 == hashlib.sha256(iso_media.pack_media(payload)).hexdigest()


def test_near_dedup_finds_what_brute_force_finds(spark):
    """Recall on a table: every pair of texts of sf0.001 at 0.8 or more shares a class."""
    rows = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    classes = {r.doc_id: r.class_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    owner, value, weight = near_dedup.named_shingles([lower(r.text) for r in rows])
    cut = np.searchsorted(owner, np.arange(len(rows) + 1))
    sets = [(value[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    index = collections.defaultdict(set)
    for i, (v, _) in enumerate(sets):
        for x in v.tolist():
            index[x].add(i)
    pairs = {(i, j) for some in index.values() if len(some) > 1 for i in some for j in some if i < j}
    links = [(i, j) for i, j in pairs if near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8]
    assert links and all(classes[rows[i].doc_id] == classes[rows[j].doc_id] for i, j in links)
