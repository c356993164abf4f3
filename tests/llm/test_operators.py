"""Brute force, round trips and odd tables for the training-data operators."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import iso_media, language_id, mixing, near_dedup, piece_codec, substring_dedup, token_store, url_filter
from tidewright.llm.exact_dedup import exact_dedup
from tidewright.llm.storage import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, bands string"
ODD = [(1, None, "en", "a", 0, True, 0.0, ""), (2, "", None, None, 0, None, None, None), (None, "Ab c", "en", "a", 4, None, None, None), (3, "aB C", "de", "b", 4, None, None, None), (3, "aB C", "de", "b", 4, None, None, None), (4, "é ü " * 3000, "fr", "a", 12000, None, None, None), (5, "x" * 9000, "en", "a", 9000, None, None, None), (6, " \t\n", "en", "b", 3, None, None, None), (7, "the cat sat on the mat and it was good " * 40, "en", "a", 1, None, None, None), (8, "the cat sat on the mat and it was good " * 40, "en", "b", 1, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("digest", [F.xxhash64, lambda b: F.length(b).cast("long")])
def test_exact_dedup(odd, empty, digest):
    got = {(r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd, 64, digest).collect()}
    want = set()
    for r in ODD:
        same = [o[0] for o in ODD if lower(o[1]) == lower(r[1])]
        keep = max((i for i in same if i is not None), default=None)
        want.add((r[0], hashlib.sha256(lower(r[1]).encode()).hexdigest(), keep, len(same), r[0] == keep))
    assert got == want
    assert exact_dedup(empty).count() == 0


def family(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        out.append((i, " ".join(words * (1 + i % 7 // 6))))
    return out


def brute_shingles(text):
    words = lower(text).encode().split()
    words += [None] * (5 - len(words))
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_similarity(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


#: Two different words of 1,024 letters that one polynomial of degree 1,023 over 2^64 maps to the same value.
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
CLASH = (MORSE, MORSE.translate(str.maketrans("ab", "ba")))


def test_clashing_words_are_different_words(spark):
    others = [f"w{i}" for i in range(30)]
    rows = [(k + 1, " ".join([*others[:4], w, *others[4:12]])) for k, w in enumerate((*CLASH, CLASH[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}
    near = spark.createDataFrame([(1, CLASH[0]), (2, CLASH[1])], "doc_id long, text string")
    assert all(r.kept for r in near_dedup.near_dedup(near).collect())


def test_near_dedup_is_brute_force(spark, odd, empty):
    rows = family(36, 1) + [(100 + i, t) for i, t in family(12, 2)] + [(200, "solo words here")]
    sets = {i: brute_shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in sets:
        for j in sets:
            if i < j and brute_similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in sets}
    assert sum(r.kept for r in got) == len({root(i) for i in sets})
    assert near_dedup.near_dedup(odd).count() == len(ODD)
    assert near_dedup.near_dedup(empty).count() == 0


def test_signatures_estimate_weighted_similarity():
    a, b = ["p q r s t " * 9 + "one two three four five six seven"], ["p q r s t " * 8 + "one two three four five nine ten"]
    true = near_dedup.exact_similarity(a[0], b[0])
    assert abs(true - brute_similarity(brute_shingles(a[0]), brute_shingles(b[0]))) < 1e-9
    sig = [near_dedup.signatures(*near_dedup.weighted_shingles(t), 1, 4000)[0] for t in (a, b)]
    assert abs(near_dedup.estimate(*sig) - true) < 0.04


def brute_substring(rows, window):
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [2, 13])
def test_substring_dedup_is_brute_force(spark, odd, empty, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SPANS_A_TASK", 2)
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(60))) for i in range(30)] + [r[:2] for r in ODD]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_substring(rows, window)
    assert substring_dedup.substring_dedup(empty).count() == 0


def poor(words):
    return np.array([len(w) % 2 for w in words.to_pylist()], np.uint64)


def test_substring_dedup_settles_clashes_by_words(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("aa", "b", "cc", "d", "eee")) for _ in range(40))) for i in range(60)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4, poor)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_substring(rows, 4)


def test_automaton_knows_substrings():
    a = substring_dedup.SuffixAutomaton()
    a.add("a b a b c".split())
    a.add("b b".split())
    assert a.matching("b a b b c".split()) == [1, 2, 3, 2, 2]  # "b c" is the end of the first sequence


def test_units_of_letters_skip_the_rules():
    """Letters that the rules do not change are encoded without them, all other units with them, in their order."""
    path = token_store.default_tokenizer()
    made, quick = token_store.tokenizer(path)[0], token_store.letters_tokenizer(path)
    units = ["the", "élève", "ÿß", "x" * 1500, "École", "e\u0301t", "don't", "a1", "ſt", "\x01", "naïve", "ǆ", "zz", "<|endoftext|>", "œuvre", "µ"]
    ids, sizes = token_store.encode_units(units, path)
    want = [made.encode(u, add_special_tokens=False).ids for u in units]
    assert np.split(ids, np.cumsum(sizes)[:-1])[1].tolist() == want[1] and ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    calls = [u for u in units if token_store.LETTERS.fullmatch(u)]
    assert quick is not None and quick.normalizer is None and calls == ["the", "élève", "ÿß", "x" * 1500, "naïve", "zz"]
    assert all(quick.encode(u, add_special_tokens=False).ids == made.encode(u, add_special_tokens=False).ids for u in calls)


def test_token_store(spark, odd, empty):
    path = new_path(spark, "t")
    token_store.write_token_shards(odd, path, shard_ids=100)
    got = sorted(token_store.read_token_shards(spark, path, ids=True).collect(), key=lambda r: r.start)
    made = token_store.tokenizer(token_store.default_tokenizer())[0]
    want = [(r[0], [*made.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in sorted(ODD, key=lambda r: (r[0] is None, r[0]))]
    assert [(r.doc_id, r.ids) for r in got] == want
    assert [r.start for r in got] == list(np.cumsum([0] + [len(w[1]) for w in want])[:-1])
    path = new_path(spark, "t")
    token_store.write_token_shards(empty, path)
    assert token_store.read_token_shards(spark, path).count() == 0


def test_shards_tell_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2048, 4096, 9001):
        ids = (rng.zipf(1.3, n) % 50000).astype(np.int32)
        image = token_store.pack_shard(np.array([9]), np.array([n]), ids)
        assert (token_store.unpack_shard(image)[2] == ids).all()
    bad = bytearray(image)
    bad[-3000] ^= 255
    with pytest.raises(token_store.StoreError):
        token_store.unpack_shard(bytes(bad))


def test_a_skewed_block_is_coded():
    for ids in (np.zeros(5000, np.int32), np.tile(np.array([3, 1, 2], np.int32), 3000), np.arange(6000, dtype=np.int32)):
        image = token_store.pack_shard(np.array([9]), np.array([len(ids)]), ids)
        assert (token_store.unpack_shard(image)[2] == ids).all()
    assert len(token_store.pack_shard(np.array([9]), np.array([9000]), np.tile(np.array([3, 1, 2], np.int32), 3000))) < 1500


def test_the_mixture_is_a_distribution():
    """Masses of all ranks follow each other and fill the whole, at every step."""
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.5, 300) % 40).astype(np.int32)
    order0 = token_store._Order0(np.bincount(ids).astype("<u2"))
    lanes, n = token_store._Lanes(1, order0), len(order0.ids)
    for x in order0.rank[ids]:
        lanes.predict()
        every = np.arange(n)
        below, own = (np.concatenate([lanes.order0(order0.group[[k]], order0.low[[k]], order0.width[[k]])[i] for k in every]) for i in (0, 1))
        mass = lanes.m0 * own + ((lanes.m1 * (lanes.p1 == every) + lanes.m2 * (lanes.p2 == every)) << token_store.ORDER0)
        start = lanes.m0 * below + ((lanes.m1 * (lanes.p1 < every) + lanes.m2 * (lanes.p2 < every)) << token_store.ORDER0)
        assert (mass > 0).all() and (start[1:] >= start[:-1] + mass[:-1]).all() and start[-1] + mass[-1] <= 1 << token_store.WEIGHT + token_store.ORDER0
        group = order0.group[[x]]
        lanes.code(np.array([x]), *lanes.order0(group, order0.low[[x]], order0.width[[x]]))
        lanes.count(group)
        assert (lanes.w1 + lanes.w2 <= (1 << token_store.WEIGHT) - token_store.KEPT).all()
        for m in lanes.shift():
            pass


def encoded(texts, path):
    ids, n = token_store.encode_texts(pa.array(texts), path)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@pytest.mark.parametrize("name", [token_store.TOKENIZER, "byte_bpe_50k.json"])
def test_words_are_encoded_as_in_whole_texts(name, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_store, "KEPT_UNITS", 8)
    path = public_tokenizers.path(name)
    made, rng = token_store.tokenizer(path)[0], random.Random(8)
    texts = ["", "a\x01b \x01", "<|endoftext|> x.", "é́ ́ é", "c\x1cd\x85e", "a.. b, ,. A, é,. E. İ. 1, it's,", "<|ENDOFTEXT|>", "a<|EndOfText|>, b", "A<|endoftext|>B, <|StartOfText|>. C.", "<|ENDOFTEXT|> <|endoftext|> É<|ENDOFTEXT|>", "A!!B ab***, 12.5% x'S' don't's É!! a-b--"]
    texts += ["".join(rng.choice(["a", "B", " ", "  ", ".", ",", "'s", "\n", "é", "İ", "1", "\u3000", "\u0301", "\x0b", "!", "'", "**", "-", "Q"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    for some in (texts, texts[::-1]):
        assert encoded(some, path) == [made.encode(t, add_special_tokens=False).ids for t in some]


def test_pieces(spark, odd, empty):
    import sentencepiece

    c = piece_codec.codec(piece_codec.default_model())
    texts = ["  a  b ", "▁x ▁", "日本語\n\t", "😀", "the " * 60 + "x" * 300, "\x00"]
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    keys = piece_codec.text_key(texts)
    plain = c.encode_batch(texts, keys, 0.0)
    assert all("▁" in t or "\x00" in t or p.tolist() == lib.encode(t) for t, p in zip(texts, plain))
    assert [c.decode(p.tolist()) for p in c.encode_batch(texts, keys, 0.4)] == texts
    back = piece_codec.decode_pieces(piece_codec.encode_pieces(odd, dropout=0.3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r[0]), r[1] or "") for r in ODD)
    assert piece_codec.encode_pieces(empty).count() == 0


def test_media(odd, empty):
    for r in iso_media.read_iso_media(iso_media.to_iso_media(odd)).collect():
        raw = next((o[1] or "" for o in ODD if o[0] == r.doc_id and len((o[1] or "").encode()) == r.n_bytes)).encode()
        assert r.payload_sha256 == hashlib.sha256(iso_media.padded(raw)).hexdigest() and r.error is None
    raw = iso_media.pack_media(bytes(64 * 200))
    rng = random.Random(3)
    for _ in range(300):
        cut = bytearray(raw[: rng.randrange(len(raw))])
        if cut:
            cut[rng.randrange(len(cut))] ^= rng.randrange(1, 256)
        try:
            iso_media.parse_media(bytes(cut))
        except iso_media.MediaError:
            pass
    assert iso_media.to_iso_media(empty).count() == 0


def test_language(odd, empty):
    model = language_id.fit(odd)
    got = language_id.identify(odd, model).collect()
    assert all((r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or "")) for r in got)
    assert language_id.identify(odd, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, model).count() == 0


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * 10, "big" if i % 3 else "small") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=100).collect()
    assert sum(r.copies for r in got if r.source == "small") == 200 and all(r.copies == 1 for r in got if r.source == "big")
    sources = spark.createDataFrame([("a", 900), ("b", 100)], "source string, tokens long")
    w = [r.weight for r in mixing.mixing_weights(sources, target_entropy=0.9).collect()]
    assert abs(-sum(x * np.log2(x) for x in w) - 0.9) < 1e-6
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == 0


def test_urls(spark):
    urls = [("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("no scheme", "", "", None, None), (None, "", "", None, None), ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"), ("http://q.org#f", "q.org", "", None, None)]
    weights = url_filter.train(spark.createDataFrame(url_filter.labelled_urls(), "url string, label int"))
    got = url_filter.judge(spark.createDataFrame([(i, u[0], 1) for i, u in enumerate(urls)], "page_id long, url string, host int"), weights).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [u[1:4] for u in urls]
    assert all(u[4] in (None, r.verdict) for u, r in zip(urls, got))
