"""The scorer against plain counting and bit-by-bit mixing."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, SCHEMA, lower
from tidewright.llm import context_mixing as cm
from tidewright.llm.storage import held_out, read_table


def texts(n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(1, 9))) for _ in range(150)] + ["É" * 3, "x" * 90, "x" * 91]
    return [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(n)]


def counted(rows):
    found = collections.Counter()
    for t in rows:
        found.update(w + b" " for w in lower(t).encode().split())
        found[cm.END] += 1
    return found


def sorted_keys(found):
    keys = pa.array(sorted(found), pa.large_binary())
    return *cm.spelled(keys), np.array([found[k] for k in sorted(found)])


def test_tokens_are_words():
    given = ["Ab  cD\té", None, "", " \n", "a\x0bb\x0cc"]
    codes, sizes, keys = cm.tokens(pa.array(given))
    made = [keys[int(c)].as_py() for c in codes]
    want = [[*(w + b" " for w in lower(t).encode().split()), cm.END] for t in given]
    assert made == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def test_odds_of_beginnings_are_counts():
    found = counted(texts(30, 1))
    data, offsets, counts = sorted_keys(found)
    for less in (0, 1):
        rows, many = cm.trie_rows(data, offsets, counts, {}, less)
        full = cm.spread(rows, many, counts - less, np.diff(offsets))
        at = 0
        for key in sorted(found):
            for d, byte in enumerate(key[: cm.REACH]):
                for j in range(8):
                    share = [(k, c) for k, c in found.items() if k[:d] == key[:d] and len(k) > d and k[d] >> 8 - j == byte >> 8 - j]
                    taken = sum(c for k, c in share if k[d] >> 7 - j == byte >> 7 - j)
                    want = math.log((taken - less + cm.PRIOR) / (sum(c for _, c in share) - taken + cm.PRIOR))
                    assert abs(full[at + d, j] / 8 - np.clip(want, -127 / 8, 127 / 8)) <= 0.0625 + 1e-6
            at += len(key)


def test_ranges_share_their_beginnings():
    found = counted(texts(40, 2))
    keys = sorted(found)
    data, offsets, counts = sorted_keys(found)
    rows, many = cm.trie_rows(data, offsets, counts, {})
    whole = cm.spread(rows, many, counts, np.diff(offsets))
    cut, parts = len(keys) // 2, []
    spine = {}
    for n in range(cm._shared_length(keys[cut - 1], keys[cut]) + 1):
        spine[keys[cut][:n]] = np.bincount([k[n] for k in keys if k[:n] == keys[cut][:n] and len(k) > n], [found[k] for k in keys if k[:n] == keys[cut][:n] and len(k) > n], 256)
    for some in (keys[:cut], keys[cut:]):
        d, o, c = sorted_keys({k: found[k] for k in some})
        parts.append(cm.spread(*cm.trie_rows(d, o, c, spine), c, np.diff(o)))
    assert np.array_equal(np.concatenate(parts), whole)


def test_mixing_is_bit_by_bit():
    draw = np.random.default_rng(3)
    given = texts(6, 4)
    codes, sizes, keys = cm.tokens(pa.array(given))
    data, offsets = cm.spelled(keys)
    rows = np.concatenate([draw.integers(-90, 90, (len(data), 8)), draw.integers(0, 6, (len(data), 1))], 1).astype(np.int8)
    tables = [draw.integers(-90, 90, cm.SLOTS * 256).astype(np.int8) for _ in range(cm.TABLES)]
    shared = draw.normal(0.3, 0.2, (cm.GATES, 8, cm.INPUTS))
    bits, stream = cm.text_bits(codes, sizes, data, offsets, rows, tables, shared)
    depth, _ = cm.places(np.diff(offsets))
    slots = [cm.byte_slots(data, depth, k) for k in cm.LAST]
    heads, _ = cm.heads_of(data, offsets)
    before = cm.classes_before(codes, sizes, cm.classes_of(data, offsets))
    at = 0
    for t, n in enumerate(sizes):
        own, cost, size = np.zeros((8, cm.INPUTS)), 0.0, 0
        for token in range(at, at + n):
            key = codes[token]
            for i in range(offsets[key], offsets[key + 1]):
                d, byte = depth[i], int(data[i])
                gate = min(d, cm.DEPTHS - 1) * 6 + rows[i, 8]
                for j in range(8):
                    bit, node = byte >> 7 - j & 1, 1 << j | byte >> 8 - j
                    one = [rows[i, j] * (1 if bit else -1)]
                    one += [tables[cm.LAGS + k][s[i] * 256 + node] if s[i] >= 0 else 0 for k, s in enumerate(slots)]
                    one += [tables[k][cm.class_slots(before[token : token + 1, k], heads[key : key + 1], d)[0] * 256 + node] if d < cm.CLASS_BYTES else 0 for k in range(cm.LAGS)]
                    x = np.array(one, float) / 8
                    p = 1 / (1 + math.exp(-np.clip((shared[gate, j] + own[j]) @ x, -14, 14)))
                    cost -= math.log2(p if bit else 1 - p)
                    own[j] += cm.RATE * (bit - p) * x
                size += 1
        assert size == stream[t] and abs(bits[t] - cost) < 1e-3 * cost + 1e-3
        at += n


def test_weights_have_the_least_cost():
    draw = np.random.default_rng(5)
    x = draw.integers(-30, 90, (cm.INPUTS, 400, 8)).astype(np.int8)
    weight = draw.integers(1, 5, 400).astype(float)

    def cost(w, j):
        z = w @ (x[:, :, j] / 8)
        return (np.log1p(np.exp(-np.clip(z, -14, 14))) * weight).sum() + ((w - cm.START) ** 2).sum() / 2

    w, _, _ = cm.solved([(x[:, :250], weight[:250]), (x[:, 250:], weight[250:])])
    for j in range(8):
        assert all(cost(w[j], j) <= cost(w[j] + draw.normal(0, 0.05, cm.INPUTS), j) + 1e-2 for _ in range(30))


def test_base_score_and_odd_rows(spark):
    odd, empty = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    got = cm.score(odd, ~F.col("doc_id").eqNullSafe(7)).collect()
    words = [(r[0], [*(w + b" " for w in lower(r[1]).encode().split()), cm.END]) for r in ODD]
    train = collections.Counter(w for i, ws in words if i != 7 for w in ws)
    n, v = sum(train.values()), len(train)
    assert len(got) == len(ODD)
    for i, ws in words:
        rows = [r for r in got if r.doc_id == i and r.n_tokens == len(ws)]
        assert rows and len({(r.score, r.base_score) for r in rows}) <= len({r[1] for r in ODD if r[0] == i})
        want = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        for r in rows:
            assert r.held_out == (i == 7) and r.train_tokens == n and r.n_known == sum(train[w] > 0 for w in ws)
            assert abs(r.base_score - want) < 1e-6 * abs(want) and r.n_bytes == sum(map(len, ws)) and r.score < 0
    assert cm.score(empty, F.lit(True)).count() == 0
    assert all(abs(r.bits_per_byte - 8) < 1e-6 for r in cm.score(odd, F.lit(False)).collect())


def test_many_ranges_and_parts_score_alike(spark):
    docs = spark.createDataFrame(list(enumerate(texts(60, 6))), "doc_id long, text string")
    one, many = ({r.doc_id: r for r in cm.score(docs, F.col("doc_id") >= 10, words_a_range=w, part_bytes=p).collect()} for w, p in ((10**6, 1 << 30), (20, 400)))
    assert all(one[i].n_known == many[i].n_known and abs(one[i].base_score - many[i].base_score) < 1e-9 for i in one)
    # Ranges solve for their weights apart, so the weights are only nearly the same.
    assert abs(sum(r.score for r in one.values()) / sum(r.score for r in many.values()) - 1) < 0.05
    assert all(r.bits_per_byte < 3.5 for r in one.values() if r.n_tokens > 20)


def test_held_out_texts_score_above_the_word_base(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = cm.score(docs, ~held_out(F.col("doc_id"), 5)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_weights_see_every_occurrence():
    given, trains = texts(50, 8), [k % 5 != 1 for k in range(50)]
    want, total = collections.Counter(), collections.Counter()
    for text, use in zip(given, trains, strict=True):
        codes, sizes, keys = cm.tokens(pa.array([text]))
        classes = cm.classes_of(*cm.spelled(keys))
        for i, code in enumerate(codes if use else []):
            before = [int(classes[codes[i - k]]) if i >= k else 0 for k in range(1, cm.LAGS + 1)]
            want[keys[int(code)].as_py(), before[0] + cm.CLASSES * before[1]] += 1
            total[keys[int(code)].as_py()] += 1
    batches = [pa.RecordBatch.from_arrays([pa.array([int(k // 20)] * 10, pa.int32()), pa.array([not t for t in trains[k : k + 10]]), pa.array(given[k : k + 10])], ["part", "held_out", "text"]) for k in range(0, 50, 10)]
    gathered = [b for b in cm._gather(iter(batches)) if b.column("word").null_count == 0]
    table = pa.Table.from_batches(gathered).select(["word", "c", "codes", "counts"]).sort_by("word")
    (row,) = cm._ranged(iter(table.to_batches(max_chunksize=7)))
    data, offsets, counts, (many, codes, times) = cm._unranged(row, 0)
    words = [data[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
    assert {w: int(c) for w, c in zip(words, counts, strict=True) if c} == total and words == sorted(words)
    assert dict(zip(zip(np.repeat(np.array(words, object), many), codes.tolist(), strict=True), times.tolist(), strict=True)) == want
    assert max(many) > 2


def test_a_range_may_hold_fewer_bytes_than_a_context():
    assert cm.byte_slots(np.frombuffer(b"a ", np.uint8), np.array([0, 1]), 3).tolist() == [-1, -1]


def scoring_peak(words=200_000):
    """Bytes held at most while one batch is scored, a byte of its stream."""
    import tracemalloc

    g = np.random.default_rng(4)
    pool = ["".join(chr(97 + k) for k in g.integers(0, 26, g.integers(4, 12))) for _ in range(500)]
    codes, sizes, keys = cm.tokens(pa.array([" ".join(pool[k] for k in g.integers(0, 500, words))]))
    data, offsets = cm.spelled(keys)
    rows = np.zeros((len(data), 9), np.int8)
    tables, shared = [np.zeros(cm.SLOTS * 256, np.int8)] * cm.TABLES, np.full((cm.GATES, 8, cm.INPUTS), cm.START)
    tracemalloc.start()
    _, stream = cm.text_bits(codes, sizes, data, offsets, rows, tables, shared)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / stream.sum()


def test_scoring_holds_few_numbers_a_byte():
    assert scoring_peak() < 28


def test_batches_of_a_part_are_let_go():
    held = [pa.table({"word": pa.array([b"a ", b"bc "], pa.binary()), "c": pa.array([3, 4], pa.int64()), "odds": pa.array([bytes(9), bytes(18)], pa.binary())}), pa.table({"word": pa.array([b"\n"], pa.binary()), "c": pa.array([5], pa.int64()), "odds": pa.array([b""], pa.binary())})]
    made = cm.Dictionary(held)
    assert held == [] and made.counts.tolist() == [3, 4, 5] and made.many.tolist() == [1, 2, 0] and made.begin.tolist() == [0, 1, 3]
    assert made.of(pa.array([b"\n", b"bc "], pa.large_binary()))[0].tolist() == [5, 4]
