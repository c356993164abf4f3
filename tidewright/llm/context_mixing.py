"""LM scoring by online logistic context mixing.

The text, as its lower-cased words, is a byte stream: each word's bytes and a space, at the end a
line feed.  Every bit of it is predicted from several contexts: the whole beginning of the word, the
word's last two, three and four bytes, and the word's beginning with a class of each of the two words before.
A context's log odds come from the counts of all training words.  They are mixed by weights and
squashed to a probability.  The weights are the sum of a shared set, chosen by a gate (bytes of the
word so far, and how often training saw this beginning) and the place of the bit, and the text's own set,
chosen by the place of the bit, which after each bit moves down the gradient of that bit's cost.  The
sum of costs gives the text's bits, bits per byte, and log10 probability.

What grows with the corpus is never broadcast.  All distinct words, sorted and cut into ranges, are a
trie; a range counts its own branches, and the few beginnings that two ranges share are summed over all.
So the odds of whole beginnings are exact for every word, and a word's odds are a row of a table.
Documents are dealt into parts; a part is joined with the rows of its own words and scored with them.
Contexts of two, three and four bytes and of the class before are hashed to SLOTS slots each: tables of a
fixed size, which are broadcast.

The shared weights are learned from all distinct training words, weighted by their counts: each word is
predicted with one occurrence of it taken out, ranges solve for their weights by Newton steps, the solutions
are joined by their curvature, and all ranges together take one more step from there.   A word's classes before are those of all its occurrences, kept as distinct pairs with their counts.

The text's own weights start anew every SEGMENT bytes (contexts do not), so numpy scores one byte of
thousands of segments at a time.  All eight places of a byte have own weights, so that is the same as bit by bit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.memory import release, returning
from tidewright.llm.storage import dropped, free_shuffles, held_out, need, read_table, settings, written
from tidewright.llm.words import SPACE, runs, spelled

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
#: The hashed contexts: for each of LAGS words before, its class with the beginning; and that many last bytes.
LAGS = 2
LAST = (2, 3, 4)
TABLES = LAGS + len(LAST)
INPUTS = 1 + TABLES
CLASSES = 256
#: Classes before as one number, below this.
PLACES = CLASSES**LAGS
#: Bytes of a word that the class before helps to predict, and the longest beginning that is a context.
CLASS_BYTES = 4
REACH = 64
DEPTHS = 7
#: A beginning's count falls into one of these buckets.
SEEN = np.array([1, 2, 4, 16, 256])
GATES = DEPTHS * (len(SEEN) + 1)
SEGMENT = 2048
LANES = 4096
RATE = 0.01
PRIOR = 0.03
#: Weights before any learning.
START = 0.3
NEWTON = 5
BLOCK = 1 << 16
#: Log odds are held as eighths in a byte.
UNIT = 8.0
PART_BYTES = 24 << 20
MIN_PARTS = 8
WORDS_A_RANGE = 60_000
CHUNK = 1 << 20  # counts that one task sums at a time
PAIRS = 1 << 16  # pairs of a word and its classes before whose weights are solved, or which are merged, at a time
BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": "5000", "spark__sql__execution__arrow__maxBytesPerBatch": str(4 << 20)}
END = b"\n"
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- words ----------------------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of every token, tokens of each text, distinct keys).  A key is a lower-cased (A-Z) word and a
    space, or the end; words are runs of bytes other than ASCII white space, null is empty."""
    words, per_text = runs(texts, SPACE, LOWER, 1)
    coded = words.dictionary_encode()
    keys = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_binary())])
    codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(per_text), len(keys) - 1)
    return codes, per_text + 1, keys


def classes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class 1 to CLASSES - 1 of each key by its word's last two bytes (0 where it has one)."""
    size, end = np.diff(offsets), offsets[1:]
    last = np.where(size > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
    other = np.where(size > 2, data[np.maximum(end - 3, 0)], 0).astype(np.int64)
    return (last * 0x9E3779B1 + other * 0x85EBCA77 >> 11) % (CLASSES - 1) + 1


def classes_before(codes: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The classes of the LAGS words before each token [token, lag]; 0 where the text has none."""
    out = np.zeros((len(codes), LAGS), np.int64)
    place, _ = places(sizes)
    for k in range(LAGS):
        out[k + 1 :, k] = classes[codes[: -k - 1]]
        out[place <= k, k] = 0
    return out


# ---- hashed contexts ------------------------------------------------------------------------


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def byte_slots(data: np.ndarray, depth: np.ndarray, order: int) -> np.ndarray:
    """Slot of the last ``order`` bytes of the word before each byte; -1 where it has fewer."""
    h = np.zeros(len(data), np.uint64)
    for k in range(1, order + 1):
        h[k:] |= data[: max(len(data) - k, 0)].astype(np.uint64) << np.uint64(8 * (k - 1))
    return np.where(depth >= order, _slot(h + np.uint64(order << 40)), -1)


def class_slots(before: np.ndarray, heads: np.ndarray, place: int) -> np.ndarray:
    """Slot of the class before with the first ``place`` bytes (rows of ``heads``)."""
    h = before.astype(np.uint64) + np.uint64((place + 1) << 56)
    for k in range(place):
        h |= (heads[:, k].astype(np.uint64) + np.uint64(1)) << np.uint64(16 * (k + 1))
    return _slot(h)


def heads_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first CLASS_BYTES bytes of each key, size)."""
    size = np.diff(offsets)
    at = offsets[:-1, None] + np.minimum(np.arange(CLASS_BYTES), size[:, None] - 1)
    return data[at].astype(np.int64).reshape(-1, CLASS_BYTES), size


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * UNIT), -127, 127).astype(np.int8)


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Counts [slot, byte] as log odds [slot, node]: node 1 is the first bit, 2 and 3 the second after 0 and 1, ..."""
    out = np.zeros(counts.shape, np.int8)
    while counts.shape[1] > 1:
        zeros, ones = counts[:, ::2], counts[:, 1::2]
        out[:, zeros.shape[1] : 2 * zeros.shape[1]] = quantised(np.log((ones + PRIOR) / (zeros + PRIOR)))
        counts = zeros + ones
    return out


def lessened_of(counts: np.ndarray) -> np.ndarray:
    """Counts [slot, byte] as log odds [slot, node, bit] in favour of the bit, one byte that has it taken out."""
    out = np.zeros((*counts.shape, 2), np.int8)
    while counts.shape[1] > 1:
        zeros, ones = counts[:, ::2], counts[:, 1::2]
        some = slice(zeros.shape[1], 2 * zeros.shape[1])
        out[:, some, 0] = quantised(np.log((np.maximum(zeros - 1, 0) + PRIOR) / (ones + PRIOR)))
        out[:, some, 1] = quantised(np.log((np.maximum(ones - 1, 0) + PRIOR) / (zeros + PRIOR)))
        counts = zeros + ones
    return out


def looked_up_lessened(table: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
    base, v = slot * 512, value.astype(np.int64)
    return np.stack([table[base + (1 << j | v >> 8 - j) * 2 + (v >> 7 - j & 1)] for j in range(8)], 1)


def looked_up(table: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Log odds [byte, place] in favour of the bits that came; 0 at slot -1."""
    out = np.zeros((len(slot), 8), np.int8)
    use = np.flatnonzero(slot >= 0)
    base, v = slot[use] * 256, value[use].astype(np.int64)
    for j in range(8):
        x = table[base + (1 << j | v >> 8 - j)]
        out[use, j] = np.where(v >> 7 - j & 1, x, -x)
    return out


# ---- the trie of a range of words -----------------------------------------------------------


def branches(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, spine: dict[bytes, np.ndarray], reach: int = REACH):
    """(depth, words, their byte, counts [word, 0 to 8 bits of the byte], whether a beginning is the word's
    alone) for sorted distinct keys.  No key begins another one.  ``spine``: counts of the next byte, over
    all ranges, after beginnings that ranges share.  A word leaves after the first beginning of its own."""
    size = np.diff(offsets)
    live, flag = np.arange(len(size)), np.zeros(len(size), bool)
    flag[:1] = True
    for d in range(reach):
        if not len(live):
            return
        v, own = data[offsets[live] + d].astype(np.int64), counts[live]
        total = np.empty((len(live), 9))
        for j in range(9):
            new = flag.copy()
            new[1:] |= v[1:] >> 8 - j != v[:-1] >> 8 - j
            at = np.flatnonzero(new)
            total[:, j] = np.repeat(np.add.reduceat(own, at), np.diff(at, append=len(live)))
        groups = np.flatnonzero(flag)
        many = np.diff(groups, append=len(live))
        alone = np.repeat(many == 1, many)
        for a, b in {(0, int(many[0])), (int(groups[-1]), len(live))}:
            hist = spine.get(data[offsets[live[a]] : offsets[live[a]] + d].tobytes())
            if hist is not None:
                below = np.concatenate([[0], np.cumsum(hist)])
                for j in range(9):
                    lo = v[a:b] >> 8 - j << 8 - j
                    total[a:b, j] = below[lo + (1 << 8 - j)] - below[lo]
                alone[a:b] = False
        yield d, live, v, total, alone
        go = (size[live] > d + 1) & ~alone
        live, flag = live[go], new[go]


def trie_rows(data, offsets, counts, spine, less: int = 0, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(rows [byte, 8 log odds in favour of the word and a bucket of the count], rows of each word) down to
    where a beginning is the word's alone; ``less``: occurrences of the word itself that are taken out."""
    found, rows = [], np.zeros(len(counts), np.int64)
    for d, words, _, total, alone in branches(data, offsets, counts, spine, reach):
        words, total = words[~alone], total[~alone]
        x = np.empty((len(words), 9), np.int8)
        x[:, :8] = quantised(np.log((np.maximum(total[:, 1:] - less, 0) + PRIOR) / (total[:, :8] - total[:, 1:] + PRIOR)))
        x[:, 8] = np.searchsorted(SEEN, total[:, 0] - less, "right")
        rows[words] = d + 1
        found.append((d, words, x))
    begin = np.cumsum(rows) - rows
    out = np.zeros((int(rows.sum()), 9), np.int8)
    for d, words, x in found:
        out[begin[words] + d] = x
    return out, rows


def spread(rows: np.ndarray, many: np.ndarray, counts: np.ndarray, sizes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Rows for every byte of the words: behind ``many`` rows of the trie a word is alone with its count."""
    depth, owner = places(sizes)
    out = np.zeros((len(depth), 9), np.int8)
    begin = np.cumsum(many) - many
    inside = depth < many[owner]
    out[inside] = rows[(begin[owner] + depth)[inside]]
    alone = ~inside & (many < np.minimum(sizes, reach))[owner] & (depth < reach)
    of = np.maximum(counts[owner[alone]], 0)
    out[alone, :8] = quantised(np.log((of + PRIOR) / PRIOR))[:, None]
    out[alone, 8] = np.searchsorted(SEEN, of, "right")
    return out


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in its word, word) of every byte."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner], owner


# ---- mixing ---------------------------------------------------------------------------------


def _inputs(data, sizes, rows, tables) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs [byte, place] of all predictors but the classes before, and the gate of each byte."""
    depth, _ = places(sizes)
    x = [np.ascontiguousarray(rows[:, :8])]
    x += [looked_up(table, byte_slots(data, depth, order), data) for table, order in zip(tables[LAGS:], LAST, strict=True)]
    return x, np.minimum(depth, DEPTHS - 1) * (len(SEEN) + 1) + rows[:, 8]


def learned(data, offsets, counts, before, spine, tables, lessened, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(curvature [gate, place, input, input], curvature times solution) of the weights that suit the words of
    a range best, each word's own occurrence taken out; with ``weights``, of one Newton step from those.  
    ``before``: (pairs of each word, their classes before, how often training has each); every occurrence counts."""
    size = np.diff(offsets)
    rows, many = trie_rows(data, offsets, counts, spine, 1)
    x, gate = _inputs(data, size, spread(rows, many, counts - 1, size), tables)
    depth, owner = places(size)
    heads, _ = heads_of(data, offsets)
    curve, pull, found = np.zeros((GATES, 8, INPUTS, INPUTS)), np.zeros((GATES, 8, INPUTS)), {}

    def add(at, extra, weight):
        gates = gate[at]
        order = np.argsort(gates, kind="stable")
        cuts = np.searchsorted(gates[order], np.arange(GATES + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[g] : cuts[g + 1]]
            w, h, more = solved([(np.stack([*(f[at[some]] for f in x), *(f[some] for f in extra)]), weight[some]) for some in np.split(own, np.arange(BLOCK, len(own), BLOCK))], None if weights is None else weights[g], found.get(g))
            found[g] = w
            curve[g] += h
            pull[g] += np.einsum("jab,jb->ja", h, w) + more

    late = np.flatnonzero((counts[owner] > 0) & (depth >= CLASS_BYTES))
    add(late, [np.zeros((len(late), 8), np.int8)] * LAGS, counts[owner[late]].astype(np.float64))
    many, codes, times = before
    word = np.repeat(np.arange(len(size)), many)
    for a in range(0, len(codes), PAIRS):
        w, c, t = word[a : a + PAIRS], codes[a : a + PAIRS].astype(np.int64), times[a : a + PAIRS].astype(np.float64)
        at, extra, weight = [], [[] for _ in range(LAGS)], []
        for d in range(CLASS_BYTES):
            here = np.flatnonzero(size[w] > d)
            at.append(offsets[w[here]] + d)
            weight.append(t[here])
            for lag in range(LAGS):
                extra[lag].append(looked_up_lessened(lessened[lag], class_slots(c[here] // CLASSES**lag % CLASSES, heads[w[here]], d), data[at[-1]]))
        add(np.concatenate(at), [np.concatenate(e) for e in extra], np.concatenate(weight))
    return curve, pull


def solved(blocks: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray | None = None, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights [place, input] of the least cost, curvature there, 0), or (``start``, curvature and slope there) for blocks of (inputs [input, byte, place],
    weight of each byte).  Newton steps from ``begin`` of at most 1 an input; one that raises a place's cost is cut to a quarter."""
    w = (start if start is not None else np.full((8, INPUTS), START) if begin is None else begin).copy()
    curve, slopes = np.zeros((8, INPUTS, INPUTS)), np.zeros((8, INPUTS))
    weighted = [weight.astype(np.float32) for _, weight in blocks]
    for j in range(8):  # places have weights of their own, so each stops by itself
        own = [x[:, :, j].astype(np.float32) for x, _ in blocks]
        for b in own:
            b *= np.float32(1 / UNIT)
        if start is not None:
            _, curve[j], slopes[j] = _costs(own, weighted, w[j])
            continue
        now, least = w[j].copy(), np.inf
        for _ in range(NEWTON):
            cost, h, slope = _costs(own, weighted, now)
            good = cost <= least
            if good:
                least, w[j], curve[j] = cost, now, h
            step = np.linalg.solve(h + np.eye(INPUTS), slope + START - now)
            step /= max(1, np.abs(step).max())
            if good and np.abs(step).max() < 0.01:
                break
            now = now + step if good else w[j] + (now - w[j]) / 4
    return w, curve, slopes


def _costs(own: list[np.ndarray], weighted: list[np.ndarray], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(cost, curvature, slope) of the weights of one place."""
    cost, h, slope = float(((w - START) ** 2).sum() / 2), np.zeros((INPUTS, INPUTS)), np.zeros(INPUTS)
    for b, many in zip(own, weighted, strict=True):
        e = w.astype(np.float32) @ b
        np.clip(e, -14, 14, out=e)
        np.exp(np.negative(e, out=e), out=e)
        e += np.float32(1)
        cost += float(np.log(e) @ many)
        p = np.float32(1) - np.float32(1) / e
        p *= many
        slope += b @ p
        p /= e
        h += (b * p) @ b.T
    return cost, h, slope


def joined(curve: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Weights [gate, place, input] from sums of curvatures and pulls; START where nothing was seen."""
    return np.linalg.solve(curve + np.eye(INPUTS), (pull + START)[..., None])[..., 0]


def mixed_bits(source, extra_of, begins, lengths, x, extra, gates, shared, rate: float = RATE) -> np.ndarray:
    """Bits of each segment source[begins:begins + lengths], in descending length.  ``source`` points at
    inputs ``x`` ([byte, place] an order) and ``gates``, ``extra_of`` at the rows of each of ``extra``."""
    n, most = len(begins), int(lengths[0])
    packed = [f.view(np.int64).reshape(-1) for f in (*x, *extra)]
    weights = [np.ascontiguousarray(shared[:, :, o]).astype(np.float32) / np.float32(UNIT) for o in range(INPUTS)]
    own = [np.zeros((n, 8), np.float32) for _ in packed]
    cost, one, step = np.zeros(n), np.float32(1), np.float32(rate / UNIT**2)
    active = np.searchsorted(-lengths, -np.arange(most), "left").tolist()
    for t in range(most):
        m = active[t]
        at = begins[:m] + t
        u = source[at]
        gate = gates[u]
        inputs = []
        for o, f in enumerate(packed):
            inputs.append(f.take(u if o < len(x) else extra_of[at]).view(np.int8).reshape(m, 8).astype(np.float32))
            w = weights[o].take(gate, 0)
            w += own[o][:m]
            w *= inputs[o]
            z = w if o == 0 else np.add(z, w, out=z)
        np.clip(z, -14, 14, out=z)
        np.negative(z, out=z)
        e = np.exp(z, out=z)
        e += one
        cost[:m] += np.log(e).sum(1)
        np.reciprocal(e, out=e)
        np.subtract(one, e, out=e)
        e *= step
        for o, f in enumerate(inputs):
            f *= e
            own[o][:m] += f
    return cost / math.log(2)


def text_bits(codes, sizes, data, offsets, rows, tables, shared, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(bits, bytes of the stream) of each text, given as its tokens, the keys and the rows of their bytes."""
    of_key = np.diff(offsets)
    x, gates = _inputs(data, of_key, rows, tables)
    heads, many = heads_of(data, offsets)[0].astype(np.uint8)[codes], of_key[codes]
    before = classes_before(codes, sizes, classes_of(data, offsets))
    extra = [np.zeros((len(codes) * CLASS_BYTES + 1, 8), np.int8) for _ in range(LAGS)]
    for lag in range(LAGS):
        for d in range(CLASS_BYTES):
            slot = np.where(many > d, class_slots(before[:, lag], heads, d), -1)
            extra[lag][d : len(codes) * CLASS_BYTES : CLASS_BYTES] = looked_up(tables[lag], slot, heads[:, d])
    del before, heads
    # The stream has many more bytes than tokens: numbers of 32 bits a byte, and none besides those that are kept.
    ends = np.cumsum(many)
    begin = ends - many
    source = np.repeat((offsets[codes] - begin).astype(np.int32), many)
    source += np.arange(len(source), dtype=np.int32)
    extra_of = np.full(len(source), len(codes) * CLASS_BYTES, np.int32)
    for d in range(CLASS_BYTES):
        use = np.flatnonzero(many > d)
        extra_of[begin[use] + d] = use * CLASS_BYTES + d
    stops = ends[np.cumsum(sizes) - 1]
    stream = np.diff(stops, prepend=0)
    pieces = -(-stream // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    begins, lengths = (stops - stream)[owner] + offset, np.minimum(SEGMENT, stream[owner] - offset)
    cost, order = np.empty(len(owner)), np.argsort(-lengths, kind="stable")
    for a in range(0, len(order), LANES):
        some = order[a : a + LANES]
        cost[some] = mixed_bits(source, extra_of, begins[some], lengths[some], x, extra, gates, shared, rate)
    return np.bincount(owner, cost, len(sizes)), stream


# ---- corpus ---------------------------------------------------------------------------------

GATHERED = "part int, word binary, c bigint, chunk int, codes binary, counts binary"


def _batch(types: str, **columns) -> pa.RecordBatch:
    """Columns named as in ``types``; those not given are null."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    n = len(next(iter(columns.values())))
    names = [t.split() for t in types.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[t]) if not isinstance(columns.get(k), pa.Array) and k in columns else columns[k].cast(kinds[t]) if k in columns else pa.nulls(n, kinds[t]) for k, t in names], [k for k, _ in names])


def _sums(order: int, counts: np.ndarray, at: np.ndarray):
    """(chunk, codes, counts) of an order's counts at the ascending places ``at``."""
    cut = np.searchsorted(at, np.arange(0, SLOTS * 256 + 1, CHUNK))
    for k in range(SLOTS * 256 // CHUNK):
        some = slice(cut[k], cut[k + 1])
        if cut[k] < cut[k + 1]:
            yield order * (SLOTS * 256 // CHUNK) + k, (at[some] - k * CHUNK).astype("<u4").tobytes(), counts[some].astype("<i8").tobytes()


def _cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary cell of ``values`` between each two of ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype("<i4")), pa.py_buffer(values.tobytes())])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct pairs, their times) of (pairs, times); a pair is a word's number and its classes before."""
    pairs, times = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in (0, 1))
    order = np.argsort(pairs)
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


def _gather(batches):
    """Rows in order of their part -> its distinct words with training counts and their classes before; at the
    end the task's counts of the class before with the beginning."""
    total = np.zeros((LAGS, SLOTS * 256), np.uint32)
    part, held = None, []

    def flush():
        nonlocal held
        coded = pa.chunked_array([k for k, _, _ in held]).combine_chunks().dictionary_encode()
        at, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        c = np.bincount(at, np.concatenate([c for _, c, _ in held]), n).astype(np.int64)
        begin = np.cumsum([0, *(len(k) for k, _, _ in held)])
        pairs, times = _merged([(at[begin[i] + p // PLACES] * PLACES + p % PLACES, t) for i, (_, _, (p, t)) in enumerate(held)])
        cut = np.searchsorted(pairs, np.arange(n + 1) * PLACES)
        held = []
        for a in range(0, n, 50_000):
            z = min(a + 50_000, n)
            some, ends = slice(cut[a], cut[z]), cut[a : z + 1] - cut[a]
            yield _batch(GATHERED, part=np.full(z - a, part, np.int32), word=coded.dictionary.slice(a, z - a), c=c[a:z], codes=_cells((pairs[some] % PLACES).astype("<u2"), ends), counts=_cells(times[some].astype("<u4"), ends))

    for b in batches:
        parts = b.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            if held and parts[a] != part:
                yield from flush()
            part = int(parts[a])
            codes, sizes, keys = tokens(b.column("text").slice(a, z - a))
            data, offsets = spelled(keys)
            trains = np.repeat(~b.column("held_out").slice(a, z - a).to_numpy(zero_copy_only=False).astype(bool), sizes)
            before = classes_before(codes, sizes, classes_of(data, offsets))
            known, prior = codes[trains], before[trains]
            heads, size = heads_of(data, offsets)
            heads, size = heads.astype(np.uint8)[known], size[known]
            for d in range(CLASS_BYTES):
                use = np.flatnonzero(size > d)
                some = heads[use]
                for lag in range(LAGS):
                    np.add.at(total[lag], class_slots(prior[use, lag], some, d) * 256 + some[:, d], np.uint32(1))
            pairs = known * PLACES + prior @ CLASSES ** np.arange(LAGS)
            held.append((keys, np.bincount(known, minlength=len(keys)), _merged([(pairs, np.ones(len(pairs), np.int64))])))
    if held:
        yield from flush()
    made = [m for lag in range(LAGS) for at in [np.flatnonzero(total[lag])] for m in _sums(lag, total[lag][at], at)]
    if made:
        yield _batch(GATHERED, chunk=[m[0] for m in made], codes=[m[1] for m in made], counts=[m[2] for m in made])


RANGES = "n bigint, v bigint, t bigint, first binary, last binary, data binary, sizes binary, counts binary, many binary, codes binary, times binary"


def _ranged(batches):
    """Sorted words of one range, a row a part that has the word, as one row."""
    words, counts, held, n, last = [], [], [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column("word").cast(pa.large_binary()).dictionary_encode()
        keys, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        c = np.bincount(at, b.column("c").to_numpy(), len(keys)).astype(np.int64)
        again = keys[0].as_py() == last
        at += n - again
        if again:
            counts[-1][-1] += c[0]
        words.append(keys.slice(int(again)))
        if len(c) > again:
            counts.append(c[int(again) :])
        n, last = n + len(keys) - again, keys[len(keys) - 1].as_py()
        raw, ends = spelled(b.column("codes").cast(pa.large_binary()))
        held.append((np.repeat(at, np.diff(ends) // 2) * PLACES + raw.view("<u2"), spelled(b.column("counts").cast(pa.large_binary()))[0].view("<u4")))
        if len(held) > 1 and sum(len(p) for p, _ in held[1:]) > max(1 << 20, len(held[0][0])):
            held = [_merged(held)]
    if not n:
        return
    keys, c = pa.concat_arrays(words), np.concatenate(counts)
    pairs, times = _merged(held)
    data, offsets = spelled(keys)
    key = lambda i: data[offsets[i] : offsets[i + 1]].tobytes()
    cells = {"data": data, "sizes": np.diff(offsets).astype("<i4"), "counts": c.astype("<i8"), "many": np.bincount(pairs // PLACES, minlength=n).astype("<i4"), "codes": (pairs % PLACES).astype("<u2"), "times": times.astype("<i8")}
    yield _batch(RANGES, n=[n], v=[int((c > 0).sum())], t=[int(c.sum())], first=[key(0)[:REACH]], last=[key(n - 1)[:REACH]], **{k: [f.tobytes()] for k, f in cells.items()})


def _unranged(batch: pa.RecordBatch, i: int):
    data, sizes, counts, *before = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("data", np.uint8), ("sizes", "<i4"), ("counts", "<i8"), ("many", "<i4"), ("codes", "<u2"), ("times", "<i8")))
    return data, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), counts, before


def _suffix_sums(batches):
    """Counts of the last-bytes contexts over the words of ranges."""
    for b in batches:
        for i in range(b.num_rows):
            data, offsets, counts, _ = _unranged(b, i)
            depth, owner = places(np.diff(offsets))
            weight = counts[owner]
            made = []
            for k, order in enumerate(LAST, LAGS):
                slot = byte_slots(data, depth, order)
                use = np.flatnonzero((slot >= 0) & (weight > 0))
                at, inverse = np.unique(slot[use] * 256 + data[use], return_inverse=True)
                made += _sums(k, np.bincount(inverse, weight[use], len(at)).astype(np.int64), at)
            if made:
                yield _batch("chunk int, codes binary, counts binary", chunk=[m[0] for m in made], codes=[m[1] for m in made], counts=[m[2] for m in made])


def _tabled(batches):
    """Sums of each chunk, rows in order of the chunk, as log odds."""
    now, total = None, None

    def done():
        counts = total.reshape(-1, 256)
        return _batch("chunk int, odds binary, less binary", chunk=[now], odds=[odds_of(counts).tobytes()], less=[lessened_of(counts).tobytes() if now < LAGS * SLOTS * 256 // CHUNK else None])

    for b in batches:
        for chunk, codes, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "codes", "counts")), strict=True):
            if chunk != now:
                if now is not None:
                    yield done()
                now, total = chunk, np.zeros(CHUNK, np.int64)
            total[np.frombuffer(codes, "<u4")] += np.frombuffer(counts, "<i8")
    if now is not None:
        yield done()


def _shared_length(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _spine_counts(depths: dict[bytes, int]):
    """(beginning, byte, count) of a range's own words after the beginnings it shares with a neighbour."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data, offsets, counts, _ = _unranged(b, i)
                edges = [(b.column(c)[i].as_py(), depths.get(b.column(c)[i].as_py(), -1)) for c in ("first", "last")]
                found = {}
                for d, live, v, _, _ in branches(data, offsets, counts, {}, max(n for _, n in edges) + 1):
                    for edge, n in edges:
                        if d <= n and edge[:d] not in found and len(live):
                            same = np.ones(len(live), bool)
                            for k in range(d):
                                same &= data[offsets[live] + k] == edge[k]
                            found[edge[:d]] = np.bincount(v[same], counts[live[same]], 256)
                rows = [(p, int(x), int(h[x])) for p, h in found.items() for x in np.flatnonzero(h)]
                if rows:
                    yield _batch("prefix binary, byte int, n bigint", prefix=[r[0] for r in rows], byte=[r[1] for r in rows], n=[r[2] for r in rows])

    return run


ODDS = "word binary, c bigint, odds binary, stats binary"


def _flat(parts) -> bytes:
    return np.concatenate([f.reshape(-1) for f in parts]).astype("<f8").tobytes()


def _summed(batches):
    """The sum of all rows of a task."""
    total = None
    for b in batches:
        for raw in b.column("stats"):
            value = np.frombuffer(raw.as_py(), "<f8")
            total = value if total is None else total + value
    if total is not None:
        yield _batch("stats binary", stats=[total.tobytes()])


def _modelled(shared):
    """Each word's count and rows; and the range's curvatures and pulls."""

    def run(batches):
        packed, spine, less = shared.value
        tables, lessened = packed.get(), less.get()
        for b in batches:
            for i in range(b.num_rows):
                data, offsets, counts, before = _unranged(b, i)
                rows, many = trie_rows(data, offsets, counts, spine)
                raw, ends = rows.tobytes(), np.cumsum(many)
                for a in range(0, len(counts), 50_000):
                    some = range(a, min(a + 50_000, len(counts)))
                    yield _batch(ODDS, word=[data[offsets[k] : offsets[k + 1]].tobytes() for k in some], c=counts[a : some.stop], odds=[raw[9 * (ends[k] - many[k]) : 9 * ends[k]] for k in some])
                del rows, raw
                yield _batch(ODDS, stats=[_flat(learned(data, offsets, counts, before, spine, tables, lessened))])
                release()

    return run


def _stepped(shared):
    """A range's curvatures and pulls of one step from the weights that all ranges gave together."""

    def run(batches):
        packed, spine, less, weights = shared.value
        for b in batches:
            for i in range(b.num_rows):
                yield _batch("stats binary", stats=[_flat(learned(*_unranged(b, i), spine, packed.get(), less.get(), weights))])
                release()

    return run


def _weights_of(stats: DataFrame) -> np.ndarray:
    """Weights from the sums of all ranges' curvatures and pulls, a row a range."""
    flat = np.zeros(GATES * 8 * INPUTS * (INPUTS + 1))
    for r in stats.repartition(MIN_PARTS).mapInArrow(_summed, "stats binary").toLocalIterator():
        flat += np.frombuffer(r["stats"], "<f8")
    cut = GATES * 8 * INPUTS * INPUTS
    return joined(flat[:cut].reshape(GATES, 8, INPUTS, INPUTS), flat[cut:].reshape(GATES, 8, INPUTS))


class Packed:
    """Arrays that are sent compressed, as most of a table is 0, and unpacked once in each process."""

    def __init__(self, arrays: list[np.ndarray]):
        self.held = [(len(a), pa.compress(a.tobytes(), "zstd", asbytes=True)) for a in arrays]

    def get(self) -> list[np.ndarray]:
        if not hasattr(self, "_arrays"):
            self._arrays = [np.frombuffer(pa.decompress(raw, n, "zstd"), np.int8) for n, raw in self.held]
        return self._arrays

    def __getstate__(self):
        return {"held": self.held}


class Dictionary:
    """Counts and rows of the words of one part."""

    def __init__(self, held: list[pa.Table]):
        # A column at a time; the batches are emptied as they are read, so that no word is held twice.
        whole = lambda name: pa.chunked_array([t.column(name).chunk(0) for t in held]).combine_chunks().cast(pa.large_binary())
        self.counts = np.concatenate([t.column("c").to_numpy() for t in held])
        self.words = whole("word")
        held[:] = [t.select(["odds"]) for t in held]
        raw, offsets = spelled(whole("odds"))
        held.clear()
        self.rows, self.begin, self.many = raw.view(np.int8).reshape(-1, 9), (offsets[:-1] // 9).astype(np.int32), (np.diff(offsets) // 9).astype(np.int32)

    def of(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(count of each key, rows of all their bytes)."""
        at = pc.index_in(keys, value_set=self.words)
        if at.null_count:
            raise ValueError("a word of the part has no row")
        at = at.to_numpy(zero_copy_only=False)
        many = self.many[at]
        place, owner = places(many)
        return self.counts[at], spread(self.rows[self.begin[at][owner] + place], many, self.counts[at], np.diff(spelled(keys)[1]))


def score(docs: DataFrame, training, rate: float = RATE, part_bytes: int = PART_BYTES, words_a_range: int = WORDS_A_RANGE) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``training``: a condition, true for the rows to learn from; the others are held out.  Null
    text is empty: one token, the end.  Without training rows all log odds are 0 (a bit costs one bit) and the
    base uses counts of 0.  Equal texts score alike; repeated rows stay repeated; other columns, whatever
    their names, are not looked at.  Empty table: empty result."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(MIN_PARTS, -(-size // part_bytes))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(parts)).cast("int")
    rows = docs.select("doc_id", "text", (~F.coalesce(training, F.lit(False))).alias("held_out")).withColumn("part", part)
    dealt = rows.select("part", "held_out", "text").repartition(parts, "part").sortWithinPartitions("part")
    with settings(spark, **BATCH):
        gathered = written(dealt.mapInArrow(returning(_gather), GATHERED), "gathered")
    free_shuffles(spark)
    wanted = gathered.where("word IS NOT NULL")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="20000", spark__sql__execution__arrow__maxBytesPerBatch=str(8 << 20)):
        many = max(1, -(-wanted.count() // words_a_range))
        ranges = written(wanted.select("word", "c", "codes", "counts").repartitionByRange(many, "word").sortWithinPartitions("word").mapInArrow(returning(_ranged), RANGES), "ranges")
    free_shuffles(spark)
    known = ranges.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in "vt")).first()
    train_tokens, bottom = known["t"], known["t"] + 0.5 * (known["v"] + 1)

    # One file a range: ranges are read one at a time, by as many tasks.
    with settings(spark, spark__sql__files__maxPartitionBytes="4m", spark__sql__files__openCostInBytes="4m", spark__sql__execution__arrow__maxRecordsPerBatch="1"):
        sums = gathered.where("chunk IS NOT NULL").select("chunk", "codes", "counts").unionByName(ranges.mapInArrow(returning(_suffix_sums), "chunk int, codes binary, counts binary"))
        made = sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_tabled, "chunk int, odds binary, less binary")
        tables = np.zeros((TABLES * SLOTS * 256 // CHUNK, CHUNK), np.int8)  # of a fixed size
        lessened = np.zeros((LAGS * SLOTS * 256 // CHUNK, 2 * CHUNK), np.int8)
        made = written(made, "tables", compression="zstd")
        for r in made.toLocalIterator():
            tables[r["chunk"]] = np.frombuffer(r["odds"], np.int8)
            if r["less"] is not None:
                lessened[r["chunk"]] = np.frombuffer(r["less"], np.int8)
        tables, lessened = list(tables.reshape(TABLES, -1)), list(lessened.reshape(LAGS, -1))
        dropped(made)
        asked = written(wanted.select("part", "word"), "asked")
        dropped(gathered)
        # Two keys a range; and the beginnings that neighbours share, a few a range.
        edges = sorted((r["first"], r["last"]) for r in ranges.select("first", "last").collect())
        depths: dict[bytes, int] = {}
        for (_, last), (first, _) in zip(edges[:-1], edges[1:], strict=True):
            n = min(_shared_length(last, first), REACH - 1)
            for key in (last, first):
                depths[key] = max(depths.get(key, -1), n)
        spine: dict[bytes, np.ndarray] = {}
        for r in ranges.mapInArrow(_spine_counts(depths), "prefix binary, byte int, n bigint").groupBy("prefix", "byte").agg(F.sum("n").alias("n")).toLocalIterator():
            spine.setdefault(bytes(r["prefix"]), np.zeros(256))[r["byte"]] = r["n"]
        packed = Packed(tables)
        less = Packed(lessened)
        model = spark.sparkContext.broadcast((packed, spine, less))
        odds = written(ranges.mapInArrow(returning(_modelled(model)), ODDS), "odds")
        weights = _weights_of(odds.where("stats IS NOT NULL").select("stats"))
        model.destroy()
        if len(edges) > 1:
            model = spark.sparkContext.broadcast((packed, spine, less, weights))
            weights = _weights_of(ranges.mapInArrow(returning(_stepped(model)), "stats binary"))
            model.destroy()
    dropped(ranges)
    shared = spark.sparkContext.broadcast((packed, weights))
    del tables, lessened, packed, less
    release()

    # Written, so that the join's shuffle is freed before the next one.
    found = written(asked.join(odds.where("word IS NOT NULL").select("word", "c", "odds"), "word"), "found")
    dropped(odds, asked)
    free_shuffles(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    null = lambda t: F.lit(None).cast(t)
    both = found.select("part", F.lit(0).alias("kind"), "word", "c", "odds", null(kind).alias("doc_id"), null("boolean").alias("held_out"), null("string").alias("text"))
    both = both.unionByName(rows.select("part", F.lit(1).alias("kind"), null("binary").alias("word"), null("bigint").alias("c"), null("binary").alias("odds"), "doc_id", "held_out", "text"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "bits", "n_bytes"]

    def scored(batches):
        packed, weights = shared.value
        tables = packed.get()
        held, part, dictionary = [], None, None
        for b in batches:
            kinds, parts = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "part"))
            cuts = [0, *(np.flatnonzero((np.diff(kinds) != 0) | (np.diff(parts) != 0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if parts[a] != part:
                    part, held, dictionary = parts[a], [], None
                if kinds[a] == 0:
                    held.append(pa.Table.from_batches([b.slice(a, z - a)]).select(["word", "c", "odds"]))
                    continue
                if dictionary is None:
                    dictionary, held = Dictionary(held), []
                codes, sizes, keys = tokens(b.column("text").slice(a, z - a))
                counts, rows = dictionary.of(keys)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                base = np.bincount(owner, np.log10((counts + 0.5) / bottom)[codes], len(sizes))
                seen = np.bincount(owner, (counts > 0)[codes], len(sizes)).astype(np.int64)
                bits, stream = text_bits(codes, sizes, *spelled(keys), rows, tables, weights, rate)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), b.column("held_out").slice(a, z - a), pa.array(sizes), pa.array(seen), pa.array(base), pa.array(bits), pa.array(stream)], names)
                del codes, sizes, keys, counts, rows, owner, base, seen, bits, stream
                release()

    with settings(spark, **{**BATCH, "spark__sql__execution__arrow__maxRecordsPerBatch": "50000", "spark__sql__execution__arrow__maxBytesPerBatch": str(3 << 20)}):
        out = written(both.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(returning(scored), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, bits double, n_bytes bigint"), "scored")
    dropped(found)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("bits") * F.lit(-math.log10(2))).alias("score"),
        "n_bytes",
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, ~held_out(F.col("doc_id"), 5))
