"""Token-id output: an adaptive context-mixing range coder in reset, checksummed blocks.

A shard is one self-contained image: header, document table, the counts of its ids, and blocks of
BLOCK ids.  Every block starts from the same state, so each decodes alone, and carries the
crc32 of its ids.  Three predictions are mixed for each id:

- order 2 and order 1 say which id followed the last two ids, or the last one, when last seen in the block;
- order 0 is a distribution of all ids: GROUPS groups of about equal mass, whose frequencies adapt
  in the block, and inside a group the shares of the shard's counts.

The mixture gives an id w0 * P0(id) + w1 * [order 1 says it] + w2 * [order 2 says it].  The weights
belong to the confidences of both predictions (unseen, seen, right once, right more often); after each id they move
towards the share that each order had in the id's probability.  One step of a 64-bit carryless range coder
writes the id: ids are ranked, and the mixture's mass below a rank is that of order 0 plus the masses
of the predictions that lie below it.

Blocks are independent, so numpy codes one id of every block at a time.

Images are rows of a Parquet table that Spark writes and reads (any store that Spark reaches):
shard, part (order), first_id count and ``content``.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.memory import returning
from tidewright.llm.storage import need, new_path, read_table, settings
from tidewright.llm.words import runs, spelled

MAGIC = b"TWID\x02"
BLOCK = 2048
SHARD_IDS = 8 << 20
GROUPS = 16
RENEWED = 32  # ids between two renewals of the groups' frequencies
SLOTS1, SLOTS2 = 9, 10  # bits of the tables of order 1 and 2, in each block
MAX_ID = (1 << 28) - 1
#: Bits of a weight, of a group's frequency, and of a share inside a group.
WEIGHT, GROUP, SHARE = 14, 14, 16
ORDER0 = GROUP + SHARE
TOTAL = np.uint64(WEIGHT + ORDER0)
#: Weight that order 0 always keeps, and first weights by confidence, of 1 << WEIGHT.
KEPT = 256
FIRST = np.array([0, 1600, 4800, 9600])
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 44)
RATE = 5
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Stands for a null doc_id in an image: the largest number, so that such documents come last.
NO_ID = (1 << 63) - 1


class StoreError(ValueError):
    """An image is damaged."""


# ---- coder ----------------------------------------------------------------------------------


class _Order0:
    """Ranks of the ids, and group, start and width of each rank, from 16-bit counts."""

    def __init__(self, counts: np.ndarray):
        ids = np.flatnonzero(counts)
        ids = ids[np.lexsort((ids, -counts[ids].astype(np.int64)))]
        mass = counts[ids].astype(np.int64)
        before = np.cumsum(mass) - mass
        kind = np.minimum(GROUPS - 1, before * GROUPS // max(1, mass.sum()))
        self.ids, n = ids.astype(np.int32), len(ids)
        self.rank = np.zeros(len(counts), np.int32)
        self.rank[ids] = np.arange(n)
        # One rank more stands for no id: behind all others, without width.
        self.group, self.low, self.width = np.full(n + 1, GROUPS - 1), np.full(n + 1, 1 << SHARE), np.zeros(n + 1, np.int64)
        self.lookup = np.zeros(GROUPS << SHARE, np.int32)
        for c in range(GROUPS):
            own = np.flatnonzero(kind == c)
            if not len(own):
                continue
            width = 1 + mass[own] * ((1 << SHARE) - len(own)) // mass[own].sum()
            width[0] += (1 << SHARE) - width.sum()
            self.group[own], self.low[own], self.width[own] = c, np.cumsum(width) - width, width
            self.lookup[c << SHARE : c + 1 << SHARE] = np.repeat(own, width)


class _Lanes:
    """The state of all blocks: predictions, mixture and coder."""

    def __init__(self, n: int, order0: _Order0):
        self.none = len(order0.ids)
        # An entry is a rank and its confidence in the last two bits.
        self.t1, self.t2 = np.full(n << SLOTS1, self.none << 2, np.int32), np.full(n << SLOTS2, self.none << 2, np.int32)
        lane = np.arange(n)
        self.at1, self.at2, self.at_row, self.at_group = lane << SLOTS1, lane << SLOTS2, lane << 4, lane * (GROUPS + 1)
        w2 = np.repeat(FIRST, 4)
        w1 = np.tile(FIRST, 4) * ((1 << WEIGHT) - KEPT - w2) >> WEIGHT
        self.w1, self.w2 = np.tile(w1, n), np.tile(w2, n)
        self.seen = np.full((n, GROUPS + 1), 4, np.int32)
        self.seen[:, 0] = 0
        self.seen_flat = self.seen.reshape(-1)
        self.a, self.b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.step = 0

    def predict(self) -> None:
        if self.step % RENEWED == 0:
            below = np.cumsum(self.seen, 1)
            self.cdf = (below * ((1 << GROUP) - GROUPS) // below[:, -1:] + np.arange(GROUPS + 1)).reshape(-1)
        self.step += 1
        s1, s2 = self.a * 0x9E3779B1, self.a * 0x85EBCA77
        s1 >>= 7
        s1 &= (1 << SLOTS1) - 1
        s1 += self.at1
        s2 += self.b
        s2 >>= 9
        s2 &= (1 << SLOTS2) - 1
        s2 += self.at2
        self.s1, self.s2 = s1, s2
        self.e1, self.e2 = self.t1.take(self.s1), self.t2.take(self.s2)
        self.c1, self.c2 = self.e1 & 3, self.e2 & 3
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        self.row = self.at_row + (self.c2 << 2 | self.c1)
        self.m1, self.m2 = self.w1.take(self.row), self.w2.take(self.row)
        self.m0 = (1 << WEIGHT) - self.m1 - self.m2

    def order0(self, group, low, width) -> tuple[np.ndarray, np.ndarray]:
        """Mass below and mass of ranks given by group, start and width, of 1 << ORDER0."""
        at = self.at_group + group
        begin = self.cdf.take(at)
        at += 1
        many = self.cdf.take(at)
        many -= begin
        begin <<= SHARE
        begin += many * low
        many *= width
        return begin, many

    def code(self, x, below, own) -> None:
        """Narrow the coder to ``x``, whose order-0 masses are given, and learn it."""
        hit1, hit2 = self.p1 == x, self.p2 == x
        by1, by2 = self.m1 * hit1, self.m2 * hit2
        mass = by1 + by2
        mass <<= ORDER0
        mass += self.m0 * own
        start = self.m1 * (self.p1 < x)
        start += self.m2 * (self.p2 < x)
        start <<= ORDER0
        start += self.m0 * below
        self.range >>= TOTAL
        self.low += self.range * start.view(np.uint64)
        self.range *= mass.view(np.uint64)
        part = float(((1 << WEIGHT) - KEPT) << ORDER0) / mass
        for table, by, old in ((self.w1, by1, self.m1), (self.w2, by2, self.m2)):
            move = (by * part).astype(np.int64)
            move -= old
            move >>= RATE
            move += old
            table[self.row] = move
        new = x << 2 | 1
        self.t1[self.s1] = np.where(hit1, self.e1 + (self.c1 < 3), new)
        self.t2[self.s2] = np.where(hit2, self.e2 + (self.c2 < 3), new)
        self.b, self.a = self.a * 0xC2B2AE3D, x.astype(np.int64) + 1

    def count(self, group) -> None:
        at = self.at_group + group + 1
        self.seen_flat[at] += 4

    def shift(self):
        """Lanes whose first 16 bits are settled, until there is none; the caller moves them.  Only lanes that
        have just moved can be settled again."""
        low, rng = self.low, self.range
        l, r, at = low, rng, None
        while True:
            settled = (l ^ (l + r)) < TOP
            short = r < BOTTOM
            if short.any():
                short &= ~settled
                r[short] = (np.uint64(0) - l[short]) & (BOTTOM - np.uint64(1))
                settled |= short
            if at is not None:
                low[at], rng[at] = l, r
            moved = np.flatnonzero(settled)
            if not len(moved):
                return
            at = moved if at is None else at[moved]
            yield at
            l, r = low[at] << np.uint64(16), rng[at] << np.uint64(16)


def _steps(lengths: np.ndarray) -> int:
    """All blocks are coded to the same length; what fills up the last one is dropped again."""
    return int(lengths.max(initial=0))


def encode_blocks(ids: np.ndarray, order0: _Order0) -> list[bytes]:
    """Code of each block of BLOCK ids (the last one may be shorter)."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return []
    steps = min(len(ids), BLOCK)
    flat = np.zeros(blocks * steps, np.int32)
    flat[: len(ids)] = order0.rank[ids]
    grid = np.ascontiguousarray(flat.reshape(blocks, steps).T)
    del flat
    lanes = _Lanes(blocks, order0)
    width = 4 * steps + 8
    out, put = np.zeros(blocks * width, np.uint16), np.arange(blocks) * width
    for t in range(steps):
        x = grid[t]
        lanes.predict()
        group = order0.group.take(x)
        lanes.code(x, *lanes.order0(group, order0.low.take(x), order0.width.take(x)))
        lanes.count(group)
        for m in lanes.shift():
            out[put[m]] = lanes.low[m] >> np.uint64(48)
            put[m] += 1
    for _ in range(4):
        out[put] = lanes.low >> np.uint64(48)
        put += 1
        lanes.low <<= np.uint64(16)
    return [out[k * width : put[k]].astype(">u2").tobytes() for k in range(blocks)]


def decode_blocks(codes: list[bytes], lengths: np.ndarray, order0: _Order0) -> np.ndarray:
    """The ids of blocks that ``encode_blocks`` made (full ones, then perhaps a shorter one)."""
    blocks = len(codes)
    if not blocks:
        return np.zeros(0, np.int32)
    words = np.frombuffer(b"".join(c + b"\0\0\0\0" for c in codes), ">u2").astype(np.uint64)
    sizes = np.array([len(c) // 2 + 2 for c in codes])
    take = np.cumsum(sizes) - sizes
    steps = _steps(lengths)
    lanes, grid = _Lanes(blocks, order0), np.zeros((steps, blocks), np.int32)
    code = np.zeros(blocks, np.uint64)
    for _ in range(4):
        code = code << np.uint64(16) | words[take]
        take += 1
    end = len(words) - 1
    top, last = np.int64((1 << ORDER0 + WEIGHT) - 1), lanes.none - 1
    for t in range(steps):
        lanes.predict()
        value = np.minimum(((code - lanes.low) // (lanes.range >> TOTAL)).view(np.int64) & (1 << 62) - 1, top)
        # The two predictions in order of their ranks; both of one rank are one.
        one, two = np.minimum(lanes.p1, lanes.p2), np.maximum(lanes.p1, lanes.p2)
        first = lanes.p1 <= lanes.p2
        big1, big2 = np.where(first, lanes.m1, lanes.m2) << ORDER0, np.where(first, lanes.m2, lanes.m1) << ORDER0
        same = one == two
        big1 += big2 * same
        big2 *= ~same
        below1, own1 = lanes.order0(order0.group.take(one), order0.low.take(one), order0.width.take(one))
        below2, own2 = lanes.order0(order0.group.take(two), order0.low.take(two), order0.width.take(two))
        start1 = lanes.m0 * below1
        end1 = start1 + lanes.m0 * own1 + big1
        start2 = lanes.m0 * below2 + big1
        end2 = start2 + lanes.m0 * own2 + big2
        past1, past2 = value >= end1, value >= end2
        is1, is2 = (value >= start1) & ~past1, (value >= start2) & ~past2 & past1
        inner = np.minimum((value - big1 * past1 - big2 * past2) / lanes.m0, (1 << ORDER0) - 1).astype(np.int64)
        share = inner >> SHARE
        group = np.zeros(blocks, np.int64)
        for k in range(GROUPS.bit_length() - 2, -1, -1):
            group += (lanes.cdf.take(lanes.at_group + group + (1 << k)) <= share) << k
        at = lanes.at_group + group
        begin = lanes.cdf.take(at)
        many = lanes.cdf.take(at + 1) - begin
        begin <<= SHARE
        x = order0.lookup.take((group << SHARE) + np.minimum(((inner - begin) / many).astype(np.int64), (1 << SHARE) - 1))
        begin += many * order0.low.take(x)
        many *= order0.width.take(x)
        for here, rank, below, own in ((is1, one, below1, own1), (is2, two, below2, own2)):
            np.copyto(x, rank, where=here)
            np.copyto(begin, below, where=here)
            np.copyto(many, own, where=here)
        x = np.minimum(x, last)  # a damaged block decodes to something, and its crc tells
        group = order0.group.take(x)
        lanes.code(x, begin, many)
        lanes.count(group)
        np.maximum(lanes.range, np.uint64(1), out=lanes.range)
        for m in lanes.shift():
            code[m] = code[m] << np.uint64(16) | words[np.minimum(take[m], end)]
            take[m] += 1
        grid[t] = x
    flat = np.ascontiguousarray(grid.T).reshape(-1)
    if len(lengths) and lengths[-1] < steps:
        flat = flat[: len(flat) - (steps - int(lengths[-1]))]
    return order0.ids[flat]


# ---- images ---------------------------------------------------------------------------------


def pack_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One image; ``counts``: ids of each document, in order.  Ids are 0 to MAX_ID."""
    if len(ids) and (ids.min() < 0 or ids.max() > MAX_ID):
        raise StoreError("an id is out of range")
    size = int(ids.max()) + 1 if len(ids) else 0
    seen = np.bincount(ids, minlength=size) if size else np.zeros(0, np.int64)
    scaled = np.where(seen > 0, 1 + seen * 60000 // max(1, seen.max(initial=1)), 0).astype("<u2")
    codes = encode_blocks(ids, _Order0(scaled))
    checks = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(len(codes))]
    head = zlib.compress(scaled.tobytes(), 6)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes(), 6)
    table = np.array([[len(c), k] for c, k in zip(codes, checks, strict=True)], "<u4").reshape(-1, 2).tobytes()
    body = struct.pack("<QQQIII", len(doc_ids), len(ids), len(codes), size, len(head), len(docs)) + head + docs + table
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body + b"".join(codes)


def unpack_shard(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids); StoreError if any checksum fails."""
    if image[:5] != MAGIC or len(image) < 45:
        raise StoreError("no shard image")
    n_docs, n_ids, n_blocks, size, head, docs = struct.unpack_from("<QQQIII", image, 9)
    at = 45 + head + docs
    end = at + 8 * n_blocks
    if zlib.crc32(image[9:end]) != struct.unpack_from("<I", image, 5)[0]:
        raise StoreError("damaged header")
    order0 = _Order0(np.frombuffer(zlib.decompress(image[45 : 45 + head]), "<u2"))
    both = zlib.decompress(image[45 + head : at])
    table = np.frombuffer(image, "<u4", 2 * n_blocks, at).reshape(-1, 2).astype(np.int64)
    stops = end + np.cumsum(table[:, 0])
    codes = [image[s - k : s] for s, k in zip(stops, table[:, 0], strict=True)]
    lengths = np.full(n_blocks, BLOCK)
    if n_blocks:
        lengths[-1] = n_ids - (n_blocks - 1) * BLOCK
    ids = decode_blocks(codes, lengths, order0)
    for k in range(n_blocks):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != table[k, 1]:
            raise StoreError(f"damaged block {k}")
    return np.frombuffer(both, "<i8", n_docs), np.frombuffer(both, "<u8", n_docs, 8 * n_docs).astype(np.int64), ids


# ---- tokenizer ------------------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


MARK = "\x01"
#: What a tokenizer must do with a text so that its words can be encoded apart (fixed values of the file format).
WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: White space that parts words; other white space stays inside a word, where the library meets it.
PARTS = np.isin(np.arange(256), [32, 9, 10, 13])
#: Distinct units whose ids a worker keeps; beyond it starts anew, which costs time and changes no id.
KEPT_UNITS = 1 << 21


@cache
def tokenizer(path: str):
    """(tokenizer, the id of MARK or None, whether words can be encoded apart)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    apart = (rules.get("normalizer"), rules.get("pre_tokenizer")) == WORDWISE and rules.get("post_processor") is None and rules.get("truncation") is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in rules["added_tokens"])
    mark = made.encode(MARK, add_special_tokens=False).ids
    return made, mark[0] if len(mark) == 1 else None, apart


#: Units of these letters alone are what the rules of WORDWISE make of them: lower case, composed, one run.
LETTERS = re.compile("[a-zß-öø-ÿ]+")


@cache
def letters_tokenizer(path: str):
    """The tokenizer without the rules that change nothing in LETTERS, or None where an added token may be in them.
    Units come once, so the library's own store of words would only cost time."""
    from tokenizers import Tokenizer, pre_tokenizers

    full, mark, apart = tokenizer(path)
    if not apart or any(LETTERS.fullmatch(t.content.lower()) for t in full.get_added_tokens_decoder().values()):
        return None
    made = Tokenizer(full.model)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.model._resize_cache(0)
    return made if made.encode(MARK, add_special_tokens=False).ids == [mark] else None


@cache
def added_heads(path: str) -> np.ndarray:
    """True for the first bytes, in any case, of tokens that the library looks for before it lower-cases."""
    out = np.zeros(256, bool)
    for t in tokenizer(path)[0].get_added_tokens_decoder().values():
        for head in (t.content.lower().encode()[:1], t.content.upper().encode()[:1]):
            out[list(head)] = True
    return out


class _Known:
    """Ids of units that this worker has encoded before, one tokenizer at a time."""

    path, units = None, None

    @classmethod
    def of(cls, units: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and size in them) of distinct units."""
        if cls.path != path or len(cls.units) > KEPT_UNITS:
            cls.path, cls.units, cls.ids = path, pa.array([], pa.large_binary()), np.zeros(0, np.int32)
            cls.starts = cls.sizes = np.zeros(0, np.int64)
        at = pc.index_in(units, value_set=cls.units)
        if at.null_count:
            missing = pc.is_null(at)
            new = units.filter(missing)
            ids, sizes = encode_units(new.cast(pa.large_string()).to_pylist(), path)
            cls.starts = np.concatenate([cls.starts, np.cumsum(sizes) - sizes + len(cls.ids)])
            cls.sizes, cls.ids = np.concatenate([cls.sizes, sizes]), np.concatenate([cls.ids, ids])
            missing = missing.to_numpy(zero_copy_only=False)
            at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at[missing] = len(cls.units) + np.arange(len(new))
            cls.units = pa.concat_arrays([cls.units, new])
        else:
            at = at.to_numpy(zero_copy_only=False)
        return cls.ids, cls.starts[at], cls.sizes[at]


#: Kinds of bytes: ASCII letters and digits, and ASCII marks.
PLAIN_BYTE = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
MARK_BYTE = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def units_of(words: pa.Array, path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct units, first unit of each word, second unit or -1).

    The marks at the end of a word, behind an ASCII letter or digit, are a token run of their own, and the
    tokenizer lower-cases: so a word is its stem, in lower case if all ASCII, and its marks.  A word that may
    hold an added token stays as it is, as such a token is matched by exact case."""
    data, offsets = spelled(words)
    size = np.diff(offsets)
    place = np.arange(len(data))
    stop = np.maximum.accumulate(np.where(MARK_BYTE[data], -1, place))[offsets[1:] - 1] if len(data) else np.zeros(0, np.int64)
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])
    whole = total(added_heads(path)[data]) > 0
    cut = ~whole & (stop >= offsets[:-1]) & (stop < offsets[1:] - 1)
    cut[cut] = PLAIN_BYTE[data[stop[cut]]]
    stem = np.where(cut, stop + 1 - offsets[:-1], size)
    changes = np.repeat(~whole & (total(data >= 128) == 0), size)
    data = np.where(changes, LOWER[data], data)
    tailed = np.flatnonzero(cut)
    starts, sizes = np.concatenate([offsets[:-1], (offsets[:-1] + stem)[tailed]]), np.concatenate([stem, (size - stem)[tailed]])
    at, _ = _gathered(starts, sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[at]))]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    second = np.full(len(size), -1)
    second[tailed] = codes[len(size) :]
    return coded.dictionary, codes[: len(size)], second


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each text) as the library gives them for the whole texts.

    Where the tokenizer drops white space and never joins across it, each distinct unit of a word is encoded
    once; any other tokenizer gets whole texts."""
    made, _, apart = tokenizer(path)
    if not apart:
        found = [e.ids for e in made.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.fromiter((i for f in found for i in f), np.int32), np.fromiter(map(len, found), np.int64, len(found))
    words, per_text = runs(texts, PARTS)
    coded = words.dictionary_encode()
    units, first, second = units_of(coded.dictionary, path)
    ids, starts, sizes = _Known.of(units, path)
    # The ids of each distinct word, then of each word of the texts.  Unit -1 is none: it has no id.
    starts, sizes = np.append(starts, 0), np.append(sizes, 0)
    both = np.stack([first, second], 1).reshape(-1)
    at, n = _gathered(starts[both], sizes[both])
    ids, many = ids[at], n.reshape(-1, 2).sum(1)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    at, n = _gathered((np.cumsum(many) - many)[codes], many[codes])
    cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per_text)])]
    return ids[at], np.diff(cuts)


def encode_units(given: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, ids of each).  They go in groups, parted by a mark whose id no unit without the mark
    can have."""
    made, mark, _ = tokenizer(path)
    sizes, parts = np.zeros(len(given), np.int64), []
    quick = letters_tokenizer(path) if mark is not None else None
    letters = [k for k, w in enumerate(given) if LETTERS.fullmatch(w) and len(w) < 1000] if quick is not None else []
    rest = sorted(set(range(len(given))) - set(letters)) if len(letters) < len(given) else []
    grouped = [k for k in rest if MARK not in given[k] and len(given[k]) < 1000] if mark is not None else []
    plain = letters + grouped
    odd = sorted(set(rest) - set(grouped)) if len(grouped) < len(rest) else []
    glue, group = f" {MARK} ", 64
    for of, by in ((letters, quick), (grouped, made)):
        for begin in range(0, len(of), group * 256):
            some = of[begin : begin + group * 256]
            lines = [glue.join([given[k] for k in some[i : i + group]]) + glue for i in range(0, len(some), group)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in by.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(ids == mark)
            sizes[some] = np.diff(ends, prepend=-1) - 1
            parts.append(np.delete(ids, ends))
    for k in odd:
        one = np.array(made.encode(given[k], add_special_tokens=False).ids, np.int32)
        sizes[k] = len(one)
        parts.append(one)
    flat = np.concatenate([*parts, np.zeros(0, np.int32)])
    if rest:
        order = np.array(plain + odd, np.int64)
        starts = np.zeros(len(given), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        flat = flat[_gathered(starts, sizes)[0]]
    return flat, sizes


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions starts[k], starts[k] + 1, ... of all k one after the other, and the sizes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out, sizes


# ---- tables ---------------------------------------------------------------------------------

SHARDS = "part int, seq int, n_docs bigint, n_ids bigint, content binary"


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Shard images of all texts in ascending doc_id (ties: by text), ``end_id`` after each document.

    Null text is empty.  A null doc_id is written behind all others as NO_ID, which is read back as null; repeated
    rows stay repeated.  Columns other than doc_id and text, whatever their names, are not looked at.  An empty table
    gives no image.  Documents are range-partitioned by id, each task writes images of about ``shard_ids`` ids."""
    need(docs, "doc_id", "text")
    at = tokenizer_path or default_tokenizer()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def made(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, counts, names, held = [], [], [], 0

        def flush():
            nonlocal ids, counts, names, held, seq
            image = pack_shard(np.concatenate(names), np.concatenate(counts), np.concatenate(ids))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(map(len, names))], pa.int64()), pa.array([held], pa.int64()), pa.array([image], pa.binary())], ["part", "seq", "n_docs", "n_ids", "content"])
            ids, counts, names, held, seq = [], [], [], 0, seq + 1
            return row

        for b in batches:
            some, n = encode_texts(b.column("text"), at)
            ids.append(np.insert(some, np.cumsum(n), end_id).astype(np.int32))
            counts.append(n + 1)
            names.append(b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(ids[-1])
            if held >= shard_ids:
                yield flush()
        if held:
            yield flush()

    with settings(docs.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=str(16 << 20)):
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(returning(made), SHARDS).write.parquet(path)


def read_token_shards(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32 (and ``ids``), decoded from the images.

    The start of an image is that of its task, whose sums alone meet in one window, and what the task's
    images before it hold."""
    table = spark.read.schema(SHARDS).parquet(path)
    sizes = table.select("part", "seq", "n_ids")
    whole = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    tasks = whole.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("_task"))
    inner = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = sizes.withColumn("_inner", inner).join(tasks, "part").select("part", "seq", (F.col("_task") + F.col("_inner")).alias("_before"))
    added = ", ids array<int>" if ids else ""

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                names, counts, flat = unpack_shard(b.column("content")[i].as_py())
                ends = np.cumsum(counts)
                raw = memoryview(flat.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                whole = lambda k: pa.array(np.full(len(names), b.column(k)[i].as_py(), np.int32))  # noqa: B023, E731
                more = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))] if ids else []
                yield pa.RecordBatch.from_arrays([whole("part"), whole("seq"), pa.array(names), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64()), *more], ["part", "seq", "doc_id", "_local", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])

    docs = table.select("part", "seq", "content").mapInArrow(read, f"part int, seq int, doc_id bigint, _local bigint, n_tokens bigint, ids_crc32 bigint{added}")
    return docs.join(starts, ["part", "seq"]).select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("_local") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_token_shards(spark, path)
