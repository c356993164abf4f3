"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is a leading space and its characters, spaces written U+2581.  It is cut before each
run of spaces (no piece has a space behind another character, so no merge crosses a cut).
Each unit starts as single characters; the agenda always takes the candidate pair whose merged
piece has the best score, the leftmost of equals, and merges it.  Merge-dropout: a candidate is
skipped for good if a hash keyed by seed, variant, both symbols and their places is below the
dropout rate.  A unit's variant is drawn by (seed, document key, unit number), so the same word
is segmented in several ways over a corpus, always the same way for the same place.  Characters
without a piece, and U+2581 in the text itself, are written as byte pieces, so decoding is exact.

Many units are processed at once in numpy, one agenda step for all of them; units of more than
LONG characters go through the same agenda with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.memory import returning
from tidewright.llm.storage import need, read_table

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
VARIANTS = 8
SEED = 4
LONG = 96
SPACE = 0x2581
NONE = np.int32(2**31 - 1)
UNITS = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceCodec:
    """A sentencepiece BPE model with byte fallback, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        self.size = len(model.pieces)
        self.bytes = np.full(256, -1, np.int32)
        self.out: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.out.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.out.append(p.piece.replace(chr(SPACE), " ").encode() if p.type == 1 else b"")
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces")
        self.char = np.full(0x110000 + 1, -1, np.int32)
        for s, (i, _) in kinds.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        order = sorted((-score, i) for i, score in kinds.values())
        self.piece_of_rank = np.array([i for _, i in order], np.int32)
        rank = {int(i): r for r, i in enumerate(self.piece_of_rank)}
        pairs = [(kinds[s[:k]][0] << 32 | kinds[s[k:]][0], rank[i]) for s, (i, _) in kinds.items() for k in range(1, len(s)) if s[:k] in kinds and s[k:] in kinds]
        self.pairs = dict(pairs)
        self._index(np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32))

    def _index(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open hash table of all pairs."""
        self.bits = max(10, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            slots = (at[todo] + self.probes - 1) & (size - 1)
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            self.keys[slots[won]], self.ranks[slots[won]] = keys[todo[won]], ranks[todo[won]]
            todo = todo[~won]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left, right, start, mid, end, variant, dropout, seed) -> np.ndarray:
        """Rank of each candidate, NONE where there is no such piece or the candidate is skipped."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for p in range(1, self.probes):
            if not len(todo):
                break
            slots = (at[todo] + p) & (len(self.keys) - 1)
            k = self.keys[slots]
            hit = k == keys[todo]
            found[todo[hit]] = self.ranks[slots[hit]]
            todo = todo[~hit & (k != -1)]
        if dropout > 0:
            live = np.flatnonzero(found != NONE)
            place = (start[live].astype(np.uint64) << np.uint64(42)) ^ (mid[live].astype(np.uint64) << np.uint64(21)) ^ end[live].astype(np.uint64)
            h = _mixed(_mixed(keys[live].astype(np.uint64) + np.uint64(seed)) ^ _mixed(place + (variant[live].astype(np.uint64) << np.uint64(56)) + np.uint64(0x632BE59BD9B4E019)))
            found[live[(h >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53]] = NONE
        return found

    def segment(self, units: list[str], variants: np.ndarray, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, starts) of all units; a unit begins with its spaces.  Symbols of ``size`` and
        above stand for a character without a piece."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        symbols = np.where(points == 32, self.char[SPACE], np.where(points == SPACE, -1, self.char[points]))
        symbols = np.where(symbols < 0, self.size + points, symbols).astype(np.int64)
        keep = np.ones(len(symbols), bool)
        for low, high in ((1, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, 24), (24, 40), (40, LONG)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in range(0, len(rows), 1 << 14):
                self._merge(symbols, keep, begins[rows[part : part + (1 << 14)]], lengths[rows[part : part + (1 << 14)]], variants[rows[part : part + (1 << 14)]], high, dropout, seed)
        for k in np.flatnonzero(lengths > LONG):
            self._merge_long(symbols, keep, int(begins[k]), int(lengths[k]), int(variants[k]), dropout, seed)
        kept = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], kept[begins]

    def _merge(self, symbols, keep, begins, lengths, variants, width, dropout, seed) -> None:
        n, stride = len(begins), width + 1  # the last place of a row stands for its end
        place = np.arange(stride)
        inside = place < lengths[:, None]
        at = np.minimum(begins[:, None] + place, len(symbols) - 1)
        sym = np.where(inside, symbols[at], -1)
        nxt = np.minimum(place + 1, lengths[:, None]).reshape(-1)
        prv = np.broadcast_to(place - 1, (n, stride)).reshape(-1).copy()
        alive = inside.reshape(-1).copy()
        flat = sym.reshape(-1)
        best = np.full((n, stride), NONE, np.int32)
        has = place[:-1] + 1 < lengths[:, None]
        r, c = np.nonzero(has)
        best[r, c] = self._rank(sym[r, c], sym[r, c + 1], c, c + 1, c + 2, variants[r], dropout, seed)
        rank = best.reshape(-1)
        rows = np.arange(n)
        while len(rows):
            j = best[rows].argmin(1)
            base = rows * stride
            top = rank[base + j]
            go = top != NONE
            rows, j, base, top = rows[go], j[go], base[go], top[go]
            if not len(rows):
                break
            k = nxt[base + j]
            end = nxt[base + k]
            flat[base + j] = self.piece_of_rank[top]
            alive[base + k] = False
            rank[base + k] = NONE
            nxt[base + j] = end
            prv[base + end] = j
            last = end >= lengths[rows]
            after = np.where(last, end, nxt[base + end])
            right = self._rank(flat[base + j], np.where(last, -1, flat[base + end]), j, end, after, variants[rows], dropout, seed)
            rank[base + j] = np.where(last, NONE, right)
            p = prv[base + j]
            ok = np.flatnonzero(p >= 0)
            b, q = base[ok], p[ok]
            rank[b + q] = self._rank(flat[b + q], flat[b + j[ok]], q, j[ok], end[ok], variants[rows[ok]], dropout, seed)
        r, c = np.nonzero(inside)
        symbols[begins[r] + c] = flat[r * stride + c]
        keep[begins[r] + c] = alive[r * stride + c]

    def _merge_long(self, symbols, keep, begin, n, variant, dropout, seed) -> None:
        sym = symbols[begin : begin + n].copy()
        place = np.arange(n - 1)
        ranks = self._rank(sym[:-1], sym[1:], place, place + 1, place + 2, np.full(n - 1, variant), dropout, seed)
        nxt, prv, s = list(range(1, n + 1)), list(range(-1, n - 1)), sym.tolist()
        heap = [(int(ranks[i]), int(i), int(i) + 1, int(i) + 2) for i in np.flatnonzero(ranks != NONE)]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i, k):
            end = nxt[k]
            r = self.pairs.get(s[i] << 32 | s[k])
            if r is not None:
                one = lambda v: np.array([v], np.int64)
                r = int(self._rank(one(s[i]), one(s[k]), one(i), one(k), one(end), one(variant), dropout, seed)[0])
                if r != NONE:
                    heapq.heappush(heap, (r, i, k, end))

        while heap:
            r, i, k, end = heapq.heappop(heap)
            if not alive[i] or nxt[i] != k or k >= n or nxt[k] != end or self.pairs.get(s[i] << 32 | s[k]) != r:
                continue
            s[i] = int(self.piece_of_rank[r])
            alive[k] = False
            nxt[i] = end
            if end < n:
                prv[end] = i
                push(i, end)
            if prv[i] >= 0:
                push(prv[i], i)
        symbols[begin : begin + n] = s
        keep[begin : begin + n] = alive

    def with_bytes(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the byte pieces of their UTF-8 form."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols.astype(np.int32), starts
        chars, which = np.unique(symbols[odd] - self.size, return_inverse=True)
        raw = [chr(int(c)).encode() for c in chars]
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = np.array([len(x) for x in raw])[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.repeat(symbols, counts)
        for b in range(4):
            rows = np.flatnonzero(counts[odd] > b)
            values = np.array([x[b] if len(x) > b else 0 for x in raw])
            out[ends[odd[rows]] + b] = self.bytes[values[which[rows]]]
        return out.astype(np.int32), ends[starts]

    def encode_batch(self, texts: list[str], keys: np.ndarray, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> list[np.ndarray]:
        """Piece ids of each text.  ``keys``: a uint64 a text that draws its units' variants."""
        found = [UNITS.findall(" " + t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        words = [u for f in found for u in f]
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        codes, uniques = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        number = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        draw = _mixed(np.repeat(keys.astype(np.uint64), counts) + np.uint64(seed) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(variants) if dropout > 0 else np.zeros(len(words), np.uint64)
        combined, which = np.unique(codes * variants + draw.astype(np.int64), return_inverse=True)
        of = combined // variants
        symbols, starts = self.with_bytes(*self.segment([uniques[i] for i in of], combined % variants, dropout, seed))
        sizes = np.diff(starts)[which] if len(which) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = symbols[np.repeat(starts[:-1][which] - (ends - sizes), sizes) + np.arange(total)] if total else np.zeros(0, np.int32)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])] if len(texts) else []
        return [ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    def decode(self, ids) -> str:
        """The text of piece ids that ``encode_batch`` made: the leading space is dropped."""
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8")[1:]


@cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def text_key(texts: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in texts], np.uint64)


def parts(texts: list[str], most: int = 1 << 19):
    """Index ranges of at most about ``most`` characters; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encode_pieces(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS, key: str | None = "doc_id", verify: bool = False) -> DataFrame:
    """``docs`` with ``ids`` in place of the text (and of a column of that name).  ``verify`` adds
    n_pieces, ids_crc32 and lossless: whether the ids decode to the text.

    Null text is encoded as the empty one: a single space piece.  ``key`` names the column that
    draws the variants (null counts as one more key); None takes the text itself, so that equal
    texts are segmented alike.  Repeated rows get the same ids."""
    need(docs, "text", *([key] if key else []))
    path = model or default_model()
    added = ["n_pieces", "ids_crc32", "lossless"] if verify else []
    names = [c for c in docs.columns if c not in ("text", "ids", *added)]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)

    def encoded(batches):
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            keys = np.array([zlib.crc32(repr(v).encode()) for v in b.column(key).to_pylist()], np.uint64) if key else text_key(texts)
            for i, j in parts(texts):
                found = c.encode_batch(texts[i:j], keys[i:j], dropout, seed, variants)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                more = []
                if verify:
                    more = [pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()), pa.array([c.decode(x.tolist()) == t for x, t in zip(found, texts[i:j], strict=True)])]
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in names), ids, *more], [*names, "ids", *added])

    return docs.select(*names, "text").mapInArrow(returning(encoded), ddl + "ids array<int>" + (", n_pieces bigint, ids_crc32 bigint, lossless boolean" if verify else ""))


def decode_pieces(encoded: DataFrame, model: str | None = None, digest: bool = False) -> DataFrame:
    """``encoded`` with the text in place of ``ids``; null ids give null.  ``digest``: n_pieces,
    ids_crc32 (of little-endian unsigned 32-bit ids) and text_sha256 of the decoded text instead."""
    need(encoded, "ids")
    path = model or default_model()
    added = ["n_pieces", "ids_crc32", "text_sha256"] if digest else ["text"]
    names = [c for c in encoded.columns if c not in ("ids", *added)]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema if f.name in names) + ("n_pieces bigint, ids_crc32 bigint, text_sha256 string" if digest else "text string")

    def decoded(batches):
        c = codec(path)
        for b in batches:
            column = b.column("ids")
            offsets, values, rows = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), []
            for i in range(b.num_rows):
                if not column[i].is_valid:
                    rows.append((None,) * len(added))
                    continue
                ids = values[offsets[i] : offsets[i + 1]]
                text = c.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(text.encode()).hexdigest()) if digest else (text,))
            kinds = [pa.int64(), pa.int64(), pa.string()] if digest else [pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*names, *added])

    return encoded.select(*names, "ids").mapInArrow(returning(decoded), ddl)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode_pieces(encode_pieces(docs), digest=True)
