"""Media columns: ISO base media containers written and read without a codec.

``to_iso_media`` stores bytes as 8-bit samples of a ``raw `` track; ``read_iso_media`` walks
the nested boxes of any such file, decodes the sample tables and gives codec, duration and
the byte range of every keyframe.  Reading a table never decodes a payload: ranges come from
the tables alone, and the payload is the concatenation of the sample ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.storage import need, read_table, settings, written

UNIT = 64
RATE = 8000
CHUNK_SAMPLES = 64
SYNC_EVERY = 16
BATCH = {"spark__sql__execution__arrow__maxBytesPerBatch": str(16 << 20)}
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class MediaError(ValueError):
    """The bytes are not a readable container."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body if len(body) < 0xFFFFFFF0 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def padded(raw: bytes) -> bytes:
    """``raw`` and bytes 0 up to a positive multiple of UNIT."""
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def pack_media(payload: bytes) -> bytes:
    """One sound track of UNIT-byte samples, CHUNK_SAMPLES in a chunk, every SYNC_EVERY-th a keyframe."""
    n = len(payload) // UNIT
    if n * UNIT != len(payload) or not n:
        raise MediaError("the payload is not a positive multiple of the unit")
    duration = n * UNIT
    chunks = -(-n // CHUNK_SAMPLES)
    last = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 else []
    runs += [(chunks, last, 1)] if chunks == 1 or last != CHUNK_SAMPLES else []
    sync = np.arange(1, n + 1, SYNC_EVERY, dtype=">u4")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    wide = len(payload) > 0xF0000000
    clock = (lambda v: struct.pack(">QQIQ", 0, 0, RATE, v)) if wide else (lambda v: struct.pack(">IIII", 0, 0, RATE, v))
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.uint64) * (CHUNK_SAMPLES * UNIT)
        entry = box(b"raw ", b"\0" * 6, struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
        table = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, UNIT)),
            full(b"stss", 0, struct.pack(">I", len(sync)), sync.tobytes()),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", 0, struct.pack(">II", UNIT, n)),
            full(b"co64", 0, struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full(b"stco", 0, struct.pack(">I", chunks), offsets.astype(">u4").tobytes()),
        )
        mdia = box(b"mdia", full(b"mdhd", int(wide), clock(duration), struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"soun"), b"payload\0"), box(b"minf", full(b"smhd", 0, b"\0" * 4), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), table))
        head = struct.pack(">QQIIQ", 0, 0, 1, 0, duration) if wide else struct.pack(">IIIII", 0, 0, 1, 0, duration)
        tkhd = full(b"tkhd", int(wide), head, b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, b"\0" * 8)
        mvhd = full(b"mvhd", int(wide), clock(duration), struct.pack(">IH10x", 0x10000, 0x100), matrix, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    mdat_head = 16 if len(payload) + 8 >= 0xFFFFFFF0 else 8
    base = len(ftyp) + len(moov(0)) + mdat_head
    return ftyp + moov(base) + box(b"mdat", payload)


def walk(data: memoryview, start: int, end: int, depth: int = 0):
    """(kind, start, body start, body end) of each box, containers entered.  Four bytes 0 may close a container."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise MediaError("cut 64-bit size")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise MediaError(f"box {kind!r} leaves its parent")
        yield kind, at, at + head, at + size
        if kind in CONTAINERS:
            if depth > 16:
                raise MediaError("boxes nested too deep")
            yield from walk(data, at + head, at + size, depth + 1)
        at += size
    if at != end and depth and bytes(data[at:end]) != b"\0" * 4:
        raise MediaError("bytes after the last box")


def _table(data, start, end, width, columns):
    (count,) = struct.unpack_from(">I", data, start)
    if start + 4 + count * columns * width > end:
        raise MediaError("cut table")
    return np.frombuffer(data, f">u{width}", count * columns, start + 4).astype(np.int64).reshape(count, columns)


def _track(data: memoryview, t: dict) -> dict:
    """Sample byte ranges and features of one track."""
    codec, channels, bits = t.get("codec", ("", 0, 0))
    sizes = t.get("sizes", np.zeros(0, np.int64))
    n = len(sizes)
    chunks, runs = t.get("chunks", np.zeros(0, np.int64)), t.get("runs", np.zeros((0, 3), np.int64))
    per_chunk = np.zeros(len(chunks), np.int64)
    for first, samples, _ in runs:
        if first < 1:
            raise MediaError("chunk numbers start at 1")
        per_chunk[first - 1 :] = samples
    if per_chunk.sum() != n:
        raise MediaError("chunks and sizes differ in their number of samples")
    chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
    ends = np.cumsum(sizes)
    before = ends - sizes
    first_of_chunk = np.cumsum(per_chunk) - per_chunk
    starts = chunks[chunk_of] + before - before[first_of_chunk[chunk_of]] if n else np.zeros(0, np.int64)
    if n and (starts.min() < 0 or (starts + sizes).max() > len(data)):
        raise MediaError("a sample lies outside the file")
    sync = t.get("sync")
    keys = np.arange(n) if sync is None else sync - 1
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise MediaError("a keyframe that no sample has")
    ticks = int((t["times"][:, 0] * t["times"][:, 1]).sum()) if "times" in t else 0
    return {"handler": t.get("handler", ""), "codec": codec, "channels": channels, "bits": bits, "timescale": t.get("timescale", 0), "duration": t.get("duration", 0), "ticks": ticks, "edits": t.get("edits", []), "shifts": t.get("shifts", np.zeros((0, 2), np.int64)), "starts": starts, "sizes": sizes, "keys": keys}


def _narrow(data, a: int, b: int) -> np.ndarray:
    """Sample sizes of 4, 8 or 16 bits."""
    width, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if width not in (4, 8, 16) or a + 12 + (n * width + 7) // 8 > b:
        raise MediaError("cut table of sizes")
    raw = np.frombuffer(data, np.uint8, (n * width + 7) // 8, a + 12)
    if width == 16:
        return raw.view(">u2").astype(np.int64)
    return (np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n] if width == 4 else raw).astype(np.int64)


def _signed(data, a: int, b: int) -> list[tuple[int, int, int]]:
    """(duration, media time, rate) of an edit list; a media time of -1 is a pause."""
    (n,) = struct.unpack_from(">I", data, a + 4)
    form = ">Qqi" if data[a] else ">Iii"
    if a + 8 + n * struct.calcsize(form) > b:
        raise MediaError("cut edit list")
    return [struct.unpack_from(form, data, a + 8 + k * struct.calcsize(form)) for k in range(n)]


NOT_SYNC = 0x10000  # a sample flag
#: Fields of a fragment's header, and of a run's samples, by flag bit, in their order.
HEAD_FIELDS = ((0x1, "base", ">Q"), (0x2, "entry", ">I"), (0x8, "ticks", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I"))
RUN_FIELDS = (0x100, 0x200, 0x400, 0x800)


def _fragment_head(data, a: int, b: int, begin: int, moof: int, first: bool, end: int, defaults: dict[int, dict]) -> dict:
    flags, track = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    head = {"track": track, "ticks": 0, "size": 0, "flags": 0, **defaults.get(track, {})}
    head["base"] = moof if first or flags & 0x20000 else end
    at = a + 8
    for bit, name, form in HEAD_FIELDS:
        if flags & bit:
            (head[name],) = struct.unpack_from(form, data, at)
            at += struct.calcsize(form)
    if at > b:
        raise MediaError("cut fragment header")
    head["next"] = head["base"]
    return head


def _run(data, a: int, b: int, head: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, ticks, keyframe or not) of a run of samples; moves the fragment's place on."""
    flags, n = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    at, start, first = a + 8, head["next"], None
    if flags & 0x1:
        start = head["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & 0x4:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    own = [bit for bit in RUN_FIELDS if flags & bit]
    if at + 4 * n * len(own) > b or n > len(data):
        raise MediaError("cut run of samples")
    table = np.frombuffer(data, ">u4", n * len(own), at).astype(np.int64).reshape(n, len(own))
    column = lambda bit, default: table[:, own.index(bit)] if bit in own else np.full(n, default, np.int64)
    ticks, sizes, marks = column(0x100, head["ticks"]), column(0x200, head["size"]), column(0x400, head["flags"]).copy()
    if first is not None and n:
        marks[0] = first
    ends = start + np.cumsum(sizes)
    head["next"] = int(ends[-1]) if n else start
    return ends - sizes, sizes, ticks, (marks & NOT_SYNC) == 0


def _joined(track: dict, runs: list, data) -> dict:
    """``track`` with the samples of its fragments behind those of its tables."""
    if not runs:
        return track
    starts, sizes, ticks, sync = (np.concatenate(x) for x in zip(*runs, strict=True))
    if len(starts) and (starts.min() < 0 or (starts + sizes).max() > len(data)):
        raise MediaError("a sample lies outside the file")
    n = len(track["sizes"])
    track |= {"starts": np.concatenate([track["starts"], starts]), "sizes": np.concatenate([track["sizes"], sizes]), "keys": np.concatenate([track["keys"], n + np.flatnonzero(sync)])}
    track["ticks"] += int(ticks.sum())
    track["duration"] = max(track["duration"], track["ticks"])
    return track


def parse_media(raw: bytes) -> list[dict]:
    """The tracks of a container, samples of fragments included; MediaError for bytes that are none."""
    data, tracks, now = memoryview(raw), [], None
    defaults: dict[int, dict] = {}
    runs: dict[int, list] = {}
    moof, head, first = 0, None, True
    try:
        for kind, begin, a, b in walk(data, 0, len(data)):
            if kind == b"trak":
                now = {"id": len(tracks) + 1}
                tracks.append(now)
            elif kind == b"trex":
                track, _, ticks, size, flags = struct.unpack_from(">5I", data, a + 4)
                defaults[track] = {"ticks": ticks, "size": size, "flags": flags}
            elif kind == b"moof":
                moof, head, first = begin, None, True
            elif kind == b"tfhd":
                head = _fragment_head(data, a, b, begin, moof, first, head["next"] if head else moof, defaults)
                first = False
            elif kind == b"trun":
                if head is None:
                    raise MediaError("a run without a fragment")
                runs.setdefault(head["track"], []).append(_run(data, a, b, head))
            if now is None or kind in (b"tfhd", b"trun"):
                continue
            if kind == b"tkhd":
                (now["id"],) = struct.unpack_from(">I", data, a + (20 if data[a] else 12))
            elif kind == b"elst":
                now["edits"] = _signed(data, a, b)
            elif kind == b"ctts":
                now["shifts"] = _table(data, a + 4, b, 4, 2)
            elif kind == b"stz2":
                now["sizes"] = _narrow(data, a, b)
            elif kind == b"mdhd":
                now["timescale"], now["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
            elif kind == b"hdlr":
                now["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd" and struct.unpack_from(">I", data, a + 4)[0]:
                _, codec = struct.unpack_from(">I4s", data, a + 8)
                sound = now.get("handler") == "soun"
                now["codec"] = (codec.decode("latin-1"), *(struct.unpack_from(">HH", data, a + 32) if sound else (0, 0)))
            elif kind == b"stts":
                now["times"] = _table(data, a + 4, b, 4, 2)
            elif kind == b"stss":
                now["sync"] = _table(data, a + 4, b, 4, 1)[:, 0]
            elif kind == b"stsc":
                now["runs"] = _table(data, a + 4, b, 4, 3)
            elif kind == b"stsz":
                same, n = struct.unpack_from(">II", data, a + 4)
                if same and same * n > len(data):
                    raise MediaError("more samples than bytes")
                now["sizes"] = np.full(n, same, np.int64) if same else _table(data, a + 8, b, 4, 1)[:, 0]
            elif kind == b"stco":
                now["chunks"] = _table(data, a + 4, b, 4, 1)[:, 0]
            elif kind == b"co64":
                now["chunks"] = _table(data, a + 4, b, 8, 1)[:, 0]
        if not tracks:
            raise MediaError("no track")
        return [_joined(_track(data, t), runs.get(t["id"], []), data) for t in tracks]
    except (struct.error, IndexError) as e:
        raise MediaError(f"cut box: {e}") from None


def payload_of(raw: bytes, track: dict) -> bytes:
    """The samples' bytes in order; samples that adjoin are read as one range."""
    starts, sizes = track["starts"], track["sizes"]
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    return b"".join(raw[starts[i] : starts[j] + sizes[j]] for i, j in zip(first, last, strict=True))


def keyframe_ranges(track: dict) -> list[tuple[int, int]]:
    """(offset, bytes) from each keyframe up to the next one's first byte or its own end of run."""
    return [(int(track["starts"][k]), int(track["sizes"][k])) for k in track["keys"]]


def feature_of(track: dict) -> str:
    """codec;channels x bits@timescale;seconds;samples;keyframes;crc32 of the keyframe ranges."""
    ranges = np.stack([track["starts"][track["keys"]], track["sizes"][track["keys"]]], 1).astype("<i8").tobytes() if len(track["keys"]) else b""
    seconds = track["duration"] / track["timescale"] if track["timescale"] else 0.0
    return f"{track['codec'].strip()};{track['channels']}x{track['bits']}@{track['timescale']};{seconds:.3f}s;{len(track['sizes'])};{len(track['keys'])};{zlib.crc32(ranges):08x}"


def _fields(df: DataFrame, *without: str) -> tuple[list[str], str]:
    kept = [f for f in df.schema if f.name not in without]
    return [f.name for f in kept], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)


def to_iso_media(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with n_bytes (of the UTF-8 text; null is empty) and ``media``, the container's bytes,
    in place of the text column and of any columns of these names."""
    need(df, column)
    names, ddl = _fields(df, column, "n_bytes", "media")

    def made(batches):
        for b in batches:
            texts, size, media = b.column(column), [], []
            for i in range(b.num_rows):
                raw = (texts[i].as_py() or "").encode("utf-8", "replace")
                size.append(len(raw))
                media.append(pack_media(padded(raw)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(size, pa.int64()), pa.array(media, pa.binary())], [*names, "n_bytes", "media"])

    return df.select(*names, column).mapInArrow(made, f"{ddl}n_bytes bigint, media binary")


READ = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset:bigint,bytes:bigint>>, tracks array<struct<handler:string,codec:string,duration_s:double,samples:bigint,keyframes:array<struct<offset:bigint,bytes:bigint>>>>, error string"


def read_iso_media(df: DataFrame, column: str = "media", keyframes: bool = True) -> DataFrame:
    """What the first track of each container says, and an entry for each of its ``tracks``, in place of the
    ``media`` column.

    Bytes that are no container (null included) give null features and an error text; the run goes on.
    ``keyframes=False`` leaves the lists null (a crc of the first track's is in ``feature``).  Rows are read one
    by one: repeated rows stay repeated, an empty table gives an empty result; columns of the added names are
    replaced."""
    need(df, column)
    added = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes", "tracks", "error"]
    names, ddl = _fields(df, column, *added)

    def read(batches):
        ranged = pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))
        listed = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", ranged)]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), ranged, listed, pa.string()]
        seconds_of = lambda t: t["duration"] / t["timescale"] if t["timescale"] else None
        ranges_of = lambda t: [{"offset": o, "bytes": s} for o, s in keyframe_ranges(t)]
        for b in batches:
            rows, media = [], b.column(column)
            for i in range(b.num_rows):
                raw = media[i].as_py()
                if raw is None:
                    rows.append((None,) * 10 + ("no bytes",))
                    continue
                try:
                    tracks = parse_media(raw)
                    track = tracks[0]
                    payload = payload_of(raw, track)
                    each = [{"handler": t["handler"], "codec": t["codec"], "duration_s": seconds_of(t), "samples": len(t["sizes"]), "keyframes": ranges_of(t)} for t in tracks] if keyframes else None
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(track), track["codec"], seconds_of(track), each[0]["keyframes"] if each else None, each, None))
                except MediaError as e:
                    rows.append((None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*names, *added])

    return df.select(*names, column).mapInArrow(read, ddl + READ)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    with settings(spark, **BATCH):
        media = written(to_iso_media(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "media", compression="zstd")
    return read_iso_media(media, keyframes=False).drop("keyframes", "tracks", "error")
