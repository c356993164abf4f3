import os
import random
import struct
import zlib

import numpy as np
import pytest

from tidewright.kernels import containers as C
from tidewright.kernels import pdf_file as P
from tidewright.kernels import png_rows as R
from tidewright.kernels.control import Recorded
from tidewright.operators.files import compress_images, compress_pdfs, image_parts, image_result, pdf_objects, pdf_result, two_pages
from tidewright.sources import folder_scan, result_store


def tiff(value, order=">"):
    return (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(f"{order}IH", 8, 2) + struct.pack(f"{order}HHII", 0x10F, 2, 4, 0) + struct.pack(f"{order}HHIHH", 0x112, 3, 1, value, 0) + struct.pack(f"{order}I", 0)


def jpeg(*segments, frame=0xC0, tail=b""):
    def part(marker, content):
        return bytes([255, marker]) + struct.pack(">H", len(content) + 2) + content

    head = part(frame, b"\x08" + struct.pack(">HH", 7, 11) + b"\x01\x01\x11\0")
    return b"\xff\xd8" + b"".join(part(*s) for s in segments) + head + part(0xDA, b"\x01\x01\0\0\x3f\0") + b"ab\xff\0c\xff\xd0d" + b"\xff\xd9" + tail


def webp(*chunks):
    body = b"".join(struct.pack("<4sI", n, len(c)) + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


LOSSLESS = b"\x2f" + struct.pack("<I", 9 | 4 << 14)


@pytest.mark.parametrize("colour", sorted(R.SAMPLES))
@pytest.mark.parametrize("interlaced", [False, True])
def test_png_rows_come_back(colour, interlaced):
    rng = np.random.default_rng(colour)
    for depth in R.DEPTHS[colour]:
        for width, height in ((1, 1), (3, 2), (37, 23)):
            bits = depth * R.SAMPLES[colour]
            row, step = -(-width * bits // 8), max(1, bits // 8)
            rows = rng.integers(0, 256, (height, row), dtype=np.uint8)
            if width * bits % 8:
                rows[:, -1] &= 0xFF << (8 - width * bits % 8) & 0xFF
            raw, pixels = b"", R._pixels(rows, width, bits)
            for x, y, dx, dy in R.ADAM7 if interlaced else ((0, 0, 1, 1),):
                some = pixels[y::dy, x::dx]
                if some.size:
                    lines = some.reshape(len(some), -1) if bits >= 8 else np.packbits(some.reshape(len(some), -1), axis=1)
                    raw += R._lines(R.filtered(lines, step), (np.arange(len(lines)) % 5).astype(np.uint8))
            ihdr = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
            png = C.PNG + C.png_chunk("IHDR", ihdr) + C.png_chunk("IDAT", zlib.compress(raw)) + C.png_chunk("IEND", b"")
            assert (R.decoded(C.parse(png)) == rows).all()
            assert (R.decoded(C.parse(R.recompressed(C.parse(png), True, 6)[0])) == rows).all()


def test_png_chunks_follow_their_policy():
    rows = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    before = b"".join(C.png_chunk(n, c) for n, c in (("gAMA", b"\0\0\xb1\x8f"), ("tEXt", b"a\0b"), ("eXIf", tiff(6)), ("prVt", b"safe"), ("prVT", b"unsafe")))
    png = R.encoded(64, 64, 8, 0, rows, 1, before)
    left = {strip: [p.name for p in C.parse(C.rebuilt(C.parse(png), strip)[0]).parts] for strip in (False, True)}
    assert left == {False: ["IHDR", "gAMA", "tEXt", "eXIf", "prVt", "IDAT", "IEND"], True: ["IHDR", "gAMA", "eXIf", "IDAT", "IEND"]}
    assert C.parse(C.rebuilt(C.parse(png), True)[0]).first("eXIf") == C.orientation_only(tiff(6))


@pytest.mark.parametrize("order", "<>")
def test_orientation(order):
    assert [C.orientation(tiff(v, order)) for v in (0, 1, 2, 8, 9)] == [None, None, (2, order), (8, order), None]
    assert len(C.orientation_only(tiff(3, order))) == 26 and C.orientation(C.orientation_only(tiff(3, order))) == (3, order)
    assert C.orientation(tiff(5, order)[:15]) is None and C.orientation(b"") is None


def test_jpeg_segments():
    data = jpeg((0xE0, b"JFIF\0rest"), (0xE1, b"Exif\0\0" + tiff(6)), (0xE1, b"http://ns.adobe.com/xap/1.0/\0x"), (0xE2, b"ICC_PROFILE\0p"), (0xEE, b"Adobe1"), (0xFE, b"said"))
    box = C.parse(data)
    assert (C.size(box), C.kept_reason(box), C.rebuilt(box, False)[0]) == ((11, 7), None, data)
    assert [p.name for p in C.parse(C.rebuilt(box, True)[0]).parts] == ["E0", "E1", "E2", "EE", "C0", "DA", "scan"]
    assert C.kept_reason(C.parse(jpeg((0xEB, b"JP..c2pa"), frame=0xC9))) == "signed"
    assert C.kept_reason(C.parse(jpeg(frame=0xC9))) == "unsupportedEncoding"
    assert C.kept_reason(C.parse(jpeg((0xEB, b"JP..c2pa"), tail=b"!"))) == "extraData"


def test_webp_chunks():
    canvas = bytes([0x0C, 0, 0, 0]) + b"\x09\0\0\x04\0\0"
    data = webp((b"VP8X", canvas), (b"VP8L", LOSSLESS), (b"EXIF", tiff(1)), (b"XMP ", b"odd"), (b"any ", b"x"))
    box = C.parse(data)
    assert (C.size(box), C.kept_reason(box), C.rebuilt(box, False)[0]) == ((10, 5), None, data)
    out = C.parse(C.rebuilt(box, True)[0])
    assert [p.name for p in out.parts] == ["VP8X", "VP8L"] and out.first("VP8X")[0] == 0
    assert C.kept_reason(C.parse(webp((b"VP8X", b"\x02" + canvas[1:]), (b"C2PA", b"")))) == "animated"
    assert C.kept_reason(C.parse(webp((b"VP8L", LOSSLESS), (b"C2PA", b"")))) == "signed"
    assert C.kept_reason(C.parse(webp((b"VP8X", canvas), (b"VP8L", b"\x2f" + struct.pack("<I", 1 << 28))))) == "unsupportedEncoding"


def test_damaged_files_are_refused_and_never_grow():
    rng = random.Random(3)
    rows = np.tile(np.arange(40, dtype=np.uint8), (40, 1))
    for whole in (R.encoded(40, 40, 8, 0, rows, 1), jpeg((0xFE, b"said")), webp((b"VP8L", LOSSLESS), (b"XMP ", b"x")), two_pages(b"shown text " * 30)):
        for _ in range(120):
            data = bytearray(whole[: rng.randrange(1, len(whole) + 1)])
            data[rng.randrange(len(data))] ^= rng.randrange(1, 256)
            try:
                out = pdf_result(bytes(data), True, True) if whole[:4] == b"%PDF" else image_result(bytes(data), True, 1)
                assert len(out["content"]) <= len(data)
            except (C.Refused, LookupError, TypeError, ValueError, zlib.error):
                pass


def test_pdf_is_cleaned_and_read_again():
    data = two_pages(b"(kept) Tj \\ " * 40)
    out, report = P.compressed(data, strip_metadata=True)
    assert (report["pages"], report["duplicates_merged"], report["unused_removed"], report["metadata_removed"], report["kept_original"]) == (2, 1, 2, True, False)
    pdf = P.load(out)
    assert [P.inflated(pdf.at(pdf.objects[n][b"Contents"])) for n in pdf.pages()] == [b"(kept) Tj \\ " * 40] * 2
    again, second = P.compressed(out)
    assert len(again) <= len(out) and second["pages"] == 2
    assert P.compressed(data)[1]["metadata_removed"] is False
    assert P.load(P.compressed(data)[0]).at(P.load(P.compressed(data)[0]).trailer[b"Info"])[b"Producer"] == b"(a \\(test\\))"


def test_pdf_without_its_table_is_searched():
    data = two_pages(b"text")
    assert len(P.load(data[: data.index(b"startxref")]).pages()) == 2
    with pytest.raises(C.Refused, match="encrypted"):
        P.load(data.replace(b"/Size 9", b"/Encrypt<</V 1>>/Size 9"))
    with pytest.raises(C.Refused, match="signed"):
        P.compressed(data.replace(b"/Producer(", b"/ByteRange[0 1]/Contents<00>/Producer("))


def test_archival_files_stay_classic():
    xmp = b"<x pdfaid:part='1'/>"
    assert [P.archival_part(x) for x in (xmp, b"<pdfaid:part>2<", b"pdfaid:part=x1", b"none")] == [1, 2, None, None]
    pdf = P.load(two_pages(b"text"))
    pdf.objects[1][b"Metadata"], pdf.objects[9] = P.Ref(9), P.Stream({b"Type": P.Name(b"Metadata")}, xmp)
    out, report = P.compressed(P.saved(pdf, True), strip_metadata=True)
    assert b"ObjStm" not in out and b"\nxref\n" in out and report["metadata_kept_for_standard"] and not report["metadata_removed"]


def test_operators_hold_errors_as_data(spark):
    rows = [(1, two_pages(b"text" * 99)), (2, b""), (3, None), (4, R.encoded(40, 40, 8, 0, np.zeros((40, 40), np.uint8), 1)), (5, b"GIF89a"), (4, b"\xff\xd8\xff")]
    files = spark.createDataFrame([(i, bytearray(c) if c is not None else None, "x") for i, c in rows], "id long, content binary, format string")
    pictures = [(r.id, r.error_code, r.error_detail if r.id == 5 else None) for r in compress_images(files).collect()]
    assert sorted(pictures, key=str) == sorted([(1, "unsupportedFormat", None), (2, "unsupportedFormat", None), (3, "noInput", None), (4, None, None), (4, "malformed", None), (5, "unsupportedFormat", "GIF")], key=str)
    assert sorted((r.id, r.error_code or "") for r in compress_pdfs(files).collect()) == [(1, ""), (2, "malformed"), (3, "noInput"), (4, "malformed"), (4, "malformed"), (5, "malformed")]
    assert [r.name for r in image_parts(files.where("id = 4 and length(content) > 9")).orderBy("ord").collect()] == ["IHDR", "IDAT", "IEND"]
    assert {(r.id, tuple(r.refs)) for r in pdf_objects(files.where("id = 1")).where("id < 3").collect()} == {(0, (8, 1)), (1, (2,)), (2, (4, 3))}
    assert compress_images(files.limit(0)).count() == 0


@pytest.fixture
def tree(tmp_path):
    for name in ("melon.pdf", "Kiwi.PDF", "list.csv", "2019/fig.pdf", "2019/more/plum.pdf", "Lemons/lime.pdf", "shot.png", ".secret.pdf", ".cache/a.pdf", "Maker.app/b.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-" + name.encode())
    os.symlink(tmp_path / "2019", tmp_path / "again")
    os.symlink(tmp_path / "melon.pdf", tmp_path / "zest.pdf")
    return tmp_path


def test_scan_order_and_limits(tree, spark):
    found = folder_scan.scan([str(tree), str(tree / "2019")], ["pdf"])
    assert [f[2][len(str(tree)) + 1 :] for f in found.files] == ["2019/fig.pdf", "2019/more/plum.pdf", "Kiwi.PDF", "Lemons/lime.pdf", "melon.pdf", "zest.pdf"]
    assert found.summary == (2, 6, 3, False, [])
    assert [f[3] for f in folder_scan.scan([str(tree)], ["pdf"], max_files=2).files] == ["fig.pdf", "plum.pdf"]
    assert folder_scan.scan([str(tree)], ["pdf"], max_files=2).summary[3] and folder_scan.scan([str(tree)], ["pdf"], max_depth=1).summary[3]
    assert folder_scan.scan([str(tree / "none")], ["pdf"]).summary == (1, 0, 0, False, [str(tree / "none")])
    spark.dataSource.register(folder_scan.FolderScan)
    listed = spark.read.format("folder_scan").option("extensions", "pdf").load(str(tree))
    assert [r.name for r in listed.orderBy("ord").collect()] == ["fig.pdf", "plum.pdf", "Kiwi.PDF", "lime.pdf", "melon.pdf", "zest.pdf"]
    first = folder_scan.registered(listed.where("ord < 2"), "pdf")
    assert sorted((r.id, r.name) for r in folder_scan.registered(listed, "pdf", first).collect())[0] == (3, "Kiwi.PDF")
    read = {os.path.basename(r.path): (r.content, r.error_code) for r in folder_scan.contents(spark, listed, 14).collect()}
    assert read["melon.pdf"] == (bytearray(b"%PDF-melon.pdf"), None) and read["fig.pdf"] == (None, "tooLarge")


def test_sink_never_overwrites_and_repeats_nothing(tmp_path, spark):
    (tmp_path / "a.txt").write_bytes(b"old")
    assert result_store.publish(str(tmp_path), "a.txt", "t1", b"new") == result_store.publish(str(tmp_path), "a.txt", "t1", b"new") == str(tmp_path / "a (2).txt")
    os.unlink(tmp_path / ".t1")
    spark.sparkContext.setCheckpointDir("/tmp/tidewright-tests")
    rows = spark.createDataFrame([(1, "a.txt", bytearray(b"1")), (2, "a.txt", bytearray(b"2")), (3, "c.txt", None)], "id long, name string, content binary")
    out = {r.id: (r.saved_path, r.error_code) for r in result_store.save_to_folder(rows, str(tmp_path)).collect()}
    assert out[3] == (None, "noResult") and {open(out[i][0]).read() for i in (1, 2)} == {"1", "2"}
    assert sorted(os.listdir(tmp_path)) == ["a (2).txt", "a (3).txt", "a (4).txt", "a.txt"] and (tmp_path / "a.txt").read_bytes() == b"old"
    originals = spark.createDataFrame([(str(tmp_path / "a.txt"),)], "path string")
    os.link(tmp_path / "a.txt", tmp_path / "alias.txt")
    assert result_store.save_as(b"x", str(tmp_path / "alias.txt"), originals) == "sameAsInput"
    assert result_store.save_as(b"x", str(tmp_path / "a (2).txt"), originals) is None and (tmp_path / "a (2).txt").read_bytes() == b"x"


def test_store_keeps_the_last_result(spark):
    made = spark.createDataFrame([(1, 1, "pdf", None), (1, 3, "jpg", None), (1, 2, "png", None), (2, 1, "pdf", "/old")], "id long, seq long, extension string, saved_path string")
    last = result_store.latest(made)
    assert sorted((r.id, r.extension) for r in last.collect()) == [(1, "jpg"), (2, "pdf")]
    saved = spark.createDataFrame([(1, "/new")], "id long, saved_path string")
    assert sorted(r.saved_path for r in result_store.marked(last, saved).collect()) == ["/new", "/old"]
    assert result_store.unsaved_count(last).first().unsaved == 1 and result_store.without(last, saved).count() == 1


def test_stages_come_in_order_and_stop():
    data = two_pages(b"text " * 50)
    seen = Recorded()
    P.compressed(data, control=seen)
    assert [p.stage for p in seen.seen] == ["loading", "structure", "streams", "streams", "saving", "verifying"]
    assert [(p.done, p.total) for p in seen.seen if p.stage == "streams"] == [(0, 1), (1, 1)]
    for n in range(len(seen.seen)):
        with pytest.raises(C.Refused, match="cancelled"):
            P.compressed(data, control=Recorded(lambda so_far, n=n: len(so_far) >= n))


def test_predictor_of_differences():
    rows = np.random.default_rng(2).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    coded = np.diff(rows, axis=1, prepend=0).astype(np.uint8)
    parms = {b"Predictor": 2, b"Colors": 3, b"Columns": 7}
    assert P.inflated(P.Stream({b"Filter": P.Name(b"FlateDecode"), b"DecodeParms": parms}, zlib.compress(coded.tobytes()))) == rows.tobytes()


def test_picked_paths(tree):
    got = folder_scan.picked([str(tree / "2019"), str(tree / "shot.png"), str(tree / "Maker.app"), str(tree / "gone.pdf"), str(tree / "2019" / "fig.pdf")], ["pdf"], "compression")
    assert [r[:2] for r in got] == [("added", "shot.png"), ("skipped", "Maker.app"), ("skipped", "gone.pdf"), ("added", "fig.pdf"), ("added", "plum.pdf")]


def test_files_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.PDF", "b.txt", ".c.pdf", "long.pdf"):
        (tmp_path / "in" / name).write_bytes(b"%PDF" * (9 if name == "long.pdf" else 1))
    running = folder_scan.arriving(spark, str(tmp_path / "in"), ["pdf"], 10, "pdf").writeStream.format("memory").queryName("came").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert sorted((r["name"], r["size"], r["scope"], r["content"]) for r in spark.table("came").collect()) == [("a.PDF", 4, "pdf", bytearray(b"%PDF")), ("long.pdf", 36, "pdf", None)]
