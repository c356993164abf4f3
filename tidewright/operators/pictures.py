"""Conversion and background removal of pictures, and placements of pictures in PDFs.

Rows (id, content) in; errors are columns, as in ``operators.files``.  Pixels are read from PNG and from
sequential JPEG; other formats are ``conversionUnsupported`` (no decoder for them is at hand).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.kernels import containers, jpeg_code, pdf_file, pixels, placement
from tidewright.kernels.containers import Refused
from tidewright.operators.files import ERRORS, _applied

CONVERTED = "id long, format string, width int, height int, original_size long, output_size long, flattened boolean, " + ERRORS
CUT = "id long, width int, height int, original_size long, output_size long, " + ERRORS
PLACED = "doc long, image_id long, width_pt double, height_pt double"


#: Colour space of a profile, and where a profile says so (fixed values).
ICC_RGB, ICC_PLACE = b"RGB ", slice(16, 20)


def _profile(box: containers.Container) -> bytes | None:
    """The colour profile of a picture; only those of RGB can be kept."""
    if box.format == "jpeg":
        parts = [box.payload(p) for p in box.parts if p.name == "E2" and box.payload(p).startswith(b"ICC_PROFILE\0")]
        found = b"".join(p[14:] for p in sorted(parts, key=lambda p: p[12])) or None
    else:
        raw = box.first("iCCP")
        found = None if raw is None else zlib.decompressobj().decompress(raw[raw.index(b"\0") + 2 :], 4 << 20)
    if found is not None and found[ICC_PLACE] != ICC_RGB:
        raise Refused("conversionUnsupported", "a profile that is not of RGB")
    return found


#: Gamma and primaries that an sRGB picture may declare (fixed values).
SRGB_GAMMA, SRGB_PRIMARIES = struct.pack(">I", 45455), struct.pack(">8I", 31270, 32900, 64000, 33000, 30000, 60000, 15000, 6000)


def _picture(data: bytes):
    box = containers.parse(data)
    if box.format == "jpeg":
        if containers.kept_reason(box) is not None:
            raise Refused("conversionUnsupported", "extra data, a signature or a coding of its own")
        samples = jpeg_code.pixels(box)
        exif = next((box.payload(p)[6:] for p in box.parts if p.name == "E1" and box.payload(p).startswith(containers.EXIF_PREFIX)), b"")
        whole = np.full((*samples.shape[:2], 4), 255, np.uint8)
        whole[..., :3] = samples
        return pixels.oriented(whole, (containers.orientation(exif) or (1, ""))[0])
    odd = [n for n, plain in (("gAMA", SRGB_GAMMA), ("cHRM", SRGB_PRIMARIES)) if "sRGB" not in box.names() and "iCCP" not in box.names() and box.first(n) not in (None, plain)]
    if odd:
        raise Refused("conversionUnsupported", f"{odd[0]} of its own")
    if box.format != "png" or containers.kept_reason(box) == "animated" or box.names() & {"cICP", "mDCV", "mDCv", "cLLI", "cLLi"} or data[24] == 16:
        raise Refused("conversionUnsupported", box.format)  # P15: 16 bits and wide gamuts would lose something
    return pixels.rgba(box)


def _jpeg_of(picture: np.ndarray, profile: bytes | None, quality: int) -> bytes:
    """A file without subsampling, its profile in segments; read again, size and profile must agree."""
    cut = [profile[k : k + 65000] for k in range(0, len(profile), 65000)] if profile else []
    segments = [(0xE2, b"ICC_PROFILE\0" + bytes([k + 1, len(cut)]) + part) for k, part in enumerate(cut)]
    out = jpeg_code.written(np.ascontiguousarray(picture[..., :3]), quality, (1, 1), segments)
    again = containers.parse(out)
    if containers.size(again) != (picture.shape[1], len(picture)) or _profile(again) != profile:
        raise Refused("internal", "size or profile changed")
    return out


def _converted(data: bytes, background: tuple[int, int, int] | None, form: str = "png", quality: int = 90) -> dict:
    if containers.image_format(data[:16]) is None:
        raise Refused("conversionUnsupported", containers.description(data[:16]))
    picture, profile = _picture(data), _profile(containers.parse(data))
    if form == "jpeg":
        background = background or (255, 255, 255)
    flattened = background is not None and bool((picture[..., 3] != 255).any())  # A9
    picture = pixels.composited(picture, background) if flattened else picture
    out = _jpeg_of(picture, profile, quality) if form == "jpeg" else pixels.png_of(picture, profile=profile)
    return {"format": form, "width": picture.shape[1], "height": len(picture), "original_size": len(data), "output_size": len(out), "flattened": flattened, "content": out}


class _CutOut:
    """The segmenter is made once a worker task, not once a file."""

    def __init__(self, make: Callable[[], pixels.Segmenter], **options) -> None:
        self.make, self.options, self.model = make, options, None

    def __call__(self, data: bytes) -> dict:
        picture = _picture(data)
        self.model = self.model or self.make()
        point = self.options["point"]
        mask = self.model.mask(self.model.embed(picture), point or (0.5, 0.5), point is None)
        cut = pixels.cut_out(picture, mask, self.options["crop"], self.options["background"])
        out = pixels.png_of(cut)
        return {"width": cut.shape[1], "height": len(cut), "original_size": len(data), "output_size": len(out), "content": out}


def convert_images(files: DataFrame, background: tuple[int, int, int] | None = None, form: str = "png", quality: int = 90) -> DataFrame:
    """PNG or JPEG of each picture, oriented, with its RGB profile; over ``background`` (for JPEG white, if none is
    given) where something is clear."""
    if form not in ("png", "jpeg") or not 30 <= quality <= 100:
        raise ValueError("invalidOptions: form or quality")
    return _applied(files, partial(_converted, background=background, form=form, quality=quality), CONVERTED, pixels.MAX_BYTES)


def cut_out_images(files: DataFrame, make: Callable[[], pixels.Segmenter], point: tuple[float, float] | None = None, crop: bool = False, background: tuple[int, int, int] | None = None) -> DataFrame:
    """The subject of each picture by the masks of ``make()``; ``point`` (0 to 1 on each axis) chooses
    the subject, none lets the segmenter choose.  Nothing visible is ``noSubject``."""
    if point is not None and not all(0 <= p <= 1 for p in point):
        raise ValueError("invalidOptions: point")
    return _applied(files, _CutOut(make, point=point, crop=crop, background=background), CUT, pixels.MAX_BYTES)


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for key, data in zip(rows["id"], rows["content"], strict=True):
            try:
                out += [(key, n, *size) for n, size in placement.display_sizes(pdf_file.load(bytes(data or b""))).items()]
            except Refused:
                continue  # its error is a row of compress_pdfs and of pdf_objects
        yield pd.DataFrame(out, columns=["doc", "image_id", "width_pt", "height_pt"])


def pdf_placements(files: DataFrame) -> DataFrame:
    """A row for each picture that a page draws, with its largest width and height."""
    return files.select("id", "content").mapInPandas(_placed, PLACED)


def placed_pdf(size: int) -> bytes:
    """Two pages: a picture drawn ``size`` x 7 points, and in a form of scale 2 drawn 3 x ``size``."""
    name = pdf_file.Name
    page = {b"Type": name(b"Page"), b"Parent": pdf_file.Ref(2)}
    form = {b"Subtype": name(b"Form"), b"Matrix": [2, 0, 0, 2, 5, 5]}
    objects = {
        1: {b"Type": name(b"Catalog"), b"Pages": pdf_file.Ref(2)},
        2: {b"Type": name(b"Pages"), b"Kids": [pdf_file.Ref(3), pdf_file.Ref(4)], b"Count": 2, b"Resources": {b"XObject": {b"I": pdf_file.Ref(6), b"F": pdf_file.Ref(7)}}},
        3: {**page, b"Contents": [pdf_file.Ref(5), pdf_file.Ref(5)]},
        4: {**page, b"Contents": pdf_file.Ref(8)},
        5: pdf_file.Stream({}, b"q %d 0 0 7 1 1 cm /I Do Q" % size),
        6: pdf_file.Stream({b"Subtype": name(b"Image"), b"Width": 1, b"Height": 1}, b"\0"),
        7: pdf_file.Stream(form, b"3 0 0 %d 0 0 cm /I Do" % size),
        8: pdf_file.Stream({}, b"/F Do"),
    }
    return pdf_file.saved(pdf_file.Pdf(b"1.4", objects, {b"Root": pdf_file.Ref(1)}), True)


def _drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"id": rows["id"], "content": [placed_pdf(int(s)) for s in rows["size"]]})


def display_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as PDFs that draw one picture twice, and how large they draw it."""
    made = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "p_size AS size").mapInPandas(_drawn, "id long, content binary")
    return pdf_placements(made).select(F.col("doc").alias("p_partkey"), "width_pt", "height_pt")


QUERIES = {"display_sizes": display_sizes}
ORACLE_SQL = {"display_sizes": "SELECT p_partkey, CAST(greatest(p_size, 6) AS DOUBLE) AS width_pt, CAST(greatest(7, 2 * p_size) AS DOUBLE) AS height_pt FROM part"}
