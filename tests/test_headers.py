"""Sizes of images from their headers, held to what the decoder of the image source says."""

import random
import struct

import numpy as np
from pyspark.sql import functions as F

from millrace.functions.headers import image_header
from millrace.plans import routing
from millrace.sources import images, media
from tests.test_files_and_streams import png


def jpeg(width, height, before=(), frame=0xC0):
    """A JPEG head: segments of the given lengths, then the frame."""
    body = b"".join(b"\xff" * (1 + n % 2) + b"\xe1" + struct.pack(">H", n + 2) + b"\xff\xc0" * (n // 2) + b"\0" * (n % 2) for n in before)
    return b"\xff\xd8" + body + b"\xff" + bytes([frame]) + struct.pack(">HBHH", 11, 8, height, width) + b"\1\1\x11\0" + b"\xff\xda"


def webp(kind, width, height):
    if kind == "VP8 ":
        data = b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", width | 1 << 14, height | 2 << 14)
    elif kind == "VP8L":
        data = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14 | 1 << 28)
    else:
        data = b"\x10\0\0\0" + struct.pack("<I", width - 1)[:3] + struct.pack("<I", height - 1)[:3]
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBP" + kind.encode() + struct.pack("<I", len(data)) + data + b"tail"


def told(spark, files):
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "name string, content binary")
    return {r.name: (r.h.kind, r.h.width, r.h.height) for r in df.select("name", image_header(F.col("content")).alias("h")).collect()}


def test_every_kind(spark):
    rng, files, want = random.Random(5), {}, {}
    for i in range(12):
        w, h = rng.randrange(1, 16000), rng.randrange(1, 16000)
        some = {
            "jpeg": jpeg(w, h, [rng.randrange(0, 60000) for _ in range(i)], [0xC0, 0xC1, 0xC2, 0xCF][i % 4]),
            "gif": b"GIF8" + (b"9a", b"7a")[i % 2] + struct.pack("<HH", w, h) + b"\0\0\0",
            "bmp": b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, w, h),
            "png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h),
        }
        for kind, data in some.items():
            files[f"{kind}{i}"], want[f"{kind}{i}"] = data, (kind, w, h)
        for kind in ("VP8 ", "VP8L", "VP8X"):
            files[f"{kind}{i}"], want[f"{kind}{i}"] = webp(kind, w, h), ("webp", w, h)
    assert told(spark, files) == want


def test_many_segments_and_broken_heads(spark):
    whole = jpeg(640, 480, [3, 8])
    files = {"many": jpeg(640, 480, [i % 50 for i in range(500)]), "none": None, "empty": b"", "text": b"no image at all, but long enough", "tables": jpeg(9, 9, [4], 0xC4), "zero": jpeg(640, 0), "webp": webp("VP8L", 9, 9)[:20]}
    files |= {f"cut{n}": whole[:n] for n in range(2, len(whole))}
    got = told(spark, files)
    assert got["many"] == ("jpeg", 640, 480)
    assert got["none"] == got["empty"] == got["text"] == (None, None, None)
    assert got["tables"] == got["zero"] == ("jpeg", None, None) and got["webp"] == ("webp", None, None)
    size = whole.rindex(b"\xff\xc0") + 9
    for n in range(3, len(whole)):
        assert got[f"cut{n}"] == (("jpeg", 640, 480) if n >= size else ("jpeg", None, None)), n


def test_headers_equal_the_decoder_and_serve_gate_and_sidecars(spark, tmp_path):
    jvm, folder = spark.sparkContext._jvm, tmp_path / "in"
    folder.mkdir()
    for i, kind in enumerate(["jpg", "gif", "bmp", "png"]):
        picture = jvm.java.awt.image.BufferedImage(300 + i, 400 - 2 * i, 1)
        assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(folder / f"a{i}.{kind}")))
    (folder / "own.png").write_bytes(png(np.zeros((7, 11))))
    (folder / "big.webp").write_bytes(webp("VP8 ", 900, 700))
    (folder / "small.webp").write_bytes(webp("VP8X", 90, 700))
    (folder / "broken.webp").write_bytes(b"RIFF")
    (folder / "broken.png").write_bytes(png(np.zeros((300, 300)))[:40])
    headers = images.read_headers(spark, str(folder))
    name = lambda r: r.path.rsplit("/", 1)[-1]
    sizes = {name(r): (r.width, r.height) for r in headers.collect()}
    pixels = images.read_images(spark, str(folder))
    decoded = {name(r): (r.width, r.height) for r in pixels.filter("pixels IS NOT NULL").collect()}
    assert len(decoded) == 5 and {k: sizes[k] for k in decoded} == decoded
    gate = {name(r): r for r in routing.quality_gate(images.image_metrics(pixels, headers)).collect()}
    assert gate["big.webp"].reasons == ["unmeasured"] and gate["small.webp"].reasons == ["too small", "extreme aspect", "unmeasured"]
    assert gate["broken.webp"].reasons == gate["broken.png"].reasons == ["undecodable"] and not gate["big.webp"].ok
    assert len(gate) == 9 and gate["a0.jpg"].reasons[0] != "undecodable"
    listed = media.read_media(spark, str(folder)).drop("content")
    none = spark.createDataFrame([], "folder string, stem string, text string")
    rows = {name(r): (r.width, r.height) for r in media.attach_sidecars(listed, none, none, headers).collect()}
    assert rows["big.webp"] == (900, 700) and rows["a0.jpg"] == (300, 400) and rows["broken.webp"] == (0, 0)
