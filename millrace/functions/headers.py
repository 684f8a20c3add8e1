"""Kind and size of an image from the first bytes of its file, as Columns: nothing is decoded."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segments of a JPEG that the first walk goes through; a file with more before its frame is walked anew to the end.
SEGMENTS = 64
_STATE = "struct<at: int, width: int, height: int, over: boolean>"


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The unsigned number of ``size`` bytes from the 1-based position ``at``; null where the file is shorter."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda i: F.conv(F.nullif(F.hex(F.substring(content, at + i, F.lit(1))), F.lit("")), 16, 10).cast("int")
    order = range(size - 1, -1, -1) if little else range(size)
    return reduce(lambda high, i: high * 256 + byte(i), order, F.lit(0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _jpeg(content: Column) -> Column:
    """Walk from segment to segment until the frame that states the size."""

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker, length = _number(content, at + 1, 1), _number(content, at + 2, 2)
        state = lambda to, width=F.lit(None), height=F.lit(None), over=F.lit(False): F.struct(to.alias("at"), width.alias("width"), height.alias("height"), over.alias("over")).cast(_STATE)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        lost = F.coalesce((_number(content, at, 1) != 0xFF) | marker.isin(0xD9, 0xDA), F.lit(True)) | marker.isNull()
        out = F.when(s["over"], s).when(lost, state(at, over=F.lit(True))).when(marker == 0xFF, state(at + 1))
        out = out.when((marker == 1) | marker.between(0xD0, 0xD8), state(at + 2))
        out = out.when(frame, state(at, _number(content, at + 7, 2), _number(content, at + 5, 2), F.lit(True)))
        return out.when(length >= 2, state(at + 2 + length)).otherwise(state(at, over=F.lit(True)))

    walk = lambda start, steps: F.aggregate(F.sequence(F.lit(1), steps), start, step)
    start = F.struct(F.lit(3).alias("at"), F.lit(None).alias("width"), F.lit(None).alias("height"), F.lit(False).alias("over")).cast(_STATE)
    return _once(walk(start, F.lit(SEGMENTS)), lambda short: F.when(short["over"], short).otherwise(walk(start, F.length(content))))


def image_header(content: Column) -> Column:
    """``kind, width, height`` of a PNG, JPEG, GIF, WebP or BMP file; all null for anything else, the sizes where the header breaks off or says 0.

    A WebP file has one of three heads: of lossy pixels, of lossless ones, or of an extended file with the canvas in it."""
    text = lambda at, size: F.hex(F.substring(content, at, size))
    head, chunk = text(1, 12), text(13, 4)
    webp = head.startswith("52494646") & head.endswith("57454250")
    lossless = _number(content, 22, 4, little=True)
    pair = lambda width, height: F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    kinds = [
        ("png", head.startswith("89504E470D0A1A0A") & (chunk == "49484452"), pair(_number(content, 17, 4), _number(content, 21, 4))),
        ("jpeg", head.startswith("FFD8FF"), _once(_jpeg(content), lambda s: pair(s["width"], s["height"]))),
        ("gif", head.startswith("474946383761") | head.startswith("474946383961"), pair(_number(content, 7, 2, True), _number(content, 9, 2, True))),
        ("webp", webp & (chunk == "56503820") & (text(24, 3) == "9D012A"), pair(_number(content, 27, 2, True) % 16384, _number(content, 29, 2, True) % 16384)),
        ("webp", webp & (chunk == "5650384C") & (text(21, 1) == "2F"), pair(lossless.bitwiseAND(16383) + 1, F.shiftright(lossless, 14).bitwiseAND(16383) + 1)),
        ("webp", webp & (chunk == "56503858"), pair(_number(content, 25, 3, True) + 1, _number(content, 28, 3, True) + 1)),
        ("webp", webp, pair(F.lit(None), F.lit(None))),
        ("bmp", head.startswith("424D") & (text(15, 4) == "28000000"), pair(_number(content, 19, 4, True), F.abs(_number(content, 23, 4, True)))),
    ]
    name, size = (reduce(lambda rest, k: F.when(k[1], pick(k)).otherwise(rest), reversed(kinds), F.lit(None)) for pick in (lambda k: F.lit(k[0]), lambda k: k[2]))

    def checked(size: Column) -> Column:
        known = F.coalesce((size["width"] > 0) & (size["height"] > 0), F.lit(False))
        return F.struct(name.alias("kind"), F.when(known, size["width"]).alias("width"), F.when(known, size["height"]).alias("height"))

    return _once(size, checked)
