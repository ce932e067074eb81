"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

Codes of a stream have widths that depend only on how many have followed the last clear code, so a
stretch is cut out of the bit string by one array operation; only the dictionary itself is sequential.

``store_samples`` keeps any bytes losslessly: 64 samples a row, a grey palette, frames of at most 1024
rows; in all but the first frame the samples that the canvas shows already are transparent.  ``frames`` and
``read_samples`` give timed frames with colour histograms, and defined results for broken media: the
frames before the damage, and the reason in ``error``.  Null media have no frames and no error.

A null or empty text is one row of zero bytes; a text of any length is whole.  Equal texts give equal
media; repeated rows repeat, an empty table gives no rows, and columns with the names of added ones are
replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared
from .frames import add_columns, slices

WIDTH, ROWS, DELAY_MS = 64, 1024, 100
_FULL = 4096
#: Samples of a canvas or a frame; media that claim more are taken for damaged.
MOST = 1 << 24


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray | None = None


def _widths(least: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for a minimum code size."""
    at = np.arange(n) + (1 << least) + 1
    return np.clip(np.ceil(np.log2(at + 1)).astype(np.int64), least + 1, 12)


_CODES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(least: int) -> tuple[np.ndarray, np.ndarray]:
    if least not in _CODES:
        w = _widths(least, 2 * _FULL)
        _CODES[least] = w, np.concatenate([[0], np.cumsum(w)])
    return _CODES[least]


#: The code of (prefix, sample), 0 where there is none; empty between calls.
_NEXT = [0] * (_FULL << 8)


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    """The code stream of samples below 2**least: a clear code first and whenever the dictionary is full."""
    clear = 1 << least
    stretches, codes, used, new = [], [], [], clear + 2
    put, table = codes.append, _NEXT
    it = iter(samples)
    prefix = next(it, None)
    if prefix is not None:
        for c in it:
            k = prefix << 8 | c
            code = table[k]
            if code:
                prefix = code
                continue
            put(prefix)
            prefix = c
            if new < _FULL:
                table[k] = new
                used.append(k)
                new += 1
            else:
                put(clear)
                stretches.append(np.array(codes, np.uint32))
                codes.clear()
                for k in used:
                    table[k] = 0
                used.clear()
                new = clear + 2
        put(prefix)
        for k in used:
            table[k] = 0
    put(clear + 1)
    stretches.append(np.array(codes, np.uint32))
    width = np.concatenate([[least + 1], *(_layout(least)[0][: len(x)] for x in stretches)])
    return _bits(np.concatenate([np.array([clear], np.uint32), *stretches]), width)


def _bits(codes: np.ndarray, width: np.ndarray) -> bytes:
    """Codes of at most 12 bits, least significant bit first."""
    end = np.cumsum(width)
    at = end - width
    wide = codes << (at & 7).astype(np.uint32)
    out = np.zeros((int(end[-1]) + 7) // 8 + 3, np.uint8)
    byte = at >> 3
    for k in range(3):  # codes start in different bytes, but for those that share one
        part = (wide >> np.uint32(8 * k) & np.uint32(255)).astype(np.uint8)
        np.bitwise_or.at(out, byte + k, part) if len(codes) < 64 else _or_at(out, byte + k, part)
    return out[: (int(end[-1]) + 7) // 8].tobytes()


def _or_at(out: np.ndarray, at: np.ndarray, part: np.ndarray) -> None:
    """A code has 3 bits at least, so at most three codes in a row start in one byte."""
    for k in range(3):
        out[at[k::3]] |= part[k::3]


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; a code out of the dictionary raises ValueError."""
    clear, stop = 1 << least, (1 << least) + 1
    width, starts = _layout(least)
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)])
    bits, at, out, size = 8 * len(stream), 0, [], 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, previous, seen, ended = list(roots), None, 0, False
    while not ended and size < most:
        w, s = (width, starts) if not seen else (np.full(_FULL, 12), np.arange(_FULL + 1) * 12)
        n = int(np.searchsorted(s, bits - at, "right")) - 1
        if n <= 0:
            break
        n = min(n, len(w))
        pos = at + s[:n]
        b = pos >> 3
        raw = data[b].astype(np.uint32) | data[b + 1].astype(np.uint32) << np.uint32(8) | data[b + 2].astype(np.uint32) << np.uint32(16)
        codes = raw >> (pos & 7).astype(np.uint32) & ((1 << w[:n]) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        upto = int(marks[0]) if len(marks) else n
        run = codes[:upto].tolist()
        if run:
            k = 0
            if previous is None:
                if run[0] >= clear:
                    raise ValueError("a code stream starts with an unknown code")
                previous = table[run[0]]
                out.append(previous)
                size += len(previous)
                k = 1
            have, put, grow = len(table), out.append, table.append
            first = len(out)
            for c in run[k:] if k else run:
                if c < have:
                    current = table[c]
                elif c == have and have < _FULL:
                    current = previous + previous[:1]
                else:
                    raise ValueError("a code is out of the dictionary")
                if have < _FULL:
                    grow(previous + current[:1])
                    have += 1
                put(current)
                previous = current
            size += sum(map(len, out[first:]))
        seen += upto
        if len(marks):
            at += int(s[upto + 1])
            ended = int(codes[upto]) == stop
            table, previous, seen = list(roots), None, 0
        else:
            at += int(s[n])
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(c := data[i : i + 255])]) + c for i in range(0, len(data), 255)) + b"\0"


def encode_grey(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """A GIF whose frames hold the samples, ``width`` in a row; their number must be a positive multiple of it."""
    if not samples or len(samples) % width:
        raise ValueError("the samples must fill whole rows")
    height = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()]
    screen = np.zeros(0, np.uint8)
    for top in range(0, height, rows):
        part = samples[top * width : (top + rows) * width]
        x, clear = np.frombuffer(part, np.uint8), None
        if top:  # what the canvas shows already is transparent, by a value that the frame does not hold
            free = np.flatnonzero(np.bincount(x, minlength=256) == 0)
            if len(free):
                clear = int(free[-1])
                part = np.where(x == screen[: len(x)], np.uint8(clear), x).tobytes()
        screen = np.concatenate([x, screen[len(x) :]])
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2 | (clear is not None), delay_ms // 10, clear or 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise ValueError("the palette is cut off")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _gather(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while True:
        if at >= len(data):
            raise ValueError("a block is cut off")
        n = data[at]
        if not n:
            return b"".join(out), at + 1
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _deinterlace(x: np.ndarray) -> np.ndarray:
    order = np.concatenate([np.arange(s, len(x), d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(x)
    out[order] = x
    return out


class Reader:
    """The frames of a GIF, one after the other; width, height and error are known once they have been read.

    A frame's canvas is RGBA after drawing it, before its disposal; one canvas is held at a time, of
    ``most`` samples at most: a larger canvas or frame is an error.
    """

    def __init__(self, data: bytes, most: int | None = None) -> None:
        self.data, self.most = data, most or MOST
        self.width, self.height, self.error = 0, 0, None
        if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
            self.error = "no GIF header"
        else:
            self.width, self.height = struct.unpack_from("<HH", data, 6)

    def __iter__(self):
        if self.error:
            return
        try:
            yield from self._frames()
        except (ValueError, struct.error, IndexError) as e:
            self.error = str(e)

    def _frames(self):
        data, width, height = self.data, self.width, self.height
        if width * height > self.most:
            raise ValueError("the canvas is too large")
        screen, delay, disposal, clear = np.zeros((height, width, 4), np.uint8), 0, 0, None
        common, at = _palette(data, 13, data[10])
        while True:
            if at >= len(data):
                raise ValueError("the trailer is missing")
            kind = data[at]
            at += 1
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = data[at] if at < len(data) else 0
                body, at = _gather(data, at + 1)
                if label == 0xF9 and len(body) >= 4:
                    bits, hundredths, index = struct.unpack_from("<BHB", body)
                    delay, disposal, clear = 10 * hundredths, bits >> 2 & 7, index if bits & 1 else None
                continue
            if kind != 0x2C or at + 10 > len(data):
                raise ValueError("an unknown or cut-off block")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            if w * h > self.most:
                raise ValueError("a frame is too large")
            own, at = _palette(data, at + 9, flags)
            palette, least = own if own is not None else common, data[at] if at < len(data) else 0
            if palette is None or not 1 <= least <= 8:
                raise ValueError("no palette, or a wrong code size")
            stream, at = _gather(data, at + 1)
            samples = lzw_decode(stream, least, w * h)
            if len(samples) < w * h:
                raise ValueError("a code stream is too short")
            x = np.frombuffer(samples, np.uint8).reshape(h, w)
            x = _deinterlace(x) if flags & 0x40 else x
            if x.size and int(x.max()) >= len(palette):
                raise ValueError("a sample is out of the palette")
            before = screen.copy() if disposal == 3 else None
            y1, x1 = min(top + h, height), min(left + w, width)
            part = x[: max(0, y1 - top), : max(0, x1 - left)]
            area = screen[top:y1, left:x1]
            if clear is None:
                area[..., :3] = palette[part]
                area[..., 3] = 255
            else:
                seen = part != clear
                area[seen, :3] = palette[part[seen]]
                area[seen, 3] = 255
            yield Frame(left, top, x, palette, delay, disposal, clear, screen)
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                screen = before
            delay, disposal, clear = 0, 0, None


def decode(data: bytes) -> tuple[int, int, list[Frame], str | None]:
    """(width, height, frames, error) with a canvas for each frame."""
    reader = Reader(data)
    frames = [replace(f, canvas=f.canvas.copy()) for f in reader]
    return reader.width, reader.height, frames, reader.error


def histogram(canvas: np.ndarray, bins: int = 8, channels: int = 3) -> list[list[int]]:
    """Counts of red, green and blue over the drawn (opaque) samples."""
    drawn = canvas[canvas[..., 3] > 0]
    return [np.bincount(drawn[:, c].astype(np.int64) * bins // 256, minlength=bins).tolist() for c in range(channels)]


def payload(text: str) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of the row width."""
    raw = text.encode()
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def store_samples(df: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with ``n_bytes`` long (of the text in UTF-8) and ``media`` binary: a GIF that holds the padded text.  Null is empty."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return add_columns(df, column, fields, lambda: lambda texts: [[len(t.encode()) for t in texts], [encode_grey(payload(t)) for t in texts]], keep=keep)


_FRAME = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("frame_no", "left", "top", "width", "height", "delay_ms", "start_ms", "disposal", "transparent")]
    + [T.StructField(f"hist_{c}", T.ArrayType(T.IntegerType())) for c in ("red", "green", "blue")]
)
_CANVAS = T.StructField("canvas", T.BinaryType())


def _row(number: int, start: int, f: Frame) -> dict:
    red, green, blue = histogram(f.canvas)
    return {"frame_no": number, "left": f.left, "top": f.top, "width": f.indices.shape[1], "height": f.indices.shape[0], "delay_ms": f.delay_ms, "start_ms": start, "disposal": f.disposal, "transparent": f.transparent, "hist_red": red, "hist_green": green, "hist_blue": blue}


def _with(df: DataFrame, column: str, added: list[T.StructField], one) -> DataFrame:
    """df without the media column, with the fields that the function finds in each row's media."""
    names = [x.name for x in added]
    kept = [f for f in df.schema.fields if f.name != column and f.name not in names]
    schema = T.StructType(kept + added)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added]
        for whole in batches:
            for b in slices(whole, column, 1 << 20):
                got = [one(x) for x in b.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array([g[n] for g in got], k) for n, k in zip(names, kinds)], names=schema.names)

    return df.mapInArrow(shared.tidy(run), schema)


def frames(df: DataFrame, column: str = "media", canvas: bool = True) -> DataFrame:
    """df without the media column, with ``frames`` (array of timed frames with colour histograms and, if asked for, RGBA canvases) and ``error``."""
    frame = T.StructType([*_FRAME.fields, _CANVAS]) if canvas else _FRAME

    def one(data: bytes | None):
        if data is None:
            return {"frames": [], "error": None}
        reader, rows, start = Reader(data), [], 0
        for i, f in enumerate(reader):
            rows.append(_row(i, start, f) | ({"canvas": f.canvas.tobytes()} if canvas else {}))
            start += f.delay_ms
        return {"frames": rows, "error": reader.error}

    return _with(df, column, [T.StructField("frames", T.ArrayType(frame)), T.StructField("error", T.StringType())], one)


def read_samples(df: DataFrame, column: str = "media") -> DataFrame:
    """df without the media, with digests of the samples read back from its frames and of the stored bytes, and its timed frames.

    Null media have null digests and no frames.
    """
    kinds = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "frames": T.ArrayType(_FRAME)}

    def one(data: bytes | None):
        if data is None:
            return dict.fromkeys(kinds) | {"frames": []}
        reader, whole, size, tail, rows, start = Reader(data), hashlib.sha256(), 0, b"", [], 0
        for i, f in enumerate(reader):
            part = f.canvas[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1], 0].tobytes()
            whole.update(part)
            size, tail = size + len(part), (tail + part)[-WIDTH:]
            rows.append(_row(i, start, f))
            start += f.delay_ms
        grey = np.sum([r["hist_red"] for r in rows], axis=0).tolist() if rows else []
        feature = reader.error or f"gif {reader.width}x{reader.height} frames={len(rows)} ms={start} grey={','.join(map(str, grey))}"
        return {"payload_bytes": size, "payload_sha256": whole.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature, "frames": rows}

    return _with(df, column, [T.StructField(n, k) for n, k in kinds.items()], one)
