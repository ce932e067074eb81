import hashlib
import random
import struct
import zlib

import numpy as np

from paperloom.llm import gif


def test_lzw_round_trip():
    rng = random.Random(0)
    for least in (2, 4, 8):
        for n in (1, 2, 50, 5000, 40_000):
            for kind in (0, 1):
                x = bytes(rng.randrange(1 << least) if kind else (i // 7) % (1 << least) for i in range(n))
                assert gif.lzw_decode(gif.lzw_encode(x, least), least, n) == x


def image(left, top, w, h, samples, control=b"", flags=0):
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))


def animation(*images):
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    return b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette + b"".join(images) + b"\x3b"


def control(delay, disposal=0, transparent=None):
    return b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)


def test_disposal_transparency_and_timing():
    data = animation(
        image(0, 0, 2, 2, [0, 0, 0, 0], control(5, 1)),
        image(0, 0, 2, 1, [1, 3], control(7, 3, transparent=3)),
        image(1, 1, 1, 1, [2], control(9, 2)),
        image(0, 0, 1, 1, [1], control(1)),
    )
    _, _, frames, error = gif.decode(data)
    assert error is None and [f.delay_ms for f in frames] == [50, 70, 90, 10]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert frames[0].canvas.tolist() == [[red, red], [red, red]]
    assert frames[1].canvas.tolist() == [[green, red], [red, red]]
    assert frames[2].canvas.tolist() == [[red, red], [red, blue]]  # the frame before was taken back
    assert frames[3].canvas.tolist() == [[green, red], [red, none]]  # the area was cleared
    assert gif.histogram(frames[3].canvas)[0][7] == 2


def test_interlace_and_damage():
    rows = [[i % 4] for i in (0, 4, 2, 6, 1, 3, 5, 7)]
    data = b"GIF89a" + struct.pack("<HHBBB", 1, 8, 0x81, 0, 0) + bytes(12) + image(0, 0, 1, 8, [r[0] for r in rows], flags=0x40) + b"\x3b"
    _, _, frames, _ = gif.decode(data)
    assert frames[0].indices.ravel().tolist() == [i % 4 for i in range(8)]
    assert gif.decode(data[:-9])[3] and gif.decode(b"no")[3] == "no GIF header"


def test_later_frames_are_transparent_where_nothing_changes():
    rows = bytes(range(64)) * 1024 + bytes(range(64)) * 1000 + bytes(64) * 24 + bytes([255] * 64)
    data = gif.encode_grey(rows)
    _, _, frames, error = gif.decode(data)
    assert error is None and [f.transparent for f in frames] == [None, 255, 254]
    assert b"".join(f.canvas[: f.indices.shape[0], :, 0].tobytes() for f in frames) == rows
    assert (frames[1].indices[:1000] == 255).all()
    noise = random.Random(1).randbytes(64 * 3000)
    assert b"".join(f.canvas[: f.indices.shape[0], :, 0].tobytes() for f in gif.decode(gif.encode_grey(noise))[2]) == noise


def test_null_and_huge_media(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x81, 0, 0) + bytes(12) + b"\x3b"
    df = spark.createDataFrame([(1, None), (2, huge), (3, b"")], "doc_id long, media binary")
    assert [(r.payload_bytes, r.feature, r.frames) for r in gif.read_samples(df).collect()] == [(None, None, []), (0, "the canvas is too large", []), (0, "no GIF header", [])]
    assert [(r.frames, r.error) for r in gif.frames(df).collect()] == [([], None), ([], "the canvas is too large"), ([], "no GIF header")]


def test_stored_texts(spark, odd_docs, no_docs):
    docs = odd_docs.collect()
    stored = gif.store_samples(odd_docs, keep=["doc_id", "lang"])
    got = gif.read_samples(stored).collect()
    for r, d in zip(got, docs, strict=True):
        raw = (d.text or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.feature.startswith("gif 64x") and sum(r.frames[0].hist_red) == 64 * r.frames[0].height
    assert gif.read_samples(gif.store_samples(no_docs)).count() == 0
    frames = gif.frames(stored.where("doc_id = 4")).first().frames
    assert len(frames) > 3 and frames[1].start_ms == gif.DELAY_MS and sum(frames[0].hist_red) == frames[0].width * frames[0].height
    assert np.frombuffer(frames[0].canvas, np.uint8).size == 4 * 64 * 1024
