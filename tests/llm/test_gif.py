import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parqlane.llm import gif

#: A well-known 10 x 10 picture of four colours, by hand.
SMALL = bytes.fromhex(
    "47494638396110000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95fa"
    "a8de608c04914c01003b"
)
ROWS = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3


def plain_decode(data, least):
    """Bit by bit, straight from the format's description."""
    clear, bits, at = 1 << least, "".join(f"{b:08b}"[::-1] for b in data), 0
    size, table, last, out = least + 1, None, None, b""
    while at + size <= len(bits):
        code = int(bits[at : at + size][::-1], 2)
        at += size
        if code == clear:
            table, size, last = [bytes((i,)) for i in range(clear)] + [b"", b""], least + 1, None
        elif code == clear + 1:
            break
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = entry
    return out


def test_known_picture():
    got = gif.decode(SMALL)
    assert ["".join(map(str, r)) for r in got.frames[0].indices] == ROWS
    canvas = next(got.render())
    assert canvas[0, 0].tolist() == [255, 0, 0, 255] and canvas[0, 9].tolist() == [0, 0, 255, 255] and canvas[0, 12, 3] == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 8), st.integers(0, 2**32 - 1), st.sampled_from([0, 1, 2, 5, 300, 6000, 30000]), st.sampled_from([1, 2, 256]))
def test_lzw_round_trip(least, seed, n, kinds):
    data = np.random.default_rng(seed).integers(0, min(kinds, 1 << least), n).astype(np.uint8).tobytes()
    stream = gif.lzw_encode(data, least)
    assert gif.lzw_decode(stream, least, n) == data
    assert plain_decode(stream, least) == data


def test_deferred_clear():
    """An encoder may go on with a full table at 12 bits."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 20000).astype(np.uint8).tobytes()
    table, free, codes, prefix = {bytes((i,)): i for i in range(256)}, 258, [256], b""
    for b in data:
        grown = prefix + bytes((b,))
        if grown in table:
            prefix = grown
            continue
        codes.append(table[prefix])
        if free < 4096:
            table[grown] = free
            free += 1
        prefix = bytes((b,))
    codes += [table[prefix], 257]
    said, have = "", 257
    size = 9
    for k, c in enumerate(codes):
        said += f"{c:012b}"[-size:][::-1]
        if k:
            have += 1
        if have == 1 << size and size < 12:
            size += 1
    stream = bytes(int(said[k : k + 8][::-1], 2) for k in range(0, len(said), 8))
    assert plain_decode(stream, 8) == data
    assert gif.lzw_decode(stream, 8, len(data)) == data


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def test_disposal_transparency_and_time():
    full, dot = bytes([1] * 16), bytes([2, 3, 3, 2])
    frames = [(full, 0, 0, 4, 4, 7, 1, None), (dot, 1, 1, 2, 2, 5, 3, 3), (dot, 0, 0, 2, 2, 1, 2, None), (dot, 2, 2, 2, 2, 2, 1, 2)]
    got = gif.decode(gif.encode(frames, 4, 4, PALETTE, loops=3))
    shown = [c.copy() for c in got.render()]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert (shown[0] == red).all()
    assert shown[1][1, 1].tolist() == green and shown[1][1, 2].tolist() == red  # transparent keeps what was there
    assert shown[2][1, 1].tolist() == green and shown[2][0, 1].tolist() == blue and shown[2][2, 2].tolist() == red
    assert shown[3][0, 0].tolist() == none and shown[3][2, 3].tolist() == blue and shown[3][2, 2].tolist() == red
    rows = gif.frame_rows(got)
    assert got.loops == 3 and [(r["start_ms"], r["delay_ms"], r["disposal"]) for r in rows] == [(0, 70, 1), (70, 50, 3), (120, 10, 2), (130, 20, 1)]
    assert [sum(r["histogram"]) for r in rows] == [16, 16, 16, 12]
    assert {k: n for k, n in enumerate(rows[1]["histogram"]) if n} == {48: 14, 12: 2}


def test_interlace():
    samples = np.arange(11, dtype=np.uint8).repeat(3)
    data = bytearray(gif.encode([(samples.tobytes(), 0, 0, 3, 11, 0, 0, None)], 3, 11, gif.GREYS, None))
    at = data.index(b"\x2c", 13 + 768)
    data[at + 9] |= 0x40
    order = [*range(0, 11, 8), *range(4, 11, 8), *range(2, 11, 4), *range(1, 11, 2)]
    got = gif.decode(bytes(data)).frames[0].indices[:, 0].tolist()
    assert [got[r] for r in order] == list(range(11))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 40, 200]), st.sampled_from([2, 90, 130, 256]))
def test_store_uses_palettes_transparency_and_disposal(seed, rows, kinds):
    """Repeated rows, so that pixels are right already; the canvas is what is read back."""
    rng = np.random.default_rng(seed)
    payload = rng.integers(0, kinds, (rows, 192)).astype(np.uint8)
    payload[rng.random(rows) < 0.5] = payload[0]
    data = payload.tobytes()
    got = gif.decode(gif.store(data, frame_rows=8))
    assert gif.stored_bytes(got) == data
    assert {f.disposal for f in got.frames} == set(list((1, 2, 3))[: len(got.frames)])
    if kinds < 128:
        assert all(len(f.palette) <= 128 and f.transparent is not None for f in got.frames)
    if rows == 40 and kinds < 200:
        assert any((f.indices == f.transparent).any() for f in got.frames[1:])


def test_too_many_pixels(spark):
    """A small file that asks for a huge canvas, or for many frames, is told before anything is made."""
    huge = bytearray(SMALL)
    huge[6:10] = b"\xff" * 4
    with pytest.raises(ValueError, match="pixels"):
        gif.decode(bytes(huge), gif.MOST_PIXELS)
    df = spark.createDataFrame([(1, bytes(huge)), (2, SMALL)], "id long, m binary")
    one, two = sorted(gif.gif_columns(df, "m").collect(), key=lambda r: r.id)
    assert one.gif_frames is None and "pixels" in one.gif_error and two.gif_width == 16 and two.gif_error is None


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"PNG" * 30, SMALL[:20], SMALL[:30]])
def test_not_a_gif(data):
    with pytest.raises(ValueError):
        gif.decode(data)


def test_cut_stream_keeps_what_it_has():
    got = gif.decode(SMALL[:-10])
    assert got.frames[0].indices.shape == (10, 10) and got.frames[0].indices[0].tolist() == [1] * 5 + [2] * 5


def plain_row(text):
    data = (text or "").encode()
    padded = data + b" " * ((192 - len(data) % 192) % 192 if data else 192)
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = gif.text_media(docs)
    for r in made.collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == plain_row(r.text)
        assert [(f.start_ms, f.delay_ms) for f in r.frames] == [(100 * k, 100) for k in range(len(r.frames))]
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert gif.stored_bytes(gif.decode(bytes(r.media)))[: r.n_bytes] == r.text.encode()
    for r in gif.gif_columns(made, "media", keep=["doc_id", "payload_bytes"]).collect():
        assert r.gif_error is None and r.gif_width == 192
        assert sum(f.height * f.width for f in r.gif_frames) == r.payload_bytes
        assert all(sum(f.histogram) % 192 == 0 for f in r.gif_frames if f.height == r.gif_height)


def test_odd_rows(spark):
    texts = [None, "", "", "x" * 192, "é" * 120000, "a\x00b"]
    df = spark.createDataFrame([(i if i else None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = gif.text_media(df, outputs=("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")).collect()
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == plain_row(texts[r.doc_id or 0])
    assert gif.text_media(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, b"no"), (2, None)], "id long, m binary")
    assert [r.gif_error is not None and r.gif_frames is None for r in gif.gif_columns(bad, "m").collect()] == [True, True]
