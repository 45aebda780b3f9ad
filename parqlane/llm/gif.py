"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

Decoding handles any GIF87a or GIF89a: global and local colour tables, interlace, all disposal
methods, transparent pixels, deferred clears and several frames. A code's width depends only on its
place since the last clear, so a stretch between two clears is unpacked at once by numpy and only
the string table is walked in Python.

Bytes are stored as animations 192 wide. A byte is a colour (three bits of red and green, two of
blue), a frame holds up to ``FRAME_ROWS`` rows with a table of the colours it uses, pixels that show
the right colour already are transparent, and frames are left, cleared or undone in turn. So what is
read back is the canvas, by the rules of palettes, transparency and disposal, and not the samples.

Each row is handled by itself, in bounded batches, without shuffle. Defined cases: null media, media
that isn't a GIF, or pictures of more than ``MOST_PIXELS`` in all give null columns and an error text;
null text counts as empty; a frame cut short keeps the pixels it has, the rest are index 0; repeated
rows repeat; columns named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from parqlane.llm.common import map_columns

WIDTH, FRAME_ROWS, DELAY = 192, 64, 10
#: Pixels of the canvas and of all frames of a foreign GIF: a header can ask for far more than its file holds.
MOST_PIXELS = 1 << 26
BINS = 4  # of each colour channel in a histogram
MOST = 4096  # Fixed by the format: codes have up to 12 bits.


def _code_widths(least: int, n: int = MOST) -> np.ndarray:
    """Width in bits of the n codes after a clear."""
    free = (1 << least) + 2 + np.arange(n)  # entries in the table before code k is read, but one
    return np.clip(np.ceil(np.log2(free)).astype(np.int64), least + 1, 12)


def _regions(widths: np.ndarray) -> list[tuple[int, int | None]]:
    """(width, codes of that width) since a clear; the last width has no end."""
    sizes, counts = np.unique(widths, return_counts=True)
    return [(int(s), int(c) if s < 12 else None) for s, c in zip(sizes, counts)]


_WIDTHS = {least: _code_widths(least) for least in range(2, 12)}
_REGIONS = {least: _regions(w) for least, w in _WIDTHS.items()}


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    """The code stream of samples below 2 ** least, without its length bytes."""
    clear = 1 << least
    stretches, codes, table, free = [[clear]], [], {}, clear + 2
    get, emit = table.get, codes.append
    if samples:
        prefix = samples[0]
        for sample in memoryview(samples)[1:]:
            key = prefix << 8 | sample
            longer = get(key)
            if longer is not None:
                prefix = longer
                continue
            emit(prefix)
            prefix = sample
            if free < MOST:
                table[key] = free
                free += 1
            else:
                emit(clear)
                stretches.append(codes)
                table, codes, free = {}, [], clear + 2
                get, emit = table.get, codes.append
        emit(prefix)
    emit(clear + 1)
    stretches.append(codes)
    all_codes = np.concatenate([np.array(c, np.uint16) for c in stretches])
    widths = np.concatenate([_WIDTHS[least][: len(c)] for c in stretches])
    places = np.arange(12)
    bits = (all_codes[:, None] >> places.astype(np.uint16)).astype(np.uint8) & 1
    return np.packbits(bits[places < widths[:, None]], bitorder="little").tobytes()


def _unpack(bits: np.ndarray, at: int, least: int) -> tuple[list[int], int]:
    """Codes from bit ``at`` to the next clear or end, that one included, and the bit after it."""
    clear, out = 1 << least, []
    for size, left in _REGIONS[least]:
        while left is None or left:
            n = min((len(bits) - at) // size, MOST if left is None else left)
            if not n:
                return out, len(bits)
            wide = np.zeros((n, 16), np.uint8)
            wide[:, :size] = bits[at : at + n * size].reshape(n, size)
            codes = np.packbits(wide, axis=1, bitorder="little").view("<u2")[:, 0]
            stop = np.flatnonzero(codes >> 1 == clear >> 1)
            if len(stop):
                n = int(stop[0]) + 1
                return out + codes[:n].tolist(), at + n * size
            out += codes.tolist()
            at += n * size
            left = left and left - n
    return out, len(bits)


def lzw_decode(data: bytes, least: int, wanted: int) -> bytes:
    """Up to ``wanted`` samples of a code stream; stops at the end code, bad codes or the data's end."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    clear, at, out, had = 1 << least, 0, [], 0
    single = [bytes((i,)) if i < 256 else b"" for i in range(clear)] + [b"", b""]
    while at < len(bits) and had < wanted:
        codes, at = _unpack(bits, at, least)
        ended = bool(codes) and codes[-1] == clear + 1
        if codes and codes[-1] in (clear, clear + 1):
            codes.pop()
        if codes:
            table = list(single)
            if codes[0] >= clear:
                break
            last = table[codes[0]]
            piece = [last]
            free, add, keep = clear + 2, table.append, piece.append
            for code in codes[1:]:
                if code < free:
                    entry = table[code]
                elif code == free and free < MOST:
                    entry = last + last[:1]
                else:
                    ended = True
                    break
                keep(entry)
                if free < MOST:
                    add(last + entry[:1])
                    free += 1
                last = entry
            joined = b"".join(piece)
            had += len(joined)
            out.append(joined)
        if ended:
            break
    return b"".join(out)[:wanted]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    indices: np.ndarray


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    loops: int | None = None
    frames: list[Frame] = field(default_factory=list)

    def render(self):
        """The canvas, RGBA, as shown with each frame."""
        canvas = np.zeros((self.height, self.width, 4), np.uint8)
        for f in self.frames:
            before = canvas.copy() if f.disposal == 3 else None
            rows, columns = slice(f.top, f.top + f.height), slice(f.left, f.left + f.width)
            area = canvas[rows, columns]
            shown = f.indices[: area.shape[0], : area.shape[1]]
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(f.palette), :3], colours[: len(f.palette), 3] = f.palette, 255
            if f.transparent is None:
                area[:] = colours[shown]
            else:
                seen = shown != f.transparent
                area[seen] = colours[shown[seen]]
            yield canvas
            if f.disposal == 2:
                canvas[rows, columns] = 0
            elif f.disposal == 3:
                canvas = before


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _colours(data: bytes, at: int, packed: int):
    n = 2 << (packed & 7)
    if at + 3 * n > len(data):
        raise ValueError("the colour table is cut short")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


#: Fixed by the format: first row and step of the four interlaced passes.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def decode(data: bytes, most_pixels: int | None = None) -> Gif:
    """Parse a GIF and decode all frames; ValueError if it isn't one or holds more pixels."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette, pixels = 13, None, width * height
    if packed & 0x80:
        palette, at = _colours(data, at, packed)
    gif = Gif(width, height, background, palette)
    control = (0, 0, None)
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                flags, delay, index = struct.unpack_from("<BHB", body)
                control = (flags >> 2 & 7, delay, index if flags & 1 else None)
            elif label == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14:
                gif.loops = struct.unpack_from("<H", body, 12)[0]
            continue
        if kind != 0x2C or at + 11 > len(data):
            raise ValueError(f"unknown or cut block at byte {at}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at, own, pixels = at + 10, palette, pixels + w * h
        if most_pixels is not None and pixels > most_pixels:
            raise ValueError(f"more than {most_pixels} pixels")
        if packed & 0x80:
            own, at = _colours(data, at, packed)
        if own is None:
            own = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
        least = data[at] if at < len(data) else 0
        if not 2 <= least <= 11:
            raise ValueError("bad code size")
        stream, at = _blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
        indices = np.zeros(w * h, np.uint8)
        indices[: len(samples)] = samples
        indices = indices.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in PASSES])
            woven = np.empty_like(indices)
            woven[order] = indices
            indices = woven
        gif.frames.append(Frame(left, top, w, h, control[1], control[0], control[2], own, indices))
        control = (0, 0, None)
    if not gif.frames:
        raise ValueError("no frame")
    return gif


def encode(frames, width: int, height: int, palette: bytes, loops: int | None = 0) -> bytes:
    """A GIF89a; frames: (samples, left, top, width, height, delay, disposal, transparent or None) and,
    where a frame has a colour table of its own, that. Tables hold 2, 4, ... or 256 colours."""
    bits = lambda table: (len(table) // 3 - 1).bit_length() - 1  # noqa: E731  as the format has it, one less
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | bits(palette), 0, 0), palette]
    if loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for samples, left, top, w, h, delay, disposal, transparent, *own in frames:
        flags = disposal << 2 | (transparent is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, delay, transparent or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, w, h, 0x80 | bits(own[0]) if own else 0) + (own[0] if own else b""))
        least = max(2, bits(own[0] if own else palette) + 1)
        stream = lzw_encode(samples, least)
        out.append(bytes((least,)))
        out += [bytes((len(part),)) + part for k in range(0, len(stream), 255) if (part := stream[k : k + 255])]
        out.append(b"\0")
    return b"".join([*out, b";"])


#: The colour of each byte: bits 7 to 5 are red, 4 to 2 green, 1 and 0 blue.
CUBE = np.array([((v >> 5) * 36, (v >> 2 & 7) * 36, (v & 3) * 85) for v in range(256)], np.uint8)
GREYS = bytes(v for v in range(256) for _ in range(3))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of 192, and the length without them."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % WIDTH or (WIDTH if not data else 0)), len(data)


def store(payload: bytes, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """Lossless: the canvas shows each byte's colour while the frame of its row is on."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    shown = np.full((min(len(samples), frame_rows), WIDTH), -1, np.int16)  # bytes on the canvas; -1: nothing
    frames = []
    for k, top in enumerate(range(0, len(samples), frame_rows)):
        part = samples[top : top + frame_rows]
        area, disposal = shown[: len(part)], 1 + k % 3
        used = np.flatnonzero(np.bincount(part.ravel(), minlength=256))
        index, own, clear = np.arange(256, dtype=np.uint8), (), None
        if len(used) < 128:  # a table of these colours and a transparent one
            index[used] = np.arange(len(used))
            table = np.zeros((1 << len(used).bit_length(), 3), np.uint8)
            table[: len(used)] = CUBE[used]
            own, clear = (table.tobytes(),), len(used)
        elif len(used) < 256:
            clear = int(np.setdiff1d(np.arange(256), used)[0])
        same, indices = area == part, index[part]
        if clear is not None:
            indices[same] = clear
        frames.append((indices.tobytes(), 0, 0, WIDTH, len(part), delay, disposal, clear, *own))
        before = area.copy()
        area[:] = -1 if disposal == 2 else before if disposal == 3 else part
    return encode(frames, WIDTH, len(shown), CUBE.tobytes(), 0 if len(frames) > 1 else None)


def bytes_of(frame: Frame, canvas: np.ndarray) -> bytes:
    """The bytes whose colours stand in the frame's place while it is shown."""
    area = canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
    return (area[..., 0] // 36 << 5 | area[..., 1] // 36 << 2 | area[..., 2] // 85).tobytes()


def stored_bytes(gif: Gif) -> bytes:
    """What store() was given, from the pictures shown one after another."""
    return b"".join(bytes_of(f, canvas) for f, canvas in zip(gif.frames, gif.render(), strict=True))


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour, BINS bins a channel."""
    seen = canvas[canvas[..., 3] > 0] if not canvas[..., 3].all() else canvas.reshape(-1, 4)
    step = 256 // BINS
    place = (seen[:, 0] // step).astype(np.int64) * BINS * BINS + seen[:, 1] // step * BINS + seen[:, 2] // step
    return np.bincount(place, minlength=BINS**3)


FRAME_TYPE = (
    "array<struct<start_ms:long,delay_ms:long,disposal:int,left:int,top:int,width:int,height:int,histogram:array<long>>>"
)


def _frame_row(f: Frame, canvas: np.ndarray, start: int) -> dict:
    place = {"start_ms": start, "delay_ms": 10 * f.delay, "disposal": f.disposal, "left": f.left, "top": f.top}
    return place | {"width": f.width, "height": f.height, "histogram": histogram(canvas).tolist()}


def frame_rows(gif: Gif) -> list[dict]:
    out, start = [], 0
    for f, canvas in zip(gif.frames, gif.render(), strict=True):
        out.append(_frame_row(f, canvas, start))
        start += 10 * f.delay
    return out


def gif_columns(docs: DataFrame, media_col: str, keep=None, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """docs' ``keep`` columns (default: all), gif_width, gif_height, gif_loops, gif_frames, gif_error.

    gif_frames: each frame's time, place, disposal and the colour histogram of the picture shown.
    """

    def make():
        def work(media):
            rows = []
            for data in media:
                try:
                    if data is None:
                        raise ValueError("no media")
                    gif = decode(bytes(data), most_pixels)
                    rows.append((gif.width, gif.height, gif.loops, frame_rows(gif), None))
                except ValueError as why:
                    rows.append((None, None, None, None, str(why)))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)]

        return work

    fields = [("gif_width", "int"), ("gif_height", "int"), ("gif_loops", "int"), ("gif_frames", FRAME_TYPE), ("gif_error", "string")]
    return map_columns(docs, [media_col], make, fields, keep)


def feature_of(rows: list[dict]) -> str:
    """Frames, total time and, over all frames, pixels in each bin that has some."""
    total = np.sum([r["histogram"] for r in rows], axis=0)
    bins = ",".join(f"{k}:{total[k]}" for k in np.flatnonzero(total))
    return f"frames={len(rows)};ms={sum(r['delay_ms'] for r in rows)};bins={bins}"


TEXT_MEDIA = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long",
    "media_sha256": "string", "feature": "string", "frames": FRAME_TYPE, "media": "binary",
}


def text_media(docs: DataFrame, text_col: str = "text", keep=None, outputs=tuple(TEXT_MEDIA)) -> DataFrame:
    """docs' ``keep`` columns (default: all) and ``outputs`` of each text stored as a GIF.

    media: the GIF; frames: its timed frames with their colour histograms, as in ``gif_columns``. The
    payload's columns, the feature and the frames come from the GIF decoded again.
    """

    def make():
        def work(texts):
            made = {k: [] for k in outputs}
            for text in texts:
                payload, n = payload_of(text)
                media = store(payload)
                gif, parts, rows = decode(media), [], []
                for f, canvas in zip(gif.frames, gif.render(), strict=True):
                    parts.append(bytes_of(f, canvas))
                    rows.append(_frame_row(f, canvas, sum(r["delay_ms"] for r in rows[-1:]) + (rows[-1]["start_ms"] if rows else 0)))
                back = b"".join(parts)
                row = {
                    "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(),
                    "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(rows), "frames": rows, "media": media,
                }
                for k, column in made.items():
                    column.append(row[k])
            return list(made.values())

        return work

    return map_columns(docs, [text_col], make, [(k, TEXT_MEDIA[k]) for k in outputs], keep)
