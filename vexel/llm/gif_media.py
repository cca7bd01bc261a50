"""GIF media columns: timed frames and colour histograms from GIF bytes.

The LZW code stream is decoded without a loop over its codes. Between two clear codes the code
widths follow from the codes' numbers alone, so codes are cut out of the bit stream many at
once. While the table grows, an entry is a copy of what was put out for an earlier code and one pixel more, so each
pixel either is given or equals an earlier one; following these links by pointer doubling resolves them
in as many steps as the logarithm of the longest chain. Once the table is full, its entries are stretches of
what was put out so far, and further codes are looked up in windows of bounded size until the next clear code. No more codes
are read than an image has pixels, and pixels are handed on in pieces, so memory is bounded by the
band of the canvas being drawn. A canvas above `band_pixels` is drawn and given out in bands of rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import map_arrow, quoted, table

HIST_BINS = 8
#: Pixels of canvas drawn at a time; a larger canvas is drawn in bands of whole rows, one after the other.
BAND_PIXELS = 1 << 23
#: Bytes of frames given out in one Arrow batch, about.
BATCH_BYTES = 64 << 20
#: Pixels decoded at a time.
PIECE = 1 << 18
#: Frames that op1 draws for a page, and the bytes of html that make a pixel of one of them.
FRAMES, BYTES_PER_PIXEL = 3, 6

FRAME_SCHEMA = "frame int, top int, rows int, start_ms int, delay_ms int, width int, height int, disposal int, transparent int, rgba binary, opaque int, hist_r array<int>, hist_g array<int>, hist_b array<int>, error string"


def _schedule(code_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, width) in bits of the codes after a clear code, while the table grows."""
    n = 4096 - (1 << code_size)
    nxt = (1 << code_size) + 2 + np.maximum(0, np.arange(n) - 1)
    width = np.minimum(12, np.maximum(code_size + 1, np.floor(np.log2(nxt)).astype(np.int64) + 1))
    return np.concatenate([[0], np.cumsum(width)[:-1]]), width


_schedules = {k: _schedule(k) for k in range(1, 12)}


def lzw_encode(pixels: bytes, code_size: int) -> bytes:
    """The LZW stream of pixels below 2**code_size, with a clear code at the start and whenever the table is full."""
    clear = 1 << code_size
    out, parts, known, nxt = [], [], {}, clear + 2
    cur = pixels[0] if pixels else -1
    for p in pixels[1:]:
        pair = cur << 8 | p
        if (code := known.get(pair)) is not None:
            cur = code
            continue
        out.append(cur)
        if nxt < 4096:
            known[pair] = nxt
            nxt += 1
        else:
            parts.append([*out, clear])
            out, known, nxt = [], {}, clear + 2
        cur = p
    parts.append([*out, *([cur] if cur >= 0 else []), clear + 1])
    widths = _schedules[code_size][1]
    width = np.concatenate([[code_size + 1], *(widths[: len(x)] for x in parts)])
    code = np.concatenate([[clear], *parts]).astype(np.int64)
    at = np.cumsum(width) - width
    n = (int(at[-1] + width[-1]) + 7) // 8
    code <<= at & 7
    got = sum(np.bincount((at >> 3) + k, (code >> (8 * k)) & 255, n + 3) for k in range(3))
    return got[:n].astype(np.uint8).tobytes()


def lzw_pixels(data: bytes, code_size: int, n_pixels: int, piece: int = PIECE) -> Iterator[np.ndarray]:
    """The first n_pixels indices of an LZW stream, in pieces; fewer if it ends early. ValueError for a code that can't be."""
    clear = 1 << code_size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    total, bit, left = len(data) * 8, 0, n_pixels
    offs, widths = _schedules[code_size]

    def read(at: np.ndarray, width) -> tuple[np.ndarray, int]:
        """(codes, number of them before the next clear or end code)."""
        byte = at >> 3
        got = raw[byte].astype(np.int32) | raw[byte + 1].astype(np.int32) << 8 | raw[byte + 2].astype(np.int32) << 16
        got = (got >> (at & 7).astype(np.int32)) & ((1 << width) - 1)
        stop = np.flatnonzero((got == clear) | (got == clear + 1))
        return got, int(stop[0]) if len(stop) else len(got)

    while left > 0 and bit + code_size + 1 <= total:
        fit = min(int(np.searchsorted(offs + widths, total - bit, "right")), left + 1)
        codes, n = read(bit + offs[:fit], widths[:fit])
        if n:
            text, start, length = _grow(codes[:n], clear, left)
            for s in range(0, len(text), piece):
                yield text[s : s + piece]
            left -= len(text)
        if n < len(codes):
            if codes[n] == clear + 1:
                return
            bit += int(offs[n] + widths[n])
            continue
        if fit < len(offs) or left <= 0:
            return
        bit += int(offs[-1] + widths[-1])  # the table is full and stays as it is until it is cleared
        first = np.arange(4096)
        first[clear + 2 :] = clear + start[: 4094 - clear]
        long = np.ones(4096, np.int64)
        long[clear + 2 :] = length[: 4094 - clear] + 1
        source = np.concatenate([np.arange(clear, dtype=np.uint8), text])
        window = 4096
        while (k := min(window, (total - bit) // 12, left)) > 0:
            codes, n = read(bit + 12 * np.arange(k), 12)
            done = 0
            while done < n and left > 0:
                ends = np.cumsum(long[codes[done : min(n, done + piece)]])
                m = max(1, int(np.searchsorted(ends, min(piece, left), "right")))
                m += m < len(ends) and ends[m - 1] < left <= piece
                c, ends = codes[done : done + m], ends[:m]
                size = long[c]
                yield source[np.repeat(first[c] - ends + size, size) + np.arange(ends[-1])][:left]
                left -= int(min(left, ends[-1]))
                done += m
            bit += 12 * (n + (n < k))
            if n < k:
                if codes[n] == clear + 1:
                    return
                break
            window = min(2 * window, PIECE)
        else:
            return


def lzw_decode(data: bytes, code_size: int, n_pixels: int) -> np.ndarray:
    """lzw_pixels() in one piece."""
    return np.concatenate([np.zeros(0, np.uint8), *lzw_pixels(data, code_size, n_pixels)])


def _grow(codes: np.ndarray, clear: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixels, at most `most`; start and length of each code's) of the codes after a clear code, as long as the table grows."""
    index = np.arange(len(codes), dtype=np.int32)
    entry = codes - (clear + 2)
    copy = entry >= 0
    bad = np.flatnonzero(copy & (entry >= index))
    if len(bad):
        codes, index, entry, copy = (x[: bad[0]] for x in (codes, index, entry, copy))
    parent = np.where(copy, entry, index)
    length, up = 1 + copy.astype(np.int32), parent
    while True:
        nxt = up[up]
        if np.array_equal(nxt, up):
            break
        length = length + length[up] - 1
        up = nxt
    end = np.cumsum(length, dtype=np.int64)
    if len(bad) and (not len(end) or end[-1] < most):
        raise ValueError("LZW code out of range")
    start = end - length
    if end[-1] > most:
        n = int(np.searchsorted(end, most)) + 1
        codes, index, parent, copy = codes[:n], index[:n], parent[:n], copy[:n]
    size = length[: len(codes)]
    owner = np.repeat(index, size)
    pixel = np.arange(len(owner), dtype=np.int32)
    link = np.where(copy[owner], (start[parent] - start[: len(codes)]).astype(np.int32)[owner] + pixel, pixel)
    while True:
        nxt = link[link]
        if np.array_equal(nxt, link):
            break
        link = nxt
    return codes.astype(np.uint8)[owner[link]][:most], start, length


def _blocks(b: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(b) and (n := b[at]):
        parts.append(b[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _histogram(rgba: np.ndarray) -> tuple[int, np.ndarray]:
    seen = rgba[rgba[..., 3] > 0]
    return len(seen), np.stack([np.bincount(seen[:, c] >> 5, minlength=HIST_BINS) for c in range(3)]).astype(np.int32)


def _images(b: bytes) -> tuple[int, int, list[dict], str | None]:
    """(width, height, images with their undecoded data and control values, what is wrong after them)."""
    width, height, packed = struct.unpack("<HHB", b[6:11])
    found: list[dict] = []
    try:
        at, palette = 13, None
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette = np.frombuffer(b, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        disposal, delay, transparent = 0, 0, -1
        while at < len(b) and b[at] != 0x3B:
            if b[at] == 0x21:
                kind = b[at + 1]
                body, at = _blocks(b, at + 2)
                if kind == 0xF9:
                    disposal, delay = body[0] >> 2 & 7, (body[1] | body[2] << 8) * 10
                    transparent = body[3] if body[0] & 1 else -1
                continue
            if b[at] != 0x2C:
                return width, height, found, f"unknown block {b[at]}"
            left, top, w, h, packed = struct.unpack("<HHHHB", b[at + 1 : at + 10])
            at += 10
            colours = palette
            if packed & 0x80:
                n = 2 << (packed & 7)
                colours = np.frombuffer(b, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            if colours is None:
                return width, height, found, "no palette"
            code_size = b[at]
            if not 1 <= code_size <= 8:
                return width, height, found, "bad code size"
            data, at = _blocks(b, at + 1)
            found.append({"left": left, "top": top, "w": w, "h": h, "interlaced": bool(packed & 0x40), "colours": colours, "code_size": code_size, "data": data, "disposal": disposal, "delay": delay, "transparent": transparent})
            disposal, delay, transparent = 0, 0, -1
    except (IndexError, ValueError, struct.error) as e:
        return width, height, found, f"broken: {type(e).__name__}"
    return width, height, found, None if found else "no image"


def _draw(canvas: np.ndarray, first: int, m: dict) -> int:
    """Draws an image into the band of the canvas that begins at row `first`; gives the number of pixels its data has."""
    shown, colour = np.zeros(256, bool), np.zeros(256, "<u4")
    shown[: len(m["colours"])] = True
    if m["transparent"] >= 0:
        shown[m["transparent"]] = False
    colour[: len(m["colours"])] = m["colours"].astype("<u4") @ np.array([1, 1 << 8, 1 << 16], "<u4") + np.uint32(0xFF << 24)
    w, h, at = m["w"], m["h"], 0
    order = np.concatenate([np.arange(y, h, step) for y, step in ((0, 8), (4, 8), (2, 4), (1, 2))]) if m["interlaced"] else np.arange(h)
    order += m["top"] - first
    for px in lzw_pixels(m["data"], m["code_size"], w * h):
        y, x = np.divmod(np.arange(at, at + len(px)), w)
        y, x = order[y], x + m["left"]
        draw = shown[px] & (y >= 0) & (y < canvas.shape[0]) & (x < canvas.shape[1])
        canvas[y[draw], x[draw]] = colour[px[draw]]
        at += len(px)
    return at


def gif_rows(b: bytes | None, band_pixels: int = BAND_PIXELS) -> Iterator[dict]:
    """The frames as they are shown: the canvas after each image, as RGBA bytes, with timing and histograms.

    Not drawn parts and transparent pixels have alpha 0. Disposal 2 clears the image's area
    after its time, disposal 3 brings back what was there before; interlaced images are put in
    order. A frame has one row, but for a canvas above band_pixels, which has one for each band of `rows` rows from `top` on (the
    histograms are the band's, too); a file is decoded once for each band. A broken or cut file gives the frames before the break (of a cut image, the pixels there are) and then
    one row with `error`; null and empty bytes, and a file without an image, give that row only.
    """
    if not b:
        yield {"error": "no data"}
        return
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 13:
        yield {"error": "not a GIF"}
        return
    width, height, images, why = _images(b)
    if not width * height:
        yield {"error": "bad size"}
        return
    step = max(1, band_pixels // width)
    for first in range(0, height if images else 0, step):
        canvas, clock = np.zeros((min(step, height - first), width), "<u4"), 0
        for k, m in enumerate(images):
            area = canvas[max(0, m["top"] - first) : max(0, m["top"] + m["h"] - first), m["left"] : m["left"] + m["w"]]
            before = area.copy() if m["disposal"] == 3 else None
            try:
                cut = _draw(canvas, first, m) < m["w"] * m["h"]
            except ValueError:
                why, images = "broken: ValueError", images[:k]
                break
            opaque, hist = _histogram(canvas.view(np.uint8).reshape(*canvas.shape, 4))
            yield {"frame": k, "top": first, "rows": canvas.shape[0], "start_ms": clock, "delay_ms": m["delay"], "width": width, "height": height, "disposal": m["disposal"], "transparent": m["transparent"], "rgba": canvas.tobytes(), "opaque": opaque, "hist_r": hist[0], "hist_g": hist[1], "hist_b": hist[2]}
            clock += m["delay"]
            if cut:
                why, images = "image data ends early", images[: k + 1]
                break
            if m["disposal"] == 2:
                area[:] = 0
            elif m["disposal"] == 3:
                area[:] = before
    if why:
        yield {"error": why}


def decode_gif(b: bytes | None, band_pixels: int = BAND_PIXELS) -> list[dict]:
    return list(gif_rows(b, band_pixels))


def encode_gif(width: int, height: int, palette: np.ndarray, images: list[dict]) -> bytes:
    """A GIF89a of images given as {pixels (h x w), left, top, delay (1/100 s), disposal, transparent (index or None), interlace, palette (or None)}."""
    bits = max(1, int(len(palette) - 1).bit_length())

    def colours(p: np.ndarray) -> bytes:
        full = np.zeros((1 << max(1, int(len(p) - 1).bit_length()), 3), np.uint8)
        full[: len(p)] = p
        return full.tobytes()

    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | (bits - 1), 0, 0), colours(palette)]
    for m in images:
        px, t, local = m["pixels"], m.get("transparent"), m.get("palette")
        h, w = px.shape
        own = max(1, int(len(local) - 1).bit_length()) if local is not None else bits
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, m.get("disposal", 0) << 2 | (t is not None), m.get("delay", 0), t or 0, 0))
        flags = (0x40 if m.get("interlace") else 0) | (0x80 | (own - 1) if local is not None else 0)
        out.append(struct.pack("<BHHHHB", 0x2C, m.get("left", 0), m.get("top", 0), w, h, flags))
        if local is not None:
            out.append(colours(local))
        if m.get("interlace"):
            px = px[[y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]]
        size = max(2, own)
        data = lzw_encode(px.astype(np.uint8).tobytes(), size)
        out.append(bytes([size]) + b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0")
    return b"".join(out) + b"\x3b"


def frames_of(media: DataFrame, key: str, gif: str) -> DataFrame:
    """A row (key, frame, top, rows, start_ms, delay_ms, width, height, disposal, transparent, rgba, opaque, hist_r, hist_g, hist_b, error) per frame shown, as gif_rows() has them.

    Every row is decoded, repeated ones again; null keys are values like others. Other columns are not looked at, whatever their names;
    a key named like a column of the result gets an underscore. A file of any length and canvas is decoded whole, in bounded memory. Empty in, empty out.
    """
    fields = T._parse_datatype_string(FRAME_SCHEMA).fields
    names, name = [f.name for f in fields], key
    while name in names:
        name += "_"
    d = media.select(quoted(key), F.col(quoted(gif)).cast("binary"))
    kinds = [pa.int32()] * 9 + [pa.binary(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.string()]

    def run(batches):
        for b in batches:
            rows, at, size = [], [], 0

            def batch():
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array([r.get(c) for r in rows], k) for c, k in zip(names, kinds))], names=[name, *names])

            for i, g in enumerate(b.column(1)):
                for r in gif_rows(g.as_py()):
                    rows.append(r)
                    at.append(i)
                    size += len(r.get("rgba") or b"")
                    if size > BATCH_BYTES:
                        yield batch()
                        rows, at, size = [], [], 0
            yield batch()

    return map_arrow(d, run, T.StructType([T.StructField(name, media.schema[key].dataType), *fields]))


def page_gif(html: bytes | None, frames: int = FRAMES) -> bytes:
    """An animated picture of a page's bytes: the tables hold no pictures, so op1's are drawn from the pages.

    The picture has a pixel for BYTES_PER_PIXEL bytes of the whole text, 256 at least, and grows with it. Frame f shows the means over
    equal stretches, turned by f; placement, disposal, transparency, interlacing and palettes vary with the text's hash.
    """
    raw = np.frombuffer(html or b"\0", np.uint8)
    width = max(16, int((len(raw) / BYTES_PER_PIXEL) ** 0.5))
    height = max(16, -(-len(raw) // (BYTES_PER_PIXEL * width)))
    edges = np.arange(width * height + 1) * len(raw) // (width * height)
    acc = np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
    mean = (acc[edges[1:]] - acc[edges[:-1]]) // np.maximum(1, np.diff(edges))
    h = int(tv.mix(np.array([acc[-1] * 1000003 + len(raw)], np.int64).view(tv.U64))[0])
    palette = ((np.arange(48).reshape(16, 3) * (37 + h % 64) + h % 251) % 256).astype(np.uint8)
    images = []
    for f in range(frames):
        g = h >> (8 * f)
        px = (np.roll(mean, f * width) // 4 % 16).reshape(height, width)
        inset = (g % 4) if f else 0
        px = px[inset:, inset:]
        images.append({"pixels": px, "left": inset, "top": inset, "delay": 4 + g % 9, "disposal": (g >> 2) % 4, "transparent": (g >> 4) % 16 if f and g & 1 else None, "interlace": bool(g >> 5 & 1), "palette": palette[::-1] if g >> 6 & 1 else None})
    return encode_gif(width, height, palette, images)


def page_pictures(pages: DataFrame) -> DataFrame:
    """(page_id, gif) of every page, from its html; a null or empty one has a picture, too."""

    def run(batches):
        for b in batches:
            gifs = [page_gif(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gifs, pa.binary())], names=["page_id", "gif"])

    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("gif", T.BinaryType())])
    return map_arrow(pages.select("page_id", F.col("html").cast("binary")), run, schema)


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed frames of every page's picture."""
    return frames_of(page_pictures(table(spark, sf_dir, "pages")), "page_id", "gif")
