import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import gif_media as g
from vexel.llm.common import table


def slow_lzw(data, code_size, n):
    """The decoder as the format's text has it: one code after another."""
    clear, out = 1 << code_size, []
    bits = "".join(format(x, "08b")[::-1] for x in data)
    at, width, entries, prev = 0, code_size + 1, None, None
    while at + width <= len(bits) and len(out) < n:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            entries, width, prev = [bytes([i]) for i in range(clear)] + [b"", b""], code_size + 1, None
            continue
        if code == clear + 1:
            break
        if entries is None:
            entries = [bytes([i]) for i in range(clear)] + [b"", b""]
        if prev is None:
            s = entries[code]
        else:
            s = entries[code] if code < len(entries) else prev + prev[:1]
            if len(entries) < 4096:
                entries.append(prev + s[:1])
                if len(entries) == 1 << width and width < 12:
                    width += 1
        out += s
        prev = s
    return bytes(out[:n])


@pytest.mark.parametrize("code_size", [2, 3, 4, 7, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 100, 5000, 60000])
def test_lzw_round_trip(code_size, n):
    rng = np.random.default_rng(n + code_size)
    for px in (np.zeros(n, int), rng.integers(0, 1 << code_size, n), np.arange(n) // 7 % (1 << code_size), (np.arange(n) % 3 == 0).astype(int)):
        px = px.astype(np.uint8).tobytes()
        data = g.lzw_encode(px, code_size)
        assert g.lzw_decode(data, code_size, n).tobytes() == px
        assert slow_lzw(data, code_size, n) == px


def slow_frames(width, height, palette, images):
    canvas = [[(0, 0, 0, 0)] * width for _ in range(height)]
    out = []
    for m in images:
        before = [row[:] for row in canvas]
        colours = palette if m.get("palette") is None else m["palette"]
        for y, row in enumerate(m["pixels"]):
            for x, p in enumerate(row):
                yy, xx = y + m.get("top", 0), x + m.get("left", 0)
                if p != m.get("transparent") and yy < height and xx < width:
                    canvas[yy][xx] = (*(int(v) for v in colours[p]), 255)
        out.append([row[:] for row in canvas])
        if m.get("disposal") == 2:
            for y in range(m["pixels"].shape[0]):
                for x in range(m["pixels"].shape[1]):
                    if y + m.get("top", 0) < height and x + m.get("left", 0) < width:
                        canvas[y + m.get("top", 0)][x + m.get("left", 0)] = (0, 0, 0, 0)
        elif m.get("disposal") == 3:
            canvas = before
    return out


def test_frames_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        w, h = rng.integers(1, 24, 2)
        palette = rng.integers(0, 256, (int(rng.integers(2, 17)), 3)).astype(np.uint8)
        images, clock = [], 0
        for _ in range(int(rng.integers(1, 5))):
            left, top = int(rng.integers(0, w)), int(rng.integers(0, h))
            shape = (int(rng.integers(1, h - top + 1)), int(rng.integers(1, w - left + 1)))
            images.append({"pixels": rng.integers(0, len(palette), shape), "left": left, "top": top, "delay": int(rng.integers(0, 50)), "disposal": int(rng.integers(0, 4)), "transparent": int(rng.integers(0, len(palette))) if rng.random() < 0.5 else None, "interlace": bool(rng.random() < 0.5), "palette": rng.integers(0, 256, (8, 3)).astype(np.uint8) if rng.random() < 0.3 and len(palette) <= 8 else None})
        got = g.decode_gif(g.encode_gif(int(w), int(h), palette, images))
        want = slow_frames(w, h, palette, images)
        assert len(got) == len(want)
        for a, b, m in zip(got, want, images):
            flat = np.array(b, np.uint8).reshape(-1, 4)
            assert a["rgba"] == flat.tobytes() and a["start_ms"] == clock and a["delay_ms"] == m["delay"] * 10
            clock += m["delay"] * 10
            seen = flat[flat[:, 3] > 0]
            assert a["opaque"] == len(seen)
            for c, name in enumerate(("hist_r", "hist_g", "hist_b")):
                assert list(a[name]) == [int(((seen[:, c] >= 32 * i) & (seen[:, c] < 32 * i + 32)).sum()) for i in range(8)]


def test_broken_files():
    good = g.page_gif(b"some page " * 50)
    whole = g.decode_gif(good)
    assert len(whole) == g.FRAMES and all("error" not in f for f in whole)
    for bad in (None, b"", b"GIF89a", b"PNG" + good, b"GIF89a\0\0\0\0\0\0\0"):
        assert [f for f in g.decode_gif(bad)] == [{"error": g.decode_gif(bad)[0]["error"]}]
    for n in range(13, len(good)):
        got = g.decode_gif(good[:n])
        assert all("error" not in f for f in got[:-1])
    rng = np.random.default_rng(0)
    for _ in range(300):
        b = bytearray(good)
        for at in rng.integers(6, len(b), 4):
            b[at] = rng.integers(0, 256)
        g.decode_gif(bytes(b))


def test_deferred_clear_codes():
    """A table that stays full: further codes are looked up in it, over many windows."""
    rng = np.random.default_rng(2)
    px = np.concatenate([rng.integers(0, 4, 9000), np.tile([0, 1, 2, 3, 3, 1], 20_000)]).astype(np.uint8)
    words, out, text = {bytes([i]): i for i in range(4)}, [4], px.tobytes()
    at, nxt, width, acc, n = 0, 6, 3, 4, 3
    while at < len(text):
        size = 1
        while text[at : at + size + 1] in words and at + size < len(text):
            size += 1
        acc |= words[text[at : at + size]] << n
        n += width
        if nxt < 4096 and at + size < len(text):
            words[text[at : at + size + 1]] = nxt
            nxt += 1
            if nxt > 1 << width and width < 12:
                width += 1
        at += size
    acc |= 5 << n
    data = acc.to_bytes((n + width + 7) // 8, "little")
    assert slow_lzw(data, 2, len(px)) == px.tobytes()
    assert g.lzw_decode(data, 2, len(px)).tobytes() == px.tobytes()
    for k in (1, 8000, 9001, 50_000, len(px) - 1):
        pieces = list(g.lzw_pixels(data, 2, k, piece=1000))
        assert np.concatenate(pieces).tobytes() == px[:k].tobytes() and max(map(len, pieces)) <= 5096


def test_noise_takes_time_in_proportion_and_no_more_is_decoded_than_asked_for():
    import time
    import tracemalloc

    rng = np.random.default_rng(0)
    data = {k: g.lzw_encode(rng.integers(0, 256, k * k, dtype=np.uint8).tobytes(), 8) for k in (256, 1024)}
    took = {}
    for k, d in data.items():
        t = time.process_time()
        assert len(g.lzw_decode(d, 8, k * k)) == k * k
        took[k] = time.process_time() - t
    assert took[1024] < 1.5 and took[1024] < 60 * took[256] + 0.2
    bomb = g.lzw_encode(bytes(1 << 24), 2)
    tracemalloc.start()
    assert len(g.lzw_decode(bomb, 2, 256)) == 256
    assert tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()


def test_a_large_canvas_comes_in_bands():
    rng = np.random.default_rng(4)
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    images = [{"pixels": rng.integers(0, 16, (50, 40)), "left": 3 * k, "top": 7 * k, "delay": 5, "disposal": k + 1, "transparent": 3, "interlace": k == 1} for k in range(3)]
    b = g.encode_gif(60, 70, palette, images)
    whole, bands = g.decode_gif(b), g.decode_gif(b, band_pixels=60 * 9 + 5)
    assert len(whole) == 3 and len(bands) == 24 and {r["rows"] for r in bands} == {9, 7}
    for k, f in enumerate(whole):
        mine = [r for r in bands if r["frame"] == k]
        assert b"".join(r["rgba"] for r in mine) == f["rgba"] and (sum(r["hist_g"] for r in mine) == f["hist_g"]).all() and {r["start_ms"] for r in mine} == {f["start_ms"]}
    cut = g.decode_gif(b[: len(b) * 2 // 3], band_pixels=60 * 9)
    assert [r for r in cut if "error" in r] == [cut[-1]] and b"".join(r["rgba"] for r in cut[:-1] if r["frame"] == 0) == whole[0]["rgba"]
    big = g.decode_gif(b[:6] + b"\x28\x23\x28\x23" + b[10:])  # 9000 x 9000
    assert len(big) == 3 * 10 and sum(len(r["rgba"]) for r in big) == 3 * 4 * 9000**2


def slow_gif(b):
    """A GIF read byte by byte: (delay, disposal, transparent, RGBA bytes) of each frame."""
    width, height = b[6] | b[7] << 8, b[8] | b[9] << 8
    n = 2 << (b[10] & 7)
    main, at = [tuple(b[13 + 3 * i : 16 + 3 * i]) for i in range(n)], 13 + 3 * n
    canvas, out = [[(0, 0, 0, 0)] * width for _ in range(height)], []
    while b[at] != 0x3B:
        assert b[at : at + 3] == b"\x21\xf9\x04"
        flags, delay, clear = b[at + 3], b[at + 4] | b[at + 5] << 8, b[at + 6]
        at += 8
        left, top, w, h, packed = (*(b[at + k] | b[at + k + 1] << 8 for k in (1, 3, 5, 7)), b[at + 9])
        at += 10
        colours = main
        if packed & 128:
            k = 2 << (packed & 7)
            colours, at = [tuple(b[at + 3 * i : at + 3 * i + 3]) for i in range(k)], at + 3 * k
        size, data = b[at], b""
        at += 1
        while b[at]:
            data, at = data + b[at + 1 : at + 1 + b[at]], at + 1 + b[at]
        at += 1
        px = slow_lzw(data, size, w * h)
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)] if packed & 64 else range(h)
        before = [row[:] for row in canvas]
        for k, y in enumerate(order):
            for x in range(w):
                p = px[k * w + x]
                if not (flags & 1 and p == clear):
                    canvas[top + y][left + x] = (*colours[p], 255)
        out.append((delay * 10, flags >> 2 & 7, clear if flags & 1 else -1, bytes(v for row in canvas for p in row for v in p)))
        if flags >> 2 & 7 == 2:
            for y in range(top, top + h):
                canvas[y][left : left + w] = [(0, 0, 0, 0)] * w
        elif flags >> 2 & 7 == 3:
            canvas = before
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {}
    for r in g.op1_gif_media(spark, sf).collect():
        got[r.page_id, r.frame] = r
    pages = table(spark, sf, "pages").select("page_id", "html").collect()
    assert len(got) == len(pages) * g.FRAMES
    for p in pages:
        clock = 0
        for k, (delay, disposal, clear, rgba) in enumerate(slow_gif(g.page_gif(p.html.encode()))):
            r = got[p.page_id, k]
            assert (r.start_ms, r.delay_ms, r.disposal, r.transparent, bytes(r.rgba)) == (clock, delay, disposal, clear, rgba) and r.error is None and r.top == 0
            seen = np.frombuffer(rgba, np.uint8).reshape(-1, 4)
            seen = seen[seen[:, 3] > 0]
            assert r.opaque == len(seen) and all(h == np.histogram(seen[:, c], 8, (0, 256))[0].tolist() for c, h in enumerate((r.hist_r, r.hist_g, r.hist_b)))
            clock += delay
    assert max(r.width * r.height for r in got.values()) > 2000


def test_nulls_repeats_names_and_empty(spark):
    good = bytearray(g.page_gif(b"x"))
    d = spark.createDataFrame([(1, good, 5, 0), (1, good, 6, 0), (None, good, 7, 0), (2, None, 8, 0), (3, bytearray(b""), 9, 0)], "`k.k` long, gif binary, frame int, rgba int")
    got = g.frames_of(d, "k.k", "gif").collect()
    assert len(got) == 3 * g.FRAMES + 2 and sum(r.error is not None for r in got) == 2
    assert g.frames_of(d, "frame", "gif").columns[:2] == ["frame_", "frame"] and g.frames_of(d, "frame", "gif").count() == len(got)
    assert g.frames_of(d.limit(0), "frame", "gif").count() == 0
    long = g.decode_gif(g.page_gif(b"a long page " * 200_000))
    assert len(long) == g.FRAMES and long[0]["width"] * long[0]["height"] >= 400_000
