import json
import stat
import struct
import threading
import time
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.sources import images, ocr


def page(height=60, width=80):
    out = np.full((height, width), 255, dtype=np.uint8)
    for y in range(8, height - 8, 8):
        out[y : y + 3, 6 : width - 6] = 0
    return out


def test_image_files_round_trip():
    gray, color = page(), np.random.default_rng(0).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (images.read_png(images.write_png(gray)) == gray).all() and (images.read_png(images.write_png(color)) == color).all()
    pnm = b"P5\n# a comment\n80 60\n255\n" + gray.tobytes() + b"P6 5 7 255\n" + color.tobytes()
    assert [f.shape for f in images.frames(pnm)] == [(60, 80), (7, 5, 3)]
    rows = b"".join(color[y, :, ::-1].tobytes().ljust(16, b"\0") for y in reversed(range(7)))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 7, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (images.frames(bmp)[0] == color).all()
    with pytest.raises(ValueError):
        images.frames(b"nothing")


def test_png_filters():
    rng = np.random.default_rng(1)
    want, rows, above = rng.integers(0, 256, (5, 12)).astype(np.int64), b"", np.zeros(12, dtype=np.int64)
    for kind, line in enumerate(want):
        left, corner = np.concatenate(([0] * 3, line[:-3])), np.concatenate(([0] * 3, above[:-3]))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (np.zeros(12, dtype=np.int64), left, above, (left + above) // 2, paeth)[kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (images.frames(raw)[0].reshape(5, 12) == want).all()


def tiff(pages):
    out, at = b"II*\0" + struct.pack("<I", 8), 8
    for k, p in enumerate(pages):
        tags = [(256, 4, 1, p.shape[1]), (257, 4, 1, p.shape[0]), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, at + 2 + 12 * 8 + 4), (277, 3, 1, 1), (279, 4, 1, p.size)]
        body = struct.pack("<H", 8) + b"".join(struct.pack("<HHII", *t) for t in tags)
        at += len(body) + 4 + p.size
        out += body + struct.pack("<I", at if k < len(pages) - 1 else 0) + p.tobytes()
    return out


def test_every_frame_of_a_tiff_is_a_page():
    engine = images.image_engine(lambda image: f"{image.shape[0]}x{image.shape[1]}")
    assert engine(tiff([page(), page(40, 50)])) == ["60x80", "40x50"]
    assert engine(b"broken") == ["1x1"]


@pytest.mark.parametrize("angle", [-12.0, -4.0, 3.0, 20.0])
def test_skew_is_found_and_undone(angle):
    turned = images.rotated(images.scaled(page(90, 200), 2), angle)
    assert abs(images.skew(turned) + angle) < 1.0
    assert abs(images.skew(images.deskewed(turned))) < 1.0
    assert images.skew(np.full((30, 30), 255, dtype=np.uint8)) == 0.0
    straight = page()
    assert images.deskewed(straight) is straight


def test_preparation():
    noisy = page().copy()
    noisy[2, 40] = 0
    ready = images.prepared_invoice(noisy)
    assert ready.shape == (56, 76) and set(np.unique(ready)) == {0, 255} and ready[0, 38] == 255
    card = images.frames(images.prepared_card(images.write_png(page(20, 600))))[0]
    assert card.shape == (40, images.LEAST_WIDTH) and (card < 128).any() and (card > 128).any()
    assert images.prepared_card(b"broken") == b"broken"
    flat = np.full((40, 40), 100, dtype=np.uint8)
    assert (images.denoised(flat) == 100).all() and images.equalized(np.tile(np.arange(90, 130, dtype=np.uint8), (40, 1))).std() > 12


def test_regions_and_bands():
    assert [r.shape for r in images.regions(np.zeros((140, 100), dtype=np.uint8))] == [(203, 260), (227, 280), (100, 296), (84, 353)]
    assert len(images.regions(np.zeros((100, 100), dtype=np.uint8))) == 4 and not images.regions(np.zeros((125, 100), dtype=np.uint8))
    assert [b.shape[0] for b in images.bands(np.zeros((101, 3)))] == [30, 40, 31]
    text = ocr.banded_reading(np.zeros((10, 4), dtype=np.uint8), lambda image, mode: f"{mode}:{image.shape[0]}")
    assert text.splitlines() == [ocr.BANNERS[0], "6:3", "6:4", "6:3", ocr.BANNERS[1], "11:3", "11:4", "11:3"]


def test_best_reading_and_time_limits():
    seen = []

    def engine(image, mode):
        seen.append((image.shape, mode))
        return f"{mode} {'x' * image.shape[0]}"

    assert ocr.best_reading(page(), engine, len) == "11 " + "x" * 120 and len(seen) == 9
    assert ocr.best_reading(page(), lambda image, mode: "only gray" if image.shape == (60, 80) and mode == 6 else "", len) == "only gray"
    slow = lambda image, mode: time.sleep(0.2) or "late"
    assert ocr.within(0.01, slow, page(), 6) == ("", True) and ocr.best_reading(page(), slow, len, 0.05, 0.01) == ""
    assert ocr.within(1.0, lambda image, mode: 1 / 0, page(), 6) == ("", False)


def test_card_readings_leave_blank_ones_out():
    texts = ocr.card_readings(images.write_png(page(30, 1200)), lambda image, mode: "" if mode is None else f"{mode} {image.shape[0]}")
    assert len(texts) == 4 + 12 and texts[0] == "4 30"


def test_fallback_by_mode():
    good, bad = (lambda image: "text"), (lambda image: 1 / 0)
    assert ocr.with_fallback(page(), "hybrid", bad, good) == ("text", "local", 0.75)
    assert ocr.with_fallback(page(), "hybrid", lambda image: ("far", 0.9), good) == ("far", "remote", 0.9)
    assert ocr.with_fallback(page(), "paddle", bad, good) == (None, None, None)
    assert ocr.with_fallback(page(), "tesseract", good, lambda image: " ") == (None, None, None)


def test_remote_engine():
    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"text": f"{len(body['image']) > 20}"} if self.path == "/ok" else {}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert ocr.remote_engine(f"{url}/ok")(page()) == ("True", 0.85)
    assert ocr.with_fallback(page(), "hybrid", ocr.remote_engine(f"{url}/wrong"), lambda image: "local")[1] == "local"
    server.shutdown()


def test_pdf_pages_are_drawn_in_order(tmp_path):
    program = tmp_path / "draw"
    program.write_text("#!/bin/sh\nshift 2\ncat \"$1\" >/dev/null || exit 3\nfor k in 1 2 10; do printf 'P5 %s 1 255\\n' $k > \"$2-$k.pgm\"; head -c $k /dev/zero >> \"$2-$k.pgm\"; done\n")
    program.chmod(program.stat().st_mode | stat.S_IEXEC)
    assert [p.shape[1] for p in ocr.page_images(b"%PDF", (str(program),))] == [1, 2, 10]
    assert ocr.pdf_engine(lambda image: str(image.shape[1]), command=(str(program),))(b"%PDF") == ["1", "2", "10"]
    program.write_text("#!/bin/sh\necho broken file >&2; exit 1\n")
    with pytest.raises(RuntimeError, match="broken file"):
        ocr.page_images(b"x", (str(program),))
    assert [ocr.page_number(n) for n in ("output-12.png", "output.png")] == [12, 0]


def test_text_scores(spark):
    good = "Tax Invoice\nInvoice No 12\nGSTIN 27AAPFU0939F1ZV\nDate 01/02/2024\nDescription HSN Qty Rate Amount\n1,500.00"
    rows = [(1, good), (2, "?? ~~ ..\n; ; ;\nok"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r for r in df.select("id", ocr.reading_score(F.col("t")).alias("score"), ocr.garbage_lines(F.col("t")).alias("bad"), ocr.keyword_count(F.lower("t"), "in").alias("n"), ocr.engine_mode(F.col("t")).alias("mode")).collect()}
    assert got[1].score > 100 > 0 > got[2].score and (got[1].bad, got[2].bad, got[3].bad, got[4].bad) == (0, 3, 0, 0)
    assert got[1].n == good.lower().count("in") and {r.mode for r in got.values()} == {"hybrid"}
    modes = spark.createDataFrame([(" Paddle ",), ("TESSERACT",), ("x",), (None,)], "t string").select(ocr.engine_mode(F.col("t"))).collect()
    assert [m[0] for m in modes] == ["paddle", "tesseract", "hybrid", "hybrid"]
    assert [r[0] for r in df.select(ocr.medical_page(F.col("t"))).collect()][2:] == ["", ""]
