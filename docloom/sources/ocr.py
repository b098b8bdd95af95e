"""Recognition around engines that the caller gives: passes, fallbacks, time limits, and what makes one text better.

An engine is a function from an image to text, or from (image, mode) to text. Engines run inside Arrow batches of page
rows; a page's failure or time-out is a row's own, never the job's.
"""

from __future__ import annotations

import base64
import json
import re
import subprocess
import tempfile
import time
import urllib.request
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from pathlib import Path

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions.text import as_text, clean_invoice_text, clean_medical_text, correct_medical_text
from docloom.functions.values import AMOUNT, invoice_date_candidates
from docloom.sources import images

# --- Fixed values: what tells a good reading, page modes, and limits in seconds. ---
KEYWORD_POINTS = {
    "invoice": 10, "invoice no": 20, "dated": 12, "gstin": 15, "bill to": 10, "ship to": 10, "amount": 6, "hsn": 8, "qty": 7, "quantity": 7, "rate": 5,
    "medical certificate": 18, "recommended for leave": 22, "communication of leave": 18, "absence from duty": 22, "with effect from": 16,
    "advised rest": 18, "fitness to return to duty": 10, "fit to resume duty": 10, "medical officer": 8,
}
TABLE_POINTS, GSTIN_POINTS, DATE_POINTS, AMOUNT_POINTS, GARBAGE_POINTS = 24, 35, 8, 1.5, 6
GSTIN = r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
INVOICE_MODES, CARD_MODES, REGION_MODES, FALLBACK_MODE = (11, 6, 4), (None, 4, 11), (6, 4, 11), 6
PAGE_SECONDS, ATTEMPT_SECONDS, FALLBACK_SECONDS = 180.0, 25.0, 12.0
SMALL_SIDE = 1800
MODES = ("paddle", "tesseract", "hybrid")
REMOTE_CONFIDENCE, LOCAL_CONFIDENCE = 0.85, 0.75
BANNERS = ("--- OCR PASS 1 (PRINTED) ---", "--- OCR PASS 2 (HANDWRITTEN) ---")
# --- End of fixed values. ---

Engine = Callable[[np.ndarray, "int | None"], str]


# --- how good a reading is ---------------------------------------------------------------------------------------------


def keyword_count(c: Column, word: str) -> Column:
    """How often a text holds a word, places that overlap counted once."""
    text = as_text(c)
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def pattern_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(as_text(c), F.lit(pattern))


def garbage_lines(c: Column) -> Column:
    """Lines that are not blank and have fewer letters and digits than three, or a third of their characters."""
    lines = F.filter(F.transform(F.split(as_text(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bad = F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{Nd}]", "")) < F.greatest(F.lit(3), F.floor(F.length(x) / 3)))
    return F.size(bad)


def reading_score(c: Column, cleaned: bool = False) -> Column:
    """How much a text reads like a document that was recognised well; the text is cleaned first unless it is already."""
    text = as_text(c) if cleaned else clean_invoice_text(c)
    lower = F.lower(text)
    score = F.lit(0.0)
    for word, points in KEYWORD_POINTS.items():
        score = score + keyword_count(lower, word) * points
    score = score + F.when(P.is_table_header(lower), TABLE_POINTS).otherwise(0)
    score = score + pattern_count(text, GSTIN) * GSTIN_POINTS + F.size(invoice_date_candidates(text)) * DATE_POINTS + pattern_count(text, AMOUNT) * AMOUNT_POINTS
    return score - garbage_lines(text) * GARBAGE_POINTS


def engine_mode(c: Column) -> Column:
    """The mode that a setting names, whatever its case; the last of MODES for any other, or none."""
    name = F.lower(F.trim(c))
    return F.when(name.isin(*MODES), name).otherwise(MODES[-1])


def medical_page(c: Column) -> Column:
    """A page's recognised text cleaned, then corrected."""
    return correct_medical_text(clean_medical_text(c))


# --- running engines ---------------------------------------------------------------------------------------------------


def within(seconds: float, engine: Engine, image: np.ndarray, mode: int | None) -> tuple[str, bool]:
    """(text, late): what an engine says in time; nothing if it fails or is late. A late call is left to itself."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(engine, image, mode).result(timeout=seconds) or "", False
    except Late:
        return "", True
    except Exception:
        return "", False
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def best_reading(image: np.ndarray, engine: Engine, score: Callable[[str], float], page: float = PAGE_SECONDS, attempt: float = ATTEMPT_SECONDS) -> str:
    """The reading of a page that scores most, the first of equals, of three variants in three modes.

    No further attempt begins when the page's time is up. If all are blank the gray page is read once more, and if two
    attempts were late a smaller one.
    """
    gray, best, late, until = images.to_gray(image), None, 0, time.monotonic() + page
    for variant in (images.prepared_invoice(image), images.scaled(gray, 2), gray):
        for mode in INVOICE_MODES:
            left = until - time.monotonic()
            if left <= 0:
                break
            text, over = within(min(attempt, left), engine, variant, mode)
            late += over
            if text.strip():
                value = score(text)
                best = (value, text) if best is None or value > best[0] else best
    for again in (gray, images.at_most(gray, SMALL_SIDE) if late >= 2 else None):
        left = until - time.monotonic()
        if best is None and again is not None and left > 0:
            text, _ = within(min(FALLBACK_SECONDS, left), engine, again, FALLBACK_MODE)
            best = (0.0, text) if text.strip() else None
    return best[1] if best else ""


def card_readings(raw: bytes, engine: Engine, seconds: float = ATTEMPT_SECONDS) -> list[str]:
    """All readings of a card that are not blank, for merge_passes: the page as it is and made ready, in three modes each,
    and its regions in three modes each."""
    image = images.to_gray(images.frames(raw)[0])
    ready = images.to_gray(images.frames(images.prepared_card(raw))[0])
    passes = [(v, m) for v in (image, ready) for m in CARD_MODES] + [(v, m) for v in images.regions(image) for m in REGION_MODES]
    return [text for text in (within(seconds, engine, v, m)[0] for v, m in passes) if text.strip()]


def with_fallback(image: np.ndarray, mode: str, remote: Callable[[np.ndarray], str], local: Callable[[np.ndarray], str]) -> tuple[str | None, str | None, float | None]:
    """(text, engine, confidence): the remote engine's reading, or the local one's, as the mode allows; hybrid tries both."""
    for name, use, engine, sure in (("remote", mode != "tesseract", remote, REMOTE_CONFIDENCE), ("local", mode != "paddle", local, LOCAL_CONFIDENCE)):
        if use:
            try:
                answer = engine(image)
            except Exception:
                continue
            text, sure = answer if isinstance(answer, tuple) else (answer, sure)
            if text and text.strip():
                return text, name, sure
    return None, None, None


def remote_engine(url: str, seconds: float = 30.0) -> Callable[[np.ndarray], tuple[str, float]]:
    """An engine behind an HTTP address: it is sent {"image": base64 of a PNG} and answers with `text`, and maybe `confidence`."""

    def read(image: np.ndarray) -> tuple[str, float]:
        body = json.dumps({"image": base64.b64encode(images.write_png(images.to_gray(image))).decode()}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            found = json.load(answer)
        if "text" not in found:
            raise ValueError("the answer holds no text")
        return str(found["text"]), float(found.get("confidence", REMOTE_CONFIDENCE))

    return read


def banded_reading(image: np.ndarray, engine: Engine, bolder: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> str:
    """Top, middle and bottom read as print and then as handwriting, under a banner each; the lower two made bolder for that."""
    parts = images.bands(images.to_gray(image))
    texts = [[engine(p, 6) for p in parts], [engine(p if k == 0 else bolder(p), 11) for k, p in enumerate(parts)]]
    return "".join(f"{banner}\n" + "".join(f"{t}\n" for t in own) for banner, own in zip(BANNERS, texts, strict=True))


# --- documents of pages ------------------------------------------------------------------------------------------------


def page_number(name: str) -> int:
    """The number before a file's extension: output-12.png is page 12; 0 if there is none."""
    found = re.search(r"(\d+)\.[A-Za-z]+$", name)
    return int(found[1]) if found else 0


def page_images(raw: bytes, command: Sequence[str] = ("pdftoppm", "-png"), dpi: int = 300, seconds: float = 300.0) -> list[np.ndarray]:
    """The pages of a PDF in order, drawn by a program: `command -r dpi in.pdf output` writes a file for each page.

    Its folder lies in the task's own temporary folder and is removed at the end. A program that fails is an error.
    """
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder, "in.pdf")
        source.write_bytes(raw)
        done = subprocess.run([*command, "-r", str(dpi), str(source), str(Path(folder, "output"))], capture_output=True, timeout=seconds)
        if done.returncode:
            raise RuntimeError(done.stderr.decode("utf-8", "replace").strip() or f"{command[0]} failed")
        files = sorted(Path(folder).glob("output*"), key=lambda p: (page_number(p.name), p.name))
        return [images.frames(p.read_bytes())[0] for p in files]


def pdf_engine(engine: Callable[[np.ndarray], str], **drawing: object) -> Callable[[bytes], list[str]]:
    """An engine for PDF files from one for single images."""
    return lambda raw: [engine(page) for page in page_images(raw, **drawing)]
