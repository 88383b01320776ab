"""Adapters to recognition engines: each load function imports its module and returns (image, language) -> (text, confidence, method)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np

Recognise = Callable[[np.ndarray, str], tuple[str, float, str]]

# Page modes in the order they are tried, when a reading is good enough, and language codes by engine.
PAGE_MODES, GOOD, LONG = (6, 11, 3, 4), 85, 20
CODES = {"eng": "en", "ind": "id"}
ROW_GAP = 10


def lines_of_words(data: dict[str, list]) -> tuple[str, float]:
    """Words of a page as lines, blank lines between paragraphs, and the mean confidence of those that have one."""
    parts: dict[tuple, dict[int, list[str]]] = {}
    for block, par, line, word in zip(data["block_num"], data["par_num"], data["line_num"], data["text"], strict=True):
        if word.strip():
            parts.setdefault((block, par), {}).setdefault(line, []).append(word.strip())
    text = "\n\n".join("\n".join(" ".join(ws) for ws in lines.values()) for lines in parts.values())
    known = [float(c) for c in data["conf"] if float(c) != -1]
    return text, sum(known) / len(known) if known else 0.0


def in_reading_order(found: list[tuple[Any, str, float]]) -> tuple[str, float]:
    """Regions (corners, text, confidence of 0 to 1) from top to bottom, on one line while tops are under ROW_GAP apart."""
    boxes = sorted(((min(p[1] for p in corners), min(p[0] for p in corners), text, share) for corners, text, share in found if text.strip()), key=lambda b: b[:2])
    rows: list[list[tuple]] = []
    for box in boxes:
        if rows and box[0] - rows[-1][0][0] < ROW_GAP:
            rows[-1].append(box)
        else:
            rows.append([box])
    text = "\n".join(" ".join(b[2] for b in sorted(row, key=lambda b: b[1])) for row in rows)
    return text, 100 * sum(b[3] for b in boxes) / len(boxes) if boxes else 0.0


def tesseract() -> Recognise:
    import pytesseract

    def read(image: np.ndarray, language: str) -> tuple[str, float, str]:
        best = ("", 0.0, "no_text")
        for mode in PAGE_MODES:
            text, confidence = lines_of_words(pytesseract.image_to_data(image, lang=language, config=f"--oem 1 --psm {mode}", output_type=pytesseract.Output.DICT))
            if text and confidence > best[1]:
                best = (text, confidence, f"psm{mode}")
            if confidence > GOOD and len(text) > LONG:
                break
        return best

    return read


def easyocr() -> Recognise:
    import easyocr as module

    readers: dict[tuple[str, ...], Any] = {}

    def read(image: np.ndarray, language: str) -> tuple[str, float, str]:
        codes = tuple(CODES.get(c, c) for c in language.split("+"))
        if codes not in readers:
            readers[codes] = module.Reader(list(codes))
        text, confidence = in_reading_order([(r[0], r[1], float(r[2])) for r in readers[codes].readtext(image)])
        return text, confidence, "detail" if text else "no_text"

    return read


def paddleocr() -> Recognise:
    import paddleocr as module

    readers: dict[str, Any] = {}

    def read(image: np.ndarray, language: str) -> tuple[str, float, str]:
        code = CODES.get(language.split("+")[0], "en")
        if code not in readers:
            readers[code] = module.PaddleOCR(use_angle_cls=True, lang=code)
        pages = readers[code].ocr(image, cls=True) or []
        text, confidence = in_reading_order([(corners, said[0], float(said[1])) for page in pages for corners, said in page or []])
        return text, confidence, "ocr" if text else "no_text"

    return read


def pdf_page(content: bytes, page: int) -> tuple[int, bytes | None]:
    """How many pages a PDF has, and one of them (from 1) as a grey PGM file, at the resolution its text asks for; None where it has no such page."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        n = len(document)
        if not 1 <= page <= n:
            return n, None
        sheet = document[page - 1]
        dpi = page_resolution(len(sheet.get_text()), sheet.rect.width * sheet.rect.height)
        drawn = sheet.get_pixmap(dpi=dpi, colorspace=fitz.csGRAY)
        return n, b"P5\n%d %d\n255\n" % (drawn.width, drawn.height) + bytes(drawn.samples)


def page_resolution(n_chars: int, area: float) -> int:
    """Dots an inch for a PDF page: fine for pages with text of usual size."""
    return 600 if n_chars > 100 and area <= 1e6 else 300
