"""Recognition engines and decoders as plug-ins. A missing one gives an empty result, never an error."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parchmint.sources import adapters

Recognise = Callable[[np.ndarray, str], tuple[str, float, str]]
CANDIDATES = "path string, ord long, engine string, method string, text string, confidence double, is_sign boolean"


@dataclass
class Engine:
    """needs: modules that must be there; load: makes the function (image, language) -> (text, confidence, method)."""

    name: str
    needs: tuple[str, ...]
    load: Callable[[], Recognise] | None = None
    _loaded: Recognise | None = field(default=None, repr=False)

    @property
    def available(self) -> bool:
        return self.load is not None and all(importlib.util.find_spec(m) is not None for m in self.needs)

    def process(self, image: np.ndarray, language: str) -> tuple[str, float, str]:
        if not self.available:
            return "", 0.0, "unavailable"
        if self._loaded is None:  # once for each Python worker
            self._loaded = self.load()
        return self._loaded(image, language)


#: Engines by name; each is available where its module is installed.
ENGINES = {
    "tesseract": Engine("tesseract", ("pytesseract",), adapters.tesseract),
    "easyocr": Engine("easyocr", ("easyocr",), adapters.easyocr),
    "paddleocr": Engine("paddleocr", ("paddleocr",), adapters.paddleocr),
}


def available() -> list[str]:
    return [name for name, engine in ENGINES.items() if engine.available]


def netpbm(content: bytes) -> np.ndarray | None:
    """Grey or colour levels of a binary PGM or PPM file, None for anything else."""
    if content[:2] not in (b"P5", b"P6"):
        return None
    tokens, at = [], 2
    while len(tokens) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at) + 1
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        tokens.append(int(content[at:end]))
        at = end
    width, height, _ = tokens
    channels = 3 if content[:2] == b"P6" else 1
    data = np.frombuffer(content, dtype=np.uint8, count=width * height * channels, offset=at + 1)
    return data.reshape(height, width, channels) if channels == 3 else data.reshape(height, width)


#: Tried in this order; each returns None for what it can't read.
DECODERS: list[Callable[[bytes], np.ndarray | None]] = [netpbm]


def decoded(content: bytes) -> np.ndarray | None:
    for decode in DECODERS:
        if (image := decode(content)) is not None:
            return image
    return None


def recognise(files: DataFrame, sequence: list[str], language: str = "eng", engines: dict[str, Engine] | None = None) -> DataFrame:
    """Candidates of each engine for each file (path, content), in the given order; arbitration chooses among them.

    Files that nothing decodes give one empty candidate of engine `none`.
    """
    known = engines or ENGINES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                image = decoded(bytes(content))
                if image is None:
                    rows.append((path, 0, "none", "undecoded", "", 0.0, False))
                    continue
                for k, name in enumerate(sequence):
                    text, confidence, method = known[name].process(image, language)
                    rows.append((path, k, name, method, text, float(confidence), False))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return files.select("path", "content").mapInPandas(run, CANDIDATES)


PAGES = "path string, page int, n_pages int, content binary, message string"


def pdf_pages(files: DataFrame, page: int = 1, read: Callable[[bytes, int], tuple[int, bytes | None]] = adapters.pdf_page) -> DataFrame:
    """One page of each PDF file (path, content) as an image file; content is null, with a message, where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    n, image = read(bytes(content), page)
                    rows.append((path, page, n, image, None if image is not None else f"no page {page} of {n}"))
                except ImportError:
                    rows.append((path, page, None, None, "no reader of PDF files is installed"))
                except Exception as e:  # a damaged file is a row of its own
                    rows.append((path, page, None, None, f"unreadable: {type(e).__name__}"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])
            yield out.astype({"n_pages": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)


GRID = "image_id string, ord long, engine string, method string, text string, confidence double"
# The engine that reads every variant; the others read the first one.
EVERY_VARIANT = "tesseract"


def recognise_variants(images: DataFrame, made: Callable[[np.ndarray, str, str], Iterator[tuple[str, np.ndarray]]], language: str = "eng", engines: dict[str, Engine] | None = None, all_read: bool = False) -> DataFrame:
    """images (image_id, image_type, strategy, sequence, content): a row for each variant and engine that reads it, in order.

    all_read: every engine reads every variant. made(image, image_type, strategy) gives the named variants. sequence: names of engines, in order.
    """
    known = engines or ENGINES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, kind, strategy, sequence, content in zip(pdf["image_id"], pdf["image_type"], pdf["strategy"], pdf["sequence"], pdf["content"], strict=True):
                variants = list(made(decoded(bytes(content)), kind, strategy)) if len(sequence) else []
                for place, engine in enumerate(sequence):
                    for k, (variant, image) in enumerate(variants if all_read or engine == EVERY_VARIANT else variants[:1]):
                        text, confidence, method = known[engine].process(image, language)
                        rows.append((name, place * 1000 + k, engine, f"{variant}_{method}", text, float(confidence)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GRID.split(", ")])

    return images.select("image_id", "image_type", "strategy", "sequence", "content").mapInPandas(run, GRID)
