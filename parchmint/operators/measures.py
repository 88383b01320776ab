"""What an image is like, counted from its pixels; scores and types follow from the counts by SQL (images.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parchmint.functions import geometry
from parchmint.functions import kernels as k
from parchmint.functions.kernels import Image
from parchmint.operators import images
from parchmint.plans.dialect import Dialect, steps
from parchmint.sources.engines import decoded

COUNTS = "edge_pixels", "h_edges", "v_edges", "h_lines", "v_lines", "crossings", "h_long", "rects", "n", "most_aligned", "x_groups"
SCHEMA = "image_id string, filename string, readable boolean, width int, height int, br double, c double, bl double, cv double, glare boolean, " + ", ".join(f"{c} long" for c in COUNTS)


def colour_variance(image: Image) -> float:
    """Deviation of hue (0 to 180) plus that of saturation; grey images have none."""
    if image.ndim < 3:
        return 0.0
    x = image.astype(np.float64)
    high, low = x.max(2), x.min(2)
    span = np.where(high > low, high - low, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    sixth = np.where(high == r, (g - b) / span, np.where(high == g, 2 + (b - r) / span, 4 + (r - g) / span))
    hue = np.where(high > low, sixth * 30 % 180, 0)
    return float(np.rint(hue).std() + np.rint(np.where(high > 0, (high - low) / np.maximum(high, 1) * 255, 0)).std())


# Sizes of windows, boxes and outlines that count.
def text_boxes(g: Image) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of dark parts that grow together under a window of 5 by 5, thrice: the finder by threshold."""
    grown = k.invert(k.otsu(g))
    for _ in range(3):
        grown = k.dilate(grown, 5, 5)
    boxes = [(x, y, part.shape[1], part.shape[0]) for y, x, part in geometry.components(grown > 0)]
    return [(x, y, w, h) for x, y, w, h in boxes if w * h > 100 and 0.1 < w / h < 15]


def rectangles(dark: np.ndarray) -> int:
    """Dark parts whose outline is over 100 long and has four corners."""
    n = 0
    for _, _, part in geometry.components(dark):
        points = geometry.outline(part)
        length = float(np.hypot(*(points - np.roll(points, -1, axis=0)).T).sum()) if len(points) > 1 else 0.0
        n += length > 100 and len(geometry.corners(points)) == 4
    return n


def counted(image: Image) -> dict[str, float]:
    g = k.grey(image)
    h, w = g.shape
    edges = k.edges(g, 50, 150)
    across, down = k.opened(edges, 1, max(1, w // 30)), k.opened(edges, max(1, h // 30), 1)
    dark = k.invert(k.otsu(g))
    boxes = text_boxes(g)
    tens = np.unique([x // 10 for x, *_ in boxes], return_counts=True)[1] if boxes else np.zeros(0, int)
    n = np.count_nonzero
    return {
        "width": w, "height": h, "br": float(g.mean()), "c": float(g.std()), "bl": float(k.laplacian(g).var()), "cv": colour_variance(image), "glare": bool(k.has_glare(g)),
        "edge_pixels": n(edges), "h_edges": n(k.erode(edges, 1, 5)), "v_edges": n(k.erode(edges, 5, 1)), "h_lines": n(across), "v_lines": n(down), "crossings": n((across > 0) & (down > 0)),
        "h_long": n(k.opened(dark, 1, 20)), "rects": rectangles(dark > 0), "n": len(boxes), "most_aligned": int(tens.max(initial=0)), "x_groups": len({x // 50 for x, *_ in boxes}),
    }


def measured(files: DataFrame) -> DataFrame:
    """files (image_id, filename, content): one row each; images that nothing decodes aren't readable."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, filename, content in zip(pdf["image_id"], pdf["filename"], pdf["content"], strict=True):
                image = decoded(bytes(content)) if content is not None else None
                found = counted(image) if image is not None and 0 not in image.shape else {}
                rows.append({"image_id": name, "filename": filename, "readable": bool(found)} | found)
            yield pd.DataFrame(rows, columns=names)

    return files.select("image_id", "filename", "content").mapInPandas(run, SCHEMA)


def typed(d: Dialect, rows: str) -> str:
    """rows (SCHEMA) with aspect ratio, edge density, text confidence, likelihoods, image type and strategy."""
    area = "(width * height)"
    scored = steps(
        f"(SELECT * FROM {rows} WHERE readable)",
        ("ar", d.div("width", "height")),
        ("ed", d.div("edge_pixels", area)),
        ("tc", images.text_confidence(d, "h_edges", "v_edges", "edge_pixels", area)),
        ("tl", images.table_likelihood(d, "h_lines", "v_lines", area, "crossings")),
        ("fl", images.form_likelihood(d, "h_long", area, "most_aligned", "n", "rects")),
        *images.type_steps(d),
    )
    return f"SELECT image_id, filename, width, height, ar, br, c, bl, cv, glare, ed, n, x_groups, tc, tl, fl, image_type, {images.strategy(d, 'image_type')} AS strategy FROM {scored}"
