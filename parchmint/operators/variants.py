"""Named variants of an image for recognition, by strategy; rows in, rows out, in order."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parchmint.functions import geometry
from parchmint.functions import kernels as k
from parchmint.sources.engines import decoded

Image = np.ndarray
Named = list[tuple[str, Callable[[Image], Image]]]


def _bilateral_75(g: Image) -> Image:
    return k.bilateral(g, 9, 75, 75)


def _edge_enhanced(g: Image) -> Image:
    return k.blend(g, 0.8, k.edges(g), 0.2)


# Makers are cached: equal parameters give one function, whose result strategies share.
@functools.cache
def _then(*steps: Callable[[Image], Image]) -> Callable[[Image], Image]:
    def run(g: Image) -> Image:
        for step in steps:
            g = step(g)
        return g

    run.steps = steps
    return run


@functools.cache
def _clahe(limit: float, tiles: int = 8) -> Callable[[Image], Image]:
    return lambda g: k.clahe(g, limit, tiles)


@functools.cache
def _adaptive(size: int, c: float, mean: bool = False) -> Callable[[Image], Image]:
    return lambda g: k.adaptive(g, size, c, mean)


@functools.cache
def _denoise(strength: float, patch: int = 7) -> Callable[[Image], Image]:
    return lambda g: k.denoise(g, strength, patch)


@functools.cache
def _without_grid(size: int) -> Callable[[Image], Image]:
    return lambda g: np.where(k.grid(g, size) > 0, 255, g).astype(np.uint8)


def _columns_marked(g: Image) -> Image:
    return np.where(k.column_gaps(g)[..., None, :], np.uint8(255), g)


def _resized(y: float, x: float) -> Callable[[Image], Image]:
    """By a factor; of stacks, whose images go as a picture's colours do."""

    def run(g: Image) -> Image:
        h, w = max(1, int(g.shape[-2] * y)), max(1, int(g.shape[-1] * x))
        return k.resized(g, h, w) if g.ndim == 2 else np.moveaxis(k.resized(np.moveaxis(g, 0, -1), h, w), -1, 0)

    return run


# Names, order and parameters of the variants.
#: Variants by strategy, in the order they are tried.
STRATEGIES: dict[str, Named] = {
    "minimal": [("otsu", k.otsu)],
    "document": [("contrast", _clahe(2.0)), ("otsu", k.otsu), ("adaptive", _adaptive(11, 2)), ("denoised_otsu", _then(_denoise(10), k.otsu))],
    "receipt": [("contrast", _clahe(3.0)), ("adaptive", _adaptive(11, 4)), ("removed_lines", lambda g: k.lines_removed(g, 20)), ("deskewed", k.deskewed), ("sharpened_thresh", _then(k.sharpen, k.otsu))],
    "id_card": [
        ("resized", lambda g: k.capped(g, 1500) if g.ndim == 2 else g), ("denoised", _denoise(15)), ("contrast", _clahe(2.5)), ("sharpened", k.sharpen), ("otsu", k.otsu), ("adaptive", _adaptive(21, 10)),
        ("strong_adaptive", _adaptive(15, 8)), ("inv_otsu", _then(k.otsu, k.invert)), ("bilateral", _bilateral_75), ("edge_enhanced", _edge_enhanced),
    ],
    "natural": [("contrast", _clahe(3.0)), ("adaptive", _adaptive(25, 15)), ("bilateral", _bilateral_75), ("shadow_removed", k.unshadowed), ("sharpened", k.sharpen), ("sharp_thresh", _then(k.sharpen, k.otsu))],
    "handwritten": [
        ("bilateral", lambda g: k.bilateral(g, 15, 40, 40)), ("contrast", _clahe(3.0)), ("adaptive", _adaptive(21, 12)), ("stroke_enhanced", lambda g: k.invert(k.dilate(k.invert(g), 2, 2))),
        ("local_thresh", _then(k.tiled_equalize, k.otsu)), ("normalized", k.stretch), ("inv_thresh", _then(k.otsu, k.invert)),
    ],
    "book": [("contrast", _clahe(2.0, 16)), ("denoised", _denoise(10)), ("otsu", k.otsu), ("normalized", k.stretch), ("edge_enhanced", _edge_enhanced), ("sharpened_thresh", _then(k.sharpen, k.otsu))],
    "table": [("table_structure", lambda g: k.grid(g, 40)), ("table_cells", lambda g: k.dilate(k.grid(g, 40), 3, 3)), ("adaptive", _adaptive(11, 2)), ("otsu", k.otsu), ("text_only", _without_grid(40))],
    "multi_column": [("denoised", _denoise(10)), ("otsu", k.otsu), ("column_segmented", _then(k.otsu, _columns_marked)), ("column_detected", _columns_marked), ("adaptive", _adaptive(15, 8, True))],
    "scientific": [("contrast", _clahe(2.0)), ("adaptive", _adaptive(11, 2)), ("formula_preserved", lambda g: k.closed(k.otsu(g), 2, 2)), ("symbol_enhanced", lambda g: k.blend(g, 1.5, k.levels(k.gauss(g, 5)), -0.5)), ("sharp_thresh", _then(k.sharpen, k.otsu)), ("formula_enhanced", _then(_clahe(3.0), k.otsu))],
    "form": [("contrast", _clahe(2.0)), ("adaptive", _adaptive(15, 5)), ("form_enhanced", lambda g: k.dilate(k.grid(g, 30), 3, 3)), ("text_only", _without_grid(30)), ("labels", _then(k.sharpen, k.otsu))],
    "standard": [("otsu", k.otsu), ("adaptive", _adaptive(11, 2)), ("contrast_otsu", _then(_clahe(2.0), k.otsu)), ("edge_enhanced", _edge_enhanced)],
    "aggressive": [
        ("contrast", _clahe(4.0)), ("denoised", _denoise(15, 9)), ("sharpened", k.sharpen), ("sharpened_otsu", _then(k.sharpen, k.otsu)), ("adaptive", _adaptive(13, 5)), ("inverted_otsu", _then(k.invert, k.otsu)),
        ("stretched", k.stretch), ("multi_scale_otsu", lambda g: np.minimum(k.otsu(g), k.otsu(k.levels(k.gauss(g, 5))))), ("strong_otsu", _then(_clahe(5.0, 4), k.otsu)),
    ],
    "signage": [
        ("contrast_enhanced", _clahe(3.0)), ("denoised", _denoise(10)), ("sharpened", k.sharpen), ("otsu", k.otsu), ("adaptive_mean", _adaptive(15, 5, True)), ("adaptive_gaussian", _adaptive(15, 8)),
        ("scaled_0.5", _resized(0.5, 0.5)), ("scaled_1.5", _resized(1.5, 1.5)), ("scaled_2.0", _resized(2.0, 2.0)), ("edge_binary", k.edges),
    ],
}
MOST_PIXELS, MOST_HANDWRITTEN = 3000, 1500


def variants(image: Image, strategy: str) -> Iterator[tuple[str, Image]]:
    """gray first, resized if too large, the strategy's own, a glare pair where there is glare, original last."""
    g = k.grey(image)
    yield "gray", g
    small = k.capped(g, MOST_HANDWRITTEN if strategy == "handwritten" else MOST_PIXELS)
    if small is not g:
        yield "resized", small
    for name, make in STRATEGIES.get(strategy, STRATEGIES["standard"]):
        if name == "scaled_0.5" and (flat := geometry.sign_corrected(small)) is not None:
            yield "perspective_corrected", flat
            yield "corrected_otsu", k.otsu(flat)
        yield name, make(small)
    if k.has_glare(small):
        clear = k.deglared(small)
        yield "glare_reduced", clear
        yield "glare_reduced_otsu", k.otsu(clear)
    yield "original", g


#: Images of at most so many pixels go in stacks of at most so many.
SMALL, STACK = 1 << 10, 1 << 13


def stacked(g: Image, strategy: str, known: dict[Callable[[Image], Image], Image]) -> Iterator[tuple[str, Image, np.ndarray | None]]:
    """The variants of small grey images (n, h, w) as variants() gives them for each: name, images, and whose they are (None: of all).

    known keeps what was made of these images, for other strategies.
    """

    def made(make: Callable[[Image], Image], *more: Callable[[Image], Image]) -> Image:
        if steps := getattr(make, "steps", ()):
            return made(*steps, *more)
        if make not in known:
            known[make] = make(g)
        out = known[make]
        for step in more:
            out = step(out)
        return out

    yield "gray", g, None
    for name, make in STRATEGIES.get(strategy, STRATEGIES["standard"]):
        if name == "scaled_0.5":
            for i, image in enumerate(g):
                if (flat := geometry.sign_corrected(image)) is not None:
                    yield "perspective_corrected", flat[None], np.array([i])
                    yield "corrected_otsu", k.otsu(flat)[None], np.array([i])
        yield name, made(make), None
    if len(bright := np.flatnonzero(k.has_glare(g))):
        clear = made(_cleared)
        yield "glare_reduced", clear, bright
        yield "glare_reduced_otsu", made(_cleared, k.otsu), bright
    yield "original", g, None


def _cleared(g: Image) -> Image:
    return k.deglared(g[k.has_glare(g)])


CARD_WIDTH = 1000


def optimized_card(image: Image) -> Image:
    """An identity card before recognition: at most CARD_WIDTH wide, equalised by tiles, without noise."""
    h, w = image.shape[:2]
    small = k.resized(image, max(1, h * CARD_WIDTH // w), CARD_WIDTH) if w > CARD_WIDTH else image
    return k.denoise(k.clahe(k.grey(small), 2.0), 10, 7, 10)


def corrected(image: Image, image_type: str) -> Iterator[tuple[str, Image]]:
    """What is done to an image of a type before its variants, one step on the other; steps that change nothing are left out."""
    if image_type == "id_card":
        image = optimized_card(image)
        yield "optimized", image
    g = k.grey(image)
    if image_type == "natural" and (flat := geometry.page_corrected(g)) is not None:
        g = flat
        yield "perspective", g
    if image_type not in ("natural", "signage") and (turned := geometry.auto_rotated(g)) is not g:
        yield "auto_rotated", turned


VARIANTS = "image_id long, ord int, variant string, height int, width int, brightness double, contrast double, data binary"


def image_variants(images: DataFrame) -> DataFrame:
    """images (image_id, strategy, content): a row for each variant, in order; undecoded images give none."""
    return images.select("image_id", "strategy", "content").mapInPandas(lambda batches: map(_with_variants, batches), VARIANTS)


def every_variant(images: DataFrame) -> DataFrame:
    """images (image_id, content): image_variants of each strategy, with a column of its name."""
    return images.select("image_id", "content").mapInPandas(lambda batches: (f for pdf in batches for f in _of_every_strategy(pdf)), f"{VARIANTS}, strategy string")


def _frame(found: list[tuple[str, Image, np.ndarray]], names: np.ndarray) -> pd.DataFrame:
    """Rows of (variant, images (n, h, w), places in names), in order of places and then as they were found."""
    parts, seen = [], np.zeros(len(names), dtype=np.int64)
    for variant, g, at in found:
        flat = np.ascontiguousarray(g).reshape(len(g), -1)
        # As a picture's own std() goes, along memory: the last bit depends on it.
        along = np.ascontiguousarray(g.swapaxes(-1, -2)).reshape(len(g), -1) if g.strides[-1] > g.strides[-2] else flat
        parts.append(pd.DataFrame({"at": at, "image_id": names[at], "ord": seen[at], "variant": variant, "height": g.shape[-2], "width": g.shape[-1], "brightness": flat.mean(1), "contrast": along.std(1), "data": [x.tobytes() for x in flat]}))
        seen[at] += 1
    if not parts:
        return pd.DataFrame(columns=[c.split()[0] for c in VARIANTS.split(", ")])
    return pd.concat(parts).sort_values(["at", "ord"]).drop(columns="at")


def _stacks(contents: pd.Series) -> tuple[list[tuple[np.ndarray, Image]], list[tuple[int, Image]]]:
    """Of those that are decoded: (places, images) of small grey ones by size, and (place, image) of the others."""
    small: dict[tuple[int, ...], list[int]] = {}
    images, others = {}, []
    for i, content in enumerate(contents):
        image = decoded(bytes(content)) if content is not None else None
        if image is None or 0 in image.shape:
            continue
        if image.ndim == 2 and image.size <= SMALL and image.dtype == np.uint8:
            images[i] = image
            small.setdefault(image.shape, []).append(i)
        else:
            others.append((i, image))
    cut = lambda at: (at[j : j + max(1, STACK // images[at[0]].size)] for j in range(0, len(at), max(1, STACK // images[at[0]].size)))
    return [(np.array(some), np.stack([images[i] for i in some])) for at in small.values() for some in cut(at)], others


def _with_variants(pdf: pd.DataFrame) -> pd.DataFrame:
    found, strategies = [], pdf["strategy"].to_numpy()
    stacks, others = _stacks(pdf["content"])
    for at, g in stacks:
        for strategy in pd.unique(strategies[at]):
            own = np.flatnonzero(strategies[at] == strategy) if strategy is not None else np.flatnonzero(pd.isna(strategies[at]))
            found += [(name, images, at[own] if of is None else at[own][of]) for name, images, of in stacked(g[own], strategy, {})]
    for i, image in others:
        found += [(name, g[None], np.array([i])) for name, g in variants(image, strategies[i])]
    return _frame(found, pdf["image_id"].to_numpy())


def _of_every_strategy(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    names = pdf["image_id"].to_numpy()
    stacks, others = _stacks(pdf["content"])
    for at, g in stacks:
        known: dict[Callable[[Image], Image], Image] = {}
        for strategy in STRATEGIES:
            yield _frame([(name, images, at if of is None else at[of]) for name, images, of in stacked(g, strategy, known)], names).assign(strategy=strategy)
    for i, image in others:
        for strategy in STRATEGIES:
            yield _frame([(name, g[None], np.array([i])) for name, g in variants(image, strategy)], names).assign(strategy=strategy)


def image_corrections(images: DataFrame) -> DataFrame:
    """images (image_id, strategy: the image's type, content): a row for each correction made, in order."""
    return _rows(images, corrected)


def _rows(images: DataFrame, made: Callable[[Image, str], Iterator[tuple[str, Image]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, strategy, content in zip(pdf["image_id"], pdf["strategy"], pdf["content"], strict=True):
                image = decoded(bytes(content)) if content is not None else None
                if image is None or 0 in image.shape:
                    continue
                rows = [(name, i, v, g.shape[0], g.shape[1], float(g.mean()), float(g.std()), g.tobytes()) for i, (v, g) in enumerate(made(image, strategy))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in VARIANTS.split(", ")])

    return images.select("image_id", "strategy", "content").mapInPandas(run, VARIANTS)
