"""Kernels, decoders, engines, files and streams."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from parchmint.functions import kernels as k
from parchmint.operators import measures, process, variants
from parchmint.plans import row_queries
from parchmint.sources import adapters, engines, files
from parchmint.streaming import tasks
from tests.conftest import SF


@pytest.fixture
def page():
    g = np.full((60, 80), 220, dtype=np.uint8)
    g[10:50:8, 10:70] = 30
    g[10:50, 20] = 30
    return g


def test_kernels(page):
    assert set(np.unique(k.otsu(page))) == {0, 255} and 30 <= k.otsu_level(page) < 220
    assert np.allclose(k.box(page, 3)[5, 5], page[4:7, 4:7].mean())
    assert k.erode(page, 3, 3).max() <= page.max() and (k.dilate(page, 3, 3) >= page).all()
    assert (k.invert(k.invert(page)) == page).all() and (k.stretch(page).min(), k.stretch(page).max()) == (0, 255)
    assert k.capped(page, 40).shape == (30, 40) and k.capped(page, 400) is page
    assert (k.rotated(page, 0) == page).all()
    assert (k.warped(page, np.array([[0, 0], [79, 0], [79, 59], [0, 59]])) == page[:59, :79]).mean() > 0.8
    assert k.has_glare(np.full((4, 4), 250, np.uint8)) and not k.has_glare(page)
    assert k.laplacian(np.full((5, 5), 9, np.uint8)).any() == 0
    flat = np.full((6, 6), 77, np.uint8)
    for f in (k.equalize, k.stretch, k.sharpen, lambda g: k.clahe(g, 2.0), lambda g: k.denoise(g, 10), lambda g: k.bilateral(g, 5, 50, 50), k.deglared, k.unshadowed):
        assert f(flat).shape == flat.shape and f(flat).dtype == np.uint8


@pytest.mark.parametrize("strategy", [*variants.STRATEGIES, "unheard of"])
@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (60, 80)])
def test_variants(strategy, shape):
    g = (np.arange(shape[0] * shape[1]) % 256).astype(np.uint8).reshape(shape)
    found = list(variants.variants(g, strategy))
    assert found[0][0] == "gray" and found[-1][0] == "original"
    assert all(v.dtype == np.uint8 and v.ndim == 2 for _, v in found)


def test_engines(spark, tmp_path):
    content = b"P5\n# note\n3 2\n255\n" + bytes(range(6))
    assert engines.decoded(content).tolist() == [[0, 1, 2], [3, 4, 5]] and engines.decoded(b"nothing") is None
    own = {"echo": engines.Engine("echo", (), lambda: lambda image, language: (f"{image.shape} {language}", 77.0, "shape")), **engines.ENGINES}
    df = spark.createDataFrame([("a", content), ("b", b"junk")], "path string, content binary")
    found = {(r.path, r.engine): (r.text, r.confidence, r.method) for r in engines.recognise(df, ["echo", "paddleocr"], engines=own).collect()}
    assert found == {("a", "echo"): ("(2, 3) eng", 77.0, "shape"), ("a", "paddleocr"): ("", 0.0, "unavailable"), ("b", "none"): ("", 0.0, "undecoded")}
    assert adapters.page_resolution(200, 5e5) == 600 and adapters.page_resolution(50, 5e5) == 300 and adapters.page_resolution(200, 2e6) == 300
    pdfs = spark.createDataFrame([("a", b"two pages"), ("b", b"damaged")], "path string, content binary")

    def reader(content, page):
        if content == b"damaged":
            raise ValueError(content)
        return 2, b"P5\n1 1\n255\n\x07" if page <= 2 else None

    got = {r.path: r for r in engines.pdf_pages(pdfs, 2, reader).collect()}
    assert engines.decoded(bytes(got["a"].content)).tolist() == [[7]] and got["a"].n_pages == 2
    assert got["b"].content is None and got["b"].message == "unreadable: ValueError"
    assert {r.message for r in engines.pdf_pages(pdfs.where("path = 'a'"), 3, reader).collect()} == {"no page 3 of 2"}
    assert {r.message for r in engines.pdf_pages(pdfs).collect()} == {"no reader of PDF files is installed"}


def test_files(spark, tmp_path):
    for name, body in (("a.pgm", b"x"), ("b.PNG", b"y"), ("c.txt", b"z"), ("d.pdf", b"w")):
        (tmp_path / name).write_bytes(body)
    found = files.read_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in found.select("path").collect()} == {"b.PNG", "d.pdf"}
    up = files.unique_names(files.with_upload(found), as_of=5).collect()
    assert all(r.stored_name.split("_")[1] == "5" and not r.is_large for r in up)
    out = str(tmp_path / "md")
    files.write_markdown(spark.createDataFrame([("one.png", "# One\ntext"), ("two.png", "# Two")], "filename string, md string"), out)
    assert {r.filename for r in files.list_markdown(spark, out).collect()} == {"one.md", "two.md"}
    assert [r.value for r in files.read_markdown(spark, out, "one.md").collect()] == ["# One", "text"]
    assert files.read_markdown(spark, out, "none.md").count() == 0
    said = {r.endpoint: r.says for r in files.catalogue(spark).collect()}
    assert files.TITLE in said["/api/"] and "endpoints" in said["/api/docs"] and all(path in said["/api/docs"] for path in said)


def test_transitions():
    state = tasks.transition(None, (10, "processing", 60))
    assert state == (10, 10, "processing", 60)
    state = tasks.transition(state, (20, "complete", 60))
    assert state == (10, 20, "complete", 60)
    assert tasks.transition(state, (30, "processing", 60)) == state


def test_task_stream_in_several_batches(spark, tmp_path):
    """Tasks whose events come in three micro-batches, late ones among them, have one row each."""
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[("a", at(10), "processing"), ("b", at(5), "processing")], [("a", at(40), "complete"), ("b", at(3), "error")], [("a", at(50), "error"), ("b", at(65), "processing"), ("c", at(1), "error")]]
    for rows in batches:
        spark.createDataFrame(rows, "task_id string, ts timestamp, event string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("task_id string, ts timestamp, event string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = tasks.task_status(source.selectExpr("*", "3600L as timeout_s")).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    writer.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(str(tmp_path / f"rows/batch={k}"))).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    changes = spark.read.schema(f"{tasks.OUTPUT}, batch long").parquet(str(tmp_path / "rows"))
    assert changes.count() > 3
    found = {r.task_id: (r.status, r.code, r.elapsed) for r in tasks.latest(changes).collect()}
    assert found == {"a": ("complete", 200, 30), "b": ("processing", 202, 60), "c": ("error", 200, 0)}


def test_counts_of_pixels():
    """Counts by hand on drawn images: a frame, bars, a grid, colours."""
    g = np.full((120, 160), 255, np.uint8)
    g[20:60, 30:110] = 0
    c = measures.counted(g)
    assert (c["width"], c["height"], c["n"], c["rects"]) == (160, 120, 1, 1)
    assert measures.text_boxes(g) == [(24, 14, 92, 52)]  # six pixels wider on each side
    assert (c["most_aligned"], c["x_groups"], c["h_long"]) == (1, 1, 40 * 80)
    assert abs(c["br"] - (255 - 255 * 3200 / 19200)) < 1e-9 and c["cv"] == 0.0 and c["glare"]
    grid = np.full((120, 160), 255, np.uint8)
    grid[::20] = grid[:, ::20] = 0
    lines = measures.counted(grid)
    assert lines["crossings"] > 0 and lines["h_lines"] > 0 and lines["v_lines"] > 0
    assert measures.counted(np.full((5, 5), 9, np.uint8))["edge_pixels"] == 0
    red, blue = np.zeros((4, 4, 3), np.uint8), np.zeros((4, 4, 3), np.uint8)
    red[..., 0], blue[..., 2] = 200, 200
    assert measures.colour_variance(red) == 0.0 and measures.colour_variance(np.concatenate([red, blue])) == 60.0


def reader(text, confidence):
    return lambda: lambda image, language: (text, confidence, f"{image.shape[0]}")


def test_process_from_file_to_report(spark):
    """Engines that read: one weak, one better; the broken file is an error; nobody reads where there is no engine."""
    pages = row_queries.drawn_pages(spark, SF).where("image_id in ('page1', 'page2', 'broken')")
    text = "Full  Name: Jane\nTotal 12O4\nthis is the text of the page and it is read well"
    own = {"tesseract": engines.Engine("tesseract", (), reader("bad", 20.0)), "easyocr": engines.Engine("easyocr", (), reader(text, 90.0))}
    found = {r.image_id: r for r in process.process_images(pages, own).collect()}
    assert (found["broken"].status, found["broken"].message, found["broken"].text) == ("error", "Failed to read image file", None)
    for name in ("page1", "page2"):
        r = found[name]
        assert r.engine == "merged_engines" if r.image_type == "signage" else r.engine.startswith("easyocr_gray_")
        assert r.status == "success" and r.confidence == 90.0 and "1204" in r.text
        assert r.strategy and r.structure and r.language in ("en", "latin")
    weak = {"easyocr": engines.Engine("easyocr", (), lambda: lambda image, language: ("a longer text when scaled up", 70.0, "x") if image.shape[0] > 300 else ("oops", 10.0, "x"))}
    for r in process.process_images(pages.where("image_id = 'page1'"), weak).collect():
        assert (r.engine, r.text, r.confidence) == ("fallback_scaled_1.5_x", "a longer text when scaled up", 70.0)
    nobody = {r.image_id: (r.status, r.engine, r.text) for r in process.process_images(pages, {}).collect()}
    assert nobody == {"page1": ("poor_quality", "none", ""), "page2": ("poor_quality", "none", ""), "broken": ("error", None, None)}


def test_engine_adapters(monkeypatch):
    """The adapters against stand-ins of the modules, which aren't installed here."""
    import importlib.machinery
    import types

    def module(name, **members):
        m = types.ModuleType(name)
        m.__spec__ = importlib.machinery.ModuleSpec(name, None)
        for k, v in members.items():
            setattr(m, k, v)
        monkeypatch.setitem(__import__("sys").modules, name, m)

    asked = []

    def data(image, lang, config, output_type):
        asked.append((lang, config, output_type))
        conf = [90, 96, -1, 90] if config.endswith("3") else [50, 40, -1, 60]
        return {"block_num": [1, 1, 1, 2], "par_num": [1, 1, 1, 1], "line_num": [1, 2, 2, 1], "text": ["first", "second", " ", "a paragraph of its own"], "conf": conf}

    module("pytesseract", image_to_data=data, Output=types.SimpleNamespace(DICT="dict"))
    box = lambda x, y: [[x, y], [x + 5, y], [x + 5, y + 5], [x, y + 5]]
    module("easyocr", Reader=lambda codes: types.SimpleNamespace(readtext=lambda image: [(box(50, 3), "right", 0.5), (box(0, 0), "left", 0.7), (box(0, 40), "+".join(codes), 0.9)]))
    module("paddleocr", PaddleOCR=lambda use_angle_cls, lang: types.SimpleNamespace(ocr=lambda image, cls: [None, [[box(0, 0), ("said", 0.25)]]]))
    image = np.zeros((4, 4), np.uint8)
    fresh = {n: engines.Engine(n, e.needs, e.load) for n, e in engines.ENGINES.items()}
    assert all(e.available for e in fresh.values()) and engines.available() == list(engines.ENGINES)
    assert fresh["tesseract"].process(image, "ind") == ("first\nsecond\n\na paragraph of its own", 92.0, "psm3")
    assert [c for _, c, _ in asked] == ["--oem 1 --psm 6", "--oem 1 --psm 11", "--oem 1 --psm 3"]
    text, confidence, method = fresh["easyocr"].process(image, "eng+ind")
    assert (text, round(confidence, 6), method) == ("left right\nen+id", 70.0, "detail")
    assert fresh["paddleocr"].process(image, "eng") == ("said", 25.0, "ocr")


def test_process_directory(spark, tmp_path):
    """A folder of files in; results and one report for each readable file out."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.png").write_bytes(row_queries.drawn(3, "document"))
    (tmp_path / "in" / "deep" / "two.jpg").write_bytes(b"broken")
    (tmp_path / "in" / "three.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "notes.txt").write_bytes(b"not taken")
    own = {"easyocr": engines.Engine("easyocr", (), reader("The key result must be read from this page without any doubt at all.", 88.0))}
    out = str(tmp_path / "out")
    found = {r.filename: r.status for r in process.process_directory(spark, str(tmp_path / "in"), out, "2024-01-31 00:00:00", own).collect()}
    assert found == {"one.png": "success", "two.jpg": "error", "three.pdf": "error"}
    assert {r.filename for r in files.list_markdown(spark, f"{out}/markdown").collect()} == {"one.md"}
    text = "\n".join(r.value for r in files.read_markdown(spark, f"{out}/markdown", "one.md").collect())
    assert "# OCR Results: one.png" in text and "The key result must be read" in text
    assert {r.status for r in spark.read.json(f"{out}/results").collect()} == {"success", "error"}


@pytest.mark.parametrize("shape", [(8, 8), (3, 7), (20, 31)])
def test_stacks(shape):
    """A stack gives each image the very variants that it has alone, and shares work among strategies."""
    h, w = shape
    rng = np.random.default_rng(1)
    sheet = np.where((np.arange(h)[:, None] > h // 5) & (np.arange(h)[:, None] < h * 4 // 5) & (np.arange(w) > w // 6) & (np.arange(w) < w * 5 // 6), 240, 20)
    images = [rng.integers(0, 256, shape), rng.integers(0, 90, shape), np.full(shape, 7), np.full(shape, 255), sheet, rng.integers(200, 256, shape)]
    images = [g.astype(np.uint8) for g in images]
    content = [b"P5\n%d %d\n255\n" % (w, h) + g.tobytes() for g in images]
    found = pd.concat(variants._of_every_strategy(pd.DataFrame({"image_id": range(len(images)), "content": content})))
    columns = ["ord", "variant", "height", "width", "brightness", "contrast", "data"]
    for strategy in variants.STRATEGIES:
        by_row = variants._with_variants(pd.DataFrame({"image_id": range(len(images)), "strategy": strategy, "content": content}))
        for i, g in enumerate(images):
            alone = [(j, name, *x.shape, float(x.mean()), float(x.std()), x.tobytes()) for j, (name, x) in enumerate(variants.variants(g, strategy))]
            for rows in (found[(found["strategy"] == strategy) & (found["image_id"] == i)], by_row[by_row["image_id"] == i]):
                assert [tuple(r) for r in rows[columns].itertuples(index=False)] == alone
