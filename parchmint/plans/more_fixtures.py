"""Candidates, boxes, pixels, image statistics, runs and task events derived from relational rows."""

from __future__ import annotations

from parchmint.plans import fixtures
from parchmint.plans.dialect import Dialect


def candidates(d: Dialect) -> str:
    """(image_id, ord, engine, method, text, confidence, is_sign): one for each order line, ord dense and unique."""
    ranked = f"(SELECT l_orderkey, l_suppkey, l_quantity, p_name, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey)"
    engine = "CASE l_suppkey % 3 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'easyocr' ELSE 'paddleocr' END"
    text = f"CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE p_name || CASE WHEN l_suppkey % 2 = 0 THEN ' -- ## ' ELSE {d.lit(chr(10))} END || p_brand || repeat(' word', CAST(l_suppkey % 7 AS int)) END"
    return f"(SELECT l_orderkey AS image_id, CAST(ord AS bigint) AS ord, {engine} AS engine, 'otsu_psm' || {d.cast('ord', d.text)} AS method, {text} AS text, l_quantity * 2 AS confidence, l_orderkey % 9 = 0 AS is_sign FROM {ranked})"


def words(d: Dialect) -> str:
    """Recognised words with boxes: one for each order line."""
    c = f"(SELECT l_orderkey AS image_id, l_linenumber % 3 AS block_num, l_linenumber % 2 AS par_num, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord, l_partkey % 600 AS left_, l_suppkey * 7 % 800 AS top_, l_partkey % 90 + 5 AS width, CAST(l_quantity AS bigint) AS height, CASE WHEN l_suppkey % 8 = 0 THEN -1 ELSE l_partkey % 101 END AS conf, p_brand AS text FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey)"
    return c


def boxes(d: Dialect) -> str:
    return f"(SELECT l_orderkey AS image_id, l_partkey % 500 AS x, l_suppkey * 17 % 60 AS y, l_partkey % 97 + 3 AS w, CAST(l_quantity AS bigint) AS h FROM {d.table('lineitem')})"


def pixels(d: Dialect) -> str:
    """(image_id, y, x, v): embeddings as images of 8 by 8, levels 0 to 255."""
    e = f"(SELECT vec_id, embedding, {d.cast('array_max(embedding)' if d.name == 'spark' else 'list_max(embedding)', 'double')} AS hi, {d.cast('array_min(embedding)' if d.name == 'spark' else 'list_min(embedding)', 'double')} AS lo FROM {d.table('embeddings')})"
    rows = d.explode(e, "embedding", "vec_id, hi, lo", "e")
    return f"(SELECT vec_id AS image_id, {d.idiv('CAST(i AS bigint)', '8')} AS y, CAST(i % 8 AS bigint) AS x, CAST(floor({d.div('e - lo', 'hi - lo')} * 255) AS bigint) AS v FROM ({rows}))"


def stats(d: Dialect) -> str:
    """Image statistics that reach every branch of the rules, from order lines by arithmetic."""
    f = d.num
    k = {
        "width": "300 + l_partkey % 1700", "height": "200 + l_suppkey * 31 % 1500", "ed": f"(l_partkey % 97) * {f(0.0017)}", "c": f"(l_suppkey * 7 + l_partkey) % 101 * {f(1.0)}", "br": f"(l_partkey * 3 + l_suppkey) % 256 * {f(1.0)}",
        "bl": f"(l_partkey * 11) % 1500 * {f(1.0)}", "tc": f"(l_suppkey * 13 + l_partkey) % 101 * {f(1.0)}", "tl": f"(l_partkey * 7) % 101 * {f(0.9)}", "fl": f"(l_suppkey * 5 + l_partkey * 3) % 101 * {f(1.0)}",
        "cv": f"(l_partkey * 5 + l_suppkey) % 60 * {f(1.0)}", "n": "(l_partkey + l_suppkey) % 31", "x_groups": "l_partkey % 5",
    }
    inner = ", ".join(f"{v} AS {n}" for n, v in k.items())
    return f"(SELECT *, {d.div('width', 'height')} AS ar FROM (SELECT l_orderkey AS image_id, l_partkey, l_suppkey, {inner} FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM {d.table('lineitem')})))"


def runs(d: Dialect) -> str:
    kinds = "CASE event_type WHEN 'view' THEN 'document' WHEN 'click' THEN 'receipt' WHEN 'signup' THEN 'form' WHEN 'purchase' THEN 'table' ELSE 'natural' END"
    return f"(SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'error' OR event_id % 4 = 0 THEN 'error' ELSE 'success' END AS status, {kinds} AS image_type, CASE user_id % 3 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'easyocr' ELSE 'paddleocr' END AS engine, value AS seconds FROM {d.table('events')})"


def tasks(d: Dialect) -> str:
    seconds = "unix_timestamp(ts)" if d.name == "spark" else "CAST(floor(epoch(ts)) AS bigint)"
    kind = "CASE WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN 'error' ELSE 'processing' END"
    return f"(SELECT 'task' || {d.cast('user_id', d.text)} AS task_id, {seconds} AS ts, {kind} AS event, 60 + user_id % 5 * 100000 AS timeout_s FROM {d.table('events')})"


def scans(d: Dialect) -> str:
    """(image_id, filename, image_type, tl, fl, k, text): what receipts, cards, forms, tables and documents would be scanned from."""
    kind = "CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'signage' WHEN 2 THEN 'natural' ELSE 'scientific' END"
    of = lambda letter, image_type, tl, fl, source: f"SELECT '{letter}' || {d.cast('doc_id', d.text)} AS image_id, {image_type} AS image_type, {tl} AS tl, {fl} AS fl, doc_id AS k, text FROM {source}"
    every = " UNION ALL ".join([of("r", "'receipt'", 10, 20, fixtures.receipts(d)), of("c", "'id_card'", 0, 50, fixtures.id_cards(d)), of("f", "'form'", 5, 80, fixtures.forms(d)), of("t", "'table'", 85, 10, fixtures.tables(d)), of("d", kind, 0, 0, d.table("documents"))])
    return f"(SELECT *, image_id || '.png' AS filename FROM ({every}))"


def scan_candidates(d: Dialect, of: str) -> str:
    """(image_id, ord, engine, text, confidence, is_sign): three engines' readings of scans; some have none."""
    late = "image_type IN ('natural', 'signage')"
    first = f"SELECT image_id, CASE WHEN {late} THEN 3 ELSE 1 END AS ord, 'tesseract_otsu_psm6' AS engine, CASE WHEN k % 5 = 0 THEN '' ELSE text END AS text, k % 101 AS c, image_type"
    second = f"SELECT image_id, CASE WHEN {late} THEN 1 ELSE 3 END AS ord, 'easyocr_detail' AS engine, substr(text, 1, CAST({d.idiv(d.len('text'), '2')} AS int)) AS text, k * 7 % 101 AS c, image_type"
    third = f"SELECT image_id, 2 AS ord, 'paddleocr_ocr' AS engine, text || {d.lit(chr(10) + 'read thrice')} AS text, k * 13 % 101 AS c, image_type"
    every = " UNION ALL ".join(f"{x} FROM {of} WHERE k % 17 <> 0" for x in (first, second, third))
    return f"(SELECT image_id, CAST(ord AS bigint) AS ord, engine, coalesce(text, '') AS text, CAST(c AS double) AS confidence, image_type = 'signage' AS is_sign FROM ({every}))"


def scans_read(d: Dialect, of: str) -> str:
    """Scans with the readings of scan_candidates and scan_fallbacks as lists, `xs` and `again`; Spark only."""
    late = "image_type IN ('natural', 'signage')"
    one = lambda ord_, engine, text, c: d.struct(ord=f"CAST({ord_} AS bigint)", engine=f"'{engine}'", text=f"coalesce({text}, '')", confidence=f"CAST({c} AS double)")
    first = one(f"CASE WHEN {late} THEN 3 ELSE 1 END", "tesseract_otsu_psm6", "CASE WHEN k % 5 = 0 THEN '' ELSE text END", "k % 101")
    second = one(f"CASE WHEN {late} THEN 1 ELSE 3 END", "easyocr_detail", f"substr(text, 1, CAST({d.idiv(d.len('text'), '2')} AS int))", "k * 7 % 101")
    third = one("2", "paddleocr_ocr", f"text || {d.lit(chr(10) + 'read thrice')}", "k * 13 % 101")
    again = d.struct(ord="CAST(1 AS bigint)", engine="'scaled_2_psm11'", text="'fallback ' || substr(coalesce(text, ''), 1, 40)", confidence="CAST(k * 17 % 101 AS double)")
    return f"(SELECT image_id, filename, image_type, tl, fl, {d.when(('k % 17 <> 0', d.array(first, second, third)), other='array()')} AS xs, {d.when(('k % 17 <> 0', d.array(again)), other='array()')} AS again FROM {of})"


def scan_fallbacks(d: Dialect, of: str) -> str:
    return f"(SELECT image_id, CAST(1 AS bigint) AS ord, 'scaled_2_psm11' AS engine, 'fallback ' || substr(coalesce(text, ''), 1, 40) AS text, CAST(k * 17 % 101 AS double) AS confidence FROM {of} WHERE k % 17 <> 0)"
