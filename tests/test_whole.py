"""Queries see whole inputs: small tables of one's own, in both dialects."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from parchmint.plans import registry
from parchmint.plans.dialect import DUCK


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query over tables given as lists of dicts, the same from either dialect."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, rows in tables.items():
            pq.write_table(pa.Table.from_pylist(rows), f"{tmp_path}/{t}.parquet")
            con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        found = [r.asDict() for r in registry.queries()[name](spark, str(tmp_path)).collect()]
        want = con.sql(registry.TWINS[name](DUCK))
        twin = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
        key = lambda r: str(sorted(r.items()))
        assert sorted(found, key=key) == sorted(twin, key=key)
        return found

    return run


def test_sign_type_reads_whole_pages(both):
    pages = [{"page_id": 1, "url": "u", "html": "x" * 5000 + " masjid"}, {"page_id": 2, "url": "u", "html": "x" * 5000}]
    rows = both("n10_sign_type", pages=pages, lineitem=[{"l_orderkey": 9, "l_linenumber": 3}])
    assert {r["page_id"]: r["kind"] for r in rows} == {1: "religious", 2: "general", 9: "general"}


def test_hash_sees_every_pixel(both):
    base = [k / 64 for k in range(64)]
    odd = [*base[:9], base[9] + 0.01, *base[10:]]
    assert odd[8] < odd[9] < odd[10]
    rows = both("i16_hash", embeddings=[{"vec_id": i, "embedding": e, "label": 0} for i, e in enumerate((base, odd, base))])
    h = {r["image_id"]: r["pixel_hash"] for r in rows}
    assert h[0] == h[2] != h[1]


def test_points_of_all_rows(both):
    points = [(10, 10), (200, 10), (210, 30), (20, 40), (5, 5), (6, 7), (100, 9)]
    at = lambda o, n, x, y: {"l_orderkey": o, "l_linenumber": n, "l_partkey": x, "l_suppkey": y, "l_quantity": 1.0, "l_extendedprice": 1.0}
    rows = both("i17_points", lineitem=[*(at(1, n, x, y) for n, (x, y) in enumerate(points)), at(2, 0, 7, 3)])
    found = {(r["image_id"], r["quad"]): r for r in rows}
    corners = lambda r: [(r[f"{c}_x"], r[f"{c}_y"]) for c in ("tl", "tr", "br", "bl")]
    assert {k: r["n_points"] for k, r in found.items()} == {(1, 0): 4, (1, 1): 3, (2, 0): 1}
    assert corners(found[1, 0]) == [(10, 70), (200, 70), (210, 210), (20, 280)]
    assert corners(found[1, 1]) == [(5, 35), (None, None), (100, 63), (6, 49)]
    assert corners(found[2, 0]) == [(7, 21), (None, None), (None, None), (None, None)]


def test_report_has_the_summary(both):
    text = "Plain words open this text and run on for a while, well past eighty characters. " + "Filler stands here and there. " * 3 + "The key result ends it."
    docs = [{"doc_id": i, "text": t, "lang": "en"} for i, t in enumerate((text, "short", None))]
    want = {r["doc_id"]: r["summary"] for r in both("n3_summary_concise", documents=docs)}
    rows = {r["doc_id"]: r["md"] for r in both("m1_report", documents=docs)}
    assert len(rows) == 3 and len(want[0]) > 80
    assert want[0] in rows[0].split("Summary")[1].replace("\\", "")
