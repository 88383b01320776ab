"""Links, neighbours, URLs, the pipeline and the folder's independence."""

import hashlib
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parchmint.llm import ann, pipeline, queries, quotes, tokenizing, url_filter
from parchmint.llm.components import components
from tests.conftest import ROOT, SF
from tests.llm.test_documents import brute_scores, classes

TALK = [
    (1, 0, "user", "Hello there.\nHow are you?\n\nSecond paragraph."),
    (1, 1, "assistant", "> hello   THERE.\n> How are you?\nFine."),
    (1, 2, "user", "> > Hello there.\n> > How are you?\n> Fine.\nGood."),
    (1, 3, "assistant", "> Second paragraph.\n\nYes, that."),
    (1, 4, "user", "no quote"),
    (2, 0, "user", "> Good.\nQuoted from elsewhere."),
    (2, 1, "user", None),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (3, 5, "user", "> nowhere to be found\n>> deeper\nlast"),
    (None, None, None, "> Good."),
]


def test_quotes(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("m", F.lit("kept")).withColumn("depth", F.lit("replaced"))
    rows = quotes.formatted(df).collect()
    assert len(rows) == len(TALK)
    at = {(r.conv_id, r.turn): r for r in rows}
    assert {r.m for r in rows} == {"kept"}
    assert at[1, 1].own_text == "Fine." and (at[1, 1].reply_to, at[1, 1].thread, at[1, 1].depth) == (0, 0, 1)
    assert (at[1, 2].reply_to, at[1, 2].thread, at[1, 2].depth, at[1, 2].n_quotes, at[1, 2].n_linked) == (1, 0, 2, 2, 2)
    assert (at[1, 3].reply_to, at[1, 3].thread, at[1, 3].depth) == (0, 0, 1)
    assert (at[1, 4].reply_to, at[1, 4].thread, at[1, 4].depth, at[1, 4].n_quotes) == (None, 4, 0, 0)
    assert (at[2, 0].reply_to, at[2, 0].far_conv, at[2, 0].far_turn) == (None, 1, 2)
    assert at[2, 1].own_text == "" and at[2, 2].n_quotes == 0
    assert (at[3, 5].n_quotes, at[3, 5].n_linked, at[3, 5].own_text) == (2, 0, "last")
    assert (at[None, None].far_conv, at[None, None].far_turn) == (1, 2)
    assert quotes.formatted(df.where("false")).count() == 0


def test_quotes_against_sql(spark):
    import duckdb

    rng = np.random.default_rng(4)
    bodies = ["alpha beta", "Gamma  delta", "epsilon", "zeta\neta", "theta\n\niota"]
    rows = []
    for c in range(30):
        for t in range(12):
            quote = str(rng.choice(bodies))
            depth = int(rng.integers(0, 3))
            lines = ["> " * depth + x for x in quote.split("\n")] + ([str(rng.choice(bodies))] if rng.random() < 0.6 else [])
            rows.append((c % 20, t, "user", "\n".join(lines)))
    df = spark.createDataFrame(rows + TALK, "conv_id long, turn long, role string, text string")
    digest = queries.quote_digest(quotes.formatted(df))
    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.sql(f"SELECT {', '.join(digest.columns)} FROM ({queries.OP4_SQL})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, digest.collect()), key=key) == sorted(want, key=key)


def test_partial_quotes_and_reply_order(spark):
    """Two paragraphs of three, one line of a paragraph; messages come after what they reply to; parts are bounded."""
    rows = [
        (1, 0, "one is here\ntwo is here\n\nthree is here\n\nfour is here"),
        (1, 1, "> three is here\n>\n> four is here\nyes"),
        (1, 2, "another thread"),
        (1, 3, "> two is here\nno"),
        (1, 4, "> another thread\nindeed"),
        (1, 5, "> yes\nso"),
        (1, 6, "> " + "long " * 50_000 + "\n" + "very " * 200_000),
        (None, 1, None),
    ]
    df = spark.createDataFrame(rows + [rows[2]], "conv_id long, turn long, text string")
    found = quotes.formatted(df)
    at = {(r.conv_id, r.turn): r for r in found.collect()}
    assert (at[1, 1].n_quotes, at[1, 1].n_linked, at[1, 1].reply_to) == (2, 2, 0)
    assert (at[1, 3].reply_to, at[1, 4].reply_to, at[1, 5].reply_to, at[1, 5].depth) == (0, 2, 1, 2)
    assert [t for (c, t), r in sorted(at.items(), key=lambda x: x[1].position) if c == 1] == [0, 1, 3, 5, 2, 4, 6]
    assert (at[1, 2].position, at[1, 4].position, at[None, 1].position) == (4, 6, 0)
    assert at[1, 6].n_quotes == 1 and len(at[1, 6].own_text) == 1_000_000 - 1
    whole = {r.conv_id: [(m.turn, m.own_text) for m in r.messages] for r in quotes.conversations(found).collect()}
    assert whole[1][:4] == [(0, rows[0][2]), (1, "yes"), (3, "no"), (5, "so")] and whole[None] == [(1, "")]


def test_quotes_take_the_latest_earlier_turn(spark, monkeypatch):
    monkeypatch.setattr(quotes, "STRETCH", 4)
    rows = [(1, k, "same words" if k % 3 == 0 else "> same words\nme") for k in range(20)]
    found = quotes.formatted(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {r.turn: r.reply_to for r in found} == {k: None if k % 3 == 0 else k - k % 3 for k in range(20)}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    x[:300] = x[0]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0, None] + [0.0] * 14), (9080, [1.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(found) == list(range(0, 1500, 20))
    hits = 0
    for q, got in found.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(1500), -score.round(9))) if i != q][:20]
        assert len(got) == 20 and all(abs(s - score[i]) < 1e-9 for i, s in got) and got == sorted(got, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in got} & set(best))
    assert hits / 20 / len(found) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0
    some = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "vec_id long, embedding array<double>")
    assert {r["count"] for r in ann.nearest(some, F.lit(True)).groupBy("query_id").count().collect()} == {20}


def exact(rows, top=20):
    """By brute force: query ids are those divisible by 20; each id counts once, at its best score; the least vector of an id asks."""
    best = {}
    for q, v in rows:
        if q % 20 == 0:
            best[q] = min(best.get(q, list(v)), list(v))
    out = []
    for q, v in best.items():
        score = {}
        for i, x in rows:
            if i != q:
                score[i] = max(score.get(i, -np.inf), float(np.dot(np.array(x), np.array(v))))
        out += [(q, k + 1, i) for k, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 9), i))[:top])]
    return sorted(out)


def test_neighbours_in_segments(spark, monkeypatch):
    for name, value in (("SEGMENT", 50), ("QUERIES", 3), ("BUNDLE", 100), ("CHUNK", 16), ("FIT", 64), ("Z", 9.0)):
        monkeypatch.setattr(ann, name, value)
    x = np.random.default_rng(6).normal(size=(400, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, probes=1000).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == exact(rows)


def test_neighbours_of_repeated_ids(spark):
    x = np.random.default_rng(8).normal(size=(200, 16)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, rows[0][1])] * 3 + [(0, rows[7][1]), (5, rows[0][1]), (6, rows[0][1])] + [(11, rows[0][1])] * 40
    rows += [(300 + i, rows[20][1]) for i in range(60)]  # more equal vectors than neighbours, queries among them
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, probes=1000).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == exact(rows)


def test_neighbours_of_many_vectors(spark, monkeypatch):
    """Recall on vectors without any clusters, and how many lists it takes."""
    monkeypatch.setattr(ann, "FIT", 2048)
    seen = {}
    probed = ann.probed
    monkeypatch.setattr(ann, "probed", lambda q, shared, probes, sizes, *rest: probed(q, shared, seen.setdefault("probes", probes), seen.setdefault("sizes", sizes), *rest))
    x = np.random.default_rng(9).normal(size=(12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(set(np.argsort(-(x @ x[q]))[1:21].tolist()) & got) for q, got in found.items())
    assert len(found) == 120 and hits / 2400 >= 0.9
    assert seen["probes"] < len(seen["sizes"]) / 2


def test_a_test_abandons_few_true_neighbours():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(500, 65)).astype(np.float32), rng.normal(size=(40, 65)).astype(np.float32)
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    radius = np.sort(d, axis=1)[:, 19]
    at, row, far = ann.scan(x, q, radius)
    within = set(zip(*np.nonzero(d <= radius[:, None] * 0.99999), strict=True))
    assert np.allclose(far, d[at, row], rtol=1e-4) and (far <= radius[at] + 1e-3).all()
    assert len(within & set(zip(at, row, strict=True))) >= 0.97 * len(within)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://Example.COM/en/12?x#y", "example.com", "/en/12", "com/en/", "block"),
        ("https://a.example.com/en/7x", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://x.net/de/", "x.net", "/de/", "net/de/", "allow"),
        ("ftp://z.org/es/", "z.org", "/es/", "org/es/", "block"),
        ("http://notcom/en/1", "notcom", "/en/1", None, None),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://h?p", "h", "", None, None),
        ("http://a.com?/en/", "a.com", "", None, None),
        ("http://spam-farm.example.org/fr/3", "spam-farm.example.org", "/fr/3", None, "block"),
    ],
)
def test_url_rules(url, host, path, rule, verdict):
    assert url_filter.host_path(url) == (host, path)
    said = MODEL.judged(host, path)
    assert said[0] == rule and verdict in (None, said[2])


MODEL = url_filter.trained()


def test_url_filter(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").withColumn("host", F.lit("x")).withColumn("_url", F.lit("y"))
    found = url_filter.filtered(pages, MODEL)
    assert found.columns == ["page_id", "url", "_url", "host", "path", "rule", "score", "verdict"]
    assert {(r.host, r.path) == url_filter.host_path(r.url) for r in found.collect()} == {True}
    kept = url_filter.allowed(pages, MODEL)
    assert kept.columns == pages.columns and {r.host for r in kept.collect()} == {"x"}
    assert url_filter.filtered(pages.where("false")).count() == 0
    rows = [(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None), (3, ""), (4, "http://" + "casino-" * 20_000 + ".com/" + "y" * 100_000), (5, "://?")]
    odd = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert odd[None] == odd[3] == odd[5] == ("", "", None, "allow") and odd[4][3] == "block" and len(odd[4][1]) == 100_001


def test_url_filter_by_brute_force(spark):
    """Hosts, paths, rules and scores written anew, over whole tables."""
    rules = {"com": ("/en/", "block"), "example.com": ("/en/7", "allow"), "net": ("/de/", "allow"), "example.net": ("/de/8", "block"), "org": ("/es/", "block")}
    verdicts = set()
    for r in queries.op6_url_filters(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url).groups() if r.url and "://" in r.url else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (r.host, r.path) == (host, path)
        labels = host.split(".")
        fits = [(name + rules[name][0], rules[name][1]) for k in range(len(labels)) if (name := ".".join(labels[k:])) in rules and path.startswith(rules[name][0])]
        score = 0.0
        if host or path:
            at = {xxhash.xxh3_64_intdigest(place + f"^{text}$"[i : i + n]) % url_filter.BUCKETS for place, text in (("h", host), ("p", path)) for n in (3, 4, 5) for i in range(len(text) + 3 - n)}
            score = 1 / (1 + np.exp(-MODEL.bias - sum(float(MODEL.weights[k]) for k in at) / len(at) ** 0.5))
        assert abs(r.score - score) < 1e-5
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "block" if score >= 0.5 else "allow")
        assert (r.rule, r.verdict) == (rule, verdict)
        verdicts.add((rule, verdict))
    assert {(None, "allow"), (None, "block"), ("com/en/", "block")} <= verdicts


def test_url_model_on_hosts_it_has_not_seen():
    table = url_filter.labelled()
    host = lambda url: url_filter.host_path(url)[0]
    held = lambda url: xxhash.xxh32_intdigest(host(url)) % 5 == 0
    model = url_filter.trained([r for r in table if not held(r[0])])
    said = [((model.score(*url_filter.host_path(u)) >= 0.5), v == "block") for u, v in table if held(u)]
    assert len(said) > 300 and np.mean([a == b for a, b in said]) > 0.95
    assert np.mean([a for a, b in said if b]) > 0.8
    ordinary = "wikipedia.org github.com arxiv.org stackoverflow.com xkcd.com bbc.co.uk debian.org python.org nasa.gov mit.edu lemonde.fr spiegel.de elpais.com nature.com archive.org nytimes.com youtube.com reddit.com"
    assert {h: round(MODEL.score(h, "/"), 2) for h in ordinary.split() if MODEL.score(h, "/") >= 0.5} == {}


def test_url_table_is_not_the_fixture(spark):
    seen = {url_filter.host_path(r.url)[0] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    mine = {url_filter.host_path(u)[0] for u, _ in url_filter.labelled()}
    first = lambda host: re.sub(r"^(www|m|blog)\.", "", host).split(".")[0]
    assert not {first(h) for h in seen} & {first(h) for h in mine}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    found = {r.v: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        seen[name] = docs.count()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == list(pipeline.COLUMNS) == before.columns[:5]
    assert seen["quality_classifier"] >= seen["line_dedup"] >= seen["ngram_jaccard_join"] > 0
    assert seen["bpe_encoding"] == seen["mixing_sources"]
    assert sum(len(r.ids) == r.n_tokens for r in docs.collect()) == seen["bpe_encoding"]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(rows):
    """Of each line held by three documents or more only the largest id's stays."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for r in rows:
        for x in {key(x) for x in (r.text or "").split("\n")}:
            held.setdefault(x, set()).add(r.doc_id)
    gone = lambda r, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != r.doc_id
    return {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if not gone(r, x)) for r in rows}


def brute_mix(rows):
    """(doc_id, text) of the mix: sources 5, 2, 1, at most 3 epochs, documents by the MD5 of their ids."""
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    of = {s: [r for r in rows if r.source == s] for s in sources}
    total = {s: sum(size[r.doc_id] for r in of[s]) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(total.values())), list(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in sources:
        budget = int(target[s] + 1e-6)
        for r in of[s]:
            if not size[r.doc_id]:
                out.append((r.doc_id, r.text))
        order = sorted((r for r in of[s] if size[r.doc_id]), key=lambda r: hashlib.md5(f"{r.doc_id}:0".encode()).hexdigest()[:15])
        while budget > 0 and order:
            for r in order:
                n = min(size[r.doc_id], budget)
                if n == size[r.doc_id]:
                    out.append((r.doc_id, r.text))
                elif n:
                    out.append((r.doc_id, r.text[: list(WORD.finditer(r.text))[n - 1].end()]))
                budget -= n
    return out


def test_pipeline_by_brute_force(spark):
    """Every stage against its definition, on the stage's own input; nothing of the code under test decides."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    out, rows = [docs], [docs.collect()]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
        rows.append(out[-1].collect())
    text = {r.doc_id: r.text for r in rows[0]}
    assert len(text) == len(rows[0])
    ids = [i for i in labels if i in text]
    scores = brute_scores(list(text.values()), [text[i] for i in ids], [labels[i] for i in ids], sum(labels.values()) / len(labels))
    assert {r.doc_id: r.text for r in rows[1]} == {d: t for (d, t), s in zip(text.items(), scores, strict=True) if s >= 0.5}
    assert {r.doc_id: r.text or "" for r in rows[2]} == brute_lines(rows[1])
    assert any(r.text != text[r.doc_id] for r in rows[2]) and all(r.n_chars == len(r.text or "") for r in rows[2])
    assert sorted(r.doc_id for r in rows[3]) == sorted({c if n else d for d, n, c in classes([(r.doc_id, r.text) for r in rows[2]])})
    assert len(rows[3]) < len(rows[2])
    assert sorted((r.doc_id, r.text or "") for r in rows[4]) == sorted((d, t or "") for d, t in brute_mix(rows[3]))
    t = tokenizing.loaded(tokenizing.default_path())
    assert sorted((r.doc_id, r.text or "") for r in rows[5]) == sorted((r.doc_id, r.text or "") for r in rows[4])
    for r in rows[5]:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), t.decode(ids, skip_special_tokens=False))


def test_stages_take_nulls_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    long = "many words of prose stand here. " * 60_000
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), (7, long, "en", "s", len(long), "z"), (1, "", None, None, 0, None), (2, "some words of prose here", "en", "s", 24, "y"), (2, "some words of prose here", "en", "s", 24, "y")], schema)
    for docs in (odd, odd.where("false")):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.columns[:5] == list(pipeline.COLUMNS)
        docs.collect()


def test_rest_does_not_need_this_folder():
    files = [p for p in Path(ROOT, "parchmint").rglob("*.py") if "llm" not in p.parts]
    assert files and not [p for p in files if "parchmint.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
    code = "import sys; sys.modules['parchmint.llm'] = None\nimport parchmint.plans.registry as r; print(len(r.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 80
