"""URL filters: logistic regression on hashed character n-grams of host and path, after rules.

Host and path are cut out of the URL as text. A rule (host, path prefix, verdict) fits its host
and all subdomains where the URL's path starts with the rule's; the longest fitting rule decides.
All other URLs get the verdict of a logistic regression over the n-grams (NGRAMS long) of host and
path, each hashed to BUCKETS columns with its place (host or path), trained on the driver from a
small labelled URL table (labelled(), or one given). Model and rules are broadcast: BUCKETS
weights, and MAX_RULES rules at most.

Nulls: a null URL, or one without "://", has an empty host and path; with nothing to go by it is
allowed. Equal URLs get equal verdicts. Extra columns are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from parchmint.llm.common import LOWER, UPPER, keeping, per_batch, scratch

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 16
MAX_RULES = 100_000
STEPS, RATE, DECAY = 500, 4.0, 1e-5
#: How much a blocked URL of the labelled table weighs beside an allowed one.
BLOCKED = 2.0

#: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: What the labelled table's hosts are made of. Words that tell an unwanted host.
UNWANTED = (
    "casino poker slots roulette blackjack jackpot betting bets bookie lottery viagra cialis pills pharmacy meds steroids slimming porn xxx adult sex escort hookup "
    "camgirls nude fetish milf payday loans lender debt forex doubler giveaway prizes winner replica rolex fake counterfeit spam clickbait popup adserver adclick tracker "
    "malware phishing keylogger crack keygen warez torrent pirated cracked botnet followers likes backlinks linkfarm traffic miracle"
).split()
#: Words that tell a wanted one; some hold an unwanted word by chance.
WANTED = (
    "library university college school news journal museum weather recipes garden travel language lectures health hospital music film books club river town council birds code docs "
    "chess bikes poetry astronomy maps family reading science history physics biology chemistry math engineering research data software linux kernel forum wiki archive photo "
    "art design architecture opera theatre sport football tennis cycling hiking mountain lake ocean forest farm bakery coffee kitchen wine bank insurance post railway airport hotel "
    "city county government court law charity church radio television press magazine review gazette tribune times herald observer institute academy laboratory foundation society "
    "association network systems digital cloud labs studio works essex sussex cocktail analytics therapist grape scrape spelling lovers alphabet creditors specialist"
).split()
#: Words that either kind may have beside them.
BESIDE = "free best easy online top real super mega my the daily new open local first global home world smart green blue red good fast big little hot cheap".split()
#: What names without a word are made of.
HEADS, VOWELS, TAILS = "b br c ch d dr f fl g gr h j k kr l m n p pl qu r s sh st t th tr v w z wh sk".split(), "a e i o u ai ea ie oo ou".split(), "b ck d l ll m n nd ng r rs s st t x sh ble ly ter".split()
ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "co.uk", "de", "fr", "es", "ac.jp", "com.br", "biz", "ru")
FRONTS = ("", "www.", "blog.", "m.", "shop.", "news.")
PATHS = ("", "/", "/index.html", "/about", "/post/2021/03/a-title", "/category/page", "/item?id=4", "/a/b/c.php", "/user/profile", "/2019/11/04", "/search", "/download/file.zip")


def labelled() -> list[tuple[str, str]]:
    """The small labelled URL table: (url, verdict). Whatever isn't the label's word goes round both kinds alike."""
    names = []
    for verdict, words, other in (("block", UNWANTED, BESIDE), ("allow", WANTED, BESIDE)):
        for k, word in enumerate(words):
            for j in range(4):
                side = other[(5 * k + 7 * j) % len(other)]
                names += [((word + side, f"{side}-{word}", f"{word}-{side}", side + word)[(k + j) % 4], verdict)]
            second = words[(7 * k + 1) % len(words)]
            names += [(word, verdict), (f"{word}{k % 90 + 10}", verdict), (f"{word}-{second}", verdict), (f"{second}{word}", verdict)]
    part = lambda table, k: table[xxhash.xxh3_64_intdigest(f"{k}") % len(table)]
    for k in range(700):
        names.append(("".join(part(t, (k, i, j)) for i in range(k % 3 + 1) for j, t in enumerate((HEADS, VOWELS, TAILS))), "allow"))
    rows = []
    for k, (name, verdict) in enumerate(names):
        path = PATHS[k % len(PATHS)]
        # A word of the label may stand in the path, of any host.
        if k % 9 == 4:
            words = UNWANTED if verdict == "block" else WANTED
            path = f"/{words[k % len(words)]}/{k % 50}"
        rows.append((f"http://{FRONTS[k % len(FRONTS)]}{name}.{ENDS[k % 7 * 2 % len(ENDS)] if k % 2 else ENDS[k % len(ENDS)]}{path}", verdict))
    return rows


def host_path(url: str | None) -> tuple[str, str]:
    """As text: the host with A-Z lower-cased, and the path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), path[:stop]


def grams(host: str, path: str) -> set[int]:
    found = set()
    for place, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in NGRAMS:
            found.update(xxhash.xxh3_64_intdigest(f"{place}{text[i : i + n]}") % BUCKETS for i in range(len(text) - n + 1))
    return found


@dataclass
class Filter:
    """Rules by host, and the regression's weights."""

    rules: dict[str, list[tuple[str, str]]]
    weights: np.ndarray
    bias: float

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule as (host and path, verdict)."""
        best = None
        name = host
        while name:
            for prefix, verdict in self.rules.get(name, ()):
                if path.startswith(prefix) and (best is None or len(name + prefix) > len(best[0])):
                    best = (name + prefix, verdict)
            name = name.partition(".")[2]
        return best

    def score(self, host: str, path: str) -> float:
        """How likely the URL is unwanted."""
        at = list(grams(host, path))
        return float(1 / (1 + np.exp(-(self.bias + self.weights[at].sum() / np.sqrt(max(1, len(at)))))))

    def judged(self, host: str, path: str) -> tuple[str | None, float, str]:
        """Rule, score and verdict."""
        score = self.score(host, path) if host or path else 0.0
        rule = self.rule(host, path)
        return (rule[0], score, rule[1]) if rule else (None, score, "block" if score >= 0.5 else "allow")


def trained(table: Iterable[tuple[str, str]] | None = None, rules: Iterable[tuple[str, str, str]] = RULES) -> Filter:
    """Gradient descent over the whole labelled table; the same table gives the same filter."""
    rows = list(labelled() if table is None else table)
    by_host: dict[str, list[tuple[str, str]]] = {}
    for k, (host, path, verdict) in enumerate(rules):
        if k >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        by_host.setdefault(host, []).append((path, verdict))
    found = [list(grams(*host_path(url))) for url, _ in rows]
    n = np.array([len(x) for x in found], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), n)
    at = np.array([k for x in found for k in x], dtype=np.int64)
    value = 1 / np.sqrt(np.maximum(1, n))[row]
    y = np.array([verdict == "block" for _, verdict in rows], dtype=np.float64)
    weight = np.where(y > 0, BLOCKED, 1.0)
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS if rows else 0):
        margin = np.bincount(row, weights=w[at] * value, minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-margin)) - y) * weight
        w -= RATE * (np.bincount(at, weights=error[row] * value, minlength=BUCKETS) / len(rows) * 10 + DECAY * w)
        bias -= RATE * float(error.mean())
    return Filter(by_host, w.astype(np.float32), bias)


@functools.cache
def standard() -> Filter:
    """The filter of the table and rules of this module, trained once a process."""
    return trained()


RESULTS = ("host", "path", "rule", "score", "verdict")


@keeping("url", results=RESULTS)
def filtered(pages: DataFrame, model: Filter | None = None) -> DataFrame:
    """pages with host, path, rule, score and verdict added."""
    scratch(pages.sparkSession, "url_filter")
    shared = pages.sparkSession.sparkContext.broadcast(model or standard())
    new = RESULTS
    names = [c for c in pages.columns if c not in new]
    rows = pages.select(*[pages[c] for c in names], pages["url"].cast("string").alias("_url"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [host_path(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
        said = [shared.value.judged(*p) for p in parts]
        cells = [[p[0] for p in parts], [p[1] for p in parts], [s[0] for s in said], [s[1] for s in said], [s[2] for s in said]]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.float64() if n == "score" else pa.string()) for n, c in zip(new, cells, strict=True))], names=[*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "host string", "path string", "rule string", "score double", "verdict string"])
    return rows.mapInArrow(per_batch(step), schema)


@keeping("url")
def allowed(pages: DataFrame, model: Filter | None = None) -> DataFrame:
    """The rows of pages whose URLs pass."""
    return filtered(pages, model).where("verdict = 'allow'")
