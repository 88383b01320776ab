"""Extractive summaries and insights. Sentences and words are rows; a document's rows stay together.

All of a document's words go to one place once (by doc_id); the word counts, the scores and the
choice of sentences then need no further exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from parchmint.functions import lexicons as lex
from parchmint.plans.dialect import WORD, WS, Dialect, steps

STYLES = ("concise", "detailed", "bullets", "structured")


def together(d: Dialect, source: str) -> str:
    """Rows of one doc_id in one partition."""
    return f"(SELECT {'/*+ REPARTITION(doc_id) */ ' if d.name == 'spark' else ''}* FROM ({source}))"


def sentences(d: Dialect, docs: str) -> str:
    """(doc_id, i, x): sentences of documents (doc_id, text)."""
    return d.explode(docs, d.sentences("text"), "doc_id")


def words(d: Dialect, docs: str) -> str:
    """(doc_id, si, sentence, word): lower-case words of ASCII letters, null for none."""
    token = d.filter(d.extract_all("lower(x)", f"[{WORD}]+"), lambda v: d.like(v, r"\A[a-z]+\z"))
    rows = f"(SELECT doc_id, i, x, {token} AS ws FROM {together(d, sentences(d, docs))})"
    padded = d.when((f"{d.size('ws')} = 0", d.array("CAST(NULL AS " + d.text + ")")), other="ws")
    named = f"(SELECT doc_id, i AS si, x AS sentence, {padded} AS padded FROM {rows})"
    return f"SELECT doc_id, si, sentence, word FROM ({d.explode(named, 'padded', 'doc_id, si, sentence', 'word')})"


def word_counts(d: Dialect, docs: str) -> str:
    """(doc_id, word, n): how often each word that isn't a stop word occurs in a document."""
    stop = ", ".join(d.lit(w) for w in lex.STOPWORDS)
    return f"SELECT doc_id, word, count(*) AS n FROM ({words(d, docs)}) WHERE word IS NOT NULL AND word NOT IN ({stop}) GROUP BY doc_id, word"


def scored(d: Dialect, docs: str) -> str:
    """(doc_id, i, sentence, score, n): sentences with their scores, null for those too short to choose."""
    stop = ", ".join(d.lit(w) for w in lex.STOPWORDS)
    counted = f"(SELECT *, CASE WHEN word IN ({stop}) OR word IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, word) END AS f FROM ({words(d, docs)}))"
    each = f"(SELECT doc_id, si AS i, max(sentence) AS sentence, {d.div('sum(f)', 'greatest(count(word), 1)')} AS word_score FROM {counted} GROUP BY doc_id, si)"
    sized = f"(SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {each})"
    place = d.when(("i = 0", "5"), ("i = n - 1", "3"), (f"i < n * {d.num(0.1)}", "2"), other="0")
    key = f"CASE WHEN {' OR '.join(d.any_of('lower(sentence)', lex.KEY_TERMS))} THEN 3 ELSE 0 END"
    return f"SELECT doc_id, i, sentence, n, CASE WHEN {d.len(d.strip('sentence'))} >= 10 THEN {place} + word_score + {key} END AS score FROM {sized}"


def wanted(d: Dialect, max_length: int, style: str, chars: str = "chars", n: str = "n") -> str:
    """How many sentences are chosen of n that have so many characters."""
    k = f"greatest(1, CAST(floor({max_length} / greatest({d.div(chars, n)}, {d.num(1e-9)})) AS bigint))"
    return {"detailed": f"least(CAST(floor({k} * {d.num(1.5)}) AS bigint), {n})", "concise": f"greatest(1, CAST(floor({k} * {d.num(0.7)}) AS bigint))"}.get(style, k)


def chosen(d: Dialect, docs: str, max_length: int, style: str) -> str:
    """(doc_id, summary): the best sentences in their order, joined."""
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score IS NULL, score DESC, i) AS r, sum({d.len('sentence')}) OVER (PARTITION BY doc_id) AS chars FROM ({scored(d, docs)}))"
    return f"SELECT doc_id, {d.join(d.collect('sentence', 'i'), ' ')} AS summary FROM {ranked} WHERE score IS NOT NULL AND r <= {wanted(d, max_length, style)} GROUP BY doc_id"


# Fixed value: up to how many characters words are counted one by one, in time that grows with their square; above, by sorting.
BRIEF = 1000


def totals(d: Dialect, found: str) -> str:
    """For each sentence of a list (ws: words) how often its words occur in all, added up: words are sorted for their counts, counts by sentence."""
    starts = lambda s, k: d.filter(d.range(d.size(s)), lambda i: f"{i} = 0 OR get({s}, {i} - 1).{k} <> get({s}, {i}).{k}")

    def runs(s: str, k: str, body: Callable[[str], str]) -> str:
        part = lambda at: d.map_i(at, lambda a, j: body(f"slice({s}, {a} + 1, coalesce(get({at}, {j} + 1), {d.size(s)}) - {a})"))
        return d.held((starts(s, k),), part)

    places = f"array_sort(flatten({d.map_i(found, lambda v, i: d.map(f'{v}.ws', lambda w: d.struct(w=w, i=i)))}))"
    counts = lambda s: f"flatten({runs(s, 'w', lambda run: d.held((run,), lambda r: d.map(r, lambda v: d.struct(i=f'{v}.i', f=d.size(r)))))})"
    none = d.map_i(found, lambda v, i: d.struct(i=i, f="0"))
    each = f"array_sort({d.concat_lists(none, d.held((places,), counts))})"
    return d.held((each,), lambda s: runs(s, "i", lambda run: d.fold(run, "CAST(0 AS bigint)", lambda a, v: f"{a} + {v}.f")))


def in_row(d: Dialect, text: str, max_length: int = 200) -> str:
    """The concise summary of a text, as `summaries` has it, in one expression; Spark only."""
    stop = ", ".join(d.lit(w) for w in lex.STOPWORDS)
    ascii_words = lambda s: d.filter(d.extract_all(f"lower({s})", f"([a-z]++)(?![{WORD}])|[{WORD}]++", 1), lambda v: f"{v} <> ''")
    counted = lambda s, ws: d.struct(s=s, n=d.size(ws), ws=d.filter(ws, lambda w: f"{w} NOT IN ({stop})"))
    with_words = lambda found: d.map(found, lambda s: d.held((s, ascii_words(s)), counted))
    long_enough = lambda s: f"{d.len(d.strip(s))} >= 10"
    key = lambda s: d.held((f"lower({s})",), lambda low: f"CASE WHEN {' OR '.join(d.any_of(low, lex.KEY_TERMS))} THEN 3 ELSE 0 END")

    def score(v: str, i: str, n: str, sums: str) -> str:
        place = d.when((f"{i} = 0", "5"), (f"{i} = {n} - 1", "3"), (f"{i} < {n} * {d.num(0.1)}", "2"), other="0")
        return f"CASE WHEN {long_enough(f'{v}.s')} THEN {place} + {d.div(f'get({sums}, {i})', f'greatest({v}.n, 1)')} + {key(f'{v}.s')} END"

    def one_by_one(found: str, every: str) -> str:
        return d.map(found, lambda v: d.fold(f"{v}.ws", "CAST(0 AS bigint)", lambda a, w: f"{a} + size({every}) - size(array_remove({every}, {w}))"))

    def counts(found: str) -> str:
        every = f"flatten({d.map(found, lambda v: f'{v}.ws')})"
        return d.when((f"{d.len(text)} <= {BRIEF}", d.held((found, every), one_by_one)), other=totals(d, found))

    def best(found: str, sums: str, k: str) -> str:
        n = d.size(found)
        ranked = d.filter(d.map_i(found, lambda v, i: d.struct(less=f"-{score(v, i, n, sums)}", i=i, s=f"{v}.s")), lambda v: f"{v}.less IS NOT NULL")
        top = d.slice(f"array_sort({ranked})", 1, k)
        return d.join(d.map(f"array_sort({d.map(top, lambda v: d.struct(i=f'{v}.i', s=f'{v}.s'))})", lambda v: f"{v}.s"), " ")

    cut = lambda s: d.when((f"{d.len(s)} > {max_length}", f"substr({s}, 1, {max_length - 3}) || '...'"), other=s)
    chars = lambda found: d.fold(found, "CAST(0 AS bigint)", lambda a, s: f"{a} + {d.len(s)}")
    ranked_best = lambda found, k: d.held((with_words(found),), lambda fs: d.held((fs, counts(fs), k), best))
    # Where as many are wanted as there are, none is scored.
    picked = lambda found, fit, k: d.when((f"{d.size(fit)} <= {k}", d.join(fit, " ")), other=ranked_best(found, k))
    sized = lambda found: d.held((found, d.filter(found, long_enough), wanted(d, max_length, "concise", chars(found), d.size(found))), picked)
    whole = d.held((d.held((d.sentences(text),), sized),), cut)
    return d.when((f"coalesce({d.len(text)}, 0) < 100", f"substr(coalesce({text}, ''), 1, {max_length})"), other=whole)


def bullet_points(d: Dialect, x: str) -> str:
    full = d.filter(d.strip_all(d.sentences(x)), lambda v: f"{v} <> ''")
    return d.join(d.map(full, lambda v: f"'• ' || {v} || {d.when((d.like(v, r'[.!?]' + chr(92) + 'z'), chr(39) * 2), other=d.lit('.'))}"), "\n")


# Months as dates name them.
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"


def structured(d: Dialect, x: str) -> str:
    """SUMMARY with PEOPLE, ORGANIZATIONS, LOCATIONS and DATES found in it, first occurrences first."""
    found = lambda *words: d.extract_words(x, "".join(words))
    w, gap = d.whole, f"[{WS}]+"
    name, capital = w("[A-Z][a-z]+"), w("[A-Z][a-z]*")
    people = found(f"{name}(?:{gap}{name}){{1,2}}")
    suffix = w("Inc|Corp|Co|Ltd|LLC|Company|Association|Organization")
    organizations = d.concat_lists(found(f"{capital}(?:{gap}{capital})+{gap}{suffix}"), found(w("[A-Z][A-Z]+")))
    locations = found(f"{name}(?:,{gap}{name})?")
    day, year, two = w("[0-9]{1,2}(?:st|nd|rd|th)?"), w("[0-9]{2,4}"), w("[0-9]{1,2}")
    dates = d.concat_lists(found(f"{two}[/-]{two}[/-]{year}"), found(f"{w(MONTH)}{gap}{day},?{gap}{year}"), found(f"{day}{gap}(?:{w('of')}{gap})?{w(MONTH)},?{gap}{year}"))
    nl = d.lit("\n")
    part = lambda name, xs, k: d.when((f"{d.size(xs)} > 0", f"{nl} || {nl} || '{name}:' || {nl} || {d.join(d.slice(d.distinct(xs), 1, k), ', ')}"), other="''")
    return d.strip(f"'SUMMARY:' || {nl} || {x} || {part('PEOPLE', people, 3)} || {part('ORGANIZATIONS', organizations, 3)} || {part('LOCATIONS', locations, 3)} || {part('DATES', dates, 2)}")


def summaries(d: Dialect, docs: str, max_length: int = 200, style: str = "concise") -> str:
    """(doc_id, summary) of documents (doc_id, text); short texts are their own summaries."""
    short = f"SELECT doc_id, substr(coalesce(text, ''), 1, {max_length}) AS summary FROM {docs} WHERE coalesce({d.len('text')}, 0) < 100"
    long = f"(SELECT doc_id, text FROM {docs} WHERE {d.len('text')} >= 100)"
    whole = f"(SELECT l.doc_id, coalesce(c.summary, '') AS summary FROM {long} l LEFT JOIN ({chosen(d, long, max_length, style)}) c ON l.doc_id = c.doc_id)"
    form = {"bullets": bullet_points(d, "summary"), "structured": structured(d, "summary")}.get(style, d.when((f"{d.len('summary')} > {max_length}", f"substr(summary, 1, {max_length - 3}) || '...'"), other="summary"))
    return f"SELECT doc_id, {form} AS summary FROM {whole} UNION ALL {short}"


# Markers of sentences worth reporting.
INSIGHTS = (
    r"(?i)(?:key|main|important|significant|critical)[^\n]{0,20}(?:point|fact|finding|conclusion)",
    rf"(?i)in[{WS}]+summary|to[{WS}]+summarize|in[{WS}]+conclusion|concluding|therefore",
    r"(?i)must|should|need to|have to",
    r"(?i)increase|decrease|improve|reduce|enhance|cause",
)
#: A sentence with a marker holds one of these, in small letters.
MARKS = "point fact finding conclusion summary summarize concluding therefore must should increase decrease improve reduce enhance cause".split() + ["need to", "have to"]


def insights(d: Dialect, x: str) -> list[tuple[str, str]]:
    """Steps that end in `insights`: up to five sentences with markers; with fewer than two, the first and the last as well."""
    found = d.slice(d.filter("sents_", lambda v: "(" + " OR ".join(d.like(v, p) for p in INSIGHTS) + ")"), 1, 5)
    marked = d.held((f"lower({x})",), lambda low: " OR ".join(d.any_of(low, MARKS)))  # a text without marks is left after one look
    first, last = d.at("sents_", 0), d.at("sents_", f"({d.size('sents_')} - 1)")
    add = lambda xs, v, more="": d.when((f"NOT {d.has(xs, v)}{more}", d.concat_lists(xs, d.array(v))), other=xs)
    return [
        ("sents_", d.sentences(x)),
        ("found_", d.when((marked, found), (f"{x} IS NOT NULL", d.empty())) if d.name == "spark" else found),
        ("few_", f"{d.size('found_')} < 2 AND {d.size('sents_')} > 2"),
        ("one_", d.when(("few_", add("found_", first)), other="found_")),
        ("insights", d.when(("few_", add("one_", last, f" AND {last} <> {first}")), other="one_")),
    ]


def insight_rows(d: Dialect, docs: str) -> str:
    return steps(docs, *insights(d, "text"))
