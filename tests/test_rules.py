"""Rules written anew in plain Python, held against whole queries; goldens worked by hand. No dialect, no shared expression."""

import re
from collections import Counter, defaultdict

import pytest

from parchmint.functions import language, layout, repair
from parchmint.functions import lexicons as lex
from parchmint.operators import arbitration, images, process, summary
from parchmint.plans import more_fixtures, more_queries, registry
from parchmint.plans.dialect import WS, Spark, steps
from tests.conftest import SF
from tests.test_text import LINES, both


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(sentence):
    return [w for w in re.findall(r"\w+", sentence.lower()) if re.fullmatch("[a-z]+", w)]


def summarised(text, most, style):
    """Sentences by place, mean frequency of their words, and key terms; as many as fit, in their order."""
    if len(text) < 100:
        return text[:most]
    parts = re.split(r"(?<=[.!?])\s+", text)
    often = Counter(w for s in parts for w in words(s) if w not in lex.STOPWORDS)
    score = {}
    for i, s in enumerate(parts):
        if len(s.strip()) < 10:
            continue
        own = words(s)
        place = 5 if i == 0 else 3 if i == len(parts) - 1 else 2 if i < len(parts) * 0.1 else 0
        mean = sum(often[w] for w in own) / len(own) if own else 0
        score[i] = place + mean + (3 if any(t in s.lower() for t in lex.KEY_TERMS) else 0)
    k = max(1, int(most / (sum(map(len, parts)) / len(parts))))
    k = {"detailed": min(int(k * 1.5), len(parts)), "concise": max(1, int(k * 0.7))}.get(style, k)
    best = sorted(sorted(score, key=lambda i: (-score[i], i))[:k])
    return " ".join(parts[i] for i in best)


def structured(text):
    """Names, organizations, places and dates by word boundaries, first ones first."""
    month = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    finders = {
        ("PEOPLE", 3): [r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"],
        ("ORGANIZATIONS", 3): [r"\b[A-Z][a-z]*(?:\s+[A-Z][a-z]*)+\s+(?:Inc|Corp|Co|Ltd|LLC|Company|Association|Organization)\b", r"\b[A-Z][A-Z]+\b"],
        ("LOCATIONS", 3): [r"\b[A-Z][a-z]+(?:,\s+[A-Z][a-z]+)?\b"],
        ("DATES", 2): [r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", rf"\b{month}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{2,4}}\b", rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{month},?\s+\d{{2,4}}\b"],
    }
    out = [f"SUMMARY:\n{text}"]
    for (name, most), patterns in finders.items():
        found = list(dict.fromkeys(m for p in patterns for m in re.findall(p, text)))
        if found:
            out.append(f"{name}:\n{', '.join(found[:most])}")
    return "\n\n".join(out).strip()


def test_summaries(spark):
    docs = documents(spark)
    found = {r.doc_id: r.summary for r in rows(spark, "n5_summary_detailed")}
    assert found == {d: summarised(t or "", 400, "detailed")[:397] + "..." if len(summarised(t or "", 400, "detailed")) > 400 else summarised(t or "", 400, "detailed") for d, t in docs.items()}
    found = {r.doc_id: r.summary for r in rows(spark, "n7_summary_structured")}
    assert found == {d: structured(summarised(t, 300, "structured")) if len(t or "") >= 100 else (t or "")[:300] for d, t in docs.items()}


def first(pattern, text, flags=0):
    m = re.search(pattern, text, flags)
    return (m[1].strip() or None) if m else None


def test_identity_cards(spark):
    text = {r.doc_id: r.text for r in spark.sql(f"SELECT * FROM {more_fixtures.fixtures.id_cards(Spark(SF))}").collect()}
    for r in rows(spark, "e2_id_card"):
        low = text[r.doc_id].lower()
        for field, labels in lex.ID_FIELDS.items():
            value = r"[a-zA-Z0-9\-\s]+" if field == "id_number" else r"[^\n]+"
            want = first(rf"(?:{labels})[\s:]+({value})", low) or first(rf"\b(?:{labels})\s*:\s*([^\n]+)", low) or first(rf"(?m)^\s*(?:{labels})\s+([^\n]+)", low)
            assert r[field] == want, (field, low)


def test_receipts_and_forms(spark):
    text = {r.doc_id: r.text for r in spark.sql(f"SELECT * FROM {more_fixtures.fixtures.receipts(Spark(SF))}").collect()}
    for r in rows(spark, "e3_receipt"):
        slip = text[r.doc_id]
        low = slip.lower()
        assert r.merchant == slip.split("\n")[0]
        assert r.date == first(r"(?:date|tanggal)[\s:]+([\d/\-.]+)", low) and r.time == first(r"(?:time|waktu)[\s:]+(\d{1,2}:\d{2}(?::\d{2})?)", low)
        assert r.tax == first(r"(?:tax|vat|pajak)[\s:]+\$?([\d.,]+)", low) and r.total == first(r"(?:total|amount|jumlah)[\s:]+\$?([\d.,]+)", low)
        assert r.payment_method == next((m for m in lex.PAYMENT_METHODS if m in low), None)
    text = {r.doc_id: r.text for r in spark.sql(f"SELECT * FROM {more_fixtures.fixtures.forms(Spark(SF))}").collect()}
    for r in rows(spark, "e4_form"):
        assert {f: r[f] for f in lex.FORM_FIELDS} == {f: first(rf"(?:{labels})[\s:]+([^\n]+)", text[r.doc_id], re.IGNORECASE) for f, labels in lex.FORM_FIELDS.items()}


def weighed(text, raw):
    n, signs = len(text.strip()), "".join(text.split())
    odd = sum(not c.isalnum() for c in signs) / max(1, len(signs))
    if not text.strip():
        return 0.0
    k = (0.8 if n < 20 else 0.9 if n < 50 else 1.0 if n < 100 else 1.1) * (0.8 if len(text.split()) < 3 else 0.9 if len(text.split()) < 10 else 1.0)
    return min(100.0, raw * k * (0.7 if odd > 0.4 else 0.8 if odd > 0.3 else 0.9 if odd > 0.2 else 1.0))


def test_arbitration_of_engines(spark):
    of = defaultdict(list)
    for r in spark.sql(f"SELECT * FROM {more_fixtures.candidates(Spark(SF))}").collect():
        of[r.image_id].append(r)
    found = {r.image_id: r for r in rows(spark, "o8_engines")}
    assert set(found) == set(of)
    for image, tried in of.items():
        best, engine, text, n = 0.0, "", "", 0
        for c in sorted(tried, key=lambda c: c.ord):
            n += 1
            if weighed(c.text, c.confidence) > best + 1e-9 and c.text.strip():
                best, engine, text = c.confidence, c.engine, c.text
            if c.confidence > 80 and len(c.text.strip()) > 20 and not c.is_sign:
                break
        r = found[image]
        assert (r.engine, r.text, r.confidence, r.tried, r.needs_fallback) == (engine, text, best, n, best < 30 or len(text.strip()) < 10)


STATS = {"width": 1000, "height": 1000, "ar": 1.0, "n": 12, "ed": 0.03, "c": 30.0, "br": 150.0, "bl": 1500.0, "tc": 40.0, "tl": 0.0, "fl": 0.0, "cv": 0.0, "x_groups": 1}


@pytest.mark.parametrize(
    ("stats", "kind"),
    [
        ({"c": 10.0, "ed": 0.01}, "mixed"),  # no score reaches 50
        ({"bl": 99.0, "c": 10.0, "ed": 0.01}, "low_quality"),  # 100 for blur below 100
        ({"bl": 400.0, "c": 10.0, "ed": 0.01}, "low_quality"),  # 100 - 400 / 10
        ({"width": 2000, "ar": 2.0, "c": 55.0, "cv": 25.0}, "signage"),  # 30 + 30 + 20 for shape, contrast and colour
        ({"tl": 71.0, "ar": 1.5, "n": 10}, "table"),  # over 70 wins against an identity card's 80
        ({"ar": 1.5, "n": 10}, "id_card"),  # 80
        ({"ar": 0.5, "n": 6}, "receipt"),  # 70
        ({"ed": 0.05, "c": 45.0, "tc": 75.0}, "document"),  # 60 + 20 + 20
        ({"ed": 0.05, "c": 75.0, "br": 190.0, "tc": 85.0, "bl": 200.0}, "high_contrast"),  # 80 + 20
        ({"ed": 0.03, "c": 15.0, "fl": 88.0}, "form"),  # the likelihood itself
        ({"ed": 0.055, "c": 45.0, "tc": 75.0, "ar": 0.7, "n": 16}, "book_page"),  # document 100, book page 100: the specific one
        ({"ed": 0.07, "c": 55.0, "n": 21, "x_groups": 3, "bl": 250.0}, "newspaper"),  # 50 + 30 + 20
        ({"ed": 0.03, "c": 30.0}, "handwritten"),  # handwritten 60, natural 60: the first of equals
    ],
)
def test_image_types(spark, stats, kind):
    all_ = STATS | stats
    spark.createDataFrame([tuple(all_.values())], list(all_)).createOrReplaceTempView("stats")
    from parchmint.plans.dialect import SPARK, steps

    assert spark.sql(f"SELECT image_type FROM {steps('stats', *images.type_steps(SPARK))}").first()[0] == kind


def test_layouts_by_hand(spark):
    at = lambda text, f: both(spark, text, LINES, ("out", lambda d: f(d, "lines_")))
    slip = [LINES, *[(n, lambda d, k=k: layout.receipt_sections(d, "lines_")[k][1]) for k, (n, _) in enumerate(layout.receipt_sections(Spark(), "lines_"))]]
    text = "SHOP ONE\n1 Main St\n\nITEM PRICE\nmilk 2\nbread 3\nSUBTOTAL 5\nTAX 1\nTOTAL 6\nTHANK YOU\ncome again"
    assert both(spark, text, *slip) == "SHOP ONE\n1 Main St\n\nITEMS:\n  milk 2\n  bread 3\n\nTOTALS:\nSUBTOTAL 5\nTAX 1\nTOTAL 6\n\nTHANK YOU\ncome again"
    assert at("note one\nnote two\nFIRST PART\nbody a\n\nbody b\nSECOND PART\nTHIRD PART\nend", layout.headers) == "note one\nnote two\n\nFIRST PART\n\nbody a body b\n\nSECOND PART\n\n\nTHIRD PART\n\nend"
    table = [LINES, ("rows_", lambda d: layout.rows_of_table(d, "lines_")), ("out", lambda d: layout.table(d, "text", "rows_"))]
    assert both(spark, "Prices\nname|qty\nmilk |  2\nend of it", *table) == "name | qty\n----|---\nmilk | 2"
    assert both(spark, "no table here", *table) == "no table here"
    assert both(spark, "a|b", *table) == "a | b"


@pytest.mark.parametrize("query", [more_queries.process_texts, more_queries.process_reports])
def test_scans_are_made_once(spark, monkeypatch, query):
    """Receipts are joined once, not for each engine's readings, the fallbacks and the results."""
    asked = []
    stage = Spark.stage
    monkeypatch.setattr(Spark, "stage", lambda self, query: asked.append(query) or stage(self, query))
    final = query(Spark(SF, 0, spark))
    assert sum("lineitem.parquet" in q for q in [*asked, final]) == 1


def test_quick_forms(spark):
    """Spark's own forms of stripping, joining of broken words and dropping of held lines, against plain Python."""
    d = Spark()
    texts = ["a-\nb-\nc d-\ne", "-\na", "x -\ny", "é-\nß_-\n1", "　\x85 a\x1c", "​ a\n", "a  b   c", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, x string")
    frame.createOrReplaceTempView("quick_forms")
    rows = spark.sql(f"SELECT x, {d.strip('x')} AS s, {d.hyphens_joined('x')} AS h, {d.one_space('x')} AS o FROM quick_forms").collect()
    assert [r.s for r in rows] == [x.strip() for x in texts]
    assert [r.h for r in rows] == [re.sub(r"(\w+)-\n(\w+)", r"\1\2", x) for x in texts] and [r.o for r in rows] == [re.sub(" +", " ", x) for x in texts]
    lines = ["abcd", "BC", "x\ny", "cd\nab", "d\nx", "", "Q"]
    kept = []
    for v in lines:
        kept += [v] * (not any(v.lower() in m.lower() for m in kept))
    assert spark.sql(f"SELECT {d.kept_lines(d.array(*map(d.lit, lines)))} AS k").first().k == kept


@pytest.mark.parametrize("query", ["t2_receipt_repair", "e3_receipt_items", "m4_table"])
def test_lists_are_made_once_a_text(spark, query):
    """Places of sections and of a table's rule aren't looked for again at each line of a text."""
    plan = registry.queries()[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"array_max\(filter\(filter\(transform\(|= coalesce\((?:get\()?filter\(", plan)


@pytest.mark.parametrize("brief", [0, 1000])
def test_summaries_in_rows(spark, monkeypatch, brief):
    """Summaries within a row are those of the plan that explodes words, with words counted either way."""
    monkeypatch.setattr(summary, "BRIEF", brief)
    told = "The main point is here. A b! Next one has more words than others? " * 2
    texts = [None, "", "short", "x" * 99, "x" * 100, "?" * 120, told, told + "İSTANBUL ÉCOLE the the word1 a_b. " + "k " * 60, "One same line here. " * 9, "a. b. c. d. e. f. g. h. " * 6, "  \n\x85 " * 40, "Kelvin K result " * 40, "the of and " * 20, "Long sentence without any end " * 30]
    d = Spark()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.createOrReplaceTempView("brief_texts")
    found = dict(map(tuple, spark.sql(f"SELECT doc_id, {summary.in_row(d, 'text')} FROM brief_texts").collect()))
    assert found == dict(map(tuple, spark.sql(summary.summaries(d, "brief_texts")).collect()))
    assert found == {i: (summarised(t, 200, "concise") if len(t or "") >= 100 else t or "") if len(summarised(t or "", 200, "concise")) <= 200 or len(t or "") < 100 else summarised(t, 200, "concise")[:197] + "..." for i, t in enumerate(texts)}


def test_languages_by_runs_of_letters(spark):
    """Letters counted by runs, verbs looked for where a text holds them: the same languages as letter by letter."""
    texts = [None, "", "word " * 5, "слово " * 5, "a б" * 9, "1234 " * 6, "𝒜𝒷 x" * 6, "akan 1 telah_ x akan y dan yang", "wakan datang " * 3, "have you will be there the is are and for that", "ünï cödé ñandú çà élève"]
    names = [n for n, _ in language.language_steps(Spark(), "text")]
    found = [both(spark, t, *((n, lambda d, n=n: dict(language.language_steps(d, "text"))[n]) for n in names)) for t in texts]
    assert set(found) == {"unknown", "latin", "non-latin", "en", "id"}
    assert "letters_" not in dict(language.language_steps(Spark(), "text"))["plain_"]


def test_repairs_of_what_is_there(spark):
    """Patterns that go over some texts only, against plain Python."""
    texts = ["", "1l2O3 lI1 I1I1I1 B8S5Z2 9S", "''x,,y''' `q` ,,,", "a - b* c•\n·  d+e ‣ \x85f", "a😀b 1😀l2", "noDigits4u 12ab", "TOTAI xTOTAI TOTAI_ SUBTOTAI THANI< YOU, PMT"]

    def basic(x):
        x = re.sub("[\U00010000-\U0010ffff]", "", x)
        x = re.sub(r"[*+\-‣▪•●·]\s+", "• ", re.sub(r"''|,,", '"', x).replace("`", "'"))
        for letter, digit in repair.DIGIT_TWINS.items():
            x = re.sub(rf"(?<=\d){letter}(?=\d)", digit, x)
        for pattern in (r"(?<=[a-z])(?=[A-Z])", r"(?<=[a-zA-Z])(?=\d)", r"(?<=\d)(?=[a-zA-Z])"):
            x = re.sub(pattern, " ", x)
        return re.sub(r"([.!?,:;])([A-Z0-9])", r"\1 \2", re.sub(" +", " ", x))

    def amended(x):
        for wrong, right in lex.RECEIPT_WORDS:
            x = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", right, x)
        return x

    for t in texts:
        assert both(spark, t, ("x", lambda d: repair.basic(d, "text"))) == basic(t)
        assert both(spark, t, ("x", lambda d: repair.receipt_amounts(d, "text"))) == amended(t)
    shares = [both(spark, t, ("x", lambda d: arbitration.share_of_signs(d, "text"))) for t in [*texts, "-- ## !", "ab c.d　é"]]
    assert shares == [sum(not c.isalnum() for c in "".join(t.split())) / max(1, len("".join(t.split()))) for t in [*texts, "-- ## !", "ab c.d　é"]]


def test_readings_as_lists(spark):
    """Readings in lists of their scan are arbitrated as those in rows are, without an exchange of theirs."""
    plain = Spark(SF, 0, spark)
    scans = plain.once(more_fixtures.scans(plain))
    rows_ = process.arbitrated(plain, more_fixtures.scan_candidates(plain, scans), more_fixtures.scan_fallbacks(plain, scans))
    lists = spark.sql(process.arbitrated_lists(plain, more_fixtures.scans_read(plain, scans)))
    assert "Exchange" not in lists._jdf.queryExecution().sparkPlan().toString()
    found = sorted(((r.image_id, r.engine, r.raw, r.confidence) for r in lists.collect() if r.engine is not None), key=str)
    assert found == sorted((tuple(r) for r in spark.sql(f"SELECT image_id, engine, text, confidence FROM ({rows_})").collect()), key=str)
    assert {"merged_engines", "fallback_scaled_2_psm11"} <= {e for _, e, _, _ in found}


@pytest.mark.parametrize(("process_query", "n"), [(more_queries.process_texts, 1), (more_queries.process_reports, 1)])
def test_spent_stages_are_removed(spark, monkeypatch, process_query, n):
    """Of the stages of results, those that later ones were made of are gone."""
    made, dropped = [], []
    stage, spent = Spark.stage, Spark.spent
    monkeypatch.setattr(Spark, "stage", lambda self, query: made.append(stage(self, query)) or made[-1])
    monkeypatch.setattr(Spark, "spent", lambda self, *stages: dropped.extend(stages) or spent(self, *stages))
    query = process_query(Spark(SF, 0, spark))
    left = [s for s in made if s not in dropped]
    assert len(left) == n and left[-1] in query and not any(s in query for s in dropped)
    assert spark.sql(query).count() > 0


def test_stages_are_read_by_many_tasks(spark):
    """One large file of a stage is dealt to several tasks of the next; the session's own setting comes back."""
    d, key = Spark(SF, 0, spark), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    one = d.stage("SELECT /*+ COALESCE(1) */ id, sha2(CAST(id AS string), 256) AS x FROM range(300000)")
    two = d.stage(f"SELECT * FROM {one}")
    sizes = [r.n for r in spark.sql(f"SELECT count(*) AS n FROM {two} GROUP BY input_file_name()").collect()]
    assert sum(sizes) == 300000 and max(sizes) < 150000
    assert spark.conf.get(key) == before


def test_receipt_lines_at_once(spark):
    """The parts of an item line, found in one match, are those of three; a mark in the text changes nothing."""
    lines = ["ITEMS", "cold plate 2 10.50", "tea  12", "x ,5 rest", "milk x 3.00", "milk 2 @ 3", "no amount", "", "a\u0001b 3 4.00", "\u0001\u0001", "9", "TOTAL 3", "after 1 2"]
    text = "\n".join(lines)

    def each(d):
        held = steps(f"(SELECT {d.split('text', chr(10))} AS ls_, text FROM docs)", *repair.section_steps(d, "ls_", repair.RECEIPT_BEGIN, repair.RECEIPT_END))
        return f"SELECT {d.join(repair.receipt_lines(d, 'ls_'), chr(10))} AS x FROM {held}"

    spark.createDataFrame([(text,)], "text string").createOrReplaceTempView("docs")
    found = spark.sql(each(Spark())).first().x.split("\n")

    def item(v):
        m = re.match(r"([^\n]+?)(?:\s+([0-9]+))?(?:\s+(?:x|@)\s+)?([0-9.,]+)", v)
        return f"{m[1].strip()}: {m[2] or '1'} x ${m[3]}" if m else v

    assert found == [lines[0], *map(item, lines[1:11]), *lines[11:]]
    assert "[\\s\\S]*" in each(Spark()).replace("\\\\", "\\")


def test_insights_of_texts_with_marks(spark):
    """Sentences are searched in texts that hold a mark; every marker's sentence holds one, nulls stay null."""
    texts = ["It MUST go. A b. C d.", "The key to this is a FACT! So. On.", "in  Summary, yes. No. So.", "To summarize: x. y. z.", "concluding. a. b.", "We need to go. a. b.", "They have to. a. b.", "reducED prices. a. b.", "plain. words. only.", "one", ""]
    for t in [None, *texts]:
        got = both(spark, t, *((n, lambda d, n=n: dict(summary.insights(d, "text"))[n]) for n, _ in summary.insights(Spark(), "text")))
        if t is None:
            assert got is None
        else:
            sents = re.split(r"(?<=[.!?])\s+", t)
            hits = [s for s in sents if any(re.search(p.replace(WS, r"\s"), s) for p in summary.INSIGHTS)][:5]
            more = [x for x in dict.fromkeys((sents[0], sents[-1])) if x not in hits] if len(hits) < 2 and len(sents) > 2 else []
            assert got == hits + more
    assert "cause" in dict(summary.insights(Spark(), "text"))["found_"].split("filter")[0]
