"""Hand-made goldens of text operators, in both dialects: null, empty, ties, odd spaces, other scripts."""

import duckdb
import pytest

from parchmint.functions import language, layout, markdown, repair
from parchmint.operators import aligned, arbitration, extract, summary
from parchmint.plans.dialect import DUCK, SPARK, steps
from parchmint.sources import names


def both(spark, text, *columns):
    """The last column of steps over one row (text), from either dialect."""
    spark.createDataFrame([(1, text)], "doc_id long, text string").createOrReplaceTempView("one")
    con = duckdb.connect()
    con.execute("CREATE TABLE one (doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO one VALUES (1, ?)", [text])
    out = []
    for d, run in ((SPARK, lambda q: spark.sql(q).collect()[0][0]), (DUCK, lambda q: con.execute(q).fetchall()[0][0])):
        made = [(n, f(d)) for n, f in columns]
        out.append(run(f"SELECT {made[-1][0]} FROM {steps('one', *made)}"))
    assert out[0] == out[1]
    return out[0]


def fixed(f):
    return ("out", lambda d: f(d, "text"))


LINES = ("lines_", lambda d: layout.lines_of(d, "text"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None),
        ("", ""),
        (" \t\n", ""),
        ("1l2l3 4O5 6S7 8Z9 1B1 xIy", "1 1 2 1 3 4 0 5 6 5 7 8 2 9 1 8 1 x Iy".replace("1 1 2 1 3", "11213").replace("4 0 5", "405").replace("6 5 7", "657").replace("8 2 9", "829").replace("1 8 1", "181")),
        ("camelCase abc12def", "camel Case abc 12 def"),
        ("a.B,C;1 d.e", "a. B, C; 1 d.e"),
        ("* one\n- two\n•three", "• one\n• two\n•three"),
        ("over-\nflow, naïve-\nté", "over• flow, naïve• té"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("say ''hi,, `x`", "say \"hi\" 'x'"),
        ("\U0001f600ok ", "ok"),
    ],
)
def test_repaired(spark, text, want):
    assert both(spark, text, fixed(repair.repaired)) == want


def test_typed_repairs(spark):
    steps_ = [("a_", lambda d: repair.receipt_amounts(d, "text")), ("lines_", lambda d: layout.lines_of(d, "a_")), *[(n, lambda d, k=k: repair.section_steps(d, "lines_", repair.RECEIPT_BEGIN, repair.RECEIPT_END)[k][1]) for k, n in enumerate(("begin_", "end_"))], ("i_", lambda d: d.join(repair.receipt_lines(d, "lines_"), "\n")), ("out", lambda d: repair.receipt_totals(d, "i_"))]
    assert both(spark, "SHOP\nITEMS\nMilk 2 x 3\nTea\nTOTAI 9", *steps_) == "SHOP\nITEMS\nMilk: 2 x $3\nTea\nTOTAL: $9"
    assert both(spark, "Name Budi\nNIK 3201234567890123\ntgl 1/2/99", fixed(repair.id_card)) == "NAMA: Budi\nNIK: 3201 2345 6789 0123tgl 01-02-99"
    assert both(spark, "[x] yes [ ] no", fixed(repair.form)) == "☑ yes ☐ no"
    assert both(spark, "KAB\\.BOGOR KEL\\.a KEC\\. x Narna", fixed(repair.indonesian_words)) == "KAB.BOGOR KEL.a KEC\\. x Nama"
    assert both(spark, "5/6/49 40/1/2000 05.06.51", fixed(repair.indonesian_dates)) == "05-06-2049 40/1/2000 05-06-1951"
    assert both(spark, "tbe tbe,ofthe_ x-arid ca11 frorntbe", fixed(repair.common_words)) == "the the,ofthe_ x-and call from the"
    assert both(spark, "tbe  lineIine rnay 1O2", fixed(repair.cleaned)) == "the line Iine may 102"
    assert both(spark, "a\\b \n c", fixed(repair.flattened)) == "ab c"
    assert both(spark, "a_b*c\\d.", fixed(repair.escaped)) == "a\\_b\\*c\\\\d\\."
    for code, ok in (("eng", True), ("eng+ind", True), ("eng+", False), ("xyz", False), ("", False)):
        assert both(spark, code, fixed(repair.valid_language)) is ok


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", "plain_text"),
        ("short", "plain_text"),
        ("x" * 100, "mixed"),
        ("\n".join(f"- item {i}" for i in range(6)), "bullet_points"),
        ("\n".join(f"a{i}|b|c" for i in range(6)), "table"),
        ("\n".join(f"Label: {i}" for i in range(6)), "form"),
        ("a\n\nb\n\nc", "paragraphs"),
        ("a = b + c - d * e", "scientific"),
        ("\n".join(["ten chars!"] * 11), "multi_column"),
    ],
)
def test_structure(spark, text, want):
    assert both(spark, text, LINES, ("out", lambda d: layout.structure(d, "text", "lines_"))) == want


def test_formatters(spark):
    at = lambda text, f: both(spark, text, LINES, ("out", lambda d: f(d, "lines_")))
    assert at("a\nb\n\nc", layout.default_formatting) == "a b\n\nc"
    assert at("\n\na\nb\n\n\nc\n", layout.paragraphs) == "a b\n\nc"
    assert at("\n\n a \n\n\n b", layout.default_organization) == "\na\n\nb"
    assert at("a=b\nx\ny\n\nz", layout.scientific) == "\na=b\n\nx y\n\nz"
    assert at("x\nTITLE HERE\nbody one\n\nbody two\nNEXT", layout.headers) == "x\n\nTITLE HERE\n\nbody one body two\n\nNEXT\n"
    assert at("First sentence that is long enough to flow on,\nand goes on here in a second line of text.\nShort label\n- item", layout.document).split("\n")[1:] == ["Short label", "- item"]
    assert at("a | b\nc|d", layout.piped_table) == "| a | b |\n| --- | --- |\n| c | d |"
    bullet = [LINES, *[(n, lambda d, k=k: layout.bullet_steps(d, "lines_")[k][1]) for k, n in enumerate(("bullet_begin_", "bullet_end_"))], ("out", lambda d: layout.bullets(d, "lines_"))]
    assert both(spark, "* one\ngoes on\n\nplain\n12. x\n3. y", *bullet) == "• one\n  goes on\n\nplain\n• x\n3. y"


def test_languages(spark):
    lang = lambda t: both(spark, t, *[(n, lambda d, k=k: language.language_steps(d, "text")[k][1]) for k, (n, _) in enumerate(language.language_steps(SPARK, "text"))])
    assert lang("too short") == "unknown" and lang(None) == "unknown"
    assert lang("the cat and the dog are here with you for all that they have been") == "en"
    assert lang("yang dengan dan untuk dari pada adalah ini itu dalam tidak akan pergi") == "id"
    assert lang("zzz qqq xxx vvv kkk jjj") == "latin"
    assert lang("абв где жзи клм ноп рст уфх") == "non-latin"
    assert both(spark, "Promo PIZZA", fixed(language.sign_type)) == "restaurant_promotion"
    assert both(spark, "", fixed(language.sign_type)) == "unknown"
    assert both(spark, "awas", fixed(language.sign_type)) == "warning"
    assert both(spark, "this is in to", fixed(language.sign_language)) == "eng"


def test_extraction(spark):
    field = lambda t, f, k: both(spark, t, ("out", lambda d: f(d, "text")[k]))
    slip = "My Shop\nsubtotal: 10.00\ntotal: 12.00\ntime: 10:15 PM\n1/2/2024 cash"
    assert field(slip, extract.receipt_fields, "total") == "10.00"  # the subtotal's line wins
    assert both(spark, slip, ("out", lambda d: extract.receipt_fields(d, "text", True)["total"])) == "12.00"
    assert field(slip, extract.receipt_fields, "time") == "10:15"
    assert field(slip, extract.receipt_fields, "date") == "1/2/2024"
    assert field(slip, extract.receipt_fields, "payment_method") == "cash"
    assert field("", extract.receipt_fields, "merchant") is None
    assert field("Name: A B\nDOB : 1 May", extract.id_card_fields, "date_of_birth") == "1 may"
    assert field("E-Mail: a@b.c", extract.form_fields, "email") == "a@b.c"
    items = [LINES, *[(n, lambda d, k=k: extract.item_steps(d, "lines_")[k][1]) for k, n in enumerate(("begin_", "end_", "items"))], ("out", lambda d: d.join(d.map("items", lambda v: f"{v}.name || '/' || {v}.quantity || '/' || {v}.price"), ";"))]
    assert both(spark, "x\nItems\nMilk 2 3.50\nTea $4\n2 x Jam 3.50\nBread\nTotal 9\nafter", *items) == "Milk/2/3.50;Tea/1/4;2 x Jam/1/3.50;Bread/1/0.00"


def test_summaries(spark):
    text = "The key result came first in this long document. " + "Filler words stand here and there without meaning at all. " * 3 + "The last one ends it."
    spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "doc_id long, text string").createOrReplaceTempView("docs")
    found = {r.doc_id: r.summary for r in spark.sql(summary.summaries(SPARK, "docs")).collect()}
    assert found[2] == "short" and found[3] == found[4] == ""
    assert found[1].startswith("The key result") and len(found[1]) <= 200
    bullets = both(spark, "One. Two! three", fixed(summary.bullet_points))
    assert bullets == "• One.\n• Two!\n• three."
    said = both(spark, "Anna Maria met NATO on 1/2/2024.", fixed(summary.structured))
    assert "PEOPLE:\nAnna Maria" in said and "ORGANIZATIONS:\nNATO" in said and "DATES:\n1/2/2024" in said
    said = both(spark, "Officials of NATO IBM UN met in Paris London Rome, Italy on 3rd of May 2020 or May 4, 2021.", fixed(summary.structured))
    part = lambda name: said.split(f"{name}:\n")[1].split("\n")[0]
    assert (part("PEOPLE"), part("ORGANIZATIONS")) == ("Paris London Rome", "NATO, IBM, UN")
    assert (part("LOCATIONS"), part("DATES")) == ("Officials, Paris, London", "May 4, 2021, 3rd of May 2020")
    assert "ORGANIZATIONS:\nAcme Steel Corp, A B Inc" in both(spark, "the Acme Steel Corp and A B Inc Bo Corporation", fixed(summary.structured))
    assert both(spark, "xAnna Maria aNATO 1/2/20245 _Rome", fixed(summary.structured)) == "SUMMARY:\nxAnna Maria aNATO 1/2/20245 _Rome\n\nLOCATIONS:\nMaria"
    steps_ = [(n, lambda d, k=k: summary.insights(d, "text")[k][1]) for k, (n, _) in enumerate(summary.insights(SPARK, "text"))]
    assert both(spark, "A first. We must go. Nothing. The end.", *steps_) == ["We must go.", "A first.", "The end."]


def test_markdown(spark):
    assert both(spark, "a.b\n\n\n\n c ", fixed(markdown.regular)) == "a\\.b\n\nc\n"
    assert both(spark, "place/dob of_BIRTH", fixed(markdown.title)) == "Place/Dob Of_Birth"
    table = [LINES, *[(n, lambda d, k=k: markdown.table_steps(d, "text", "lines_")[k][1]) for k, (n, _) in enumerate(markdown.table_steps(SPARK, "text", "lines_"))]]
    assert both(spark, "title\na   b\nc   d", *table) == "title\n| a | b |\n|---|---|\n| c | d |"


def test_names(spark):
    assert both(spark, "a.b.PNG", fixed(names.extension)) == "png" and both(spark, "none", fixed(names.extension)) == ""
    assert both(spark, "x.jpeg", fixed(names.allowed)) is True and both(spark, "jpeg", fixed(names.allowed)) is False
    assert both(spark, 'a<b>:"/\\|?*.md', fixed(names.safe)) == "a_b________.md"
    assert len(both(spark, "n" * 300 + ".txt", fixed(names.safe))) == 255


def test_weighted(spark):
    at = lambda t: both(spark, t, ("out", lambda d: arbitration.weighted(d, "text", "CAST(90 AS double)")))
    assert at("") == 0 and at(" \n") == 0
    assert at("ok") == pytest.approx(90 * 0.8 * 0.8)
    assert at("word " * 30) == pytest.approx(90 * 1.1)
    assert at("#### ####") == pytest.approx(90 * 0.8 * 0.8 * 0.7)


def test_aligned_tables():
    text = "name   qty\n-----  ---\nmilk   2\nrye    10"
    assert aligned.table(text) == (["name", "qty"], [{"name": "milk", "qty": "2"}, {"name": "rye", "qty": "10"}])
    assert aligned.table("") == ([], [])
    assert aligned.with_pipes("aa        bb\ncc        dd\nee        ff").count("|") > 3 and aligned.with_pipes("a\nb") == "a\nb"
    spaced_ = "name   qty   price\nmilk   two   3.50\n\nryes   ten   4"
    assert aligned.organized_table(spaced_) == "| name | qty | price |\n| --- | --- | --- |\n| milk | two | 3.50 |\n\n| ryes | ten | 4 |"
    # A bound is where the first gap of its column begins, so it may cut a longer word.
    assert aligned.organized_table("name  qty\nrye   two\nx") == "| nam | e  qty |\n| --- | --- |\n| rye | two |\n| x |"
    assert aligned.organized_table(" a  b \nc") == "a  b\nc"
    assert aligned.formatted_table("Prices\n" + spaced_) == "name | qty | price\n----|---|-----\nmilk | two | 3.50\nryes | ten | 4"
    assert aligned.formatted_table("nothing here") == "nothing here"
    assert aligned.any_table("a|b\n---\n1|2")[1] == aligned.any_table("a\tb\n1\t2")[1] == aligned.any_table("a    b\n1    2")[1] == [{"a": "1", "b": "2"}]


def test_national_cards(spark):
    field = lambda t, k: both(spark, t, ("out", lambda d: f"coalesce({extract.found(d, 'text', extract.KTP[k])}, {d.strip('text')})"))
    card = "NIK : 3201 2345\nNama\tBUDI S\nTempat/Tgl Lahir: BOGOR, 1-2-90\nJenis Kelamin: PRIA\nStatus  Perkawinan KAWIN\nAgama :X"
    assert (field(card, "nik"), field(card, "name"), field(card, "place_dob")) == ("3201 2345", "BUDI S", "BOGOR, 1-2-90")
    assert (field(card, "gender"), field(card, "marital_status"), field(card, "religion")) == ("Kelamin: PRIA", "KAWIN", "X")
    assert field(card, "address") == card
