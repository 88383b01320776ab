"""Queries of text repair, layout, language, summaries and extraction. One SQL for both dialects."""

from __future__ import annotations

from parchmint.functions import language, layout, repair
from parchmint.functions import lexicons as lex
from parchmint.operators import extract, summary
from parchmint.plans import fixtures
from parchmint.plans.dialect import Dialect, steps


def docs(d: Dialect) -> str:
    return f"(SELECT doc_id, text FROM {d.table('documents')})"


def lined(d: Dialect, source: str) -> str:
    return steps(source, ("lines_", layout.lines_of(d, "text")))


def flagship(d: Dialect) -> str:
    rows = steps(docs(d), ("fixed", repair.repaired(d, "text")), ("lines_", layout.lines_of(d, "fixed")), ("structure", layout.structure(d, "fixed", "lines_")), *language.language_steps(d, "fixed"), ("status", repair.status(d, "fixed", "75")))
    return f"SELECT language, structure, status, count(*) AS n_docs, sum({d.len('fixed')}) AS n_chars FROM {rows} GROUP BY language, structure, status"


def t1_repair(d: Dialect) -> str:
    return f"SELECT doc_id, {repair.repaired(d, 'text')} AS fixed FROM {docs(d)} UNION ALL SELECT doc_id, {repair.repaired(d, 'text')} AS fixed FROM {fixtures.damaged(d)}"


def t2_receipt_repair(d: Dialect) -> str:
    rows = steps(fixtures.receipts(d), ("amounts_", repair.receipt_amounts(d, "text")), ("lines_", layout.lines_of(d, "amounts_")), *repair.section_steps(d, "lines_", repair.RECEIPT_BEGIN, repair.RECEIPT_END), ("items_", d.join(repair.receipt_lines(d, "lines_"), "\n")))
    return f"SELECT doc_id, {repair.receipt_totals(d, 'items_')} AS fixed FROM {rows}"


def t3_id_card_repair(d: Dialect) -> str:
    return f"SELECT doc_id, {repair.id_card(d, 'text')} AS fixed FROM {fixtures.id_cards(d)}"


def t4_form_repair(d: Dialect) -> str:
    return f"SELECT doc_id, {repair.form(d, 'text')} AS fixed FROM {fixtures.forms(d)}"


def t5_table_repair(d: Dialect) -> str:
    rows = steps(f"(SELECT * FROM {fixtures.tables(d)} UNION ALL SELECT * FROM {fixtures.tables(d, chr(9))})", ("rows_", repair.table_rows(d, d.split("text", "\n"))))
    return f"SELECT doc_id, {d.join(repair.with_dashes(d, 'rows_'), chr(10))} AS fixed FROM {rows}"


def t7_general_repair(d: Dialect) -> str:
    both = f"(SELECT * FROM {docs(d)} UNION ALL SELECT * FROM {fixtures.damaged(d)})"
    rows = steps(both, ("basic_", repair.basic(d, "text")), ("words_", repair.common_words(d, "basic_")))
    return f"SELECT doc_id, {repair.lines_joined(d, 'words_')} AS fixed FROM {rows}"


def t8_indonesian_repair(d: Dialect) -> str:
    rows = steps(fixtures.id_cards(d), ("w_", repair.indonesian_words(d, "text")), ("n_", repair.indonesian_number(d, "w_")), ("d_", repair.indonesian_dates(d, "n_")), ("a_", repair.indonesian_address(d, "d_")))
    return f"SELECT doc_id, {repair.indonesian_labels(d, 'a_')} AS fixed FROM {rows}"


def t9_clean(d: Dialect) -> str:
    return f"SELECT doc_id, {repair.cleaned(d, 'text')} AS cleaned FROM {docs(d)}"


def t10_flatten(d: Dialect) -> str:
    return f"SELECT doc_id, {repair.flattened(d, 'text')} AS flat FROM {docs(d)}"


def t11_escape(d: Dialect) -> str:
    return f"SELECT doc_id, {repair.escaped(d, 'text')} AS escaped FROM {docs(d)}"


def t12_valid_language(d: Dialect) -> str:
    codes = f"(SELECT n_nationkey, lower(substr(n_name, 1, 3)) AS code FROM {d.table('nation')} UNION ALL SELECT n_nationkey, 'eng+' || lower(substr(n_name, 1, 3)) AS code FROM {d.table('nation')} UNION ALL SELECT 99 AS n_nationkey, 'eng+ind+chi_sim' AS code)"
    return f"SELECT n_nationkey, code, {repair.valid_language(d, 'code')} AS valid FROM {codes}"


def t13_confidence_level(d: Dialect) -> str:
    return f"SELECT l_orderkey, l_linenumber, l_quantity, {repair.confidence_level(d, 'l_quantity * 2')} AS level FROM {d.table('lineitem')}"


def e12_status(d: Dialect) -> str:
    return f"SELECT doc_id, {repair.status(d, 'text', 'CAST(doc_id % 101 AS double)')} AS status FROM {docs(d)}"


def l2_document(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.document(d, 'lines_')} AS organized FROM {lined(d, docs(d))}"


def l3_form(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.form(d, 'lines_', True)} AS organized FROM {lined(d, fixtures.forms(d))}"


def l4_receipt_sections(d: Dialect) -> str:
    return f"SELECT doc_id, organized FROM {steps(lined(d, fixtures.receipts(d)), *layout.receipt_sections(d, 'lines_'))}"


def l5_id_card(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.id_card(d, 'entries_')} AS organized FROM {steps(lined(d, fixtures.id_cards(d)), ('entries_', layout.id_card_entries(d, 'lines_')))}"


def l6_table(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.piped_table(d, 'lines_')} AS organized FROM {lined(d, fixtures.tables(d))}"


def l7_default(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.default_organization(d, 'lines_')} AS organized FROM {lined(d, docs(d))}"


def _formatted(d: Dialect, source: str) -> str:
    rows = steps(lined(d, source), ("structure", layout.structure(d, "text", "lines_")), *layout.bullet_steps(d, "lines_"))
    return f"SELECT doc_id, structure, {layout.formatted(d, 'text', 'lines_', 'structure')} AS formatted FROM {rows}"


def l8_format(d: Dialect) -> str:
    return _formatted(d, docs(d))


def l8_format_talks(d: Dialect) -> str:
    return _formatted(d, fixtures.talks(d))


def l9_structure(d: Dialect) -> str:
    every = f"(SELECT doc_id, 'd' AS kind, text FROM {d.table('documents')} UNION ALL SELECT doc_id, 't' AS kind, text FROM {fixtures.talks(d)} UNION ALL SELECT doc_id, 'p' AS kind, text FROM {fixtures.tables(d)} UNION ALL SELECT doc_id, 'f' AS kind, text FROM {fixtures.forms(d)})"
    return f"SELECT doc_id, kind, {layout.structure(d, 'text', 'lines_')} AS structure FROM {lined(d, every)}"


def l9_structure_given(d: Dialect) -> str:
    rows = f"(SELECT o_orderkey, o_orderkey % 7 = 0 AS tbl, o_orderkey % 5 = 0 AS frm, o_orderkey % 3 AS cols, CASE WHEN o_orderkey % 11 = 0 THEN 'scientific' ELSE 'document' END AS kind, o_orderkey % 4 AS paras FROM {d.table('orders')})"
    given = layout.structure_given(d, "tbl", "frm", "cols", "kind", "paras", "'mixed'")
    return f"SELECT o_orderkey, {given} AS structure FROM {rows}"


def l10_plain(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.plain(d, 'lines_')} AS formatted FROM {lined(d, docs(d))}"


def l11_paragraphs(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.paragraphs(d, 'lines_')} AS formatted FROM {lined(d, fixtures.talks(d))}"


def l12_headers(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.headers(d, 'lines_')} AS formatted FROM {lined(d, fixtures.talks(d))}"


def l13_bullets(d: Dialect) -> str:
    rows = steps(lined(d, fixtures.talks(d)), *layout.bullet_steps(d, "lines_"))
    return f"SELECT doc_id, {layout.bullets(d, 'lines_')} AS formatted FROM {rows}"


def l14_table(d: Dialect) -> str:
    rows = steps(lined(d, fixtures.tables(d)), ("rows_", layout.rows_of_table(d, "lines_")))
    return f"SELECT doc_id, {layout.table(d, 'text', 'rows_')} AS formatted FROM {rows}"


def l15_form(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.form(d, 'lines_', False)} AS formatted FROM {lined(d, fixtures.forms(d))}"


def l16_columns(d: Dialect) -> str:
    both = f"(SELECT * FROM {fixtures.talks(d)} UNION ALL SELECT * FROM {fixtures.receipts(d)})"
    return f"SELECT doc_id, {layout.columns(d, 'lines_')} AS formatted FROM {lined(d, both)}"


def l16_regions(d: Dialect) -> str:
    """Text regions by columns of 200 units, top to bottom; columns in order, a mark between."""
    regions = f"(SELECT l_orderkey, (l_partkey * 37) % 900 AS x, (l_suppkey * 13) % 200 AS w, (l_partkey * 7) % 1000 AS y, p_name AS text FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey)"
    centre = f"(x + {d.idiv('w', '2')})"
    dealt = f"(SELECT *, {d.idiv(centre, '200')} AS col FROM {regions})"
    cols = f"(SELECT l_orderkey, col, {d.join(d.collect('text', 'y, text'), chr(10) * 2)} AS part FROM {dealt} GROUP BY l_orderkey, col)"
    return f"SELECT l_orderkey, {d.join(d.collect('part', 'col'), chr(10) * 2 + '--- Next Column ---' + chr(10) * 2)} AS formatted FROM {cols} GROUP BY l_orderkey"


def l17_scientific(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.scientific(d, 'lines_')} AS formatted FROM {lined(d, docs(d))}"


def l18_default(d: Dialect) -> str:
    return f"SELECT doc_id, {layout.default_formatting(d, 'lines_')} AS formatted FROM {lined(d, docs(d))}"


def n1_language(d: Dialect) -> str:
    return f"SELECT doc_id, language FROM {steps(docs(d), *language.language_steps(d, 'text'))}"


def n2_sign_language(d: Dialect) -> str:
    return f"SELECT conv_id, turn, {language.sign_language(d, 'text')} AS language FROM {d.table('conversations')}"


def n3_summary_concise(d: Dialect) -> str:
    return summary.summaries(d, docs(d))


def n5_summary_detailed(d: Dialect) -> str:
    return summary.summaries(d, docs(d), 400, "detailed")


def n6_summary_bullets(d: Dialect) -> str:
    return summary.summaries(d, docs(d), 300, "bullets")


def n7_summary_structured(d: Dialect) -> str:
    return summary.summaries(d, docs(d), 300, "structured")


def n8_insights(d: Dialect) -> str:
    every = f"(SELECT doc_id, text FROM {d.table('documents')} UNION ALL SELECT doc_id + 1000000000 AS doc_id, 'The result must improve. ' || text AS text FROM {fixtures.talks(d)})"
    return f"SELECT doc_id, {d.join('insights', chr(10))} AS insights, {d.size('insights')} AS n FROM {summary.insight_rows(d, every)}"


def n10_sign_type(d: Dialect) -> str:
    signs = f"(SELECT page_id, url || {d.lit(chr(10))} || html AS text FROM {d.table('pages')} UNION ALL SELECT l_orderkey AS page_id, CASE l_linenumber % 4 WHEN 0 THEN 'Kantor Dinas ' WHEN 1 THEN 'promo pizza ' WHEN 2 THEN 'dijual rumah ' ELSE 'plain words ' END || {d.cast('l_linenumber', d.text)} AS text FROM {d.table('lineitem')})"
    return f"SELECT page_id, kind, {language.sign_description(d, 'text', 'kind')} AS description FROM {steps(signs, ('kind', language.sign_type(d, 'text')))}"


def n11_id_votes(d: Dialect) -> str:
    return f"SELECT doc_id, {language.keyword_votes(d, 'text', lex.ID_KEYWORDS)} AS votes, {language.keyword_votes(d, 'text', lex.ID_KEYWORDS_WIDE)} >= 2 AS is_card FROM {fixtures.id_cards(d)}"


def n12_receipt_votes(d: Dialect) -> str:
    return f"SELECT doc_id, {language.keyword_votes(d, 'text', lex.RECEIPT_KEYWORDS)} AS votes, {language.keyword_votes(d, 'text', lex.RECEIPT_KEYWORDS)} >= 2 AS is_receipt FROM {fixtures.receipts(d)}"


def a3_word_frequency(d: Dialect) -> str:
    return summary.word_counts(d, docs(d))


def _fields(source: str, fields: dict[str, str]) -> str:
    return f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in fields.items())} FROM {source}"


def e2_id_card(d: Dialect) -> str:
    return _fields(fixtures.id_cards(d), extract.id_card_fields(d, "text"))


def e3_receipt(d: Dialect) -> str:
    return _fields(fixtures.receipts(d), extract.receipt_fields(d, "text") | {"total_strict": extract.receipt_fields(d, "text", True)["total"]})


def e3_receipt_items(d: Dialect) -> str:
    rows = steps(lined(d, fixtures.receipts(d)), *extract.item_steps(d, "lines_"))
    return f"SELECT doc_id, i, item.name AS name, item.quantity AS quantity, item.price AS price FROM ({d.explode(rows, 'items', 'doc_id', 'item')})"


def e4_form(d: Dialect) -> str:
    return _fields(fixtures.forms(d), extract.form_fields(d, "text"))


def e4_form_pairs(d: Dialect) -> str:
    rows = steps(lined(d, fixtures.forms(d)), ("pairs", extract.pairs(d, "lines_")))
    return f"SELECT doc_id, i, pair.key AS key, pair.value AS value FROM ({d.explode(rows, 'pairs', 'doc_id', 'pair')})"


def e6_table(d: Dialect) -> str:
    rows = steps(f"(SELECT * FROM {fixtures.tables(d)} UNION ALL SELECT doc_id + 1000 AS doc_id, text FROM {fixtures.tables(d, chr(9))})", *extract.delimited(d, "text"))
    return f"SELECT doc_id, i, {d.at('headers', 0)} || '=' || {d.at('r', 0)} AS c0, {d.at('r', 1)} AS c1, {d.at('r', 2)} AS c2, {d.size('r')} AS n FROM ({d.explode(rows, 'cells', 'doc_id, headers', 'r')})"


def e8_generic(d: Dialect) -> str:
    rows = steps(lined(d, fixtures.forms(d)), ("pairs", extract.generic_pairs(d, "lines_")))
    return f"SELECT doc_id, i, pair.key AS key, pair.value AS value FROM ({d.explode(rows, 'pairs', 'doc_id', 'pair')})"


def e11_ktp(d: Dialect) -> str:
    """Eight fields; a card without a field's label gives its whole text."""
    return _fields(fixtures.national_cards(d), {k: f"coalesce({extract.found(d, 'text', p)}, {d.strip('text')})" for k, p in extract.KTP.items()})


def l1_organized(d: Dialect) -> str:
    kind = "CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'form' WHEN 2 THEN 'table' ELSE 'mixed' END"
    typed = f"(SELECT doc_id, text, {kind} AS image_type FROM {d.table('documents')} UNION ALL SELECT doc_id, text, 'receipt' AS image_type FROM {fixtures.receipts(d)} UNION ALL SELECT doc_id, text, 'id_card' AS image_type FROM {fixtures.id_cards(d)})"
    only = lambda of: d.when((f"image_type = '{of}'", "lines_"))
    rows = steps(lined(d, typed), ("slip_lines_", only("receipt")), *layout.receipt_sections(d, "slip_lines_"), ("card_lines_", only("id_card")), ("entries_", layout.id_card_entries(d, "card_lines_")))
    out = d.when(("image_type = 'receipt'", "organized"), ("image_type = 'id_card'", layout.id_card(d, "entries_")), other=layout.organized(d, "lines_", "image_type"))
    return f"SELECT doc_id, image_type, {out} AS organized_text FROM {rows}"


def e1_structured(d: Dialect) -> str:
    """One column for each kind of document: what its extractor finds, null for other kinds."""
    every = f"(SELECT doc_id, 'id_card' AS kind, text FROM {fixtures.id_cards(d)} UNION ALL SELECT doc_id, 'receipt' AS kind, text FROM {fixtures.receipts(d)} UNION ALL SELECT doc_id, 'form' AS kind, text FROM {fixtures.forms(d)})"
    only = lambda kind, x: f"CASE WHEN kind = '{kind}' THEN {x} END"
    card, slip, form = extract.id_card_fields(d, "text"), extract.receipt_fields(d, "text"), extract.form_fields(d, "text")
    return f"SELECT doc_id, kind, {only('id_card', card['name'])} AS name, {only('id_card', card['gender'])} AS gender, {only('receipt', slip['merchant'])} AS merchant, {only('receipt', slip['total'])} AS total, {only('form', form['company'])} AS company, {only('form', form['email'])} AS email FROM {every}"


def a4_boundaries(d: Dialect) -> str:
    """Places where words begin or end on at least two fifths of a table's lines."""
    spaced = f"(SELECT doc_id, replace(text, ' | ', '     ') AS text FROM {fixtures.tables(d)})"
    sized = f"(SELECT doc_id, {d.split('text', chr(10))} AS ls FROM {spaced})"
    each = f"(SELECT doc_id, n, {layout.word_edges(d, 'line')} AS ps FROM ({d.explode(f'(SELECT doc_id, ls, {d.size(chr(108) + chr(115))} AS n FROM {sized})', 'ls', 'doc_id, n', 'line')}))"
    votes = f"(SELECT doc_id, n, p, count(*) AS k FROM ({d.explode(each, 'ps', 'doc_id, n', 'p')}) GROUP BY doc_id, n, p)"
    return f"SELECT doc_id, CAST(p AS bigint) AS place, k FROM {votes} WHERE k >= n * {d.num(0.4)}"


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "teln" and name[1].isdigit() or name in ("a3_word_frequency", "a4_boundaries")}
