"""Line and layout organisers, structure detection and formatters. `lines` are stripped lines."""

from __future__ import annotations

from collections.abc import Callable

from parchmint.functions import lexicons as lex
from parchmint.functions.repair import in_section, section_steps
from parchmint.plans.dialect import WORD, WS, Dialect

STRUCTURES = ("plain_text", "paragraphs", "headers_and_content", "bullet_points", "table", "form", "multi_column", "scientific", "mixed")


def lines_of(d: Dialect, x: str) -> str:
    return d.strip_all(d.split(x, "\n"))


def glued(d: Dialect, lines: str, joins: Callable[[str, str], str], piece: Callable[[str], str] = lambda v: v) -> str:
    """Lines one after the other: by a space where `joins(before, line)`, else by a line break."""
    part = lambda v, i: d.when((f"{i} = 0", piece(v)), (joins(d.at(lines, f"({i} - 1)"), v), f"' ' || {piece(v)}"), other=f"{d.lit(chr(10))} || {piece(v)}")
    return d.join(d.map_i(lines, part), "")


def plain(d: Dialect, lines: str) -> str:
    return d.join(d.filter(lines, lambda v: f"{v} <> ''"), "\n")


def default_formatting(d: Dialect, lines: str) -> str:
    """Lines of a paragraph on one line; blank lines stay."""
    return glued(d, lines, lambda a, b: f"{a} <> '' AND {b} <> ''")


def paragraphs(d: Dialect, lines: str) -> str:
    """Paragraphs on one line each, one blank line between."""
    return d.rules(default_formatting(d, lines), [(r"\n{2,}", "\n\n"), (r"\A\n+|\n+\z", "")])


def default_organization(d: Dialect, lines: str) -> str:
    """Runs of blank lines become one."""
    return d.rules(d.join(lines, "\n"), [(r"\n{3,}", "\n\n"), (r"\A\n+", "\n"), (r"\n+\z", "\n"), (r"\A\n\z", "")])


def document(d: Dialect, lines: str) -> str:
    """Paragraphs joined; list items, labels and short lines without an end stand alone."""
    alone = lambda v: f"({d.matches_start(v, r'[•\-]|[0-9]+[.)]')} OR {d.matches_start(v, rf'[A-Z][A-Z{WS}]+:?|[A-Z][A-Za-z{WS}]+:')} OR ({d.len(v)} < 40 AND NOT {d.like(v, r'[.?!]\z')}))"
    flows = lambda v: f"({v} <> '' AND NOT {alone(v)})"
    return glued(d, lines, lambda a, b: f"{flows(a)} AND {flows(b)} AND NOT ({d.matches_start(b, r'[\p{Lu}0-9]')} AND {d.like(a, r'[.!?]\z')})")


# Labels with a colon or a wide gap, headers, bullets, the note on columns; counts() and structure() hold the marks and thresholds of structures.
LABEL, GAP = rf"\A([A-Za-z{WS}]+):[{WS}]*([^\n]+)", rf"\A([A-Za-z{WS}]+)[{WS}]{{2,}}([^\n]+)"


def form(d: Dialect, lines: str, rewrite_labels: bool) -> str:
    """`Label: value` for labels with a colon (where rewritten) or a wide gap."""
    pair = lambda v, p: f"{d.strip(d.extract(v, p, 1))} || ': ' || {d.strip(d.extract(v, p, 2))}"
    return d.join(d.map(lines, lambda v: d.when((d.like(v, LABEL), pair(v, LABEL) if rewrite_labels else v), (d.like(v, GAP), pair(v, GAP)), other=v)), "\n")


def receipt_sections(d: Dialect, lines: str) -> list[tuple[str, str]]:
    """Steps that end in `organized`: header, items, totals and footer of a receipt, in this order."""
    full = d.filter(lines, lambda v: f"{v} <> ''")
    first = lambda p, least: f"coalesce({d.at(d.filter(d.range(d.size('full_')), lambda k: f'{k} >= {least} AND {d.like(d.at('full_', k), p)}'), 0)}, {d.size('full_')})"
    part = lambda a, b: d.slice("full_", f"{a} + 1", f"greatest({b} - ({a}), 0)")
    joined = lambda xs, head, before="": d.when((f"{d.size(xs)} > 0", d.join(d.concat_lists(*([d.array(d.lit(head))] if head else []), d.map(xs, lambda v: f"{d.lit(before)} || {v}") if before else xs, d.array("''")), "\n") + f" || {d.lit(chr(10))}"), other="''")
    return [
        ("full_", full),
        ("b_", first(r"(?i)\A(?:ITEM|DESCRIPTION|QTY|PRICE|-+|={5,})", "0")),
        ("e_", first(r"(?i)\A(?:SUBTOTAL|TAX|TOTAL|={5,})", "b_ + 1")),
        ("f_", first(r"(?i)\A(?:THANK|RETURN|EXCHANGE|POLICY|RECEIPT)", "e_")),
        ("head_", part("0", "b_")),
        ("items_", part("b_ + 1", "e_")),
        ("totals_", part("e_", "f_")),
        ("foot_", part("f_", d.size("full_"))),
        ("organized", d.rr(f"{joined('head_', '')} || {joined('items_', 'ITEMS:', '  ')} || {joined('totals_', 'TOTALS:')} || {d.join('foot_', chr(10))}", r"\n\z", "")),
    ]


def id_card_entries(d: Dialect, lines: str) -> str:
    """(label, value) of each line that has a label at its start or, failing that, within."""
    quoted = lambda label: d.lit(label)
    at_start = lambda v: [(d.like(v, rf"(?i)\A{label}[{WS}]*:?[{WS}]*[^\n]"), d.struct(label=quoted(label), value=d.strip(d.extract(v, rf"(?i)\A{label}[{WS}]*:?[{WS}]*([^\n]+)", 1)))) for label in lex.CARD_LABELS]
    after = lambda v, label: d.strip(d.at(d.split(d.rr(v, f"(?i){label}", "\u0001"), "\u0001"), 1))
    within = lambda v: [(f"contains(upper({v}), {quoted(label)}) AND {after(v, label)} <> ''", d.struct(label=quoted(label), value=after(v, label))) for label in lex.CARD_LABELS]
    none = d.struct(label="''", value="''")
    return d.filter(d.map(lines, lambda v: d.when(*at_start(v), *within(v), other=none)), lambda e: f"{e}.label <> ''")


def id_card(d: Dialect, entries: str) -> str:
    """Labelled lines in a fixed order, the last value of each label."""
    def line(label: str) -> str:
        own = d.filter(entries, lambda e: f"{e}.label = {d.lit(label)}")
        return f"{d.lit(label + ': ')} || {d.at(own, f'({d.size(own)} - 1)')}.value"

    number = f"coalesce({line('ID NUMBER')}, {line(lex.CARD_LABELS[11])})"
    return d.join(d.filter(d.array(line("NAME"), number, *map(line, lex.CARD_ORDER), line("SIGNATURE")), lambda v: f"{v} IS NOT NULL"), "\n")


def piped_table(d: Dialect, lines: str) -> str:
    """Rows of a piped table between outer pipes; a rule follows a first line unless one does."""
    row = lambda v: d.when((f"{v} = ''", "''"), other=d.rr(d.rr(d.rr(v, rf"[{WS}]*\|[{WS}]*", " | "), r"\A([^|])", "| $1"), r"([^|])\z", "$1 |"))
    first = row(d.at(lines, 0))
    rule = f"'|' || repeat(' --- |', CAST(len_ AS int))".replace("len_", f"{d.len(d.rr(first, r'[^|]', ''))} - 1")
    needs = f"{d.size(lines)} > 1 AND {d.at(lines, 0)} <> '' AND NOT {d.matches_start(d.at(lines, 1), '--|==')}"
    rows = d.map(lines, row)
    return d.join(d.when((needs, d.concat_lists(d.slice(rows, 1, 1), d.array(rule), d.slice(rows, 2, d.size(rows)))), other=rows), "\n")


def counts(d: Dialect, x: str) -> dict[str, str]:
    """Marks of structure in a text."""
    return {
        "bullets": d.count(x, r"(?:\A|\n)[•\-*+]"),
        "numbers": d.count(x, r"(?:\A|\n)\p{Nd}+[.)]"),
        "table_rows": d.count(x, rf"(?:\A|\n)[{WORD}{WS}]+\|[{WORD}{WS}]+\|"),
        "form_fields": d.count(x, rf"(?:\A|\n)[{WORD}{WS}]+:"),
        "headers": d.count(x, rf"(?:\A|\n)[A-Z][A-Z{WS}]+(?:\n|\z)"),
        "blank_lines": d.count(x, rf"\n[{WS}]*\n"),
        "formulas": d.count(x, r"[=+\-*/^]|sqrt|sin|cos|tan|log"),
    }


def structure(d: Dialect, x: str, lines: str) -> str:
    c = counts(d, x)
    short = d.size(d.filter(lines, lambda v: f"{d.len(v)} > 5 AND {d.len(v)} < 40"))
    return d.when(
        (f"{d.size(lines)} > 10 AND {short} > {d.size(lines)} * {d.num(0.6)}", "'multi_column'"),
        (f"{c['table_rows']} > 5", "'table'"),
        (f"{c['bullets']} + {c['numbers']} > 5", "'bullet_points'"),
        (f"{c['form_fields']} > 5", "'form'"),
        (f"{c['headers']} > 2 AND {c['blank_lines']} > 1", "'headers_and_content'"),
        (f"{c['blank_lines']} > 1", "'paragraphs'"),
        (f"{c['formulas']} > 3", "'scientific'"),
        (f"{d.len(d.strip(x))} < 100", "'plain_text'"),
        other="'mixed'",
    )


def structure_given(d: Dialect, has_table: str, has_form: str, columns: str, kind: str, n_paragraphs: str, detected: str) -> str:
    """What the layout says comes before what the text shows."""
    return d.when((has_table, "'table'"), (has_form, "'form'"), (f"{columns} > 1", "'multi_column'"), (f"{kind} = 'scientific'", "'scientific'"), (f"{n_paragraphs} > 1", "'paragraphs'"), other=detected)


CAPS, TITLE = rf"\A[A-Z][A-Z{WS}]+", r"\A[A-Z][a-z]+"


def headers(d: Dialect, lines: str) -> str:
    """From the first header on: each header between blank lines, what follows it on one line."""
    is_header = lambda v, i: f"({v} <> '' AND ({d.like(v, CAPS)} OR {d.like(v, TITLE)} OR {d.at(lines, f'({i} + 1)')} = ''))"
    marks = d.map_i(lines, lambda v, i: d.when((is_header(v, i), i), other="NULL"))
    first = f"coalesce({d.at(d.filter(marks, lambda k: f'{k} IS NOT NULL'), 0)}, {d.size(lines)})"
    heads = d.filter(d.range(d.size(lines)), lambda k: f"{k} = {first} OR ({k} > {first} AND {d.like(d.at(lines, k), CAPS)})")
    end = lambda k: f"coalesce({d.at(d.filter(heads, lambda m: f'{m} > {k}'), 0)}, {d.size(lines)})"
    body = lambda k: d.join(d.filter(d.slice(lines, f"{k} + 2", f"{end(k)} - {k} - 1"), lambda v: f"{v} <> ''"), " ")
    nl = d.lit("\n")
    parts = d.map(heads, lambda k: f"{nl} || {d.at(lines, k)} || {nl} || {d.when((f'{body(k)} <> {chr(39) * 2}', f'{nl} || {body(k)}'), other=chr(39) * 2)}")
    return d.join(d.concat_lists(d.slice(lines, 1, first), parts), "\n")


BULLET, BARE = r"\A([•\-*+]|\p{Nd}+[.)])([^\n]+)", r"\A(?:[•\-*+]|\p{Nd}+[.)])\z"


def bullet_steps(d: Dialect, lines: str) -> list[tuple[str, str]]:
    return section_steps(d, lines, BULLET, rf"\A\z|{BARE}", "bullet_")


def bullets(d: Dialect, lines: str) -> str:
    """One sign for all bullets but 1. to 9.; lines that go on an item are indented. bullet_steps come before."""
    item = lambda v: d.when((d.matches_start(v, r"[1-9]\."), d.extract(v, BULLET, 1)), other="'•'") + f" || ' ' || {d.strip(d.extract(v, BULLET, 2))}"
    line = lambda begin, end: lambda v, i: d.when((d.like(v, BULLET), item(v)), (f"{v} <> '' AND NOT {d.like(v, BARE)} AND {in_section(d, i, begin, end)}", f"'  ' || {v}"), other=v)
    return d.held(("bullet_begin_", "bullet_end_"), lambda begin, end: d.join(d.map_i(lines, line(begin, end)), "\n"))


def rows_of_table(d: Dialect, lines: str) -> str:
    """Lines with a pipe, a tab or a gap of two spaces."""
    return d.filter(lines, lambda v: rf"contains({v}, '|') OR contains({v}, {d.lit(chr(9))}) OR {d.like(v, rf'[^{WS}][{WS}]{{2,}}[^{WS}]')}")


def table(d: Dialect, x: str, rows: str) -> str:
    """Piped rows with single spaces and a dashed line after the first; other rows as they are, with one too."""
    def ruled(rows: str, neat: str) -> str:
        head = d.at(neat, 0)
        dashes = d.join(d.map(d.split(head, "|"), lambda v: f"repeat('-', CAST({d.len(d.strip(v))} AS int))"), "|")
        dashes = d.when((f"contains({head}, '|')", dashes), other=f"repeat('-', CAST({d.len(head)} AS int))")
        return d.when((f"{d.size(rows)} = 0", x), (f"{d.size(rows)} = 1", head), other=d.join(d.concat_lists(d.slice(neat, 1, 1), d.array(dashes), d.slice(neat, 2, d.size(neat))), "\n"))

    def neat(rows: str) -> str:
        piped = f"{d.size(d.filter(rows, lambda v: f'contains({v}, {chr(39)}|{chr(39)})'))} > 0"
        return d.when((piped, d.map(rows, lambda v: d.join(d.strip_all(d.split(v, "|")), " | "))), other=rows)

    return d.held((rows,), lambda rows: d.held((rows, neat(rows)), ruled))


COLUMN_NOTE = "NOTE: This text appears to be in multiple columns. The content below has been reformatted as a single column."


def columns(d: Dialect, lines: str) -> str:
    """Many short lines: paragraphs flow again under a note; otherwise paragraphs."""
    n_words = lambda v: d.count(v, f"[^{WS}]+")
    breaks = lambda a, b: f"({d.matches_start(b, r'[\p{Lu}\p{Lt}]')} AND {d.len(a)} < 30 AND ({d.like(a, r'[.!?:;]\z')} OR {n_words(a)} < 4))"
    flow = glued(d, lines, lambda a, b: f"{a} <> '' AND {b} <> '' AND NOT {breaks(a, b)}")
    short = d.size(d.filter(lines, lambda v: f"{d.len(v)} > 0 AND {d.len(v)} < 30"))
    return d.when((f"{short} > {d.size(lines)} * {d.num(0.5)}", f"{d.lit(COLUMN_NOTE + chr(10) + chr(10))} || {flow}"), other=paragraphs(d, lines))


def scientific(d: Dialect, lines: str) -> str:
    """Formulas between blank lines; other lines joined."""
    formula = lambda v: d.like(v, r"[=+\-*/^]|sqrt|sin|cos|tan|log")
    text = lambda v: f"({v} <> '' AND NOT {formula(v)})"
    nl = d.lit("\n")
    return glued(d, lines, lambda a, b: f"{text(a)} AND {text(b)}", lambda v: d.when((formula(v), f"{nl} || {v} || {nl}"), other=v))


def kept_characters(d: Dialect, x: str) -> str:
    return d.strip(d.rr(x, rf"[^{WORD}{WS}.!?,;:()\"'•\-]", ""))


def formatted(d: Dialect, x: str, lines: str, kind: str) -> str:
    """A text by its structure, with all but letters, digits, space and plain punctuation removed."""
    by = {
        "plain_text": plain(d, lines),
        "paragraphs": paragraphs(d, lines),
        "headers_and_content": headers(d, lines),
        "bullet_points": bullets(d, lines),
        "table": table(d, x, rows_of_table(d, lines)),
        "form": form(d, lines, rewrite_labels=False),
        "multi_column": columns(d, lines),
        "scientific": scientific(d, lines),
    }
    return kept_characters(d, d.when(*((f"{kind} = '{k}'", v) for k, v in by.items()), other=default_formatting(d, lines)))



def organized(d: Dialect, lines: str, image_type: str) -> str:
    """Lines organised by image type; receipts and identity cards have steps of their own."""
    return d.when((f"{image_type} IN ('document', 'book_page')", document(d, lines)), (f"{image_type} = 'form'", form(d, lines, True)), (f"{image_type} = 'table'", piped_table(d, lines)), other=default_organization(d, lines))


def word_edges(d: Dialect, line: str) -> str:
    """Places in a line where words begin or end."""
    space = lambda k: f"coalesce({d.like(f'substr({line}, CAST({k} AS int), 1)', rf'[{WS}]')} OR {k} < 1 OR {k} > {d.len(line)}, true)"
    return d.filter(d.range(f"{d.len(line)} + 1"), lambda k: f"({space(k)}) <> ({space(f'({k} + 1)')})")
