"""Character-level repair of recognised text, by document type. Expression in, expression out."""

from __future__ import annotations

from parchmint.functions import lexicons as lex
from parchmint.plans.dialect import WORD, WS, Dialect

# The letters and the digits they are read for.
#: Letters that stand for digits between digits.
DIGIT_TWINS = {"l": "1", "I": "1", "O": "0", "S": "5", "Z": "2", "B": "8"}


def basic(d: Dialect, x: str) -> str:
    """The repairs that every text gets, without line structure: planes, quotes, bullets, digits, spacing."""
    signs = "*+-‣▪•●·"
    planes = lambda x: d.rr(x, r"[\x{10000}-\x{10FFFF}]", "")
    bullets = lambda x: d.rr(x, rf"[{signs.replace('-', chr(92) + '-')}][{WS}]+", "• ")

    def digits(x: str) -> str:
        for letter, digit in DIGIT_TWINS.items():
            x = d.between(x, r"\p{Nd}", letter, r"\p{Nd}", digit)
        return x

    if d.name == "spark":  # patterns go over texts that may hold what they look for; a twin has digits on both sides, so no twin makes another
        x = d.held((x,), lambda x: d.when((f"octet_length({x}) > {d.len(x)}", planes(x)), other=x))
        x = f"replace(replace(replace({x}, {d.lit(chr(39) * 2)}, {d.lit(chr(34))}), ',,', {d.lit(chr(34))}), '`', {d.lit(chr(39))})"
        x = d.held((x,), lambda x: d.when((" OR ".join(d.any_of(x, signs)), bullets(x)), other=x))
        x = d.held((x,), lambda x: d.when((d.like(x, rf"[{''.join(DIGIT_TWINS)}](?=\p{{Nd}})(?<=\p{{Nd}}.)"), digits(x)), other=x))
    else:
        x = digits(bullets(d.rr(d.rr(planes(x), r"''|,,", '"'), "`", "'")))
    x = d.between(x, "[a-z]", "", "[A-Z]", " ")
    x = d.between(x, "[a-zA-Z]", "", r"\p{Nd}", " ")
    x = d.between(x, r"\p{Nd}", "", "[a-zA-Z]", " ")
    return d.rr(d.one_space(x), "([.!?,:;])([A-Z0-9])", "$1 $2")


def lines_joined(d: Dialect, x: str) -> str:
    return d.hyphens_joined(d.rr(x, r"\n{3,}", "\n\n"))


def repaired(d: Dialect, x: str) -> str:
    """What every text gets, whatever its type."""
    return d.strip(lines_joined(d, basic(d, x)))


def general(d: Dialect, x: str) -> str:
    """repaired, with common misread words and addresses mended; not stripped."""
    return lines_joined(d, common_words(d, basic(d, x)))


def common_words(d: Dialect, x: str) -> str:
    """Misread words mended, in one pass; texts without any of them are left after one look."""
    return d.when((" OR ".join(d.any_of(x, (w for w, _ in lex.COMMON_WORDS))), d.replaced_words(x, lex.COMMON_WORDS)), other=x)


def section_steps(d: Dialect, lines: str, begin: str, end: str, name: str = "") -> list[tuple[str, str]]:
    """Steps with the places of lines that begin and that end a section."""
    at = lambda p: d.filter(d.map_i(lines, lambda v, i: d.when((d.like(v, p), i), other="-1")), lambda k: f"{k} >= 0")
    return [(f"{name}begin_", at(begin)), (f"{name}end_", at(end))]


def in_section(d: Dialect, i: str, begin: str = "begin_", end: str = "end_") -> str:
    """Whether line i lies after a line that begins a section and not at or after one that ends it."""
    last = lambda xs, test: f"coalesce({d.max_of(d.filter(xs, test))}, -1)"
    return f"{last(begin, lambda k: f'{k} < {i}')} > {last(end, lambda k: f'{k} <= {i}')}"


# How item sections of receipts begin and end, and how an item line looks.
RECEIPT_BEGIN, RECEIPT_END = r"(?i)\A(?:ITEM|DESCRIPTION|PRODUCT|GOODS)S?", r"(?i)\A(?:SUBTOTAL|TOTAL|TAX|DISCOUNT)"
RECEIPT_LINE = rf"\A([^\n]+?)(?:[{WS}]+([0-9]+))?(?:[{WS}]+(?:x|@)[{WS}]+)?([0-9.,]+)"


def receipt_amounts(d: Dialect, x: str) -> str:
    x = d.rules(x, [(r"([0-9]+)\.([0-9]{2})([^0-9])", r"\$$1.$2$3"), (r"([0-9]+)[,.]([0-9]+)o/?", "$1.$2%")])
    for wrong, right in lex.RECEIPT_WORDS:
        x = d.words(x, wrong, right)
    return x


def receipt_lines(d: Dialect, lines: str) -> str:
    """Lines of a receipt with those of its item section (section_steps come before) rewritten as `name: quantity x $price`."""
    amount = lambda v: d.extract(v, RECEIPT_LINE, 3)
    line = lambda v, a: f"{d.strip(d.extract(v, RECEIPT_LINE, 1))} || ': ' || coalesce(nullif({d.extract(v, RECEIPT_LINE, 2)}, ''), '1') || ' x $' || {a}"
    if d.name == "spark":  # a line's three parts are found at once, between marks
        parts = lambda v: d.split(d.rr(v, RECEIPT_LINE + r"[\s\S]*\z", "$1\u0001$2\u0001$3"), "\u0001")
        joined = lambda p: f"{d.strip(d.at(p, 0))} || ': ' || coalesce(nullif({d.at(p, 1)}, ''), '1') || ' x $' || {d.at(p, 2)}"
        at_once = lambda v: d.held((parts(v),), lambda p: d.when((f"{d.size(p)} = 3", joined(p)), other=v))
        each = lambda v: d.held((amount(v),), lambda a: d.when((f"{a} <> ''", line(v, a)), other=v))  # noqa: E731 - a line that matches has an amount
        item = lambda v: d.when((f"contains({v}, '\u0001')", each(v)), other=at_once(v))
        rewrite = lambda begin, end: lambda v, i: d.when((f"{v} = '' OR {d.like(v, RECEIPT_BEGIN)}", v), (in_section(d, i, begin, end), item(v)), other=v)
    else:
        rewrite = lambda begin, end: lambda v, i: d.when((f"{v} = '' OR {d.like(v, RECEIPT_BEGIN)}", v), (f"{in_section(d, i, begin, end)} AND {d.like(v, RECEIPT_LINE)}", line(v, amount(v))), other=v)
    return d.held(("begin_", "end_"), lambda begin, end: d.map_i(lines, rewrite(begin, end)))


def receipt_totals(d: Dialect, x: str) -> str:
    for label in ("subtotal", "tax", "total"):
        rewrite = lambda x: d.rr(x, rf"(?i){label}[{WS}]*[:,]?[{WS}]*[$]?([0-9.,]+)", rf"{label.upper()}: \$$1")
        x = d.held((x,), lambda x: d.when((f"contains(lower({x}), '{label}')", rewrite(x)), other=x)) if d.name == "spark" and label == "subtotal" else rewrite(x)
    return x


def id_card(d: Dialect, x: str) -> str:
    """Labels of identity cards, their colons, grouped numbers, padded dates."""
    for wrong, right in lex.ID_WORDS:
        x = d.words(x, f"(?i:{wrong})", right)
    for label in (*lex.ID_LABELS, "NIK"):
        x = d.words(x, f"(?i:{label})", label)
    for label in lex.ID_LABELS:
        x = d.rr(x, rf"({label})[{WS}]+([^:\n]+)", "$1: $2")
    def numbered(x: str) -> str:
        digits = d.rr(d.extract(x, rf"(?i)NIK[{WS}]*:?[{WS}]*([0-9{WS}]+)", 1), " ", "")
        grouped = d.strip(d.rr(f"substr({digits}, 1, 16)", "(.{4})", "$1 "))
        marked = d.rr(x, rf"(?i)NIK[{WS}]*:?[{WS}]*[0-9{WS}]+", "NIK: \u0001")
        return d.when((f"{d.len(digits)} >= 15", f"replace({marked}, '\u0001', {grouped})"), other=x)

    return dates(d, d.held((x,), numbered))


def dates(d: Dialect, x: str) -> str:
    """Day, month and year with - between and two digits at least."""
    x = d.rr(x, r"([0-9]{1,2})[/\-.\\]([0-9]{1,2})[/\-.\\]([0-9]{2,4})", "\u0002$1-$2-$3\u0003")
    return d.rules(x, [("\u0002([0-9])-", "\u00020$1-"), ("(\u0002[0-9]{2})-([0-9])-", "$1-0$2-"), ("-([0-9]{3})\u0003", "-0$1\u0003"), ("[\u0002\u0003]", "")])


def either_case(label: str) -> str:
    """A label's words, each with a first letter of either case, any white space between."""
    return f"[{WS}]*".join(f"[{w[0].upper()}{w[0].lower()}]{w[1:]}" for w in label.split())


def form(d: Dialect, x: str) -> str:
    """Labels of forms, their colons, check boxes; the last character of a field's line moves to a new line."""
    for label in lex.FORM_LABELS:
        x = d.words(x, either_case(label), label)
    for label in lex.FORM_LABELS:
        x = d.rr(x, rf"({label})[{WS}]+([^:\n]+)", "$1: $2")
    x = d.rules(x, [(rf"\[[{WS}]*[xX✓✔][{WS}]*\]", "☑"), (rf"\[[{WS}]*\]", "☐")])
    for label in lex.FORM_LABELS:
        x = d.rr(x, rf"({label}:[{WS}]+[^\n]+)([^\n])", "$1\n$2")
    return x


def table_rows(d: Dialect, lines: str) -> str:
    """Lines of a piped or tabbed table: ` | ` between cells, empty cells dropped, a dashed line after a header."""
    rows = d.map(lines, lambda v: d.rr(d.rr(f"replace({v}, '\t', ' | ')", rf"[{WS}]*\|[{WS}]*", " | "), rf"\|[{WS}]+\|", "|"))
    return rows


def with_dashes(d: Dialect, rows: str) -> str:
    head = d.at(rows, 0)
    dashes = d.join(d.map(d.split(head, "|"), lambda v: f"repeat('-', CAST({d.len(d.strip(v))} AS int))"), "|")
    more = d.concat_lists(d.slice(rows, 1, 1), d.array(dashes), d.slice(rows, 2, d.size(rows)))
    return d.when((f"{d.size(rows)} > 1 AND contains({head}, '|') AND contains({d.at(rows, 1)}, '|')", more), other=rows)


def indonesian_words(d: Dialect, x: str) -> str:
    """Misread words, and abbreviations whose dot came with a backslash before a word."""
    for wrong, right in lex.INDONESIAN_WORDS:
        x = d.words(x, wrong, right)
    for short in lex.INDONESIAN_SHORT:
        x = d.rr(x, rf"(^|[^{WORD}]){short}\\\.([{WORD}])", f"$1{short}.$2")
    return x


def indonesian_dates(d: Dialect, x: str) -> str:
    """Valid days and months only; years of two digits below 50 are of this century."""
    x = d.rr(x, r"([0-9]{1,2})([/\-.\\])([0-9]{1,2})([/\-.\\])([0-9]{2,4})", "\u0002$1\u0006$2\u0007$3\u0006$4\u0007$5\u0003")
    day, month, sep = "0?[1-9]|[12][0-9]|3[01]", "0?[1-9]|1[0-2]", "\u0006[^\u0007]\u0007"
    x = d.rr(x, f"\u0002({day}){sep}({month}){sep}([0-9]{{2,4}})\u0003", "\u0004$1-$2-$3\u0003")
    pad = [("\u0004([0-9])-", "\u00040$1-"), ("(\u0004[0-9]{2})-([0-9])-", "$1-0$2-"), ("(\u0004[0-9]{2}-[0-9]{2})-([0-4][0-9])\u0003", "$1-20$2\u0003"), ("(\u0004[0-9]{2}-[0-9]{2})-([0-9]{2})\u0003", "$1-19$2\u0003"), ("(\u0004[0-9]{2}-[0-9]{2})-([0-9]{3})\u0003", "$1-0$2\u0003")]
    return d.rules(x, [*pad, ("[\u0002\u0003\u0004\u0006\u0007]", "")])


ADDRESS = rf"(?is)ALAMAT[{WS}]*:?[{WS}]*(.+?)(\n[{WS}]*(?:RT/RW|PROVINSI|KABUPATEN|KECAMATAN|KELURAHAN|NIK|AGAMA|[{WS}]*\z))"


def indonesian_address(d: Dialect, x: str) -> str:
    """The first address on one line, up to the next label's line."""
    found = d.strip(d.rr(d.extract(x, ADDRESS, 1), f"[{WS}]+", " "))
    return d.when((d.like(x, ADDRESS), f"replace({d.rr(x, ADDRESS, 'Alamat: \u0001$2')}, '\u0001', {found})"), other=x)


def indonesian_number(d: Dialect, x: str) -> str:
    """15 to 17 digits after NIK become 16, in groups of four."""
    label = r"(?i)(?:NIK|N[l1]K)"
    digits = d.rr(d.extract(x, rf"{label}[{WS}]*:?[{WS}]*([0-9{WS}.,]+)", 1), "[^0-9]", "")
    sixteen = f"lpad(substr({digits}, 1, 16), 16, '0')"
    grouped = d.strip(d.rr(sixteen, "(.{4})", "$1 "))
    marked = d.rr(x, rf"{label}[{WS}]*:?[{WS}]*[0-9{WS}.,]+", "NIK: \u0001")
    return d.when((f"{d.len(digits)} BETWEEN 15 AND 17", f"replace({marked}, '\u0001', {grouped})"), other=x)


def indonesian_labels(d: Dialect, x: str) -> str:
    for label in lex.INDONESIAN_LABELS:
        x = d.rr(x, rf"(?i)({label})[{WS}]+([^\n:]+)", "$1: $2")
    return x


def cleaned(d: Dialect, x: str) -> str:
    """The stand-alone cleaner: planes, three digit twins, five words, camel joins, single spaces."""
    x = d.rr(x, r"[\x{10000}-\x{10FFFF}]", "")
    for letter, digit in (("l", "1"), ("O", "0"), ("I", "1")):
        x = d.between(x, r"\p{Nd}", letter, r"\p{Nd}", digit)
    for wrong, right in lex.CLEANER_WORDS:
        x = d.words(x, wrong, right)
    x = d.between(x, "[a-z]", "", "[A-Z]", " ")
    return d.strip(d.rr(x, f"[{WS}]+", " "))


def flattened(d: Dialect, x: str) -> str:
    """For responses: one line, single spaces, no backslashes."""
    return d.strip(f"replace({d.rr(x, f'[{WS}]+', ' ')}, {d.lit(chr(92))}, '')")


def escaped(d: Dialect, x: str) -> str:
    """Markdown's own characters behind backslashes."""
    marked = d.rr(x, r"([\\`*_{}\[\]()#+\-.!])", "\u0001$1")
    return f"replace({marked}, '\u0001', {d.lit(chr(92))})"


def valid_language(d: Dialect, x: str) -> str:
    known = "|".join(lex.LANGUAGES)
    return d.like(x, rf"\A(?:{known})(?:\+(?:{known}))*\z")


def confidence_level(d: Dialect, x: str) -> str:
    return d.when((f"{x} >= 90", "'Very High'"), (f"{x} >= 75", "'High'"), (f"{x} >= 60", "'Good'"), (f"{x} >= 40", "'Moderate'"), (f"{x} >= 20", "'Low'"), other="'Very Low'")


def status(d: Dialect, text: str, confidence: str) -> str:
    return d.when((f"{confidence} < 30 OR {d.len(d.strip(text))} < 5", "'poor_quality'"), (f"{confidence} < 60", "'partial_success'"), other="'success'")
