"""SQL expressions in two dialects: Spark's, which runs, and DuckDB's, which checks it.

An operator is a function of a dialect and of expressions (SQL text), and returns an expression.
Patterns keep to what Java and RE2 read alike: no look-around, no \\b, no \\w; classes are
spelled out (WORD, WS), and word edges go through Dialect.words.
"""

from __future__ import annotations

import contextlib
import itertools
import re
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from parchmint.session import finely_read, remove, shared_folder

#: Members of character classes: what a word is made of, white space, other than white space.
WORD = r"\p{L}\p{N}_"
WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
#: The same characters one by one.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_names = itertools.count()
#: Bytes of a stage's row groups before compression: what one task reads at least.
ROW_GROUP = 4 << 20

Body = Callable[..., str]


class Dialect:
    """What both dialects share; `lit` and functions that differ are below."""

    name = ""
    text, int, float = "string", "bigint", "double"

    def table(self, name: str) -> str:
        raise NotImplementedError

    def when(self, *pairs: tuple[str, str], other: str = "NULL") -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"

    def any_of(self, x: str, words: Iterable[str]) -> list[str]:
        return [f"contains({x}, {self.lit(w)})" for w in words]

    def count_true(self, conditions: Iterable[str]) -> str:
        return "(" + " + ".join(f"CAST({c} AS int)" for c in conditions) + ")"

    def strip(self, x: str) -> str:
        return self.rr(x, rf"\A[{WS}]+|[{WS}]+\z", "")

    def strip_all(self, xs: str) -> str:
        return self.map(xs, lambda v: self.strip(v))

    def cast(self, x: str, kind: str) -> str:
        return f"CAST({x} AS {kind})"

    def num(self, x: float) -> str:
        return f"CAST({x!r} AS double)"

    def rules(self, x: str, pairs: Iterable[tuple[str, str]]) -> str:
        for pattern, replacement in pairs:
            x = self.rr(x, pattern, replacement)
        return x

    def unique(self) -> str:
        return f"v{next(_names)}"

    def like_if(self, word: str, x: str, pattern: str) -> str:
        """A pattern that holds a word."""
        return self.like(x, pattern)

    def matches_start(self, x: str, pattern: str) -> str:
        return self.like(x, rf"\A(?:{pattern})")

    def once(self, source: str) -> str:
        """A source that several queries read, made once."""
        return source

    def one_space(self, x: str) -> str:
        return self.rr(x, " +", " ")

    def hyphens_joined(self, x: str) -> str:
        """Words that a hyphen and a line break part; a word takes part once."""
        return self.rr(x, rf"([{WORD}]+)-\n([{WORD}]+)", "$1$2")

    def kept_lines(self, xs: str) -> str:
        """Lines that no line kept before holds, whatever the case."""
        return self.fold(xs, self.empty(), lambda a, v: self.when((f"{self.size(self.filter(a, lambda m: f'contains(lower({m}), lower({v}))'))} = 0", self.concat_lists(a, self.array(v))), other=a))

    def stage(self, query: str) -> str:
        """A query as the source of others. A long plan is made of several: written tables, so that costly columns are made once."""
        return f"({query})"

    def stages_of(self, query: str) -> list[str]:
        """The stages that a query names."""
        return []

    def spent(self, *stages: str) -> None:
        """Stages that nothing reads any more, since what was made of them is a stage, too."""

    def nullif_blank(self, x: str) -> str:
        return f"nullif({self.strip(x)}, '')"

    def held(self, values: Iterable[str], body: Body) -> str:
        """body of values that it uses often, or once for each element of a list."""
        return body(*values)

    def paired(self, xs: str, ys: Callable[[], str], body: Body) -> str:
        """body of each element of a list and of its equal in place in another, which is as long."""
        return self.map_i(xs, lambda v, i: body(v, self.at(ys(), i)))


class Spark(Dialect):
    name = "spark"

    def __init__(self, sf_dir: str = "", spread: int = 0, session: SparkSession | None = None) -> None:
        self.sf_dir, self.spread, self.session = sf_dir, spread, session

    def table(self, name: str) -> str:
        path = f"parquet.`{self.sf_dir}/{name}.parquet`"
        return f"(SELECT /*+ REPARTITION({self.spread}) */ * FROM {path})" if self.spread else path

    def stage(self, query: str) -> str:
        if self.session is None:
            return super().stage(query)
        path = shared_folder(self.session, "stage")
        with finely_read(self.session) if self.stages_of(query) else contextlib.nullcontext():
            self.session.sql(query).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        return f"parquet.`{path}`"

    def stages_of(self, query: str) -> list[str]:
        return sorted(set(re.findall("parquet\\.`[^`]*/stage-[0-9a-f]{32}`", query)))

    def spent(self, *stages: str) -> None:
        for path in (s.removeprefix("parquet.`").removesuffix("`") for s in stages if self.session is not None):
            remove(self.session, path)

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"

    def once(self, source: str) -> str:
        return self.stage(f"SELECT * FROM {source}")

    def strip(self, x: str) -> str:
        """By characters from both ends: a pattern would try every blank within."""
        return f"trim(BOTH {self.lit(BLANKS)} FROM {x})"

    def nullif_blank(self, x: str) -> str:
        """nullif would evaluate its first argument twice."""
        v = self.unique()
        return f"get(filter(array({self.strip(x)}), {v} -> {v} <> ''), 0)"

    def held(self, values: Iterable[str], body: Body) -> str:
        """Evaluated once, and where body is: a column that stands once in an expression is put in its place, within a lambda too."""
        s, values = self.unique(), list(values)
        held = self.struct(**{f"h{k}": x for k, x in enumerate(values)})
        return f"get(transform(array({held}), {s} -> {body(*(f'{s}.h{k}' for k in range(len(values))))}), 0)"

    def paired(self, xs: str, ys: Callable[[], str], body: Body) -> str:
        v, w = self.unique(), self.unique()
        return f"zip_with({xs}, {ys()}, ({v}, {w}) -> {body(v, w)})"

    def one_space(self, x: str) -> str:
        return self.rr(x, " {2,}", " ")

    def hyphens_joined(self, x: str) -> str:
        """Hyphens are looked for, not words; a match ends with its word, so none begins right behind one."""
        return self.rr(x, rf"-\n(?<=[{WORD}]-\n)(?<!\G-\n)([{WORD}]+)", "$1")

    def kept_lines(self, xs: str) -> str:
        """What was kept is searched as one text, for a line that has no line break; lower case is made once a line."""
        start = self.struct(kept=self.empty(), text="''")
        pairs = self.map(xs, lambda v: self.struct(line=v, low=f"lower({v})"))

        def step(a: str, v: str) -> str:
            held = f"contains({a}.text, {v}.low) AND (NOT contains({v}.low, {self.lit(chr(10))}) OR exists({a}.kept, m_ -> contains(lower(m_), {v}.low)))"
            return f"if(size({a}.kept) > 0 AND {held}, {a}, {self.struct(kept=f'concat({a}.kept, array({v}.line))', text=f'{a}.text || {self.lit(chr(10))} || {v}.low')})"

        return f"aggregate({pairs}, {start}, (a_, v_) -> {step('a_', 'v_')}, a_ -> a_.kept)"

    def rr(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)})"

    def words(self, x: str, word: str, r: str) -> str:
        """Replace what matches between word edges; `word` has no groups. It is looked for first, the edge before it is dearer."""
        found = lambda x: self.rr(x, rf"(?={word})(?<![{WORD}])(?:{word})(?![{WORD}])", r.replace("$", r"\$"))
        if re.search(r"[\\()\[\]{}|?*+.^$]", word):
            return found(x)
        return self.held((x,), lambda x: self.when((f"contains({x}, {self.lit(word)})", found(x)), other=x))

    def between(self, x: str, left: str, middle: str, right: str, r: str) -> str:
        """Replace middle (it may be empty) where single characters left and right surround it; what is rarer is looked for first."""
        return self.rr(x, f"(?={middle}{right})(?<={left}){middle}", r.replace("$", r"\$"))

    def like(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.lit(p)})"

    def like_if(self, word: str, x: str, pattern: str) -> str:
        return f"(contains({x}, {self.lit(word)}) AND {self.like(x, pattern)})"

    def max_of(self, xs: str) -> str:
        return f"array_max({xs})"

    def extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def extract_all(self, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def whole(self, word: str) -> str:
        """A pattern of whole words, for extract_words."""
        return rf"(?<![{WORD}])(?:{word})(?![{WORD}])"

    def extract_words(self, x: str, p: str) -> str:
        """All matches of a pattern whose words are made by `whole`; neighbours share an edge."""
        return self.extract_all(x, p)

    def replaced_words(self, x: str, pairs: Iterable[tuple[str, str]]) -> str:
        """Whole words looked up and replaced, in one pass over the words."""
        t = self.unique()
        known = ", ".join(f"{self.lit(a)}, {self.lit(b)}" for a, b in pairs)
        return f"array_join(transform({self.extract_all(x, f'[{WORD}]+|[^{WORD}]+')}, {t} -> coalesce(element_at(map({known}), {t}), {t})), '')"

    def count(self, x: str, p: str) -> str:
        return f"regexp_count({x}, {self.lit(p)})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(re.escape(sep) if len(sep) > 1 or sep in '|.' else sep)}, -1)"

    def sentences(self, x: str) -> str:
        return f"split({x}, {self.lit(r'(?<=[.!?])[' + WS + ']+')}, -1)"

    def map(self, xs: str, body: Body) -> str:
        v = self.unique()
        return f"transform({xs}, {v} -> {body(v)})"

    def map_i(self, xs: str, body: Body) -> str:
        v, i = self.unique(), self.unique()
        return f"transform({xs}, ({v}, {i}) -> {body(v, i)})"

    def filter(self, xs: str, body: Body) -> str:
        v = self.unique()
        return f"filter({xs}, {v} -> {body(v)})"

    def fold(self, xs: str, start: str, body: Body) -> str:
        a, v = self.unique(), self.unique()
        return f"aggregate({xs}, {start}, ({a}, {v}) -> {body(a, v)})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_join({xs}, {self.lit(sep)})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def at(self, xs: str, i: str | int) -> str:
        return f"get({xs}, CAST({i} AS int))"

    def slice(self, xs: str, start: str | int, n: str | int) -> str:
        return f"slice({xs}, CAST({start} AS int), CAST({n} AS int))"

    def range(self, n: str) -> str:
        """0 to n - 1."""
        return f"if({n} > 0, sequence(0, CAST({n} AS int) - 1), CAST(array() AS array<int>))"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def empty(self, kind: str = "string") -> str:
        return f"CAST(array() AS array<{kind}>)"

    def concat_lists(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def len(self, x: str) -> str:
        return f"char_length({x})"

    def has(self, xs: str, x: str) -> str:
        return f"array_contains({xs}, {x})"

    def distinct(self, xs: str) -> str:
        return f"array_distinct({xs})"

    def common(self, xs: str, ys: str) -> str:
        """What both lists hold, each once."""
        return f"array_intersect({xs}, {ys})"

    def translate(self, x: str, a: str, b: str) -> str:
        return f"translate({x}, {self.lit(a)}, {self.lit(b)})"

    def collect(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order}, {x} AS x_))), e_ -> e_.x_)"

    def collect_structs(self, item: str, order: str) -> str:
        """Structs by rising `order`, which is their first field."""
        return f"array_sort(collect_list({item}))"

    def fixed(self, x: str, n: int) -> str:
        return f"format_string('%.{n}f', {x})"

    def explode(self, source: str, xs: str, keep: str, name: str = "x") -> str:
        """Rows (keep, i, name): one for each element."""
        return f"SELECT {keep}, i, {name} FROM (SELECT {keep}, posexplode({xs}) AS (i, {name}) FROM {source})"

    def struct_or_null(self, condition: str, **fields: str) -> str:
        return f"if({condition}, {self.struct(**fields)}, NULL)"

    def first_by(self, x: str, order: str) -> str:
        return f"min_by({x}, {order})"

    def div(self, a: str, b: str) -> str:
        return f"(CAST({a} AS double) / CAST({b} AS double))"

    def idiv(self, a: str, b: str) -> str:
        """Floor of a quotient of whole numbers that aren't negative."""
        return f"({a} div {b})"


class Duck(Dialect):
    name = "duckdb"
    text = "varchar"

    def table(self, name: str) -> str:
        return name

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def _back(self, r: str) -> str:
        return re.sub(r"(?<!\\)\$(\d)", r"\\\1", r.replace("\\$", "$")) if "\\$" not in r else re.sub(r"\$(\d)", r"\\\1", r.replace("\\$", "\0")).replace("\0", "$")

    def rr(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(self._back(r))}, 'g')"

    def words(self, x: str, word: str, r: str) -> str:
        for _ in range(2):  # neighbours share an edge
            x = f"regexp_replace({x}, {self.lit(rf'(^|[^{WORD}])(?:{word})($|[^{WORD}])')}, {self.lit(chr(92) + '1' + r + chr(92) + '2')}, 'g')"
        return x

    def between(self, x: str, left: str, middle: str, right: str, r: str) -> str:
        for _ in range(2):  # neighbours share an edge
            x = f"regexp_replace({x}, {self.lit(f'({left}){middle}({right})')}, {self.lit(chr(92) + '1' + r + chr(92) + '2')}, 'g')"
        return x

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def max_of(self, xs: str) -> str:
        return f"list_max({xs})"

    def extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def extract_all(self, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def whole(self, word: str) -> str:
        return f"\u0001(?:{word})\u0002"

    def extract_words(self, x: str, p: str) -> str:
        """Every word stands between two marks while the pattern is matched."""
        marked = f"regexp_replace({x}, {self.lit(f'([{WORD}]+)')}, {self.lit(chr(1) + chr(92) + '1' + chr(2))}, 'g')"
        return self.map(self.extract_all(marked, p), lambda v: f"replace(replace({v}, chr(1), ''), chr(2), '')")

    def replaced_words(self, x: str, pairs: Iterable[tuple[str, str]]) -> str:
        for wrong, right in pairs:
            x = self.words(x, wrong, right)
        return x

    def count(self, x: str, p: str) -> str:
        return f"len(regexp_extract_all({x}, {self.lit(p)}))"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def sentences(self, x: str) -> str:
        return f"string_split(regexp_replace({x}, {self.lit('([.!?])[' + WS + ']+')}, {self.lit(chr(92) + '1' + chr(1))}, 'g'), chr(1))"

    def map(self, xs: str, body: Body) -> str:
        v = self.unique()
        return f"list_transform({xs}, lambda {v}: {body(v)})"

    def map_i(self, xs: str, body: Body) -> str:
        v, i = self.unique(), self.unique()
        return f"list_transform({xs}, lambda {v}, {i}: {body(v, f'({i} - 1)')})"

    def filter(self, xs: str, body: Body) -> str:
        v = self.unique()
        return f"list_filter({xs}, lambda {v}: {body(v)})"

    def fold(self, xs: str, start: str, body: Body) -> str:
        a, v = self.unique(), self.unique()
        return f"list_reduce({xs}, lambda {a}, {v}: {body(a, v)}, {start})"

    def join(self, xs: str, sep: str) -> str:
        return f"coalesce(array_to_string({xs}, {self.lit(sep)}), '')"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def at(self, xs: str, i: str | int) -> str:
        return f"({xs})[CAST({i} AS int) + 1]"

    def slice(self, xs: str, start: str | int, n: str | int) -> str:
        return f"list_slice({xs}, CAST({start} AS int), CAST({start} AS int) + CAST({n} AS int) - 1)"

    def range(self, n: str) -> str:
        return f"range(CAST({n} AS int))"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def empty(self, kind: str = "string") -> str:
        return f"CAST([] AS {'varchar' if kind == 'string' else kind}[])"

    def concat_lists(self, *xs: str) -> str:
        out = xs[0]
        for x in xs[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def struct(self, **fields: str) -> str:
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def len(self, x: str) -> str:
        return f"length({x})"

    def has(self, xs: str, x: str) -> str:
        return f"list_contains({xs}, {x})"

    def common(self, xs: str, ys: str) -> str:
        return f"list_intersect({xs}, {ys})"

    def distinct(self, xs: str) -> str:
        """In order of first occurrence, as Spark's array_distinct."""
        v, i = self.unique(), self.unique()
        return f"list_filter({xs}, lambda {v}, {i}: list_position({xs}, {v}) = {i})"

    def translate(self, x: str, a: str, b: str) -> str:
        return f"translate({x}, {self.lit(a)}, {self.lit(b)})"

    def collect(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"

    def collect_structs(self, item: str, order: str) -> str:
        return f"list({item} ORDER BY {order})"

    def fixed(self, x: str, n: int) -> str:
        return f"printf('%.{n}f', {x})"

    def explode(self, source: str, xs: str, keep: str, name: str = "x") -> str:
        return f"SELECT {keep}, unnest(range(len(xs_))) AS i, unnest(xs_) AS {name} FROM (SELECT {keep}, {xs} AS xs_ FROM {source})"

    def struct_or_null(self, condition: str, **fields: str) -> str:
        return f"CASE WHEN {condition} THEN {self.struct(**fields)} END"

    def first_by(self, x: str, order: str) -> str:
        return f"arg_min({x}, {order})"

    def div(self, a: str, b: str) -> str:
        return f"(CAST({a} AS double) / CAST({b} AS double))"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"


SPARK, DUCK = Spark(), Duck()


def steps(source: str, *columns: tuple[str, str]) -> str:
    """A sub-query of source with columns added one after the other, each evaluated once."""
    for name, expression in columns:
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    return source
