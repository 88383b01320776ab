"""Documents rendered from relational rows, so that extraction can be held against the rows."""

from __future__ import annotations

from parchmint.plans.dialect import Dialect


def money(d: Dialect, x: str) -> str:
    """A double with two decimals, as text."""
    cents = f"CAST(round({x} * 100) AS bigint)"
    return f"({d.cast(d.idiv(cents, '100'), d.text)} || '.' || lpad({d.cast(f'{cents} % 100', d.text)}, 2, '0'))"


def text_of(d: Dialect, x: str) -> str:
    return d.cast(x, d.text)


def receipts(d: Dialect) -> str:
    """(doc_id, text): one for each order with lines; item lines are `name quantity price`."""
    line = f"p_name || ' ' || {text_of(d, 'CAST(l_quantity AS bigint)')} || ' ' || {money(d, 'l_extendedprice')}"
    rows = f"(SELECT l_orderkey, {line} AS line, l_extendedprice AS price FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey)"
    nl = d.lit("\n")
    bodies = f"(SELECT l_orderkey, {d.join(d.collect('line', 'line'), chr(10))} AS body, count(*) AS n FROM {rows} GROUP BY l_orderkey)"
    day = "lpad(" + text_of(d, "o_orderkey % 28 + 1") + ", 2, '0')"
    head = f"'STORE ' || {text_of(d, 'o_custkey')} || {nl} || 'Date: ' || {day} || '/04/2024' || {nl} || 'Time: 10:' || {day} || {nl} || 'ITEMS' || {nl}"
    foot = f"{nl} || 'Tax: 1.25' || {nl} || 'Total: ' || {money(d, 'o_totalprice')} || {nl} || 'paid by ' || CASE WHEN o_orderkey % 2 = 0 THEN 'visa' ELSE 'cash' END || {nl} || 'THANI< YOU'"
    return f"(SELECT o_orderkey AS doc_id, {head} || body || {foot} AS text FROM {bodies} JOIN {d.table('orders')} ON l_orderkey = o_orderkey)"


def id_cards(d: Dialect) -> str:
    nl = d.lit("\n")
    number = f"'32' || lpad({text_of(d, 'c_custkey')}, 14, '0')"
    birth = f"{text_of(d, 'c_custkey % 28 + 1')} || '/' || {text_of(d, 'c_custkey % 12 + 1')} || '/' || {text_of(d, '1960 + c_custkey % 40')}"
    text = f"'NIK : ' || {number} || {nl} || 'Name: ' || c_name || {nl} || 'address ' || n_name || {nl} || 'Gender: ' || CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END || {nl} || 'dob: ' || {birth} || {nl} || 'Occupation: ' || c_mktsegment || {nl} || 'RELIGION none' || {nl} || 'Sex M'"
    return f"(SELECT c_custkey AS doc_id, {text} AS text FROM {d.table('customer')} JOIN {d.table('nation')} ON c_nationkey = n_nationkey)"


def national_cards(d: Dialect) -> str:
    """Identity cards of one country: some labels with a colon, some without, some left out."""
    nl = d.lit("\n")
    some = lambda k, x: f"CASE WHEN c_custkey % {k} = 0 THEN '' ELSE {x} || {nl} END"
    text = f"'NIK : 32' || lpad({text_of(d, 'c_custkey')}, 14, '0') || {nl} || {some(5, chr(39) + 'Nama  ' + chr(39) + ' || c_name')} || 'Tempat/Tgl Lahir: ' || upper(n_name) || ', 01-02-1990' || {nl} || 'Jenis Kelamin: ' || CASE WHEN c_custkey % 2 = 0 THEN 'PEREMPUAN' ELSE 'LAKI-LAKI' END || {nl} || {some(3, chr(39) + 'Alamat JL ' + chr(39) + ' || c_mktsegment')} || 'Agama: none' || {nl} || 'Status Perkawinan KAWIN' || {nl} || 'Pekerjaan: ' || lower(c_mktsegment)"
    return f"(SELECT c_custkey AS doc_id, {text} AS text FROM {d.table('customer')} JOIN {d.table('nation')} ON c_nationkey = n_nationkey)"


def forms(d: Dialect) -> str:
    nl = d.lit("\n")
    text = f"'Full  Name: ' || s_name || {nl} || 'company ' || s_name || ' Ltd' || {nl} || 'Phone:  555-' || lpad({text_of(d, 's_suppkey')}, 4, '0') || {nl} || 'e-mail: s' || {text_of(d, 's_suppkey')} || '@example.com' || {nl} || 'Account balance: ' || {money(d, 'abs(s_acctbal)')} || {nl} || '[x] active [ ] closed' || {nl} || 'Date   12/05/2024' || {nl} || 'Notes   none so far'"
    return f"(SELECT s_suppkey AS doc_id, {text} AS text FROM {d.table('supplier')})"


def tables(d: Dialect, pipe: str = " | ") -> str:
    """(doc_id, text): the parts of one size as a piped table without a leading pipe."""
    p = d.lit(pipe)
    row = f"p_name || {p} || p_brand || {p} || {money(d, 'p_retailprice')}"
    head = f"{d.lit(pipe.join(('Name', 'Brand', 'Price')))} || {d.lit(chr(10) + '-----' + chr(10))}"
    return f"(SELECT CAST(p_size AS bigint) AS doc_id, {head} || {d.join(d.collect('row', 'row'), chr(10))} AS text FROM (SELECT p_size, {row} AS row FROM {d.table('part')}) GROUP BY p_size)"


def talks(d: Dialect) -> str:
    """(doc_id, text): conversations with blank lines between turns, bullets and headers."""
    nl = d.lit("\n")
    head = f"CASE WHEN turn % 3 = 0 THEN 'TURN ' || upper(role) || {nl} WHEN turn % 3 = 1 THEN '- ' ELSE {text_of(d, 'turn')} || '. ' END"
    return f"(SELECT conv_id AS doc_id, {d.join(d.collect('part', 'turn, part'), chr(10) * 2)} AS text FROM (SELECT conv_id, turn, {head} || text AS part FROM {d.table('conversations')}) GROUP BY conv_id)"


def damaged(d: Dialect) -> str:
    """(doc_id, text): order lines with letters for digits, camel joins, broken lines, odd quotes."""
    nl = d.lit("\n")
    k, p = text_of(d, "l_orderkey"), text_of(d, "l_partkey")
    text = f"'ref ' || {k} || 'l' || {p} || ' and ' || {p} || 'O' || {k} || 'S1B2 sendTo' || upper(l_returnflag) || 'now. ' || '* ' || {k} || ', `quoted'' ' || chr(39) || chr(39) || 'x,,  over-' || {nl} || 'flow' || {nl} || {nl} || {nl} || {nl} || 'tbe end:A'"
    return f"(SELECT l_orderkey AS doc_id, {text} AS text FROM {d.table('lineitem')})"
