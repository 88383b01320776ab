"""Statistics of runs and the state of tasks."""

from __future__ import annotations

from parchmint.plans.dialect import Dialect


def usable(runs: str) -> str:
    return f"(SELECT * FROM {runs} WHERE status IS NOT NULL AND image_type IS NOT NULL AND engine IS NOT NULL)"


def by_type(d: Dialect, runs: str) -> str:
    """Runs (seq, status, image_type, engine, seconds): counts and successes of each type."""
    return f"SELECT image_type, count(*) AS n, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS n_success FROM {usable(runs)} GROUP BY image_type"


def last_times(d: Dialect, runs: str, keep: int = 10) -> str:
    """Seconds of the last runs of each type and engine, in order."""
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY image_type, engine ORDER BY seq DESC) AS r FROM {usable(runs)})"
    return f"SELECT image_type, engine, {d.join(d.map(d.collect('seconds', 'seq'), lambda v: d.fixed(v, 2)), ',')} AS times, count(*) AS n FROM {ranked} WHERE r <= {keep} GROUP BY image_type, engine"


def success_rates(d: Dialect, runs: str) -> str:
    """A moving rate of each type and engine: begun with the type's rate at its first run, then 0.7 old + 0.3 new."""
    ok = "sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY image_type ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    n = "count(*) OVER (PARTITION BY image_type ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    rated = f"(SELECT *, {d.div(ok, n)} AS rate FROM {usable(runs)})"
    item = d.struct(seq="seq", hit=f"CASE WHEN status = 'success' THEN {d.num(1.0)} ELSE {d.num(0.0)} END", rate="rate")
    grouped = f"(SELECT image_type, engine, {d.collect_structs(item, 'seq')} AS xs FROM {rated} GROUP BY image_type, engine)"
    fold = d.fold(d.slice("xs", 2, f"greatest({d.size('xs')} - 1, 0)"), f"{d.at('xs', 0)}.rate * {d.num(0.7)} + {d.at('xs', 0)}.hit * {d.num(0.3)}", lambda a, v: f"{a} * {d.num(0.7)} + {v}.hit * {d.num(0.3)}")
    return f"SELECT image_type, engine, {fold} AS success_rate FROM {grouped}"


# Sizes in bytes; the seconds in timeout() and status() are fixed values too.
LARGE, SMALL = 5 * 1024 * 1024, 1024 * 1024


def process_type(d: Dialect) -> str:
    """Columns asked, image_type, as_sign, is_large."""
    return d.when(("image_type = 'handwritten'", "'handwritten'"), ("image_type = 'signage' OR as_sign", "'signage'"), ("image_type = 'id_card'", "'id_card'"), ("image_type = 'table'", "'accurate'"), ("is_large", "'fast'"), other="asked")


def timeout(d: Dialect, kind: str, size: str, default: str) -> str:
    return d.when((f"{kind} = 'fast'", f"least({default}, 60)"), (f"{kind} = 'handwritten'", f"greatest({default}, 300)"), (f"{kind} = 'id_card'", f"greatest({default}, 600)"), (f"{size} > {LARGE}", f"greatest({default}, 240)"), other=default)


def mode(d: Dialect, kind: str, size: str) -> str:
    return d.when((f"{size} < {SMALL} OR {kind} = 'fast'", "'sync'"), other="'async'")


def status(d: Dialect, events: str, now: str) -> str:
    """Events (task_id, ts, event, timeout_s), ts in seconds: what a status read at `now` says.

    complete and error end a task; processing past its timeout is an error of its own; others
    say how long they have run and what remains, one second at least.
    """
    last = f"(SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event) AS r, min(ts) OVER (PARTITION BY task_id) AS began FROM {events})"
    late = f"{now} - began > timeout_s"
    said = d.when(("event IN ('complete', 'error')", "event"), (late, "'timeout'"), other="'processing'")
    return f"SELECT task_id, {said} AS status, {d.when(('event IN (' + chr(39) + 'complete' + chr(39) + ', ' + chr(39) + 'error' + chr(39) + ')', '200'), (late, '408'), other='202')} AS code, {now} - began AS elapsed, greatest(1, timeout_s - ({now} - began)) AS remaining, event NOT IN ('complete', 'error') AND {now} - began > timeout_s + 60 AS swept FROM {last} WHERE r = 1"
