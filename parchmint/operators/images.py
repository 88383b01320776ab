"""Image statistics, rules and types; pixel kernels on rows (image_id, y, x, v)."""

from __future__ import annotations

from parchmint.plans.dialect import Dialect

# Types that win near ties, and the strategy of each type. The thresholds and weights in the rules below are fixed values too.
SPECIFIC = ("id_card", "receipt", "scientific", "form", "book_page", "newspaper", "table", "signage")
STRATEGIES = {
    "document": "document", "natural": "natural", "receipt": "receipt", "id_card": "id_card", "handwritten": "handwritten", "book_page": "book", "table": "table",
    "scientific": "scientific", "form": "form", "newspaper": "multi_column", "signage": "signage", "low_quality": "aggressive", "high_contrast": "minimal",
}


def type_scores(d: Dialect) -> dict[str, str]:
    """Scores of an image's types, in tie order. Columns: width, height, ar, n (text regions), ed (edge density),
    c (contrast), br (brightness), bl (blur), tc (text confidence), tl and fl (table and form likelihood), cv (color variance), x_groups."""
    f = d.num
    pts = lambda c, k: f"CASE WHEN {c} THEN {k} ELSE 0 END"
    if_ = lambda c, first, *more: f"CASE WHEN {c} THEN {' + '.join([str(first), *more])} ELSE 0 END"
    total = lambda *xs: " + ".join(xs)
    between = lambda x, a, b: f"({x} > {f(a)} AND {x} < {f(b)})"
    return {
        "low_quality": f"CASE WHEN bl < 100 THEN {f(100.0)} ELSE greatest({f(0.0)}, {f(100.0)} - bl / {f(10.0)}) END",
        "signage": total(pts(f"width > height * {f(1.8)} OR height > width * {f(1.8)}", 30), pts("c > 50", 30), pts("cv > 20", 20), pts("n BETWEEN 1 AND 10", 20), pts(between("ed", 0.05, 0.15), 20), pts("br > 100", 10), pts("bl > 1000", 10), pts("tc > 50", 10)),
        "id_card": if_(f"{between('ar', 1.4, 1.8)} AND n BETWEEN 4 AND 15", 80, pts("fl > 50", 20)),
        "receipt": if_(f"ar < {f(0.6)} AND n > 5", 70, pts("fl > 30 AND tc > 60", 30)),
        "document": if_(f"ed > {f(0.04)} AND c > 40 AND bl > 300", 60, pts("tc > 70", 20), pts("n > 10", 20)),
        "high_contrast": if_(f"c > 70 AND br > 180 AND ed > {f(0.04)}", 80, pts("tc > 80", 20)),
        "handwritten": if_(f"{between('ed', 0.02, 0.06)} AND {between('c', 20.0, 60.0)}", 60, pts("bl < 300 AND tc < 70", 40)),
        "natural": if_(f"ed < {f(0.04)} AND c > 30", 60, pts("cv > 30 AND tc < 60", 40)),
        "form": "fl",
        "book_page": if_(f"{between('ar', 0.65, 0.85)} AND ed > {f(0.05)} AND tc > 70", 80, pts("n > 15", 20)),
        "scientific": if_(f"ed > {f(0.05)} AND c > 50", 0, pts("tl > 40", 40), pts("tc > 60 AND n > 5", 30)),
        "presentation": if_("br > 200 AND c > 60", 40, pts("n < 10 AND tc > 70", 30), pts(between("ar", 1.2, 1.8), 30)),
        "newspaper": if_(f"ed > {f(0.06)} AND c > 50", 50, pts("n > 20", 30), pts("x_groups >= 3", 20)),
        "table": "tl",
    }


def type_steps(d: Dialect) -> list[tuple[str, str]]:
    """Steps that end in `image_type`."""
    scores = type_scores(d)
    listed = d.array(*(d.struct(score=f"CAST(-({v}) AS double)", rank=str(i), name=d.lit(k)) for i, (k, v) in enumerate(scores.items())))
    ordered = f"array_sort({listed})" if d.name == "spark" else f"list_sort({listed})"
    specific = lambda x: f"{x} IN ({', '.join(map(d.lit, SPECIFIC))})"
    one, two = d.at("ranked_", 0), d.at("ranked_", 1)
    pick = d.when((f"{two}.score - {one}.score < 10 AND {specific(two + '.name')} AND NOT {specific(one + '.name')}", two), other=one)
    return [
        ("sign_", f"CAST({scores['signage']} AS double)"),
        ("ranked_", ordered),
        ("pick_", pick),
        ("image_type", d.when(("sign_ > 60", "'signage'"), ("tl > 70", "'table'"), ("pick_.score > -50", "'mixed'"), other="pick_.name")),
    ]


def strategy(d: Dialect, image_type: str) -> str:
    return d.when(*((f"{image_type} = '{k}'", f"'{v}'") for k, v in STRATEGIES.items()), other="'standard'")


def text_confidence(d: Dialect, h: str, v: str, edges: str, area: str) -> str:
    """From counts of horizontal, vertical and all edge pixels."""
    f, r, e = d.num, d.div(h, f"({v} + 1)"), d.div(edges, area)
    ratio = d.when((f"{r} BETWEEN {f(1.0)} AND {f(3.0)}", f(100.0)), (f"({r} >= {f(0.5)} AND {r} < 1) OR ({r} > 3 AND {r} <= 5)", f(60.0)), other=f(30.0))
    density = d.when((f"{e} BETWEEN {f(0.02)} AND {f(0.15)}", f(100.0)), (f"({e} >= {f(0.01)} AND {e} < {f(0.02)}) OR ({e} > {f(0.15)} AND {e} <= {f(0.25)})", f(60.0)), other=f(30.0))
    return d.when((f"{edges} = 0", f(0.0)), other=f"least({f(100.0)}, {ratio} * {f(0.6)} + {density} * {f(0.4)})")


def table_likelihood(d: Dialect, h: str, v: str, area: str, crossings: str) -> str:
    f, e = d.num, d.div(f"({h} + {v})", area)
    balance = d.when((f"{h} = 0 OR {v} = 0", f(0.0)), other=f"{d.div(f'least({h}, {v})', f'greatest({h}, {v})')} * {f(100.0)}")
    density = d.when((f"{e} BETWEEN {f(0.002)} AND {f(0.05)}", f(100.0)), (f"{e} < {f(0.002)}", f"{e} * {f(50000.0)}"), other=f"greatest({f(0.0)}, {f(100.0)} - ({e} - {f(0.05)}) * {f(2000.0)})")
    crossing = f"least({f(100.0)}, {d.div(crossings, '5')})"
    return f"least({f(100.0)}, {balance} * {f(0.3)} + {density} * {f(0.4)} + {crossing} * {f(0.3)})"


def form_likelihood(d: Dialect, h: str, area: str, most_aligned: str, n: str, boxes: str) -> str:
    f, e = d.num, d.div(h, area)
    line = d.when((f"{e} BETWEEN {f(0.001)} AND {f(0.02)}", f"{f(100.0)} * ({e} / {f(0.02)})"), (f"{e} > {f(0.02)}", f"{f(100.0)} - least({f(100.0)}, ({e} - {f(0.02)}) * 5000)"), other=f(0.0))
    aligned = d.when((f"{n} > 5", f"{d.div(most_aligned, n)} * {f(100.0)}"), other=f(0.0))
    return f"least({f(100.0)}, {line} * {f(0.3)} + {aligned} * {f(0.4)} + least({f(100.0)}, {boxes} * {f(10.0)}) * {f(0.3)})"


def upload_type(d: Dialect) -> str:
    """The type that decides how an upload is processed. Columns: ar, id_votes, contours, receipt_votes, ed, c, h_lines, v_lines, cells, strong_colors."""
    f = d.num
    card = f"ar > {f(1.4)} AND ar < {f(1.7)} AND (id_votes >= 2 OR contours > 8)"
    table = f"cells > 5 AND h_lines > {f(0.05)} AND v_lines > {f(0.05)} AND h_lines / greatest(v_lines, {f(0.001)}) > {f(0.2)} AND h_lines / greatest(v_lines, {f(0.001)}) < 5"
    sign = f"(c > 60 OR strong_colors) AND ed < {f(0.08)} AND (ar > {f(1.5)} OR ar < {f(0.67)})"
    return d.when((card, "'id_card'"), (f"ar < {f(0.7)} AND receipt_votes >= 2", "'receipt'"), (f"ed < {f(0.05)} AND c > 20 AND c < 60", "'handwritten'"), (table, "'table'"), (sign, "'signage'"), (f"c > 70 AND ed > {f(0.04)}", "'document'"), (f"c < 40 AND ed < {f(0.03)}", "'low_quality'"), other="'natural'")


def is_sign(d: Dialect) -> str:
    """Columns: c, color_std, ed, ar, big_box, words (with confidence above 60)."""
    f = d.num
    return f"((c > 60 OR color_std > 50) AND ed < {f(0.08)} AND (ar > {f(1.5)} OR ar < {f(0.67)} OR big_box) AND words > 0 AND words < 15)"


def is_card(d: Dialect) -> str:
    return f"(ar > {d.num(1.4)} AND ar < {d.num(1.8)} AND id_votes >= 2)"


def corrections(d: Dialect) -> str:
    """Steps for low quality and natural images, as a list. Columns: image_type, bl, c, br."""
    step = lambda c, name: d.when((c, f"'{name}'"))
    named = d.array(step("bl < 100", "sharpen"), step("c < 40", "equalize"), step("br < 50 OR br > 200", "equalize_value"), step("image_type = 'natural'", "perspective"))
    return d.when(("image_type IN ('low_quality', 'natural')", d.filter(named, lambda v: f"{v} IS NOT NULL")), other=d.empty())


def camera_issues(d: Dialect) -> str:
    step = lambda c, name: d.when((c, f"'{name}'"))
    return d.filter(d.array(step("bl < 100", "motion_blur"), step("br < 50", "low_light"), step("br > 200", "overexposed"), step(f"oblique > {d.num(0.3)}", "perspective")), lambda v: f"{v} IS NOT NULL")


def boxes_kept(d: Dialect, boxes: str) -> str:
    f, r = d.num, d.div("w", "h")
    return f"SELECT * FROM {boxes} WHERE w * h > 100 AND w * h < 10000 AND {r} > {f(0.1)} AND {r} < 10 AND w > 8 AND h > 8"


def line_regions(d: Dialect, boxes: str, gap: int = 10) -> str:
    """Boxes (image_id, line, x, y, w, h) of a line merged where the next begins at most `gap` after what was reached."""
    reach = "max(x + w) OVER (PARTITION BY image_id, line ORDER BY x, y, w, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    marked = f"(SELECT *, CASE WHEN x <= {reach} + {gap} THEN 0 ELSE 1 END AS new_ FROM {boxes})"
    numbered = f"(SELECT *, sum(new_) OVER (PARTITION BY image_id, line ORDER BY x, y, w, h ROWS UNBOUNDED PRECEDING) AS island FROM {marked})"
    return f"SELECT image_id, line, island, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM {numbered} GROUP BY image_id, line, island"


def lines_of_regions(d: Dialect, boxes: str) -> str:
    """Boxes (image_id, x, y, w, h) to lines: by rising y, one joins while it is off the line's first y by under half its height."""
    item = d.struct(y="y", x="x", w="w", h="h")
    none = d.cast("0", "bigint")
    start = d.struct(first=none, line=d.cast("-1", "bigint"), out=d.empty("bigint"))

    def step(a: str, v: str) -> str:
        joins = f"({a}.line >= 0 AND abs({v}.y - {a}.first) < {v}.h * {d.num(0.5)})"
        line = d.when((joins, f"{a}.line"), other=f"{a}.line + 1")
        return d.struct(first=d.when((joins, f"{a}.first"), other=f"{v}.y"), line=line, out=d.concat_lists(f"{a}.out", d.array(line)))

    grouped = f"(SELECT image_id, {d.collect_structs(item, 'y, x, w, h')} AS xs FROM {boxes} GROUP BY image_id)"
    folded = f"(SELECT image_id, xs, {d.fold('xs', start, step)} AS r FROM {grouped})"
    both = f"(SELECT image_id, {d.map_i('xs', lambda v, i: d.struct(x=f'{v}.x', y=f'{v}.y', w=f'{v}.w', h=f'{v}.h', line=d.at('r.out', i)))} AS bs FROM {folded})"
    return f"SELECT image_id, b.line AS line, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM ({d.explode(both, 'bs', 'image_id', 'b')})"


def aligned(d: Dialect, boxes: str) -> str:
    """Per image: the largest number of boxes whose x falls in one stretch of 10."""
    return f"SELECT image_id, max(k) AS most, sum(k) AS n FROM (SELECT image_id, {d.idiv('x', '10')} AS g, count(*) AS k FROM {boxes} GROUP BY image_id, {d.idiv('x', '10')}) GROUP BY image_id"


def pixel_stats(d: Dialect, pixels: str) -> str:
    """Brightness, contrast, variance of the 4-neighbour Laplacian (edges reflected) and glare of each image."""
    at = lambda part, order, f: f"{f}(v) OVER (PARTITION BY image_id, {part} ORDER BY {order})"
    other = lambda part, order: f"coalesce({at(part, order, 'lag')}, {at(part, order, 'lead')}) + coalesce({at(part, order, 'lead')}, {at(part, order, 'lag')})"
    near = f"(SELECT *, {other('y', 'x')} + {other('x', 'y')} - 4 * v AS lap FROM {pixels})"
    return f"SELECT image_id, avg(v) AS brightness, sqrt(avg(v * v) - avg(v) * avg(v)) AS contrast, avg({d.cast('lap * lap', 'double')}) - avg(lap) * avg(lap) AS blur, avg(CASE WHEN v > 230 THEN {d.num(1.0)} ELSE {d.num(0.0)} END) * 100 > 5 AS has_glare FROM {near} GROUP BY image_id"


def otsu(d: Dialect, pixels: str) -> str:
    """Per image the level that separates two classes best, the least of equals; class one is up to the level."""
    counts = f"(SELECT image_id, v, count(*) AS k FROM {pixels} GROUP BY image_id, v)"
    up = "OVER (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)"
    all_ = "OVER (PARTITION BY image_id)"
    sums = f"(SELECT image_id, v, {d.cast(f'sum(k) {up}', 'double')} AS n0, {d.cast(f'sum(k * v) {up}', 'double')} AS s0, {d.cast(f'sum(k) {all_}', 'double')} AS n, {d.cast(f'sum(k * v) {all_}', 'double')} AS s FROM {counts})"
    spread = "n0 * (n - n0) * (s0 / n0 - (s - s0) / nullif(n - n0, 0)) * (s0 / n0 - (s - s0) / nullif(n - n0, 0))"
    ranked = f"(SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY coalesce({spread}, -1) DESC, v) AS r FROM {sums})"
    return f"SELECT image_id, v AS level FROM {ranked} WHERE r = 1"


def along(d: Dialect, pixels: str, f: str, axis: str, k: int) -> str:
    """A window of 2k + 1 pixels along an axis: min (erosion), max (dilation), sum or avg."""
    part = "y" if axis == "x" else "x"
    return f"SELECT image_id, y, x, {f}(v) OVER (PARTITION BY image_id, {part} ORDER BY {axis} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS v FROM {pixels}"


def box_blur(d: Dialect, pixels: str, k: int) -> str:
    """Mean of the (2k + 1)-square around each pixel, as far as it lies in the image."""
    counted = f"(SELECT *, 1 AS one FROM {pixels})"
    w = lambda part, order: f"OVER (PARTITION BY image_id, {part} ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    rows = f"(SELECT image_id, y, x, v, sum(v) {w('y', 'x')} AS s, sum(one) {w('y', 'x')} AS n FROM {counted})"
    return f"SELECT image_id, y, x, v, {d.div('sum(s) ' + w('x', 'y'), 'sum(n) ' + w('x', 'y'))} AS mean FROM {rows}"


def stretched(d: Dialect, pixels: str) -> str:
    """Levels spread from 0 to 255, and inverted."""
    low, high = "min(v) OVER (PARTITION BY image_id)", "max(v) OVER (PARTITION BY image_id)"
    return f"SELECT image_id, y, x, 255 - v AS inverted, coalesce(CAST(floor({d.div(f'(v - {low}) * 255', f'nullif({high} - {low}, 0)')}) AS bigint), 0) AS stretched FROM {pixels}"


def equalized(d: Dialect, pixels: str) -> str:
    """Levels by their cumulative share: round((cdf - least cdf) / (n - least cdf) * 255)."""
    counts = f"(SELECT image_id, v, count(*) AS k FROM {pixels} GROUP BY image_id, v)"
    cdf = f"(SELECT image_id, v, sum(k) OVER (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(k) OVER (PARTITION BY image_id) AS n FROM {counts})"
    least = f"(SELECT *, min(c) OVER (PARTITION BY image_id) AS c0 FROM {cdf})"
    level = f"coalesce(CAST(floor({d.div('(c - c0) * 255', 'nullif(n - c0, 0)')} + {d.num(0.5)}) AS bigint), 0)"
    return f"SELECT p.image_id, p.y, p.x, {level} AS v FROM {pixels} p JOIN {least} m ON p.image_id = m.image_id AND p.v = m.v"


def projection(d: Dialect, pixels: str) -> str:
    """Columns whose ink is under half of the mean column's: gaps between text columns."""
    sums = f"(SELECT image_id, x, sum(255 - v) AS ink FROM {pixels} GROUP BY image_id, x)"
    return f"SELECT image_id, x, ink, ink < avg({d.cast('ink', 'double')}) OVER (PARTITION BY image_id) * {d.num(0.5)} AS is_gap FROM {sums}"


def ordered_points(d: Dialect, points: str) -> str:
    """Four points (image_id, quad, k, px, py) of each quad as top left, top right, bottom right, bottom left.

    The two leftmost by y; of the others the one farther from the top left is the bottom right.
    Of n_points under four: one is the top left, two are the left ones, three lack the top right; the others are null.
    """
    by_x = f"(SELECT *, row_number() OVER (PARTITION BY image_id, quad ORDER BY px, k) AS rx FROM {points})"
    left = f"(SELECT *, row_number() OVER (PARTITION BY image_id, quad, rx <= 2 ORDER BY py, px, k) AS ry FROM {by_x})"
    cell = lambda c, v: f"max(CASE WHEN {c} THEN {v} END)"
    tl = f"(SELECT *, max(CASE WHEN rx <= 2 AND ry = 1 THEN px END) OVER (PARTITION BY image_id, quad) AS tlx, max(CASE WHEN rx <= 2 AND ry = 1 THEN py END) OVER (PARTITION BY image_id, quad) AS tly FROM {left})"
    far = f"(SELECT *, row_number() OVER (PARTITION BY image_id, quad, rx <= 2 ORDER BY (px - tlx) * (px - tlx) + (py - tly) * (py - tly) DESC, k) AS rd FROM {tl})"
    out = {"tl": "rx <= 2 AND ry = 1", "bl": "rx <= 2 AND ry = 2", "br": "rx > 2 AND rd = 1", "tr": "rx > 2 AND rd = 2"}
    return f"SELECT image_id, quad, count(*) AS n_points, {', '.join(f'{cell(c, v)} AS {k}_{v[1]}' for k, c in out.items() for v in ('px', 'py'))} FROM {far} GROUP BY image_id, quad"
