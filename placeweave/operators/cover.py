"""Covers of areas by grid cells: which cells a border touches, and which lie wholly inside.

Each area has cells of one size, a power of two of a degree, chosen by the length and the number of
its edges (`fineness`), so that a cell holds a few edges of it. A cell that an edge touches keeps
those edges and one bit: whether the point just beyond its lower right corner is in the area. That
bit is the parity of the crossings of the cell's lower side further to the east, a running sum along
the row of cells. A point in the cell is in the area if the bit and the edges crossed on the way from
the point to that corner (east, then down the right side) are odd together, or if it lies on an edge.
Cells between two touched ones hold no edge, so the bit of the one to the west tells for all of them.
They are kept as blocks of 1, 8 or 64 cells, for which no edge is tested.

Most touched cells are plain: one edge runs through, or two do, or two meet at a vertex. There the sides
of the point alone tell, so such a cell has a bit for each of their nine combinations (`_sides`), and a
point is tested by shifting them (`holds_plain`), without a walk along an array.

The corner stands for a point a little to the east of it and, much less, to the north; the way there
lies accordingly, which settles every case of an edge through a corner or along a side. Sides are
decided exactly (`geo.side`), and grid lines are exact in doubles and in the decimals used there.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions.geo import once_sql, side_sql, within_sql

# Cells that the border of an area passes, at least, and edges in such a cell, about.
PASSED, HELD = 48, 4
# Sizes of cells: from 8 degrees to a value whose multiples have fourteen digits behind the point.
COARSEST, FINEST = -3, 14
# Blocks of cells inside: runs of 8**0, 8**1, 8**2 cells of a row.
_STEP, _BLOCKS = 3, 3
KEYS = ["fineness", "run", "kx", "cy"]
# Sides of a block inside: all of them are in the area.
_ALL = 511
_ENDS = ("ax", "ay", "bx", "by")


def fineness(length: str, edges: str) -> str:
    """SQL: cells of an area whose border has that length and number of edges have sides of
    2**-fineness degrees."""
    size = f"log2(greatest({length}, 1E-9D) / greatest({PASSED}D, {edges} / {HELD}D))"
    return f"int(least(greatest(-floor({size}), {COARSEST}), {FINEST}))"


def _range(first, last) -> str:
    return f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE array() END"


def touched(edges: DataFrame, size: str) -> DataFrame:
    """Edges pointing up as (ax, ay, bx, by), in each row of cells (`cy`, `size`) that they touch, with
    the columns `cx_from` to `cx_to` there. Cells count with their borders, and a little more."""
    others = [f"`{c}`" for c in edges.columns if c not in ("x1", "y1", "x2", "y2")]
    laid = edges.selectExpr(
        *others, f"double({size}) AS size", "if(y1 <= y2, x1, x2) AS ax", "least(y1, y2) AS ay", "if(y1 <= y2, x2, x1) AS bx", "greatest(y1, y2) AS by")
    rows = laid.selectExpr("*", "explode(sequence(bigint(ceil(ay / size)) - 1, bigint(floor(by / size)))) AS cy")
    first, last = columns_in_row("size", "cy")
    return rows.selectExpr(*others, "size", "ax", "ay", "bx", "by", "cy", f"{first} AS cx_from", f"{last} AS cx_to")


def columns_in_row(size, cy) -> tuple[str, str]:
    """SQL: the first and the last column of cells that an edge pointing up touches in a row."""
    low, high = _x_at(f"greatest(ay, {cy} * {size})"), _x_at(f"least(by, ({cy} + 1) * {size})")
    return (f"bigint(floor(if(ay = by, least(ax, bx), least({low}, {high})) / {size} - 1E-6D))",
            f"bigint(floor(if(ay = by, greatest(ax, bx), greatest({low}, {high})) / {size} + 1E-6D))")


def _x_at(y) -> str:
    """SQL: where an edge that points up is at latitude `y`; rounded."""
    return f"ax + (bx - ax) * (({y} - ay) / nullif(by - ay, 0D))"


def area_cells(edges: DataFrame, carry) -> DataFrame:
    """The cover of every area: (fineness, run, kx, cy) name a cell or a block of cells, `area` holds
    `carry` and the area's id, `odd` is the bit, and `lines` are the edges of a touched cell (null in
    a block inside). `sides` has the bits of a plain cell (null in others). `edges` have their area's
    `fineness`."""
    keep = list(dict.fromkeys(["area_id", *carry]))
    rows = touched(edges.select(*keep, "fineness", "x1", "y1", "x2", "y2"), "pow(2D, -fineness)")
    # A row of cells is made whole by one exchange of few bytes, which make much work: Spark must not
    # gather them in a few tasks.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "area_id", "fineness", "cy")
    # The cell that holds the crossing of an edge and the lower side of the row: the rounded place is
    # one off at most.
    near = rows.selectExpr("*", "cy * size AS _y", f"bigint(floor(({_x_at('cy * size')}) / size)) AS _near").selectExpr(
        "*", "_near * size AS _x0", "(_near + 1) * size AS _x1")
    beyond = [f"int({side_sql('ax', 'ay', 'bx', 'by', x, '_y')} > 0)" for x in ("_x0", "_x1")]
    crossed = f"CASE WHEN ay <= _y AND _y < by THEN _near - 1 + {beyond[0]} + {beyond[1]} END AS crossed"
    cells = near.selectExpr(*keep, "fineness", "cy", "struct(ax, ay, bx, by) AS line", crossed, "explode(sequence(cx_from, cx_to)) AS cx")
    border = cells.groupBy(*keep, "fineness", "cy", "cx").agg(
        F.expr("collect_list(line) AS lines"), F.expr("count(CASE WHEN crossed = cx THEN 1 END) AS n"))
    row = "OVER (PARTITION BY area_id, fineness, cy ORDER BY cx DESC"
    known = border.selectExpr(
        *keep, "fineness", "cy", "cx", "lines", f"lag(cx) {row}) AS next",
        f"coalesce(sum(n) {row} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS odd")
    facts = ", ".join([f"`{c}`" for c in dict.fromkeys(carry) if c != "area_id"] + ["area_id"])
    blocks = _blocks("cx + 1", "next - 1")
    inside = f"transform(CASE WHEN odd AND next > cx + 1 THEN {blocks} ELSE array() END, b -> struct(b.run AS run, b.kx AS kx, true AS odd, null AS lines, {_ALL} AS sides))"
    return _with_sides(known).selectExpr(
        f"struct({facts}) AS area", "fineness", "cy", f"inline(concat(array(struct(0 AS run, cx AS kx, odd, lines, sides)), {inside}))")


def _with_sides(cells: DataFrame) -> DataFrame:
    """Touched cells with `sides`: bit 4 + 3 * s + t tells if points on side s of the first edge and t of
    the second (1 left, 0 on it, -1 right) are in the area; with one edge t is 0. Null if the cell is
    not plain. An edge runs through if its ends are clearly outside the cell, so that its line is no
    longer than the edge there; two that meet have one end each in the cell, and that is the same."""
    def near(x, y):
        return (f"({x} BETWEEN (cx - 1.52587890625E-5D) * _size AND (cx + 1.0000152587890625D) * _size AND "
                f"{y} BETWEEN (cy - 1.52587890625E-5D) * _size AND (cy + 1.0000152587890625D) * _size)")

    def corner(e):
        """The side of the point just beyond the lower right corner."""
        side = side_sql(f"{e}.ax", f"{e}.ay", f"{e}.bx", f"{e}.by", "(cx + 1) * _size", "cy * _size", apart=True)
        return f"CASE WHEN {e} IS NOT NULL THEN coalesce(nullif(int({side}), 0), if({e}.ay < {e}.by, -1, int(signum({e}.bx - {e}.ax)))) END"

    def of_end(e, other):
        """The side of edge `e` on which the far end of the other edge lies, if they meet in the cell."""
        far = [f"if(_{other}a, {other}.b{c}, {other}.a{c})" for c in "xy"]
        return f"CASE WHEN _meet THEN int({side_sql(f'{e}.ax', f'{e}.ay', f'{e}.bx', f'{e}.by', *far, apart=True)}) END"

    edges = cells.selectExpr("*", "pow(2D, -fineness) AS _size", "if(size(lines) <= 2, get(lines, 0), null) AS _e", "if(size(lines) <= 2, get(lines, 1), null) AS _g")
    ends = edges.selectExpr("*", *[f"{near(f'_{e}.{end}x', f'_{e}.{end}y')} AS __{e}{end}" for e in "eg" for end in "ab"])
    meet = " OR ".join(f"(__e{i} AND NOT __e{j} AND __g{k} AND NOT __g{l} AND _e.{i}x = _g.{k}x AND _e.{i}y = _g.{k}y)"
                       for i, j in ("ab", "ba") for k, l in ("ab", "ba"))
    seen = ends.selectExpr("*", f"{corner('_e')} AS _r", f"{corner('_g')} AS _q", f"coalesce({meet}, false) AS _meet").selectExpr(
        "*", f"{of_end('_e', '_g')} AS _s", f"{of_end('_g', '_e')} AS _t")
    one = "16 + if(odd = (_r = -1), 2, 0) + if(odd = (_r = 1), 128, 0)"
    two = "186 + if(odd = (_r * _q = 1), 257, 68)"
    # Between two edges that meet all points are on the same sides, and no others are.
    between = "shiftleft(1, 4 + 3 * _s + _t)"
    wedge = f"if(odd = (_r = _s AND _q = _t), {between} + shiftleft(1, 4 + _t) + 16 + shiftleft(1, 4 + 3 * _s), {_ALL} - {between})"
    return seen.selectExpr(
        *cells.columns,
        f"CASE WHEN _e IS NULL OR _r = 0 OR _q = 0 THEN null WHEN _g IS NULL THEN if(__ea OR __eb, null, {one}) "
        f"WHEN NOT (__ea OR __eb OR __ga OR __gb) THEN {two} WHEN _meet AND _s <> 0 AND _t <> 0 THEN {wedge} END AS sides")


def _blocks(first, last) -> str:
    """SQL: columns first to last as blocks: single ones up to the next eight, eights up to the next
    sixty-four, and so on."""
    def named(run, columns):
        return f"transform({columns}, c -> struct({run} AS run, bigint(c) AS kx))"

    def split(run, first, last):
        if run == _STEP * (_BLOCKS - 1):
            return named(run, _range(first, last))
        low, high = f"bigint(ceil(({first}) / 8))", f"bigint(floor((({last}) + 1) / 8))"
        ends = f"concat({named(run, _range(first, f'{low} * 8 - 1'))}, {named(run, _range(f'{high} * 8', last))}, {split(run + _STEP, low, f'{high} - 1')})"
        return f"CASE WHEN {low} < {high} THEN {ends} ELSE {named(run, _range(first, last))} END"

    return split(0, first, last)


def cell_of(lon, lat, level, run) -> tuple[str, str]:
    """SQL: the block (kx, cy) that holds a point."""
    return f"bigint(floor(floor({lon} * pow(2D, {level})) / pow(2D, {run})))", f"bigint(floor({lat} * pow(2D, {level})))"


def plain(cells: DataFrame) -> DataFrame:
    """Plain cells and blocks inside, with their edges in columns instead of an array."""
    ends = [f"get(lines, {i}).{c} AS {c}{i}" for i in (0, 1) for c in _ENDS]
    return cells.filter("sides IS NOT NULL").selectExpr(*KEYS, "area", "sides", *ends)


def holds_plain(px, py) -> str:
    """SQL: is the point, which lies in a cell of `plain`, in the area? Spark compiles it with the join."""
    first, second = [f"int({side_sql(*[f'{c}{i}' for c in _ENDS], px, py)})" for i in (0, 1)]
    return f"sides = {_ALL} OR shiftright(sides, 4 + 3 * {first} + CASE WHEN ax1 IS NULL THEN 0 ELSE {second} END) % 2 = 1"


def holds(level, kx, cy, odd, lines, px, py) -> str:
    """SQL: is the point, which lies in the cell, in the area?"""
    ends = ["e.ax", "e.ay", "e.bx", "e.by"]
    sides = f"named_struct('p', {side_sql(*ends, px, py)}, 'c', {side_sql(*ends, 'c.x', py)}, 'r', {side_sql(*ends, 'c.x', 'c.y')})"
    rises = "(e.bx > e.ax AND e.by > e.ay)"
    # Positive above the edge's line.
    above, below = "t.c * signum(e.bx - e.ax)", "t.r * signum(e.bx - e.ax)"
    east = f"(e.ay <= {py} AND {py} < e.by AND t.p > 0 AND t.c <= 0)"
    down = (f"(least(e.ax, e.bx) <= c.x AND c.x < greatest(e.ax, e.bx) AND ({above} > 0 OR ({above} = 0 AND NOT {rises})) "
            f"AND ({below} < 0 OR ({below} = 0 AND {rises})))")
    count = f"CASE WHEN t.p = 0 AND {within_sql(*ends, px, py)} THEN -1 ELSE n + int({east}) + int({down}) END"
    # Most edges of a cell concern neither the way east nor the way down.
    idle = f"NOT ({py} BETWEEN e.ay AND e.by OR c.x BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx))"
    step = f"CASE WHEN n < 0 OR {idle} THEN n ELSE {once_sql(sides, 't', count)} END"
    corner = f"struct(({kx} + 1) * pow(2D, -({level})) AS x, {cy} * pow(2D, -({level})) AS y)"
    met = once_sql(corner, "c", f"aggregate({lines}, int({odd}), (n, e) -> {step}, n -> n < 0 OR n % 2 = 1)")
    return f"CASE WHEN {lines} IS NULL THEN {odd} ELSE {met} END"
