"""Curves made from rules: subdivision, L-systems, Hilbert's recursion, lines, and parameter grids."""

from __future__ import annotations

import cmath
import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coastline.operators.curves import segments_from_points

#: Axiom, rules, angle in degrees, symbols that draw.
SYSTEMS = {
    "dragon_lsystem": ("F", {"F": "F+F--F+F"}, 60.0, "F"),
    "minkowski": ("F", {"F": "F+F-F-FF+F+F-F"}, 90.0, "F"),
    "sierpinski": ("F-G-G", {"F": "F-G+F+G-F", "G": "GG"}, 120.0, "FG"),
}
#: Name, dimension expected, largest number of segments.
REGISTRY = (
    ("line", "Multi-Segment Line", 1.0, 10_000),
    ("koch", "Koch", 1.2618595071429148, 50_000),
    ("dragon", "Dragon", 1.5236, 100_000),
    ("hilbert", "Hilbert", 2.0, 200_000),
    ("minkowski", "Minkowski", 1.5, 75_000),
    ("sierpinski", "Sierpinski", 1.5849625007211563, 100_000),
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "fractal string, name string, theoretical_dimension double, max_segments long")


def line(spark: SparkSession, n: int, length: float = 3.0, noise: float = 0.0, seed: int = 0, curve_id: str = "line") -> DataFrame:
    """n segments along the x-axis; the inner points may get Gaussian noise in y."""
    y = F.when((F.col("pos") > 0) & (F.col("pos") < n), F.randn(seed) * noise).otherwise(0.0) if noise else F.lit(0.0)
    points = spark.range(n + 1, numPartitions=1 if noise else None).withColumnRenamed("id", "pos").select(F.lit(curve_id).alias("curve_id"), "pos", (F.col("pos") * F.lit(length) / n).alias("x"), y.alias("y"))
    return segments_from_points(points)


def koch(spark: SparkSession, level: int, curve_id: str = "koch") -> DataFrame:
    """Each segment becomes four, with a triangle in its middle; from (0, 0) to (3, 0)."""
    segs = spark.sql(f"select '{curve_id}' as curve_id, 0L as seg_idx, 0D as x1, 0D as y1, 3D as x2, 0D as y2")
    for _ in range(level):
        segs = segs.withColumns({"dx": F.expr("(x2 - x1) / 3"), "dy": F.expr("(y2 - y1) / 3")})
        segs = segs.withColumns({"ax": F.expr("x1 + dx"), "ay": F.expr("y1 + dy"), "bx": F.expr("x1 + 2 * dx"), "by": F.expr("y1 + 2 * dy")})
        segs = segs.withColumns({"px": F.expr("ax + dx * cos(pi() / 3) - dy * sin(pi() / 3)"), "py": F.expr("ay + dx * sin(pi() / 3) + dy * cos(pi() / 3)")})
        corners = ["x1", "y1", "ax", "ay", "px", "py", "bx", "by", "x2", "y2"]
        parts = [F.struct((F.col("seg_idx") * 4 + k).alias("seg_idx"), *[F.col(c).alias(n) for c, n in zip(corners[2 * k : 2 * k + 4], ("x1", "y1", "x2", "y2"), strict=True)]) for k in range(4)]
        segs = segs.select("curve_id", F.explode(F.array(*parts)).alias("s")).select("curve_id", "s.*")
    return segs


def expand(text: str | F.Column, rules: dict[str, str], steps: int):
    """An L-system's string after ``steps`` parallel rewritings, as an expression."""
    out = F.lit(text) if isinstance(text, str) else text
    marks = {s: chr(0xE000 + i) for i, s in enumerate(rules)}
    for _ in range(steps):
        for s, m in marks.items():
            out = F.replace(out, F.lit(s), F.lit(m))
        for s, m in marks.items():
            out = F.replace(out, F.lit(m), F.lit(rules[s]))
    return out


def walk(strings: DataFrame, degrees: float, draws: str) -> DataFrame:
    """(curve_id, path) -> segments of the turtle's way: unit steps, + turns left, - right."""
    moves = strings.select("curve_id", F.posexplode(F.split("path", "")).alias("pos", "move")).where("move != ''")
    order = Window.partitionBy("curve_id").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    moves = moves.withColumn("turns", F.sum(F.when(F.col("move") == "+", 1).when(F.col("move") == "-", -1).otherwise(0)).over(order))
    step = F.col("move").isin(*draws)
    moves = moves.withColumns({"dx": F.when(step, F.cos(F.radians(F.col("turns") * degrees))).otherwise(0.0), "dy": F.when(step, F.sin(F.radians(F.col("turns") * degrees))).otherwise(0.0)})
    zero = F.lit(0.0)
    moves = moves.withColumns({"x1": F.coalesce(F.sum("dx").over(before), zero), "y1": F.coalesce(F.sum("dy").over(before), zero)})
    segs = moves.where(step).withColumns({"x2": F.col("x1") + F.col("dx"), "y2": F.col("y1") + F.col("dy")})
    return segs.select("curve_id", (F.row_number().over(order) - 1).cast("bigint").alias("seg_idx"), "x1", "y1", "x2", "y2")


def lsystem(spark: SparkSession, name: str, level: int) -> DataFrame:
    axiom, rules, degrees, draws = SYSTEMS[name]
    return walk(spark.range(1).select(F.lit(name).alias("curve_id"), expand(axiom, rules, level).alias("path")), degrees, draws)


def hilbert(spark: SparkSession, level: int, curve_id: str = "hilbert") -> DataFrame:
    """4 ** level points of the unit square, each square's frame halved into four in order."""
    df = spark.sql("select 0L as pos, 0D as x0, 0D as y0, 1D as xi, 0D as xj, 0D as yi, 1D as yj")
    for _ in range(level):
        h = {c: F.col(c) / 2 for c in ("xi", "xj", "yi", "yj")}
        frames = [
            (F.col("x0"), F.col("y0"), h["yi"], h["yj"], h["xi"], h["xj"]),
            (F.col("x0") + h["xi"], F.col("y0") + h["xj"], h["xi"], h["xj"], h["yi"], h["yj"]),
            (F.col("x0") + h["xi"] + h["yi"], F.col("y0") + h["xj"] + h["yj"], h["xi"], h["xj"], h["yi"], h["yj"]),
            (F.col("x0") + h["xi"] + F.col("yi"), F.col("y0") + h["xj"] + F.col("yj"), -h["yi"], -h["yj"], -h["xi"], -h["xj"]),
        ]
        names = ("x0", "y0", "xi", "xj", "yi", "yj")
        rows = [F.struct((F.col("pos") * 4 + k).alias("pos"), *[v.alias(n) for v, n in zip(f, names, strict=True)]) for k, f in enumerate(frames)]
        df = df.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    points = df.select(F.lit(curve_id).alias("curve_id"), "pos", F.expr("x0 + (xi + yi) / 2").alias("x"), F.expr("y0 + (xj + yj) / 2").alias("y"))
    return segments_from_points(points)


def _parts(text: str) -> list[tuple[str, int]]:
    """A rule's drawing symbols, each with the turns before it; turns after the last one must cancel."""
    out, turn = [], 0
    for c in text:
        if c in "+-":
            turn += 1 if c == "+" else -1
        else:
            out.append((c, turn))
    return out


def _net(text: str) -> int:
    return text.count("+") - text.count("-")


#: Numbers of one curve that a task makes at a time.
STRETCH = 1 << 16
#: Segments of a curve that is copied from a table of the levels; longer curves are made from their numbers.
COPIED = 1 << 14


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _numbers(curves: DataFrame, total: F.Column) -> DataFrame:
    """The curves' rows once for each seg_idx from 0 to ``total`` - 1; a long curve is dealt over tasks by its stretches."""
    rows = curves.withColumn("_n", total.cast("long")).where("_n > 0")
    # few rows make many: dealt by a number of partitions that isn't made smaller by their bytes
    rows = rows.withColumn("_k", F.explode(F.expr(f"sequence(0L, (_n - 1) div {STRETCH})"))).repartition(_tasks(curves), "curve_id", "_k")
    return rows.withColumn("seg_idx", F.explode(F.expr(f"sequence(_k * {STRETCH}, least(_n, (_k + 1) * {STRETCH}) - 1)"))).drop("_n", "_k")


def _by_level(curves: DataFrame, counts: Sequence[int], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make`` of (curve_id, level), where curves of one level are alike: once for each level, whose segments the curves then copy.

    counts: segments of each level from 0 on. The table of levels has no more than ``COPIED``
    segments a level, whatever the number of curves; longer curves are each made on their own.
    """
    short = max((k for k, n in enumerate(counts) if n <= COPIED), default=-1)
    rows = curves.select("curve_id", F.expr(f"element_at(sequence(0, {len(counts) - 1}), cast(level as int) + 1)").alias("level"))
    parts = []
    if short >= 0:
        levels = curves.sparkSession.range(short + 1).select(F.col("id").cast("string").alias("curve_id"), F.col("id").cast("int").alias("level"))
        shapes = make(levels).withColumn("level", F.col("curve_id").cast("int")).drop("curve_id")
        copies = rows.where(F.col("level") <= short).repartition(_tasks(curves), "curve_id").join(F.broadcast(shapes), "level")
        parts.append(copies.select("curve_id", "seg_idx", "x1", "y1", "x2", "y2"))
    if short < len(counts) - 1:
        parts.append(make(rows.where(F.col("level") > short)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def addressed(curves: DataFrame, name: str, most: int, scale: F.Column | float = 1.0) -> DataFrame:
    """Segments of an L-system's curves, each from its number alone; curves: (curve_id, level up to ``most``).

    Segment i of a level is found by its digits: at each level the rule's parts have
    known numbers of segments and known displacements, so the part that holds i, where it
    begins and how it is turned follow from two small tables, which grow with
    ``most`` and not with the curve. Rows are a range, dealt over all tasks; there is
    no string, no window and no recursion over rows. Levels of few segments are made
    once and copied (``_by_level``). ``scale`` is a segment's length, by its curve's level.
    """
    axiom, rules, degrees, draws = SYSTEMS[name]
    if any(_net(r) for r in rules.values()):
        raise ValueError("a rule has to end in the direction in which it begins")
    symbols = [*rules, "axiom"]
    texts = rules | {"axiom": axiom}
    count, ahead = {(s, 0): 1 for s in rules}, {(s, 0): 1 + 0j for s in rules}
    turn = lambda k: cmath.exp(1j * math.radians(degrees * k))
    table: dict[tuple[str, int], list] = {}
    for level in range(1, most + 2):
        for s in symbols:
            rows, first, at = [], 0, 0j
            for c, k in _parts(texts[s]):
                rows.append((first, at.real, at.imag, k, symbols.index(c)))
                first, at = first + count[c, level - 1], at + turn(k) * ahead[c, level - 1]
            table[s, level] = rows
            count[s, level], ahead[s, level] = first, at
    entry = lambda r: f"named_struct('first', {r[0]}L, 'x', {r[1]!r}D, 'y', {r[2]!r}D, 'h', {r[3]}, 's', {r[4]})"
    tables = "array(" + ", ".join("array(" + ", ".join(map(entry, table[s, k])) + ")" for k in range(1, most + 2) for s in symbols) + ")"
    totals = "array(" + ", ".join(f"{count['axiom', k]}L" for k in range(1, most + 2)) + ")"
    part = f"element_at(filter(element_at({tables}, (k - 1) * {len(symbols)} + a.s + 1), c -> c.first <= a.r), -1)"
    turned = f"radians({degrees}D * a.h)"
    step = f"""transform(array({part}), c -> named_struct('r', a.r - c.first, 's', c.s, 'h', a.h + c.h,
      'x', a.x + c.x * cos({turned}) - c.y * sin({turned}), 'y', a.y + c.x * sin({turned}) + c.y * cos({turned})))[0]"""
    start = f"named_struct('r', seg_idx, 's', {len(symbols) - 1}, 'h', 0, 'x', 0D, 'y', 0D)"
    ends = {"x1": "u * p.x", "y1": "u * p.y", "x2": f"u * (p.x + cos(radians({degrees}D * p.h)))", "y2": f"u * (p.y + sin(radians({degrees}D * p.h)))"}

    def make(own: DataFrame) -> DataFrame:
        rows = _numbers(own, F.expr(f"element_at({totals}, level + 1)"))
        rows = rows.withColumn("p", F.expr(f"aggregate(sequence(level + 1, 1, -1), {start}, (a, k) -> {step})"))
        rows = rows.withColumn("u", F.lit(scale) if isinstance(scale, float) else scale)
        return rows.select("curve_id", "seg_idx", *[F.expr(e).alias(n) for n, e in ends.items()])

    return _by_level(curves, [count["axiom", k] for k in range(1, most + 2)], make)


def addressed_koch(curves: DataFrame, most: int) -> DataFrame:
    """Koch curves from (0, 0) to (3, 0) by their segments' digits; curves: (curve_id, level)."""
    return addressed(curves, "dragon_lsystem", most, F.pow(F.lit(3.0), 1 - F.col("level")))


def addressed_hilbert(curves: DataFrame, most: int | None = None) -> DataFrame:
    """Hilbert curves by the digits of their points; curves: (curve_id, level), of 4 ** level points each.

    Where the greatest level is given as ``most``, levels of few segments are made once and copied.
    """
    half = {c: f"a.{c} / 2" for c in ("xi", "xj", "yi", "yj")}
    frames = [
        ("a.x0", "a.y0", half["yi"], half["yj"], half["xi"], half["xj"]),
        (f"a.x0 + {half['xi']}", f"a.y0 + {half['xj']}", half["xi"], half["xj"], half["yi"], half["yj"]),
        (f"a.x0 + {half['xi']} + {half['yi']}", f"a.y0 + {half['xj']} + {half['yj']}", half["xi"], half["xj"], half["yi"], half["yj"]),
        (f"a.x0 + {half['xi']} + a.yi", f"a.y0 + {half['xj']} + a.yj", f"-{half['yi']}", f"-{half['yj']}", f"-{half['xi']}", f"-{half['xj']}"),
    ]
    names = ("x0", "y0", "xi", "xj", "yi", "yj")
    quarters = "array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, f, strict=True)) + ")" for f in frames) + ")"

    def point(i: str) -> F.Column:
        digit = f"cast(shiftright({i}, 2 * (k - 1)) & 3 as int)"
        frame = f"aggregate(sequence(level, 1, -1), named_struct('x0', 0D, 'y0', 0D, 'xi', 1D, 'xj', 0D, 'yi', 0D, 'yj', 1D), (a, k) -> {quarters}[{digit}])"
        return F.expr(f"transform(array({frame}), a -> named_struct('x', a.x0 + (a.xi + a.yi) / 2, 'y', a.y0 + (a.xj + a.yj) / 2))[0]")

    def make(own: DataFrame) -> DataFrame:
        rows = _numbers(own, F.expr("cast(pow(4, level) as bigint) - 1"))
        ends = rows.withColumns({"p": point("seg_idx"), "q": point("(seg_idx + 1)")})
        return ends.select("curve_id", "seg_idx", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))

    if most is None:
        return make(curves.select("curve_id", F.col("level").cast("int").alias("level")))
    return _by_level(curves, [4**k - 1 for k in range(most + 1)], make)


def addressed_lines(curves: DataFrame, length: float = 3.0) -> DataFrame:
    """Lines of n segments along the x-axis; curves: (curve_id, n)."""
    rows = _numbers(curves.select("curve_id", "n"), F.col("n"))
    return rows.select("curve_id", "seg_idx", (F.col("seg_idx") * F.lit(length) / F.col("n")).alias("x1"), F.lit(0.0).alias("y1"), ((F.col("seg_idx") + 1) * F.lit(length) / F.col("n")).alias("x2"), F.lit(0.0).alias("y2"))


def parameter_grid(spark: SparkSession, deltas: Sequence[float], factors: Sequence[float], steps: Sequence[int]) -> DataFrame:
    """All combinations in order: combo_idx, initial_delta, delta_factor, num_steps."""
    one = spark.range(1).select(F.posexplode(F.array(*[F.lit(float(d)) for d in deltas])).alias("a", "initial_delta"))
    one = one.select("*", F.posexplode(F.array(*[F.lit(float(f)) for f in factors])).alias("b", "delta_factor"))
    one = one.select("*", F.posexplode(F.array(*[F.lit(int(s)) for s in steps])).alias("c", "num_steps"))
    index = (F.col("a") * len(factors) + F.col("b")) * len(steps) + F.col("c")
    return one.select(index.cast("bigint").alias("combo_idx"), "initial_delta", "delta_factor", "num_steps")


def sample_grid(grid: DataFrame, n: int = 60, seed: int = 42) -> DataFrame:
    """``n`` combinations by a hash of their number: the same ones on every run."""
    return grid.orderBy(F.xxhash64(F.lit(seed), "combo_idx"), "combo_idx").limit(n)
