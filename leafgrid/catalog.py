"""The engine's queries over the tables of a folder, and their SQL.

Points are order lines with integer coordinates, so that both engines agree bit
for bit; y and z are squared to make the tree adaptive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys as K
from .operators import deep, fem, fields, mesh, search, tree
from .plans import multigrid, problems, whole
from .sources import meshes
from .sources import points as files

DEPTH, MOST = 6, 16
MESH_DEPTH, MESH_MOST = 6, 64
FINE_DEPTH = 10  # of trees far from balanced
DEEP = 30  # of trees whose keys take two numbers
ROUNDS = 200  # of solvers at most, which end at their tolerance
BLOCK = 2  # the level of blocks
BUCKET_BITS = 9  # keys of a bucket share all but so many low bits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ inputs


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    square = "((l_{0} % 64) * (l_{0} % 64)) div 64"
    at = lines.select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", F.expr("l_orderkey % 64").alias("x"), F.expr(square.format("partkey")).alias("y"), F.expr(square.format("suppkey")).alias("z"))
    return at.withColumn("key", K.interleave(F.col("x"), F.col("y"), F.col("z")))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.construct(order_lines(spark, sf_dir), DEPTH, MOST)


def fine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with a key of ``FINE_DEPTH`` levels.  y and z are
    squared, so that the tree is adaptive at every size, and z is densest just
    below the middle plane, beyond which there is nothing."""
    side = 1 << FINE_DEPTH
    y = F.expr(f"((l_partkey % {side}) * (l_partkey % {side})) div {side}")
    z = F.expr(f"{side // 2 - 1} - ((l_suppkey % {side}) * (l_suppkey % {side})) div {2 * side}")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(K.interleave(F.expr(f"l_orderkey % {side}"), y, z).alias("key"))


def fine_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all order lines, far from balanced."""
    return tree.construct(fine_lines(spark, sf_dir), FINE_DEPTH, MOST)


def fine_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that this tree splits."""
    return tree.crowded(fine_lines(spark, sf_dir), FINE_DEPTH, MOST)


def mesh_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.balance(tree.construct(order_lines(spark, sf_dir), MESH_DEPTH, MESH_MOST))


def bucket():
    return F.shiftright("key", BUCKET_BITS)


def _encode(*at: str, bits: int = DEPTH) -> str:
    parts = [f"((({v} >> {b}) & 1) << {len(at) * b + a})" for b in range(bits) for a, v in enumerate(at)]
    return "(" + " | ".join(parts) + ")"


def _decode(prefix: str, axis: int, bits: int = DEPTH) -> str:
    return "(" + " | ".join(f"((({prefix} >> {3 * b + axis}) & 1) << {b})" for b in range(bits)) + ")"


KEYED = f"""pts AS (
  SELECT l_orderkey, l_linenumber, l_linestatus, l_quantity, l_orderkey % 64 AS x,
    ((l_partkey % 64) * (l_partkey % 64)) // 64 AS y, ((l_suppkey % 64) * (l_suppkey % 64)) // 64 AS z FROM lineitem
), keyed AS (SELECT *, {_encode("x", "y", "z")} AS key FROM pts)"""


def _tree_sql(name: str = "leaves", depth: int = DEPTH, most: int = MOST, where: str = "true", source: str = "keyed", dim: int = 3, bits: int = DEPTH) -> str:
    return f"""{name}_cells AS (
  SELECT l AS level, (key >> {dim * (bits - depth)}) >> ({dim} * ({depth} - l)) AS prefix, count(*) AS n
  FROM {source}, range(0, {depth + 1}) t(l) WHERE {where} GROUP BY ALL
), {name}_inner AS (SELECT level, prefix FROM {name}_cells WHERE n > {most} AND level < {depth}
), {name} AS (
  SELECT i.level + 1 AS level, i.prefix * {2**dim} + c AS prefix FROM {name}_inner i, range(0, {2**dim}) t(c)
  WHERE NOT EXISTS (SELECT 1 FROM {name}_inner j WHERE j.level = i.level + 1 AND j.prefix = i.prefix * {2**dim} + c)
  UNION ALL SELECT 0, 0 WHERE NOT EXISTS (SELECT 1 FROM {name}_inner))"""


def _above(cells: str, bits: int = DEPTH) -> str:
    return f"SELECT DISTINCT l AS level, prefix >> (3 * (level - l)) AS prefix FROM {cells}, range(0, {bits}) t(l) WHERE l < level"


def _complete(cells: str, bits: int = DEPTH) -> str:
    return f"""inner_ AS ({_above(cells, bits)}), done AS (
  SELECT i.level + 1 AS level, i.prefix * 8 + c AS prefix FROM inner_ i, range(0, 8) t(c)
  WHERE NOT EXISTS (SELECT 1 FROM inner_ j WHERE j.level = i.level + 1 AND j.prefix = i.prefix * 8 + c)
  UNION ALL SELECT 0, 0 WHERE NOT EXISTS (SELECT 1 FROM inner_))"""


def _grown(name: str, bits: int, directions: str = "true") -> tuple[list[str], str]:
    """Statements that grow ``{name}_src`` (level, x, y, z), one step a level
    from the finest up, and the union of all levels' cells."""

    def around(level: int) -> str:
        return f"""SELECT DISTINCT (x + dx) >> 1 AS x, (y + dy) >> 1 AS y, (z + dz) >> 1 AS z
    FROM (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z FROM {name}_{level}) p, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz)
    WHERE least(x + dx, y + dy, z + dz) >= 0 AND greatest(x + dx, y + dy, z + dz) < {1 << level - 1} AND {directions}"""

    steps = [f"{name}_{bits} AS MATERIALIZED (SELECT x, y, z FROM {name}_src WHERE level = {bits})"]
    for level in range(bits, 1, -1):
        made = f"SELECT x * 2 + (k & 1) AS x, y * 2 + ((k >> 1) & 1) AS y, z * 2 + (k >> 2) AS z FROM ({around(level)}) g, range(0, 8) s(k)"
        steps.append(f"{name}_{level - 1} AS MATERIALIZED ({made} UNION SELECT x, y, z FROM {name}_src WHERE level = {level - 1})")
    every = " UNION ALL ".join(f"SELECT {level} AS level, x, y, z FROM {name}_{level}" for level in range(1, bits + 1))
    return steps, f"{every} UNION ALL SELECT level, x, y, z FROM {name}_src WHERE level = 0"


def _balanced(source: str = "leaves", directions: str = "true", bits: int = DEPTH, name: str = "balanced") -> str:
    """``name``: the balanced tree."""
    grown, every = _grown(name, bits, directions)
    steps = [f"{name}_src AS MATERIALIZED (SELECT level, {', '.join(f'{_decode("prefix", a, bits)} AS {v}' for a, v in enumerate('xyz'))} FROM {source})", *grown]
    steps.append(f"{name}_all AS MATERIALIZED (SELECT *, {_encode('x', 'y', 'z', bits=bits)} AS prefix FROM ({every}))")
    steps.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_all g WHERE NOT EXISTS (SELECT 1 FROM {name}_all h WHERE h.level = g.level + 1 AND h.prefix >> 3 = g.prefix))")
    return ", ".join(steps)


def _decoded_blocks() -> str:
    """Pairs of blocks in ``asked`` that touch."""
    at = ", ".join(f"{_decode('prefix', a)} AS {v}" for a, v in enumerate("xyz"))
    return f"""at_ AS (SELECT prefix, {at} FROM asked)
SELECT a.prefix AS block, b.prefix AS other FROM at_ a, at_ b WHERE a.prefix <> b.prefix AND greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) <= 1"""


_TREE = f"WITH {KEYED}, {_tree_sql()}"
_B = FINE_DEPTH
_S = 1 << _B
FINE = f"""fine_ AS (SELECT {_encode("x", "y", "z", bits=_B)} AS key FROM (
  SELECT l_orderkey % {_S} AS x, ((l_partkey % {_S}) * (l_partkey % {_S})) // {_S} AS y, {_S // 2 - 1} - ((l_suppkey % {_S}) * (l_suppkey % {_S})) // {2 * _S} AS z FROM lineitem))"""
_STEEP = f"WITH {FINE}, {_tree_sql(depth=_B, source='fine_', bits=_B)}"
_D = MESH_DEPTH
_UNIT = 216 << 22  # element entries of the test meshes are multiples of 1 / _UNIT


def _elements(cells: str = "balanced", s: str = "") -> str:
    """The vertices, hanging vertices and element nodes of a balanced tree."""
    return f"""corner{s} AS (
  SELECT level, prefix, v AS vertex, x, y, z, (x + (v & 1)) << ({_D} - level) AS nx, (y + ((v >> 1) & 1)) << ({_D} - level) AS ny, (z + (v >> 2)) << ({_D} - level) AS nz
  FROM {cells}, range(0, 8) t(v)
), hang{s} AS (
  SELECT DISTINCT c.level, c.prefix, c.vertex FROM corner{s} c, range(0, 2) a(i), range(0, 2) b(j), range(0, 2) d(k), {cells} t
  WHERE c.level > 0 AND greatest(c.nx % (1 << ({_D} + 1 - c.level)), c.ny % (1 << ({_D} + 1 - c.level)), c.nz % (1 << ({_D} + 1 - c.level))) > 0
    AND least(c.nx - i, c.ny - j, c.nz - k) >= 0 AND t.level = c.level - 1
    AND t.x = (c.nx - i) >> ({_D} + 1 - c.level) AND t.y = (c.ny - j) >> ({_D} + 1 - c.level) AND t.z = (c.nz - k) >> ({_D} + 1 - c.level)
), element{s} AS (
  SELECT c.level, c.prefix, c.vertex, h.vertex IS NOT NULL AS hangs,
    CASE WHEN h.vertex IS NULL THEN nx ELSE ((x >> 1) + (c.vertex & 1)) << ({_D} + 1 - c.level) END AS nx,
    CASE WHEN h.vertex IS NULL THEN ny ELSE ((y >> 1) + ((c.vertex >> 1) & 1)) << ({_D} + 1 - c.level) END AS ny,
    CASE WHEN h.vertex IS NULL THEN nz ELSE ((z >> 1) + (c.vertex >> 2)) << ({_D} + 1 - c.level) END AS nz
  FROM corner{s} c LEFT JOIN hang{s} h ON h.level = c.level AND h.prefix = c.prefix AND h.vertex = c.vertex)"""


def _coarser(cells: str, s: str) -> str:
    """``balanced{s}``: a tree coarsened once and balanced again."""
    again = _balanced(f"merged{s}", name=f"balanced{s}")
    return f"""full{s} AS (SELECT level, prefix >> 3 AS p FROM {cells} WHERE level > 0 GROUP BY ALL HAVING count(*) = 8
), merged{s} AS (
  SELECT level, prefix FROM {cells} l WHERE NOT EXISTS (SELECT 1 FROM full{s} f WHERE f.level = l.level AND f.p = l.prefix >> 3)
  UNION ALL SELECT level - 1, p FROM full{s}), {again}"""


def _weights(s: str = "") -> str:
    """``q{s}``: the share of an element's node in the value at its vertex v."""
    return f"""q{s} AS (
  SELECT e.level, e.prefix, e.vertex AS v, n.nx, n.ny, n.nz,
    CASE WHEN e.hangs THEN 1e0 / (1 << bit_count(xor(e.prefix & 7, e.vertex))::INT) ELSE 1e0 END AS w
  FROM element{s} e JOIN element{s} n ON n.level = e.level AND n.prefix = e.prefix
    AND CASE WHEN e.hangs THEN xor(e.prefix & 7, n.vertex) & ~xor(e.prefix & 7, e.vertex) = 0 ELSE n.vertex = e.vertex END)"""


_MESH = f"WITH {KEYED}, {_tree_sql('leaves', MESH_DEPTH, MESH_MOST)}, {_balanced()}, {_elements()}"
_MASS = [f"(2 - ((xor(v, w) >> {a}) & 1)) / 6e0" for a in range(3)]
_SLOPE = [f"(1 - 2 * ((xor(v, w) >> {a}) & 1))" for a in range(3)]


def _slopes(a: int, b: int) -> str:
    """The integral of function v's slope by axis a times w's by axis b."""
    if a == b:
        return f"{_SLOPE[a]} * {_MASS[(a + 1) % 3]} * {_MASS[(a + 2) % 3]}"
    return f"(2 * ((v >> {a}) & 1) - 1) * (2 * ((w >> {b}) & 1) - 1) / 4e0 * {_MASS[3 - a - b]}"


_STIFF = " + ".join(_slopes(a, a) for a in range(3))
_FEM = _MESH + f""", {_weights()}, entry AS (
  SELECT v, w, {_STIFF} AS stiff, {" * ".join(_MASS)} AS mass FROM range(0, 8) a(v), range(0, 8) b(w)
), node AS (SELECT DISTINCT nx, ny, nz, nx + 2 * ny + 3 * nz AS u, (nx % {1 << _D} = 0 OR ny % {1 << _D} = 0 OR nz % {1 << _D} = 0) AS fixed FROM element)"""


def _product(u: str) -> str:
    """``product``: the operator with both factors 1, times the nodal field u."""
    return f"""vertex AS (SELECT q.level, q.prefix, q.v, sum(q.w * {u}) AS u FROM q JOIN node n ON n.nx = q.nx AND n.ny = q.ny AND n.nz = q.nz GROUP BY ALL
), row_ AS (
  SELECT x.level, x.prefix, e.v, sum((e.stiff * pow(0.5e0, x.level) + e.mass * pow(0.125e0, x.level)) * x.u) AS r
  FROM vertex x JOIN entry e ON e.w = x.v GROUP BY ALL
), product AS (SELECT q.nx, q.ny, q.nz, sum(q.w * r.r) AS value FROM q JOIN row_ r ON r.level = q.level AND r.prefix = q.prefix AND r.v = q.v GROUP BY ALL)"""


def _units(value: str) -> str:
    return f"round({value} * {_UNIT})::BIGINT / {_UNIT}::DOUBLE"


def _snapped(value: str = "value"):
    """A sum of entries rounded to the unit they are multiples of, so that the
    order of summation does not show."""
    return (F.round(F.col(value) * _UNIT).cast("long") / F.lit(float(_UNIT))).alias(value)


# ------------------------------------------------------------ key functions


@query(f"WITH {KEYED} SELECT x, y, z, key, count(*) AS n FROM keyed GROUP BY ALL")
def morton_key(spark, sf_dir):
    return order_lines(spark, sf_dir).groupBy("x", "y", "z", "key").agg(F.count("*").alias("n"))


@query(f"WITH {KEYED} SELECT DISTINCT key, x, y, z FROM keyed")
def decode_key(spark, sf_dir):
    unique = order_lines(spark, sf_dir).select("key").distinct()
    return unique.select("key", *(p.alias(a) for a, p in zip("xyz", K.position("key"), strict=True)))


@query(f"WITH {KEYED} SELECT key >> 3 AS parent, (key & 7)::INT AS child, count(*) AS n FROM keyed GROUP BY ALL")
def parent_rollup(spark, sf_dir):
    return order_lines(spark, sf_dir).groupBy(K.up("key", 1).alias("parent"), K.child_number("key").alias("child")).agg(F.count("*").alias("n"))


@query(_TREE + f" SELECT level::INT AS level, prefix, prefix << (3 * ({DEPTH} - level)) AS first, ((prefix + 1) << (3 * ({DEPTH} - level))) - 1 AS last FROM leaves")
def descendant_range(spark, sf_dir):
    level, prefix = F.col("level"), F.col("prefix")
    return leaves(spark, sf_dir).select("level", "prefix", K.first_key(level, prefix, DEPTH).alias("first"), K.last_key(level, prefix, DEPTH).alias("last"))


@query(
    _TREE + """, moved AS (SELECT level, prefix, list_max(list_filter(range(0, level + 1), lambda b: ((prefix + 1) & ((1 << (3 * b)) - 1)) = 0)) AS by_ FROM leaves)
SELECT level::INT AS level, prefix, (level - by_)::INT AS next_level, (prefix + 1) >> (3 * by_) AS next_prefix FROM moved"""
)
def next_octant(spark, sf_dir):
    level, prefix = K.next_cell(F.col("level"), F.col("prefix"))
    return leaves(spark, sf_dir).select("level", "prefix", level.cast("int").alias("next_level"), prefix.alias("next_prefix"))


@query(
    _TREE + f""", cell AS (SELECT level, prefix, (1 << level) - 1 AS e, {_decode("prefix", 0)} AS x, {_decode("prefix", 1)} AS y, {_decode("prefix", 2)} AS z FROM leaves)
SELECT level::INT AS level, prefix, ((x = 0)::INT + 2 * (y = 0)::INT + 4 * (z = 0)::INT + 32 * (x = e)::INT + 64 * (y = e)::INT + 128 * (z = e)::INT)::INT AS flags FROM cell"""
)
def boundary_flags(spark, sf_dir):
    return leaves(spark, sf_dir).select("level", "prefix", K.boundary_flags(F.col("level"), F.col("prefix")).alias("flags"))


@query(
    f"""WITH {KEYED}, cells AS (SELECT DISTINCT key >> 9 AS prefix FROM keyed), cell AS (
  SELECT prefix, {_decode("prefix", 0)} AS x, {_decode("prefix", 1)} AS y, {_decode("prefix", 2)} AS z FROM cells)
SELECT a.prefix, {_encode("(x + dx)", "(y + dy)", "(z + dz)")} AS neighbour FROM cell a, range(-1, 2) p(dx), range(-1, 2) q(dy), range(-1, 2) r(dz)
WHERE (dx <> 0 OR dy <> 0 OR dz <> 0) AND least(x + dx, y + dy, z + dz) >= 0 AND greatest(x + dx, y + dy, z + dz) < 8"""
)
def neighbours(spark, sf_dir):
    cells = order_lines(spark, sf_dir).select(K.up("key", 3).alias("prefix")).distinct()
    return cells.select("prefix", F.explode(K.neighbours(F.lit(3), F.col("prefix"))).alias("neighbour"))


@query(
    _TREE + f""", side AS (
  SELECT level, prefix, {", ".join(f"(prefix >> {a}) & 1 AS b{a}, {_decode('prefix', a)} AS p{a}" for a in range(3))} FROM leaves
), edge AS (
  SELECT level, prefix, {", ".join(f"((p{a} + b{a}) << ({DEPTH} - level)) - b{a} AS i{a}, ((p{a} + b{a}) << ({DEPTH} - level)) - 1 + b{a} AS o{a}" for a in range(3))} FROM side
), away AS (SELECT level, prefix, {", ".join(f"CASE WHEN (s >> {a}) & 1 = 1 THEN o{a} ELSE i{a} END AS k{a}" for a in range(3))} FROM edge, range(1, 8) t(s))
SELECT level::INT AS level, prefix, {_encode("k0", "k1", "k2")} AS key FROM away WHERE least(k0, k1, k2) >= 0 AND greatest(k0, k1, k2) < {1 << DEPTH}"""
)
def search_keys(spark, sf_dir):
    found = K.search_keys(F.col("level"), F.col("prefix"), DEPTH)
    return leaves(spark, sf_dir).select("level", "prefix", F.explode(found).alias("key"))


@query(
    f"""WITH {KEYED}, ends AS (SELECT l_orderkey, min(key) AS lo, max(key) AS hi FROM keyed GROUP BY l_orderkey),
moved AS (SELECT *, list_min(list_filter(range(0, {DEPTH + 1}), lambda b: (lo >> (3 * b)) = (hi >> (3 * b)))) AS by_ FROM ends)
SELECT l_orderkey, ({DEPTH} - by_)::INT AS level, lo >> (3 * by_) AS prefix FROM moved"""
)
def nearest_common_ancestor(spark, sf_dir):
    ends = order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    level, prefix = K.common_ancestor(F.lit(DEPTH), F.col("lo"), F.lit(DEPTH), F.col("hi"))
    return ends.select("l_orderkey", level.cast("int").alias("level"), prefix.alias("prefix"))


def _hilbert() -> str:
    """Places on the Hilbert curve, one statement for each bit and axis."""
    steps, last = [], "c AS (SELECT DISTINCT x, y, z, x AS c0, y AS c1, z AS c2 FROM keyed)"
    for bit in range(DEPTH - 1, 0, -1):
        for a in range(3):
            low, hit = (1 << bit) - 1, f"(c{a} >> {bit}) & 1 = 1"
            both = f"(xor(c0, c{a}) & {low})"
            new = {0: f"CASE WHEN {hit} THEN xor(c0, {low}) ELSE xor(c0, {both}) END"} | ({a: f"CASE WHEN {hit} THEN c{a} ELSE xor(c{a}, {both}) END"} if a else {})
            steps.append(last)
            last = f"c_{bit}_{a} AS (SELECT x, y, z, {', '.join(f'{new.get(k, f'c{k}')} AS c{k}' for k in range(3))} FROM {last.split()[0]})"
    steps += [last, f"g AS (SELECT x, y, z, c0, xor(c1, c0) AS c1, xor(c2, xor(c1, c0)) AS c2 FROM {last.split()[0]})"]
    turn = "0::BIGINT"
    for bit in range(DEPTH - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN (c2 >> {bit}) & 1 = 1 THEN {(1 << bit) - 1} ELSE 0 END)"
    steps.append(f"t AS (SELECT x, y, z, xor(c0, {turn}) AS c0, xor(c1, {turn}) AS c1, xor(c2, {turn}) AS c2 FROM g)")
    return f"WITH {KEYED}, {', '.join(steps)} SELECT x, y, z, {_encode('c2', 'c1', 'c0')} AS hilbert FROM t"


@query(_hilbert())
def hilbert_key(spark, sf_dir):
    unique = order_lines(spark, sf_dir).select("x", "y", "z").distinct()
    return unique.withColumn("hilbert", K.hilbert(F.col("x"), F.col("y"), F.col("z"), depth=DEPTH))


@query(_TREE + " SELECT level::INT AS level, prefix, (prefix >> 3) * 8 + c AS sibling FROM leaves, range(0, 8) t(c) WHERE level > 0 AND (prefix >> 3) * 8 + c <> prefix")
def sibling_cells(spark, sf_dir):
    return leaves(spark, sf_dir).filter("level > 0").select("level", "prefix", F.explode(K.siblings("prefix")).alias("sibling"))


@query(_TREE + f", up_ AS ({_above('leaves')}) SELECT level::INT AS level, prefix FROM up_")
def ancestor_cells(spark, sf_dir):
    return tree.ancestors(leaves(spark, sf_dir))


@query(
    _TREE + f""", cell AS (SELECT level, prefix, (1 << (level - {BLOCK})) - 1 AS e, prefix & ((1 << (3 * (level - {BLOCK}))) - 1) AS own FROM leaves WHERE level >= {BLOCK}),
at_ AS (SELECT level, prefix, e, {_decode("own", 0)} AS x, {_decode("own", 1)} AS y, {_decode("own", 2)} AS z FROM cell)
SELECT level::INT AS level, prefix, ((x = 0)::INT + 2 * (y = 0)::INT + 4 * (z = 0)::INT + 32 * (x = e)::INT + 64 * (y = e)::INT + 128 * (z = e)::INT)::INT AS flags
FROM at_ WHERE least(x, y, z) = 0 OR greatest(x, y, z) = e"""
)
def block_boundary(spark, sf_dir):
    return tree.block_boundary(leaves(spark, sf_dir), BLOCK)


@query(_TREE + " SELECT level::INT AS level, prefix, " + ", ".join(f"({_decode('prefix', a)} + 0.5) * pow(0.5, level) AS {v}" for a, v in enumerate("xyz")) + " FROM leaves")
def cell_centres(spark, sf_dir):
    return fields.centres(leaves(spark, sf_dir))


@query(f"WITH {KEYED} SELECT DISTINCT key FROM keyed WHERE greatest(x, y, z) <= {1 << DEPTH - 1}")
def lower_half_points(spark, sf_dir):
    half = 1 << DEPTH - 1
    return order_lines(spark, sf_dir).filter(f"x <= {half} and y <= {half} and z <= {half}").select("key").distinct()


@query(f"WITH {KEYED} SELECT key >> 3 AS parent, bit_or((1 << (key & 7))::INT) AS touched, (count(*) / 8)::DOUBLE AS mean FROM keyed GROUP BY ALL")
def child_aggregates(spark, sf_dir):
    """Of each parent which children hold points, and the points a child."""
    touched = F.bit_or(F.call_function("shiftleft", F.lit(1), K.child_number("key")))
    return order_lines(spark, sf_dir).groupBy(K.up("key", 1).alias("parent")).agg(touched.alias("touched"), (F.count("*") / 8).alias("mean"))


@query(f"WITH {KEYED} SELECT DISTINCT x, y, z, (x + 0.5e0) / {1 << DEPTH} AS cx, (y + 0.5e0) / {1 << DEPTH} AS cy, (z + 0.5e0) / {1 << DEPTH} AS cz FROM keyed")
def remapped_points(spark, sf_dir):
    """Distinct points moved to the centres of their cells of full depth."""
    unique = order_lines(spark, sf_dir).select("x", "y", "z").distinct()
    return unique.select("x", "y", "z", *(c.alias(f"c{a}") for a, c in zip("xyz", K.cell_centre(F.col("x"), F.col("y"), F.col("z"), depth=DEPTH), strict=True)))


@query(
    f"""WITH {KEYED}, ends AS (SELECT l_orderkey, min(key) AS lo, max(key) AS hi FROM keyed GROUP BY l_orderkey)
SELECT l_orderkey, (lo >> 9) = (hi >> 9) AS comparable, bit_count(xor(lo, hi))::INT AS bits FROM ends"""
)
def comparable_cells(spark, sf_dir):
    """Whether the level-4 cell of an order's first point and the level-3 cell
    of its last overlap, and the bits in which their keys differ."""
    ends = order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    overlap = K.comparable(F.lit(4), K.up("lo", 2), F.lit(3), K.up("hi", 3))
    return ends.select("l_orderkey", overlap.alias("comparable"), F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))).alias("bits"))


@query(
    _TREE + f""", cell AS (SELECT level, prefix, {", ".join(f"{_decode('prefix', a)} AS {v}" for a, v in enumerate("xyz"))} FROM leaves),
same AS (SELECT level, prefix, x + dx AS x, y + dy AS y, z + dz AS z FROM cell, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz)
  WHERE (dx <> 0 OR dy <> 0 OR dz <> 0) AND least(x + dx, y + dy, z + dz) >= 0 AND greatest(x + dx, y + dy, z + dz) < (1 << level)),
coded AS (SELECT DISTINCT level, prefix, {_encode("x", "y", "z")} AS n FROM same), listed AS (
SELECT level::INT AS level, prefix, level::INT AS around, n AS candidate FROM coded
UNION SELECT level::INT, prefix, (level - 1)::INT, n >> 3 FROM coded WHERE level > 0 AND n >> 3 <> prefix >> 3
UNION SELECT level::INT, prefix, (level + 1)::INT, n * 8 + k FROM coded, range(0, 8) s(k) WHERE level < {DEPTH}
) SELECT level, prefix, around, count(*) AS candidates, sum(candidate)::BIGINT AS total FROM listed GROUP BY ALL"""
)
def balance_candidates(spark, sf_dir):
    """The cells around a leaf, one level coarser, equal and one level finer,
    that a balanced tree may have there: their number and sum."""
    found = tree.balance_candidates(leaves(spark, sf_dir), DEPTH)
    return found.groupBy("level", "prefix", F.col("at").alias("around")).agg(F.count("*").alias("candidates"), F.sum("candidate").alias("total"))


@query(_TREE + " SELECT level::INT AS level, prefix FROM leaves WHERE level = 4")
def octants_at_level(spark, sf_dir):
    return leaves(spark, sf_dir).filter("level = 4")


# ------------------------------------------------------------------- trees


@query(_TREE + " SELECT level::INT AS level, prefix FROM leaves")
def construct_octree(spark, sf_dir):
    return leaves(spark, sf_dir)


@query(_TREE + " SELECT l.level::INT AS level, l.prefix, coalesce(c.n, 0) AS n FROM leaves l LEFT JOIN leaves_cells c ON c.level = l.level AND c.prefix = l.prefix")
def leaf_counts(spark, sf_dir):
    return tree.leaf_counts(order_lines(spark, sf_dir), leaves(spark, sf_dir), DEPTH)


@query(_TREE + " SELECT level::INT AS level, count(*) AS leaves FROM leaves GROUP BY ALL")
def level_histogram(spark, sf_dir):
    return leaves(spark, sf_dir).groupBy("level").agg(F.count("*").alias("leaves"))


@query(_TREE + f" SELECT count(*) AS cells, sum(1 << (3 * ({DEPTH} - level)))::BIGINT AS volume FROM leaves")
def octree_volume(spark, sf_dir):
    return tree.volume(leaves(spark, sf_dir), DEPTH)


_SOME = f"WITH {FINE}, cells AS (SELECT DISTINCT {_B} AS level, key AS prefix FROM fine_), mixed AS (SELECT * FROM cells UNION SELECT 4, prefix >> {3 * (_B - 4)} FROM cells)"


def nested_cells(spark, sf_dir) -> DataFrame:
    """The cells of every order line and those of level 4 around them."""
    cells = fine_lines(spark, sf_dir).select(F.lit(FINE_DEPTH).alias("level"), F.col("key").alias("prefix")).distinct()
    return cells.unionByName(cells.select(F.lit(4).alias("level"), K.up("prefix", FINE_DEPTH - 4).alias("prefix")))


@query(_SOME + f", {_complete('mixed', _B)} SELECT level::INT AS level, prefix FROM done")
def complete_octree(spark, sf_dir):
    return tree.complete(nested_cells(spark, sf_dir))


@query(_SOME + f", up_ AS ({_above('mixed', _B)}) SELECT level::INT AS level, prefix FROM mixed m WHERE NOT EXISTS (SELECT 1 FROM up_ u WHERE u.level = m.level AND u.prefix = m.prefix)")
def linearise(spark, sf_dir):
    return tree.linearise(nested_cells(spark, sf_dir))


_OPEN = "l_linestatus = 'O'"


@query(
    f"WITH {KEYED}, {_tree_sql('one', where=_OPEN)}, {_tree_sql('two', where='l_quantity > 25')}, both_ AS (SELECT * FROM one UNION SELECT * FROM two), up_ AS ({_above('both_')})"
    " SELECT level::INT AS level, prefix FROM both_ m WHERE NOT EXISTS (SELECT 1 FROM up_ u WHERE u.level = m.level AND u.prefix = m.prefix)"
)
def merge_octrees(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    return tree.merge(*(tree.construct(lines.filter(f), DEPTH, MOST) for f in (_OPEN, "l_quantity > 25")))


@query(_TREE + """, full_ AS (SELECT level, prefix >> 3 AS p FROM leaves WHERE level > 0 GROUP BY ALL HAVING count(*) = 8)
SELECT level::INT AS level, prefix FROM leaves l WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.level = l.level AND f.p = l.prefix >> 3)
UNION ALL SELECT (level - 1)::INT, p FROM full_""")
def coarsen_octree(spark, sf_dir):
    return tree.coarsen(leaves(spark, sf_dir))


@query(_TREE + f", parents AS (SELECT DISTINCT greatest(level - 1, 0) AS level, CASE WHEN level > 0 THEN prefix >> 3 ELSE prefix END AS prefix FROM leaves), {_complete('parents')} SELECT level::INT AS level, prefix FROM done")
def simple_coarsen(spark, sf_dir):
    return tree.simple_coarsen(leaves(spark, sf_dir))


@query(_TREE + f" SELECT (level + 1)::INT AS level, prefix * 8 + c AS prefix FROM leaves, range(0, 8) t(c) WHERE level < {DEPTH} UNION ALL SELECT level::INT, prefix FROM leaves WHERE level = {DEPTH}")
def refine_octree(spark, sf_dir):
    return tree.refine(leaves(spark, sf_dir), DEPTH)


@query("SELECT 4 AS level, range AS prefix FROM range(0, 4096)")
def regular_octree(spark, sf_dir):
    return tree.regular(spark, 4)


def _merge_pass(k: int) -> str:
    return f"""m{k} AS (
  SELECT level, prefix >> 3 AS p, avg(value) AS value FROM g{k} WHERE level > 0 AND (SELECT count(*) FROM g{k}) >= 10
  GROUP BY ALL HAVING count(*) = 8 AND max(value) - min(value) < 40
), g{k + 1} AS (
  SELECT * FROM g{k} l WHERE NOT EXISTS (SELECT 1 FROM m{k} m WHERE m.level = l.level AND m.p = l.prefix >> 3)
  UNION ALL SELECT level - 1, p, value FROM m{k})"""


@query(
    f"""WITH {KEYED}, g0 AS (
  SELECT 3 AS level, c AS prefix, count(key)::DOUBLE AS value FROM range(0, 512) t(c) LEFT JOIN keyed ON key >> {3 * (DEPTH - 3)} = c GROUP BY ALL
), {", ".join(map(_merge_pass, range(3)))} SELECT level::INT AS level, prefix FROM g3"""
)
def grid_octree(spark, sf_dir):
    counts = order_lines(spark, sf_dir).groupBy(K.up("key", 3).alias("prefix")).agg(F.count("*").alias("value"))
    grid = tree.regular(spark, 3).select("prefix").join(counts, "prefix", "left").select("prefix", F.coalesce("value", F.lit(0)).alias("value"))
    return tree.from_grid(grid, 3, 40.0)


def _unbalanced(cells: str) -> str:
    """``near``: the cells around a leaf, at every coarser level but one, which
    are leaves themselves where the tree is not balanced."""
    return f"""deep AS (SELECT level, prefix, {", ".join(f"{_decode('prefix', a, _B)} AS {v}" for a, v in enumerate("xyz"))} FROM {cells} WHERE level > 1),
near AS (SELECT DISTINCT level, prefix, l, {_encode("(x + dx)", "(y + dy)", "(z + dz)", bits=_B)} >> (3 * (level - l)) AS p
  FROM deep, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz), range(0, {_B}) t(l)
  WHERE l <= level - 2 AND least(x + dx, y + dy, z + dz) >= 0 AND greatest(x + dx, y + dy, z + dz) < (1 << level)),
wrong AS (SELECT DISTINCT n.level::INT AS level, n.prefix FROM near n JOIN {cells} c ON c.level = n.l AND c.prefix = n.p)"""


@query(f"{_STEEP}, {_balanced(bits=_B)} SELECT level::INT AS level, prefix FROM balanced")
def balance_octree(spark, sf_dir):
    return tree.balance_below(fine_crowded(spark, sf_dir))


@query(f"{_STEEP}, {_balanced(bits=_B)}, {_unbalanced('balanced')} SELECT count(*) AS violations FROM wrong")
def balance_violations(spark, sf_dir):
    return tree.unbalanced(tree.spread(tree.cut(tree.balance_below(fine_crowded(spark, sf_dir))))).agg(F.count("*").alias("violations"))


@query(f"{_STEEP}, {_unbalanced('leaves')} SELECT level, prefix FROM wrong")
def unbalanced_leaves(spark, sf_dir):
    return tree.unbalanced(tree.spread(tree.cut(fine_leaves(spark, sf_dir))))


@query(f"{_STEEP}, {_balanced(directions='dx * dy * dz = 0', bits=_B)} SELECT level::INT AS level, prefix FROM balanced")
def balance_without_corners(spark, sf_dir):
    return tree.balance_below(fine_crowded(spark, sf_dir), corners=False)


@query(
    f"""{_STEEP}, {_balanced(bits=_B)}, one AS (SELECT level, prefix FROM balanced), two AS (SELECT level, prefix FROM leaves)
SELECT level::INT AS level, prefix, side FROM (SELECT *, 1 AS side FROM (FROM one EXCEPT ALL FROM two) UNION ALL SELECT *, 2 FROM (FROM two EXCEPT ALL FROM one))"""
)
def tree_difference(spark, sf_dir):
    split = fine_crowded(spark, sf_dir)
    return tree.difference(tree.balance_below(split), tree.leaves_below(split, total=split.count()))


@query(f"WITH {KEYED}, flat AS (SELECT {_encode('x', 'y')} AS key FROM keyed), {_tree_sql(source='flat', dim=2)} SELECT level::INT AS level, prefix FROM leaves")
def construct_quadtree(spark, sf_dir):
    flat = order_lines(spark, sf_dir).select(K.interleave(F.col("x"), F.col("y")).alias("key"))
    return tree.construct(flat, DEPTH, MOST, dim=2)


@query(_TREE + f" SELECT prefix >> (3 * (level - {BLOCK})) AS block, count(*) AS leaves FROM leaves WHERE level >= {BLOCK} GROUP BY ALL")
def block_weights(spark, sf_dir):
    return leaves(spark, sf_dir).filter(F.col("level") >= BLOCK).groupBy(K.up("prefix", F.col("level") - BLOCK).alias("block")).agg(F.count("*").alias("leaves"))


@query(_TREE + " SELECT min(level)::INT AS least, max(level)::INT AS most FROM leaves")
def level_range(spark, sf_dir):
    return leaves(spark, sf_dir).agg(F.min("level").alias("least"), F.max("level").alias("most"))


_LO, _HI = (3, 100), (2, 50)


@query(
    f"""WITH ends(level, prefix) AS (VALUES {_LO}, {_HI}), {_complete("ends")}
SELECT level::INT AS level, prefix::BIGINT AS prefix FROM done
WHERE prefix << (3 * ({DEPTH} - level)) >= {(_LO[1] + 1) << 3 * (DEPTH - _LO[0])} AND prefix << (3 * ({DEPTH} - level)) < {_HI[1] << 3 * (DEPTH - _HI[0])}"""
)
def region_between(spark, sf_dir):
    return tree.between(_LO, _HI, spark.range(1), DEPTH)


_ON_SPHERE = "(abs(sqrt(" + " + ".join(f"pow(({_decode('prefix', a)} + 0.5e0) * pow(0.5e0, level) - 0.5e0, 2)" for a in range(3)) + ") - 0.35e0) < 0.87e0 * pow(0.5e0, level))"


@query(
    f"""WITH RECURSIVE cells AS (
  SELECT 0 AS level, 0::BIGINT AS prefix
  UNION ALL SELECT level + 1, prefix * 8 + c FROM cells, range(0, 8) t(c) WHERE level < 5 AND {_ON_SPHERE}
) SELECT level, prefix FROM cells WHERE level = 5 OR NOT {_ON_SPHERE}"""
)
def sphere_octree(spark, sf_dir):
    centre = [(p + 0.5) * F.pow(F.lit(0.5), F.col("level")) - 0.5 for p in K.position("prefix")]
    distance = F.sqrt(sum((c * c for c in centre), F.lit(0.0)))
    return tree.spheres(spark, 5, F.abs(distance - 0.35) < 0.87 * F.pow(F.lit(0.5), F.col("level")))


@query(
    _TREE + f""", placed AS (SELECT level, {", ".join(f"{_decode('prefix', a)} AS p{a}" for a in range(3))} FROM leaves
), moved AS (
  SELECT level, s, {", ".join(f"p{a} + ((s >> {a}) & 1) AS p{a}" for a in range(3))} FROM placed, range(0, 8) t(s)
  WHERE {" AND ".join(f"((s >> {a}) & 1 = 0 OR p{a} = (1 << level) - 1)" for a in range(3))}
) SELECT (level + 1)::INT AS level, {" | ".join(f"(((p{a} >> {b}) & 1) << {3 * b + a})" for b in range(DEPTH + 1) for a in range(3))} AS prefix, s::INT AS beyond FROM moved"""
)
def embedded_octree(spark, sf_dir):
    return tree.embedded(leaves(spark, sf_dir))


@query(
    _TREE + f""", weighed AS (SELECT l.level, l.prefix, count(k.key) AS weight FROM leaves l LEFT JOIN keyed k ON l.prefix = k.key >> (3 * ({DEPTH} - l.level)) GROUP BY ALL)
SELECT level::INT AS level, prefix, weight, row_number() OVER (ORDER BY weight DESC, CASE WHEN weight > 1 THEN -level ELSE level END, prefix) AS place FROM weighed"""
)
def density_order(spark, sf_dir):
    counted = tree.leaf_counts(order_lines(spark, sf_dir), leaves(spark, sf_dir), DEPTH).withColumnRenamed("n", "weight")
    return tree.by_density(counted).select("level", "prefix", "weight", F.col("place").cast("long").alias("place"))


# -------------------------------------------------------------- deep trees

_DEEP_SIDE = 1 << DEEP
#: Coordinates of DEEP bits, spread by odd factors; each point is then moved
#: towards the origin by halving it up to 27 times, so that the points are as
#: dense at every scale and the tree is adaptive down to its last levels.
_DEEP_AXES = {
    "x": f"(l_orderkey % {_DEEP_SIDE}) * 1103515245 % {_DEEP_SIDE}",
    "y": f"((l_orderkey % {_DEEP_SIDE >> 3}) * 8 + l_linenumber) * 715827883 % {_DEEP_SIDE}",
    "z": f"((l_partkey % {_DEEP_SIDE >> 10}) * 1024 + l_suppkey % 1024) * 362437069 % {_DEEP_SIDE}",
}
_DEEP = f"""WITH deep_ AS (SELECT {", ".join(f"({v}) >> (l_partkey % 28) AS {a}" for a, v in _DEEP_AXES.items())} FROM lineitem),
cells AS (SELECT l AS level, x >> ({DEEP} - l) AS x, y >> ({DEEP} - l) AS y, z >> ({DEEP} - l) AS z, count(*) AS n FROM deep_, range(0, {DEEP + 1}) t(l) GROUP BY ALL),
inner_ AS (SELECT level, x, y, z FROM cells WHERE n > {MOST} AND level < {DEEP}),
kids AS (SELECT level + 1 AS level, 2 * x + (c & 1) AS x, 2 * y + ((c >> 1) & 1) AS y, 2 * z + (c >> 2) AS z FROM inner_, range(0, 8) t(c)),
leaves AS (SELECT * FROM kids k WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.level = k.level AND i.x = k.x AND i.y = k.y AND i.z = k.z)
  UNION ALL SELECT 0, 0, 0, 0 WHERE NOT EXISTS (SELECT 1 FROM inner_))"""


def _deep_balanced() -> str:
    steps, every = _grown("balanced", DEEP)
    src = "balanced_src AS MATERIALIZED (SELECT * FROM leaves)"
    return f"""{_DEEP}, {", ".join([src, *steps])}, every AS MATERIALIZED ({every}),
above AS (SELECT DISTINCT level - 1 AS level, x >> 1 AS x, y >> 1 AS y, z >> 1 AS z FROM every WHERE level > 0)
SELECT level::INT AS level, x, y, z FROM every e WHERE NOT EXISTS (SELECT 1 FROM above a WHERE a.level = e.level AND a.x = e.x AND a.y = e.y AND a.z = e.z)"""


def deep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = lines.selectExpr(*(f"shiftright({v}, int(l_partkey % 28)) AS {a}" for a, v in _DEEP_AXES.items()))
    hi, lo = deep.key(*(F.col(a) for a in "xyz"), depth=DEEP)
    return at.withColumns({"hi": hi, "lo": lo})


def deep_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.construct(deep_lines(spark, sf_dir), DEEP, MOST)


def _placed(cells: DataFrame, *more: str) -> DataFrame:
    return cells.select("level", *(p.alias(a) for a, p in zip("xyz", deep.position(), strict=True)), *more)


@query(
    f"""{_DEEP} SELECT DISTINCT x, y, z, {_encode("(x >> 15)", "(y >> 15)", "(z >> 15)", bits=15)} AS hi, {_encode("(x & 32767)", "(y & 32767)", "(z & 32767)", bits=15)} AS lo FROM deep_"""
)
def deep_key(spark, sf_dir):
    """Keys of 90 bits in two numbers, and the positions made from them again."""
    unique = deep_lines(spark, sf_dir).select(F.lit(DEEP).alias("level"), "hi", "lo").distinct()
    return _placed(unique, "hi", "lo").drop("level")


@query(_DEEP + " SELECT level::INT AS level, x, y, z FROM leaves")
def deep_octree(spark, sf_dir):
    """A tree of 30 levels."""
    return _placed(deep_leaves(spark, sf_dir))


@query(_DEEP + " SELECT l.level::INT AS level, l.x, l.y, l.z, coalesce(c.n, 0) AS n FROM leaves l LEFT JOIN cells c ON c.level = l.level AND c.x = l.x AND c.y = l.y AND c.z = l.z")
def deep_leaf_counts(spark, sf_dir):
    return _placed(deep.counted(deep_lines(spark, sf_dir), DEEP, MOST), "n")


@query(
    f"""{_DEEP}, fine AS (SELECT DISTINCT x, y, z FROM deep_), mixed AS (SELECT {DEEP} AS level, x, y, z FROM fine UNION SELECT 20, x >> 10, y >> 10, z >> 10 FROM fine)
SELECT level::INT AS level, x, y, z FROM mixed m WHERE level = {DEEP}"""
)
def deep_linearise(spark, sf_dir):
    """The finest of the points' cells of levels 20 and 30."""
    fine = deep_lines(spark, sf_dir).select(F.lit(DEEP).alias("level"), "hi", "lo").distinct()
    return _placed(deep.linearise(fine.unionByName(deep.ancestors(fine).filter("level = 20"))))


@query(_deep_balanced())
def deep_balance(spark, sf_dir):
    """The balanced tree of 30 levels."""
    return _placed(deep.balance_below(deep.crowded(deep_lines(spark, sf_dir), DEEP, MOST)))


# ----------------------------------------------------- searches and numbers


@query(_TREE + f""" SELECT l.level::INT AS level, l.prefix, sum(k.l_quantity) AS quantity FROM keyed k JOIN leaves l
  ON l.prefix = k.key >> (3 * ({DEPTH} - l.level)) GROUP BY ALL""")
def containment_join(spark, sf_dir):
    return search.contained(order_lines(spark, sf_dir), leaves(spark, sf_dir), DEPTH).groupBy("level", "prefix").agg(F.sum("l_quantity").alias("quantity"))


_LISTED = f"WITH {KEYED}, listed AS (SELECT DISTINCT key AS found FROM keyed WHERE l_quantity >= 45), asked AS (SELECT DISTINCT key FROM keyed)"


@query(_LISTED + " SELECT key, (SELECT max(found) FROM listed WHERE found <= key) AS found FROM asked")
def as_of_search(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    return search.as_of(lines.select("key").distinct(), lines.filter("l_quantity >= 45").select("key").distinct(), "key", bucket())


_CELLS = f"WITH {KEYED}, cells AS (SELECT key, count(*) AS n FROM keyed GROUP BY key)"


def counted(spark, sf_dir) -> DataFrame:
    return order_lines(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


@query(_CELLS + " SELECT key, n, (sum(n) OVER (ORDER BY key))::BIGINT AS total FROM cells")
def prefix_sum(spark, sf_dir):
    return search.running(counted(spark, sf_dir), ["key"], F.col("n"), bucket())


@query(_CELLS + " SELECT key, n, row_number() OVER (ORDER BY key) - 1 AS id FROM cells")
def global_numbering(spark, sf_dir):
    return search.numbered(counted(spark, sf_dir), ["key"], bucket())


@query(_CELLS + ", t AS (SELECT key, n, (sum(n) OVER (ORDER BY key))::BIGINT AS s, (sum(n) OVER ())::BIGINT AS a FROM cells) SELECT key, n, (least((s * 16 + a - 1) // a, 16) - 1)::INT AS part FROM t")
def weighted_partition(spark, sf_dir):
    return search.weighted_parts(counted(spark, sf_dir), ["key"], F.col("n"), 16, bucket())


@query(_LISTED + " SELECT key, (SELECT min(found) FROM listed WHERE found >= key) AS found FROM asked")
def upper_bound_search(spark, sf_dir):
    """The first listed key that is not below a key."""
    lines = order_lines(spark, sf_dir)
    return search.next_of(lines.select("key").distinct(), lines.filter("l_quantity >= 45").select("key").distinct(), "key", lambda k: F.shiftright(k, BUCKET_BITS))


@query(
    _CELLS + """, t AS (SELECT key, n, (sum(n) OVER (ORDER BY key))::BIGINT AS s, ((sum(n) OVER ()) // 16)::BIGINT AS a, ((sum(n) OVER ()) % 16)::BIGINT AS e FROM cells)
SELECT key, n, (CASE WHEN s <= e * (a + 1) THEN (s - 1) // (a + 1) ELSE least((s - e * (a + 1) - 1) // a + e, 15) END)::INT AS part FROM t"""
)
def quota_partition(spark, sf_dir):
    """Parts in order whose first ones take one point more than the others."""
    return search.quota_parts(counted(spark, sf_dir), ["key"], F.col("n"), 16, bucket())


@query(
    f"WITH {KEYED}, blocks AS (SELECT key >> {3 * (DEPTH - BLOCK)} AS block, count(*) AS points FROM keyed GROUP BY ALL),"
    " summed AS (SELECT *, sum(points) OVER (ORDER BY points DESC, block) - points AS above, sum(points) OVER () AS whole FROM blocks) SELECT block, points FROM summed WHERE above <= whole * 0.5"
)
def heavy_blocks(spark, sf_dir):
    """The heaviest blocks, as many as hold more than half of all points."""
    blocks = order_lines(spark, sf_dir).groupBy(K.up("key", DEPTH - BLOCK).alias("block")).agg(F.count("*").alias("points"))
    return search.heaviest(blocks, "points", 0.5, "block")


@query(
    f"WITH {KEYED}, asked AS (SELECT DISTINCT key >> {3 * (DEPTH - BLOCK)} AS prefix FROM keyed), {_decoded_blocks()}"
)
def neighbouring_blocks(spark, sf_dir):
    """Pairs of occupied blocks that touch."""
    blocks = tree.cut(order_lines(spark, sf_dir).select(K.up("key", DEPTH - BLOCK).alias("block")).distinct())
    around = blocks.select("block", F.explode(K.neighbours(F.lit(BLOCK), F.col("block"))).alias("other"))
    return around.join(blocks.toDF("other"), "other", "left_semi").select("block", "other")


@query(
    f"WITH {KEYED}, once AS (SELECT DISTINCT key FROM keyed WHERE x > 0 AND y > 0 AND z > 0), {_tree_sql('leaves', most=1, source='once')}, {_balanced()} SELECT level::INT AS level, prefix FROM balanced"
)
def points_to_balanced_octree(spark, sf_dir):
    """From raw points to a balanced tree: filtered, distinct, moved to their
    cells' centres, constructed with one point a leaf, balanced."""
    lines = order_lines(spark, sf_dir).filter("x > 0 and y > 0 and z > 0").select("x", "y", "z").distinct()
    centres = lines.select(*(c.alias(a) for a, c in zip("xyz", K.cell_centre(F.col("x"), F.col("y"), F.col("z"), depth=DEPTH), strict=True)))
    keyed = centres.select(K.interleave(*(K.quantise(F.col(a), DEPTH, 1.0) for a in "xyz")).alias("key"))
    return tree.balance(tree.construct(keyed, DEPTH, 1))


@query(
    _TREE + f""", listed AS (SELECT level, prefix, row_number() OVER (ORDER BY prefix << (3 * ({DEPTH} - level))) - 1 AS id, count(*) OVER () AS n FROM leaves)
SELECT level::INT AS level, prefix, least(id // greatest(n // 5, 1), 4)::INT AS part FROM listed"""
)
def split_octree(spark, sf_dir):
    cells = leaves(spark, sf_dir).withColumn("key", K.first_key(F.col("level"), F.col("prefix"), DEPTH))
    return search.split(cells, ["key"], 5, bucket()).select("level", "prefix", "part")


@query(f"WITH {KEYED} SELECT DISTINCT key FROM keyed WHERE x > 0 AND y > 0 AND z > 0")
def distinct_points(spark, sf_dir):
    return order_lines(spark, sf_dir).filter("x > 0 and y > 0 and z > 0").select("key").dropDuplicates()


# -------------------------------------------------------------------- files


@query(_TREE + f" SELECT level::INT AS level, prefix, c::INT AS corner, ({_decode('prefix', 0)} + (c & 1)) * pow(0.5, level) AS x, ({_decode('prefix', 1)} + ((c >> 1) & 1)) * pow(0.5, level) AS y, ({_decode('prefix', 2)} + (c >> 2)) * pow(0.5, level) AS z FROM leaves, range(0, 8) t(c)")
def vtk_corners(spark, sf_dir):
    return files.vtk_corners(leaves(spark, sf_dir))


@query(
    _TREE + f"""  , cell AS (SELECT level, prefix << (3 * ({DEPTH} - level)) AS key FROM leaves)
SELECT key AS ordinal, level::INT AS level, concat_ws(' ', {_decode("key", 0)}, {_decode("key", 1)}, {_decode("key", 2)}, level) AS value FROM cell
UNION ALL SELECT -2, 0, '3 {DEPTH}' UNION ALL SELECT -1, 0, count(*)::VARCHAR FROM cell"""
)
def octree_file(spark, sf_dir):
    return files.octree_lines(leaves(spark, sf_dir), DEPTH)


_CORNER = " || ' ' || ".join(f"(({_decode('prefix', a)} + ((c >> {a}) & 1)) << ({DEPTH} - level))" for a in range(3))


@query(
    _TREE + f""", cell AS (SELECT level, prefix, row_number() OVER (ORDER BY prefix << (3 * ({DEPTH} - level))) - 1 AS id, count(*) OVER () AS n FROM leaves),
body AS (
  SELECT 1 AS section, id * 8 + c AS ordinal, ({_CORNER})::VARCHAR AS value FROM cell, range(0, 8) t(c)
  UNION ALL SELECT 2, id, concat_ws(' ', 8, id * 8, id * 8 + 1, id * 8 + 2, id * 8 + 3, id * 8 + 4, id * 8 + 5, id * 8 + 6, id * 8 + 7) FROM cell
  UNION ALL SELECT 3, id, '11' FROM cell
  UNION ALL SELECT 4, id, (least(id // greatest(n // 5, 1), 4))::VARCHAR FROM cell
), head AS (
  SELECT 0 AS section, o AS ordinal, v AS value FROM (VALUES (0, '# vtk DataFile Version 2.0'), (1, 'octree'), (2, 'ASCII'), (3, 'DATASET UNSTRUCTURED_GRID')) h(o, v)
  UNION ALL SELECT 1, -1, 'POINTS ' || 8 * count(*) || ' int' FROM cell UNION ALL SELECT 2, -1, 'CELLS ' || count(*) || ' ' || 9 * count(*) FROM cell
  UNION ALL SELECT 3, -1, 'CELL_TYPES ' || count(*) FROM cell UNION ALL SELECT 4, -3, 'CELL_DATA ' || count(*) FROM cell
  UNION ALL SELECT 4, -2, 'SCALARS owner int' UNION ALL SELECT 4, -1, 'LOOKUP_TABLE default'
) SELECT section, ordinal::BIGINT AS ordinal, value FROM body UNION ALL SELECT * FROM head"""
)
def vtk_octree(spark, sf_dir):
    """The lines of a VTK file of a tree in five parts."""
    cells = leaves(spark, sf_dir).withColumn("key", K.first_key(F.col("level"), F.col("prefix"), DEPTH))
    return files.vtk_octree_lines(search.split(cells, ["key"], 5, bucket(), "owner"), DEPTH, BUCKET_BITS)


@query(_TREE + " SELECT level::INT AS level, prefix FROM leaves")
def octree_round_trip(spark, sf_dir):
    """A tree written to text files by the executors and read back."""
    at = files.scratch(spark)
    files.write_lines(files.octree_lines(leaves(spark, sf_dir), DEPTH), at, ["ordinal", "level"])
    return files.read_octree(spark, at)[0]


@query(f"WITH {KEYED} SELECT x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, l_quantity::DOUBLE AS value FROM keyed")
def points_list(spark, sf_dir):
    """Points with values written as ``.pts`` files and read back."""
    content = files.pts_bytes(order_lines(spark, sf_dir), value="l_quantity")
    return files.decode_pts(content.select(F.col("part").cast("string").alias("path"), "content"), values=True).drop("path")


@query(
    f"""WITH {KEYED}, cell AS (SELECT c AS prefix, count(key) AS n FROM range(0, 512) t(c) LEFT JOIN keyed ON key >> {3 * (DEPTH - 3)} = c GROUP BY ALL)
SELECT {_decode("prefix", 0)} + 8 * ({_decode("prefix", 1)} + 8 * {_decode("prefix", 2)}) AS ordinal, n::VARCHAR AS value FROM cell
UNION ALL SELECT * FROM (VALUES (-10, '# vtk DataFile Version 2.0'), (-9, 'grid'), (-8, 'ASCII'), (-7, 'DATASET STRUCTURED_POINTS'), (-6, 'DIMENSIONS 8 8 8'),
  (-5, 'ORIGIN 0 0 0'), (-4, 'SPACING 0.125 0.125 0.125'), (-3, 'POINT_DATA 512'), (-2, 'SCALARS value double'), (-1, 'LOOKUP_TABLE default')) h"""
)
def vtk_grid(spark, sf_dir):
    """The lines of a VTK file of the points in each cell of a regular grid."""
    counts = order_lines(spark, sf_dir).groupBy(K.up("key", 3).alias("prefix")).agg(F.count("*").alias("value"))
    grid = tree.regular(spark, 3).select("prefix").join(counts, "prefix", "left").select("prefix", F.coalesce("value", F.lit(0)).alias("value"))
    return files.vtk_grid_lines(grid, 3)


@query(
    _MESH + f""", node AS (SELECT nx, ny, nz, row_number() OVER (ORDER BY {_encode("nx", "ny", "nz", bits=_D + 1)}) - 1 AS node FROM (SELECT DISTINCT nx, ny, nz FROM element))
SELECT node AS ordinal, concat_ws(' ', nx / {1 << _D}e0, ny / {1 << _D}e0, nz / {1 << _D}e0) AS value FROM node
UNION ALL SELECT * FROM (VALUES (-5, '# vtk DataFile Version 2.0'), (-4, 'points'), (-3, 'ASCII'), (-2, 'DATASET POLYDATA')) h
UNION ALL SELECT -1, concat('POINTS ', count(*), ' double') FROM node"""
)
def vtk_points(spark, sf_dir):
    """The lines of a VTK file of a mesh's nodes."""
    nodes = tree.cut(mesh.node_numbers(tree.cut(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH))))
    return files.vtk_point_lines(nodes.select("node", *((F.col(n) / float(1 << MESH_DEPTH)).alias(a) for n, a in zip(mesh.AT, K.AXES, strict=True))), "node")


@query()
def gaussian_octree(spark, sf_dir):
    drawn = files.gaussian(spark, 20_000, seed=7)
    key = K.interleave(*(K.quantise(F.col(a), DEPTH, 1.0) for a in K.AXES))
    return tree.construct(drawn.select(key.alias("key")), DEPTH, MOST)


# ------------------------------------------------------------ mesh and FEM


@query(_MESH + " SELECT level::INT AS level, prefix, vertex::INT AS vertex FROM hang")
def hanging_vertices(spark, sf_dir):
    return mesh.hanging(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH)


@query(_MESH + " SELECT level::INT AS level, prefix, vertex::INT AS vertex, hangs, nx, ny, nz FROM element")
def element_nodes(spark, sf_dir):
    return mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH)


@query(_MESH + f" SELECT DISTINCT nx, ny, nz, ((nx % {1 << _D} = 0)::INT + (ny % {1 << _D} = 0)::INT + (nz % {1 << _D} = 0)::INT)::INT AS boundary FROM element")
def mesh_nodes(spark, sf_dir):
    return mesh.nodes(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH), MESH_DEPTH)


@query(
    _MESH + f""", node AS (SELECT nx, ny, nz, row_number() OVER (ORDER BY {_encode("nx", "ny", "nz", bits=_D + 1)}) - 1 AS node FROM (SELECT DISTINCT nx, ny, nz FROM element)),
cell AS (SELECT level, prefix, row_number() OVER (ORDER BY prefix << (3 * ({_D} - level))) - 1 AS element FROM balanced)
SELECT c.element, e.vertex::INT AS vertex, n.node FROM element e JOIN cell c ON c.level = e.level AND c.prefix = e.prefix JOIN node n ON n.nx = e.nx AND n.ny = e.ny AND n.nz = e.nz"""
)
def numbered_mesh(spark, sf_dir):
    return mesh.numbered(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH), MESH_DEPTH)


@query(
    _MESH + """, kind AS (SELECT level, prefix, (prefix & 7)::INT AS child, sum(CASE WHEN hangs THEN 1 << vertex ELSE 0 END)::INT AS mask FROM element GROUP BY level, prefix)
SELECT child, mask, count(*) AS elements FROM kind GROUP BY ALL"""
)
def element_types(spark, sf_dir):
    kinds = mesh.masks(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH))
    return kinds.groupBy("child", "mask").agg(F.count("*").alias("elements"))


@query(_MESH + " SELECT level::INT AS level, count(*) // 8 AS elements, count(*) FILTER (hangs) AS hanging, NOT bool_or(hangs) AS regular FROM element GROUP BY level")
def mesh_statistics(spark, sf_dir):
    rows = mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH).groupBy("level")
    return rows.agg(F.expr("count(*) div 8").alias("elements"), F.count(F.when(F.col("hangs"), 1)).alias("hanging"), (~F.bool_or("hangs")).alias("regular"))


@query(_MESH + f" SELECT DISTINCT nx, ny FROM element WHERE nz = {1 << _D - 1}")
def mesh_slice(spark, sf_dir):
    nodes = mesh.nodes(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH), MESH_DEPTH)
    return nodes.filter(F.col("nz") == 1 << MESH_DEPTH - 1).select("nx", "ny")


def _shape(at: list[str], v: str) -> str:
    return " * ".join(f"CASE WHEN ({v} >> {a}) & 1 = 1 THEN {t} ELSE 1 - {t} END" for a, t in enumerate(at))


def _assembled(spark, sf_dir, stiffness=1.0, mass=1.0) -> tuple[DataFrame, DataFrame]:
    elements = tree.cut(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH))
    return elements, tree.cut(fem.matrix(elements, MESH_DEPTH, stiffness, mass))


def _linear(nodes: DataFrame) -> DataFrame:
    return nodes.select(*mesh.AT, (F.col("nx") + 2 * F.col("ny") + 3 * F.col("nz")).cast("double").alias("value"))


@query(
    _FEM + f", {_product('n.u')} SELECT nx, ny, nz, {_units('value')} AS value FROM product"
)
def matrix_vector(spark, sf_dir):
    elements = tree.cut(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH))
    return fem.product(elements, _linear(mesh.nodes(elements, MESH_DEPTH)), 1.0, 1.0).select(*mesh.AT, _snapped())


@query(_FEM + f", {_product('n.u')} SELECT nx, ny, nz, {_units('value')} AS value FROM product")
def assembled_product(spark, sf_dir):
    """As matrix_vector, with the assembled matrix."""
    elements, operator = _assembled(spark, sf_dir)
    return fem.times(operator, _linear(mesh.nodes(elements, MESH_DEPTH))).select(*mesh.AT, _snapped())


@query(
    _FEM + f""", own AS (
  SELECT q.nx, q.ny, q.nz, sum(q.w * p.w * (e.stiff * pow(0.5e0, q.level) + e.mass * pow(0.125e0, q.level))) AS value
  FROM q JOIN q p ON p.level = q.level AND p.prefix = q.prefix AND p.nx = q.nx AND p.ny = q.ny AND p.nz = q.nz JOIN entry e ON e.v = q.v AND e.w = p.v GROUP BY ALL)
SELECT nx, ny, nz, {_units("value")} AS value FROM own"""
)
def matrix_diagonal(spark, sf_dir):
    return fem.diagonal(_assembled(spark, sf_dir)[1]).select(*mesh.AT, _snapped())


@query(
    _MESH + f""", {_coarser("balanced", "1")}, {_elements("balanced1", "1")}, {_weights("1")}, vertex AS (
  SELECT level, prefix, v, sum(w * (nx + 2 * ny + 3 * nz)) AS u FROM q1 GROUP BY ALL
), point AS (SELECT DISTINCT nx, ny, nz, {_encode(*(f"least({n}, {(1 << _D) - 1})" for n in mesh.AT))} AS key FROM element
), inside AS (
  SELECT p.nx, p.ny, p.nz, b.level, b.prefix, {", ".join(f"(p.n{a} - (b.{a} << ({_D} - b.level))) / (1 << ({_D} - b.level))::DOUBLE AS t{a}" for a in "xyz")}
  FROM point p JOIN balanced1 b ON b.prefix = p.key >> (3 * ({_D} - b.level))
)
SELECT nx, ny, nz, round(sum(u * {_shape(["tx", "ty", "tz"], "v")}), 9) AS value FROM inside JOIN vertex USING (level, prefix) GROUP BY ALL"""
)
def interpolation(spark, sf_dir):
    """Values of a nodal field at the cells' next coarser nodes, prolonged."""
    fine = mesh_tree(spark, sf_dir)
    levels = multigrid.hierarchy(fine, 2, fewest=1)
    grids = [tree.cut(mesh.elements(level, MESH_DEPTH)) for level in levels]
    table = multigrid.transfer(grids[0], grids[-1], MESH_DEPTH)
    return multigrid.prolong(table, _linear(mesh.nodes(grids[-1], MESH_DEPTH))).select(*mesh.AT, F.round("value", 9).alias("value"))


@query(_FEM + " SELECT min(u)::DOUBLE AS least, max(u)::DOUBLE AS most, max(abs(u - 200))::DOUBLE AS error FROM node")
def field_extremes(spark, sf_dir):
    """Least and greatest nodal value and the largest distance from 200."""
    grid = mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH)
    return fields.extremes(_linear(mesh.nodes(grid, MESH_DEPTH)), F.lit(200.0))


@query()
def conjugate_gradients(spark, sf_dir):
    elements, operator = _assembled(spark, sf_dir)
    right = mesh.nodes(elements, MESH_DEPTH).select(*mesh.AT, F.col("boundary").cast("double").alias("value"))
    _, residual = fem.conjugate_gradients(lambda v: fem.times(operator, v), tree.cut(right), rounds=3)
    return spark.createDataFrame([(3, residual)], "rounds int, residual double")


@query(
    _MESH + f""", {_coarser("balanced", "1")}, {_coarser("balanced1", "2")}
SELECT 0 AS grid, count(*) AS cells FROM balanced UNION ALL SELECT 1, count(*) FROM balanced1 HAVING (SELECT count(*) FROM balanced) >= 8
UNION ALL SELECT 2, count(*) FROM balanced2 HAVING least((SELECT count(*) FROM balanced), (SELECT count(*) FROM balanced1)) >= 8"""
)
def grid_hierarchy(spark, sf_dir):
    levels = multigrid.hierarchy(mesh_tree(spark, sf_dir), 3, fewest=8)
    rows = [(k, level.count()) for k, level in enumerate(levels)]
    return spark.createDataFrame(rows, "grid int, cells bigint")


def _waves(x, y, z):
    return F.cos(x * 3.0) + y * z


@query(
    _FEM + f""", gauss AS (SELECT * FROM (VALUES {", ".join(f"({x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE, {w!r}::DOUBLE)" for (x, y, z), w in fem.quadrature())}) g(gx, gy, gz, weight)
), part AS (
  SELECT level, prefix, v, sum(weight * {_shape(["gx", "gy", "gz"], "v")} * (cos(3 * ((x + gx) * pow(0.5e0, level))) + (y + gy) * pow(0.5e0, level) * ((z + gz) * pow(0.5e0, level))) * pow(0.125e0, level)) AS value
  FROM balanced, gauss, range(0, 8) t(v) GROUP BY ALL
)
SELECT q.nx, q.ny, q.nz, round(sum(q.w * p.value), 9) AS value FROM q JOIN part p ON p.level = q.level AND p.prefix = q.prefix AND p.v = q.v GROUP BY ALL"""
)
def right_hand_side(spark, sf_dir):
    grid = tree.cut(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH))
    return fields.load(grid, _waves).select(*mesh.AT, F.round("value", 9).alias("value"))


@query(
    _FEM + f""", vertex AS (SELECT level, prefix, v, sum(w * (nx + 2 * ny + 3 * nz)) AS u FROM q GROUP BY ALL
), inside AS (
  SELECT k.l_orderkey, k.l_linenumber, row_number() OVER () AS point, b.level, b.prefix, {", ".join(f"(k.{a} + 0.5e0) / {1 << DEPTH} * (1 << b.level) - b.{a} AS t{a}" for a in "xyz")}
  FROM keyed k JOIN balanced b ON b.prefix = (k.key >> {3 * (DEPTH - _D)}) >> (3 * ({_D} - b.level))
)
SELECT l_orderkey, l_linenumber, round(sum(u * {_shape(["tx", "ty", "tz"], "v")}), 9) AS value, {", ".join(f"""round(sum(u * (2 * ((v >> {a}) & 1) - 1) * (1 << level) * {_shape([f"t{c}" if c != "xyz"[a] else f"(((v >> {a}) & 1)::DOUBLE)" for c in "xyz"], "v")}), 9) AS d{"xyz"[a]}""" for a in range(3))}
FROM inside JOIN vertex USING (level, prefix) GROUP BY point, l_orderkey, l_linenumber"""
)
def point_values(spark, sf_dir):
    """A nodal field and its slopes at the order lines' cell centres."""
    grid = tree.cut(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH))
    side = float(1 << DEPTH)
    points = order_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *(((F.col(a) + 0.5) / side).alias(a) for a in "xyz"))
    found = fields.at_points(points, grid, _linear(mesh.nodes(grid, MESH_DEPTH)), MESH_DEPTH)
    return found.select("l_orderkey", "l_linenumber", *(F.round(c, 9).alias(c) for c in ("value", "dx", "dy", "dz")))


_NUMBERS = _MESH + f""", node AS (SELECT nx, ny, nz, row_number() OVER (ORDER BY {_encode("nx", "ny", "nz", bits=_D + 1)}) - 1 AS node FROM (SELECT DISTINCT nx, ny, nz FROM element)),
cell AS (SELECT level, prefix, x, y, z, row_number() OVER (ORDER BY prefix << (3 * ({_D} - level))) - 1 AS element FROM balanced)"""


def _listed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows written as a binary list and read back."""
    return meshes.decode(meshes.encode(rows, kind, MESH_DEPTH), kind)


@query(_NUMBERS + " SELECT nx, ny, nz, node FROM node")
def node_list(spark, sf_dir):
    return _listed(mesh.node_numbers(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH)), "nodes")


@query(_NUMBERS + f" SELECT {', '.join(f'{a} << ({_D} - level) AS {a}' for a in 'xyz')}, level::BIGINT AS level, element FROM cell")
def element_list(spark, sf_dir):
    numbers = mesh.element_numbers(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH), MESH_DEPTH)
    return _listed(meshes.element_rows(numbers, MESH_DEPTH), "elements")


@query(
    _NUMBERS + f""" SELECT c.element, {", ".join(f"max(n.node) FILTER (e.vertex = {v}) AS n{v}" for v in range(8))}
FROM element e JOIN cell c ON c.level = e.level AND c.prefix = e.prefix JOIN node n ON n.nx = e.nx AND n.ny = e.ny AND n.nz = e.nz GROUP BY c.element"""
)
def corner_list(spark, sf_dir):
    numbers = mesh.numbered(tree.cut(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH)), MESH_DEPTH)
    return _listed(meshes.corner_rows(numbers), "corners")


#: Grids of larger problems are coarsened while they have so many cells.
COARSE = 10_000


def _grids(spark, sf_dir) -> problems.Grids:
    """One grid if it is solved on the driver, which those of MESH_DEPTH are,
    else a hierarchy."""
    cells = tree.cut(mesh_tree(spark, sf_dir))
    levels = 1 if cells.limit(whole.ELEMENTS + 1).count() <= whole.ELEMENTS else 10
    return problems.Grids(cells, MESH_DEPTH, levels, fewest=COARSE)


def _solved(grids: problems.Grids, make: problems.Operator, right: DataFrame, fixed: str | None = None, coefficients: DataFrame | None = None, **factors) -> DataFrame:
    """The solution of ``make``'s operator, which ``factors`` describe to
    ``whole.Whole``."""
    if len(grids.meshes) == 1:
        held = grids.nodes().filter(fixed).select(*mesh.AT) if fixed else None
        found = whole.Whole(grids.meshes[0], coefficients=coefficients, **factors).solve(right, held)
    else:
        found, _ = problems.solve(grids, grids.operators(make, coefficients), right, fixed, rounds=ROUNDS, must=True, small=multigrid.SMALL)
    return found.withColumn("value", F.round("value", 4) + 0.0)


_GIVEN = "(nx + 2 * ny + 3 * nz) / 1000e0"
_INSIDE = "CASE WHEN fixed THEN 0e0 ELSE ((nx + 2 * ny + 3 * nz) % 10) / 10e0 END"


@query(_FEM + f" SELECT nx, ny, nz, {_GIVEN} AS value FROM node")
def neumann_problem(spark, sf_dir):
    """-div(a grad u) + u = f with natural boundaries, a growing with x, whose
    right-hand side belongs to a known u."""
    grids = _grids(spark, sf_dir)
    coefficient = fields.centres(grids.trees[0]).select("level", "prefix", (F.col("x") + 1).alias("a"))
    known = grids.nodes().select(*mesh.AT, F.expr("(nx + 2 * ny + 3 * nz) / 1000D").alias("value"))
    right = fem.product(grids.meshes[0], known, F.col("a"), 1.0, coefficient)
    return _solved(grids, problems.scalar(MESH_DEPTH, F.col("a"), 1.0), right, coefficients=coefficient, stiffness=F.col("a"), mass=1.0)


@query(_FEM + f" SELECT nx, ny, nz, {_INSIDE} AS value FROM node")
def dirichlet_problem(spark, sf_dir):
    """-div grad u = f, u = 0 on the boundary, f belonging to a known u."""
    grids = _grids(spark, sf_dir)
    known = grids.nodes().select(*mesh.AT, F.expr("CASE WHEN boundary > 0 THEN 0D ELSE ((nx + 2 * ny + 3 * nz) % 10) / 10D END").alias("value"))
    return _solved(grids, problems.scalar(MESH_DEPTH), fem.product(grids.meshes[0], known), "boundary > 0")


@query(_FEM + " SELECT nx, ny, nz, dof, nx * (dof + 1) / 1000e0 AS value FROM node, (SELECT range::INT AS dof FROM range(0, 3))")
def elasticity_problem(spark, sf_dir):
    """An elastic body held at x = 0, under the load of a known displacement."""
    grids = _grids(spark, sf_dir)
    known = grids.nodes().select(*mesh.AT, F.explode(F.array(*map(F.lit, range(3)))).alias("dof")).withColumn("value", F.expr("nx * (dof + 1) / 1000D"))
    return _solved(grids, problems.elastic(MESH_DEPTH), fem.elastic_product(grids.meshes[0], known), "nx = 0", elastic=(1.0, 1.0))


@query(
    _FEM + f""", mean AS (SELECT b.level, b.prefix, avg(k.l_quantity)::DOUBLE AS a FROM keyed k JOIN balanced b ON b.prefix = k.key >> (3 * ({_D} - b.level)) GROUP BY ALL
), vertex AS (SELECT q.level, q.prefix, q.v, sum(q.w * n.u) AS u FROM q JOIN node n ON n.nx = q.nx AND n.ny = q.ny AND n.nz = q.nz GROUP BY ALL
), row_ AS (
  SELECT x.level, x.prefix, e.v, sum((e.stiff * pow(0.5e0, x.level) * coalesce(m.a, 1) + e.mass * pow(0.125e0, x.level)) * x.u) AS r
  FROM vertex x JOIN entry e ON e.w = x.v LEFT JOIN mean m ON m.level = x.level AND m.prefix = x.prefix GROUP BY ALL
) SELECT q.nx, q.ny, q.nz, round(sum(q.w * r.r), 6) + 0e0 AS value FROM q JOIN row_ r ON r.level = q.level AND r.prefix = q.prefix AND r.v = q.v GROUP BY ALL"""
)
def variable_coefficients(spark, sf_dir):
    """The operator with the mean quantity of each element's points."""
    cells = tree.cut(mesh_tree(spark, sf_dir))
    grid = tree.cut(mesh.elements(cells, MESH_DEPTH))
    points = order_lines(spark, sf_dir).select("key", F.col("l_quantity").cast("double").alias("value"))
    coefficient = fields.from_points(points, cells, MESH_DEPTH, 1.0).withColumnRenamed("value", "mean")
    made = fem.product(grid, _linear(mesh.nodes(grid, MESH_DEPTH)), F.col("mean"), 1.0, coefficient)
    return made.select(*mesh.AT, (F.round("value", 6) + 0.0).alias("value"))


@query(_FEM + f", own AS (SELECT v, w, mass, 0 AS stiff FROM entry), {_product('n.u').replace('entry e', 'own e')} SELECT nx, ny, nz, dof, {_units('value * (dof + 1)')} AS value FROM product, (SELECT range::INT AS dof FROM range(0, 3))")
def vector_mass(spark, sf_dir):
    """The mass operator on a field with three values a node."""
    grid = tree.cut(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH))
    nodal = _linear(mesh.nodes(grid, MESH_DEPTH)).withColumn("dof", F.explode(F.array(*map(F.lit, range(3)))))
    return fem.vector_mass(grid, nodal.withColumn("value", F.col("value") * (F.col("dof") + 1))).select(*mesh.AT, "dof", _snapped())


@query(
    _FEM + f""", {_product("CASE WHEN n.fixed THEN 0 ELSE n.u END")}
SELECT nx, ny, nz, CASE WHEN fixed THEN u ELSE {_units("value")} END AS value FROM product JOIN node USING (nx, ny, nz)"""
)
def dirichlet_vector(spark, sf_dir):
    grid, operator = _assembled(spark, sf_dir)
    nodes = mesh.nodes(grid, MESH_DEPTH)
    bound = fem.dirichlet(operator, nodes.filter("boundary > 0"))
    return fem.times(bound, _linear(nodes)).select(*mesh.AT, _snapped())


@query(
    _FEM + f""", elastic AS ({" UNION ALL ".join(f"SELECT v, w, {a} AS dof, {'stiff + ' if a == b else ''}2 * ({_slopes(a, b)}) AS a FROM entry" for a in range(3) for b in range(3))}
), vertex AS (SELECT q.level, q.prefix, q.v, sum(q.w * n.u) AS u FROM q JOIN node n ON n.nx = q.nx AND n.ny = q.ny AND n.nz = q.nz GROUP BY ALL
), row_ AS (SELECT x.level, x.prefix, e.v, e.dof, sum(e.a * pow(0.5e0, x.level) * x.u) AS r FROM vertex x JOIN elastic e ON e.w = x.v GROUP BY ALL
), product AS (SELECT q.nx, q.ny, q.nz, r.dof, sum(q.w * r.r) AS value FROM q JOIN row_ r ON r.level = q.level AND r.prefix = q.prefix AND r.v = q.v GROUP BY ALL)
SELECT nx, ny, nz, dof::INT AS dof, {_units("value")} AS value FROM product"""
)
def elasticity_vector(spark, sf_dir):
    grid = tree.cut(mesh.elements(tree.cut(mesh_tree(spark, sf_dir)), MESH_DEPTH))
    moved = _linear(mesh.nodes(grid, MESH_DEPTH)).withColumn("dof", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return fem.times(fem.elastic_matrix(grid, MESH_DEPTH), moved).select(*mesh.AT, "dof", _snapped())


@query(
    _MESH + f""", {_coarser("balanced", "1")}, {_elements("balanced1", "1")}, node AS (SELECT DISTINCT nx, ny, nz FROM element)
SELECT c.nx, c.ny, c.nz, CASE WHEN n.nx IS NULL THEN 0 ELSE c.nx + 2 * c.ny + 3 * c.nz END::DOUBLE AS value
FROM (SELECT DISTINCT nx, ny, nz FROM element1) c LEFT JOIN node n ON n.nx = c.nx AND n.ny = c.ny AND n.nz = c.nz"""
)
def injected_field(spark, sf_dir):
    """A fine nodal field at the nodes of the next coarser grid."""
    levels = multigrid.hierarchy(mesh_tree(spark, sf_dir), 2, fewest=1)
    fine, coarse = (mesh.nodes(mesh.elements(g, MESH_DEPTH), MESH_DEPTH) for g in (levels[0], levels[-1]))
    return mesh.inject(_linear(fine), coarse)


@query()
def generated_points(spark, sf_dir):
    """Points a cell of level 2 of each generated cloud."""
    clouds = {"sphere": files.sphere(spark, 5000, 3), "corners": files.corners(spark, 5000, 4), "doubled": files.doubled(files.gaussian(spark, 5000, 5, log=True)), "peaks": files.peaks(spark, 70)}
    out = None
    for name, cloud in clouds.items():
        key = K.interleave(*(K.quantise(F.col(a), 2, 1.0) for a in K.AXES))
        each = cloud.groupBy(F.lit(name).alias("cloud"), key.alias("prefix")).agg(F.count("*").alias("n"))
        out = each if out is None else out.unionByName(each)
    return out
