"""Place of a row's key among a sorted list of cut points.

Used for buckets of a key, for jobs cut by time and for jobs cut by id. It is a
binary search written as one fold over the halving steps, so its cost is the
logarithm of the list and its plan does not grow when a filter on the answer is
pushed down. Long lists are searched in two levels: a short root list in the
plan, and the leaf lists in a small table that is joined on the root's answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The longest list put into the plan as literals.
ROOT_POINTS = 255
# Points of one level of a search by trees; larger trees are too long a method for the compiler.
TREE_POINTS, TREE_POINTS_WIDE = 32, 8
# Types whose text form is exact and has no comma.
_PLAIN = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampNTZType)
# The longest list allowed at all; the leaf table holds one value per point and key.
MAX_POINTS = 200_000


def count_points_before(
    df: DataFrame,
    keys: Sequence[str],
    points: Sequence[tuple],
    out: str,
    *,
    inclusive: bool,
    root_points: int | None = None,
    compiled: bool = False,
) -> DataFrame:
    """Add ``out``: how many of the ``points`` are below the row's key.

    ``points`` hold one value per key and are sorted as Spark sorts the keys,
    nulls first. With ``inclusive`` a point equal to the key counts too. A null
    is smaller than every value and equal to another null, in points and rows.

    ``compiled`` searches by two small decision trees that become part of the
    generated code, several times faster than the fold. It is for an ``out`` that
    nobody filters by: a filter that is pushed down would write the trees out in each
    other.
    """
    root_limit = ROOT_POINTS if root_points is None else root_points
    if len(points) > MAX_POINTS:
        raise ValueError(f"{len(points)} cut points; at most {MAX_POINTS} can be searched")
    types = [df.schema[k].dataType for k in keys]
    small = len(points) < (TREE_POINTS if len(keys) == 1 else TREE_POINTS_WIDE) ** 2
    if compiled and points and small and not any(None in p for p in points):
        return _by_trees(df, keys, points, types, out, inclusive)
    below = _below_or_null if any(None in p for p in points) else _below
    if len(points) <= root_limit:
        found = _search(keys, _literals(points, types), len(points), inclusive, below)
        return df.withColumn(out, found)
    stride = -(-len(points) // root_limit)
    root = points[stride - 1 :: stride]
    group = f"{out}_group"
    leaf_columns = [f"{out}_leaf{i}" for i in range(len(keys))]
    leaves = []
    for g in range(len(root) + 1):
        members = points[g * stride : (g + 1) * stride]
        leaves.append((g, *[[p[i] for p in members] for i in range(len(keys))]))
    schema = T.StructType(
        [T.StructField(group, T.IntegerType(), False)]
        + [T.StructField(c, T.ArrayType(t), False) for c, t in zip(leaf_columns, types)]
    )
    # At most MAX_POINTS values per key: a few megabytes at the worst.
    table = F.broadcast(df.sparkSession.createDataFrame(leaves, schema))
    at_root = df.withColumn(group, _search(keys, _literals(root, types), len(root), inclusive, below))
    in_leaf = _search(keys, [F.col(c) for c in leaf_columns], stride, inclusive, below, in_columns=True)
    joined = at_root.join(table, group)
    return joined.withColumn(out, F.col(group) * F.lit(stride) + in_leaf).drop(group, *leaf_columns)


def _by_trees(
    df: DataFrame, keys: Sequence[str], points: Sequence[tuple], types: Sequence[T.DataType], out: str, inclusive: bool
) -> DataFrame:
    """The search in two levels: every ``stride``-th point first, then the points up to the next of these."""
    stride = 1
    while stride * stride <= len(points):
        stride += 1
    group = f"{out}_group"
    lists = _literals(points, types)
    own = [F.col(k) for k in keys]

    def tree(low: int, high: int, at: Callable[[int], Column]) -> Column:
        """How many of the points ``low`` to below ``high`` are below the key, plus ``low``."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        below = _below([F.get(a, at(middle)) for a in lists], own, inclusive)
        return F.when(below, tree(middle + 1, high, at)).otherwise(tree(low, middle, at))

    roots = len(points) // stride
    at_root = df.withColumn(group, tree(0, roots, lambda i: F.lit((i + 1) * stride - 1)))
    first = F.col(group) * F.lit(stride)
    # Behind the last point there is none, which reads as not below.
    in_leaf = tree(0, stride - 1, lambda i: first + F.lit(i))
    return at_root.withColumn(out, first + in_leaf).drop(group)


def _literals(points: Sequence[tuple], types: Sequence[T.DataType]) -> list[Column]:
    return [_literal_array([p[i] for p in points], dtype) for i, dtype in enumerate(types)]


def _literal_array(values: list, dtype: T.DataType) -> Column:
    """An array that Spark folds to one literal; as text it is a single call, however long."""
    if isinstance(dtype, _PLAIN) and None not in values:
        texts = [v.isoformat(sep=" ") if isinstance(v, datetime) else str(v) for v in values]
        return F.split(F.lit(",".join(texts)), ",").cast(T.ArrayType(dtype))
    return F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(dtype))


def _search(
    keys: Sequence[str],
    arrays: Sequence[Column],
    size: int,
    inclusive: bool,
    compare: Callable[[list[Column], list[Column], bool], Column],
    in_columns: bool = False,
) -> Column:
    """The fold. ``in_columns`` tells that the arrays are columns and not literals.

    The row's columns come in as the argument of an outer lambda, so that the
    fold refers to no column: the optimizer may take a column inside a lambda
    for one of the lambda's own variables when it infers join filters.
    """
    if size == 0:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])
    carried = {f"k{i}": F.col(k) for i, k in enumerate(keys)}
    if in_columns:
        carried.update({f"a{i}": a for i, a in enumerate(arrays)})

    def place(row: Column) -> Column:
        lists = [row[f"a{i}"] if in_columns else a for i, a in enumerate(arrays)]
        key = [row if len(carried) == 1 else row[f"k{i}"] for i in range(len(keys))]

        def advance(found: Column, step: Column) -> Column:
            below = compare([F.get(a, found + step - 1) for a in lists], key, inclusive)
            if compare is _below_or_null:
                # A null may be a point here, so it cannot tell of a place behind the end.
                below = (found + step <= F.size(lists[0])) & below
            return F.when(below, found + step).otherwise(found)

        return F.aggregate(steps, F.lit(0), advance)

    columns = [v.alias(c) for c, v in carried.items()]
    row = columns[0] if len(columns) == 1 else F.struct(*columns)
    return F.coalesce(F.get(F.transform(F.array(row), place), F.lit(0)), F.lit(0))


def _below(point: list[Column], key: list[Column], inclusive: bool) -> Column:
    """Lexicographic compare; null (no such point, or a null key) reads as false."""
    result = point[-1] <= key[-1] if inclusive else point[-1] < key[-1]
    for p, k in zip(reversed(point[:-1]), reversed(key[:-1])):
        result = (p < k) | ((p == k) & result)
    return result


def _below_or_null(point: list[Column], key: list[Column], inclusive: bool) -> Column:
    """The same where points may hold nulls, which come first and equal each other."""
    result = F.lit(inclusive)
    for p, k in zip(reversed(point), reversed(key)):
        smaller = F.coalesce(p < k, p.isNull() & k.isNotNull())
        result = smaller | (p.eqNullSafe(k) & result)
    return result
