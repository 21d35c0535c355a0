"""Rows as JSON text, and the rows that cannot be written as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.times import nano_text

# Characters that are written as escapes in messages.
ESCAPES = {
    "&": r"\u0026",
    "<": r"\u003c",
    ">": r"\u003e",
    "\u2028": r"\u2028",
    "\u2029": r"\u2029",
}

# The smallest double with all its digits.
LEAST_NORMAL = 2.0**-1022


def json_text(df: DataFrame, fields: Mapping[str, Column] | None = None) -> Column:
    """One JSON object per row: keys sorted at every level, nulls kept, times as text.

    ``fields`` name the members, by default all columns of the frame. Fractional
    numbers are written as in :func:`number_text`; a ``VARIANT`` keeps its own.
    """
    fields = fields or {c: F.col(_quoted(c)) for c in df.columns}
    types = {f.name: f.dataType for f in df.select(*[v.alias(n) for n, v in fields.items()]).schema}
    text = _object([(n, fields[n], types[n]) for n in sorted(fields)])
    escaped = text
    for char, escape in ESCAPES.items():
        escaped = F.replace(escaped, F.lit(char), F.lit(escape))
    return F.when(_has_special(fields, types, text), escaped).otherwise(text)


def number_text(value: Column) -> Column:
    """A fractional number as JSON text: ``1``, ``10000000``, ``0.00001``, ``1e+21``, ``1.5e-7``.

    Digits stand in full from 1e-6 up to below 1e21, without a point if whole;
    beyond, there is an exponent with its sign. Numbers that are not finite have
    no form in JSON and are quoted.
    """
    text, size = value.cast("string"), F.abs(value)
    # Most numbers stand as Spark writes them; the rest goes through one SQL lambda.
    plain = (F.length(text) <= 16) & (size < 1e7) & ((size >= 1e-3) | (size == 0))
    whole = F.substr(text, F.lit(1), F.length(text) - 2)
    return F.when(plain, F.when(text.endswith(".0"), whole).otherwise(text)).otherwise(
        F.get(F.call_function("transform", F.array(value), F.expr(_NUMBER)), F.lit(0))
    )


def shortest_text(value: Column) -> Column:
    """A fractional number as Spark writes it, with as few digits as read back as the same number.

    Older Java runtimes write some numbers with digits that are not needed. A
    number of up to 15 digits is always the shortest, so only longer ones are looked
    at: of the numbers with 15, 16 and 17 digits about the one written, those with
    the fewest digits that read back are taken, and of several the nearest. Numbers
    below the smallest normal one have fewer digits to themselves and are all looked at.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(f"v -> {_SHORTEST}")), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` is a value that is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _shortest_sql() -> str:
    """SQL of the shortest text of a number ``v``. As text it is one call, not hundreds.

    ``m`` are the digits without sign and point, ``n`` how many, ``scale`` of them
    behind the point, ``power`` the written exponent and ``place`` that of the last digit.
    """
    parts = _let(
        "t",
        "cast(v as string)",
        _let(
            "d",
            r"regexp_replace(t, 'E.*|^-?0*\\.?0*|[-.]', '')",
            r"""named_struct('text', t, 'm', try_cast(d as bigint), 'n', length(d),
                'scale', length(regexp_extract(t, '\\.([0-9]+)', 1)), 'power', regexp_extract(t, 'E.*', 0),
                'place', coalesce(try_cast(regexp_extract(t, 'E(.*)', 1) as int), 0)
                         - length(regexp_extract(t, '\\.([0-9]+)', 1)))""",
        ),
    )

    def written(number: str) -> str:
        padded = f"lpad(cast({number} as string), greatest(p.scale + 1, length(cast({number} as string))), '0')"
        short = _let(
            "q",
            padded,
            r"""regexp_replace(rtrim('0', concat(substr(q, 1, length(q) - p.scale), '.',
                substr(q, length(q) - p.scale + 1))), '\\.$', '.0')""",
        )
        # A number that is rounded up to the next power of ten has another exponent.
        raised = "concat('1.0E', cast(try_cast(substr(p.power, 2) as int) + 1 as string))"
        text = _let("s", short, f"if(startswith(s, '10.') and p.power <> '', {raised}, concat(s, p.power))")
        return f"concat(if(v < 0, '-', ''), {text})"

    # From 2^53 on a number is whole; in two halves it fits a decimal with all its digits.
    exact = """cast(floor(abs(v) / 1099511627776D) as decimal(19,0)) * cast(1099511627776L as decimal(13,0))
        + cast(abs(v) - cast(floor(abs(v) / 1099511627776D) as double) * 1099511627776D as bigint)"""
    known = "abs(v) >= 9007199254740992D and abs(v) < 1e30D and p.place >= 0"
    apart = f"""cast(if({known}, abs({exact} - try_cast(concat(cast(c as string), repeat('0', p.place)) as decimal(38,0))),
        abs(p.m - c)) as decimal(38,0))"""
    near = _let(
        "u",
        "cast(pow(10D, p.n - wanted) as bigint)",
        f"""array_min(transform(filter(array(p.m - p.m % u - u, p.m - p.m % u, p.m - p.m % u + u),
            c -> try_cast({written("c")} as double) = v), c -> named_struct('apart', {apart}, 'number', c))).number""",
    )
    lengths = f"filter(sequence(if(abs(v) < {LEAST_NORMAL!r}D, 1, 15), 17), wanted -> wanted <= p.n)"
    best = _let(
        "best", f"get(filter(transform({lengths}, wanted -> {near}), c -> c is not null), 0)",
        f"coalesce({written('best')}, p.text)",
    )
    may_be_long = f"length(cast(v as string)) > 16 or (v <> 0 and abs(v) < {LEAST_NORMAL!r}D)"
    return f"if({may_be_long}, {_let('p', parts, best)}, cast(v as string))"


_SHORTEST = _shortest_sql()
# Spark writes an exponent outside 1e-3 to 1e7; the decimal types hold every digit of the numbers in between.
_NUMBER = "v -> " + _let(
    "x",
    _SHORTEST,
    r"""case when isnan(v) or abs(v) = double('infinity') then concat('"', x, '"')
        when endswith(x, '.0') then substr(x, 1, length(x) - 2)
        when not contains(x, 'E') then x
        when abs(v) >= 1e7D and abs(v) < 1e21D
            then regexp_replace(cast(try_cast(x as decimal(38,16)) as string), '\\.?0+$', '')
        when abs(v) < 1e-3D and abs(v) >= 1e-6D
            then regexp_replace(cast(try_cast(x as decimal(38,30)) as string), '0+$', '')
        else regexp_replace(regexp_replace(x, '\\.0E|E', 'e'), 'e([0-9])', 'e+$1') end""",
)


def _object(members: Sequence[tuple[str, Column, T.DataType]]) -> Column:
    """Text of a JSON object; runs of members without fractional numbers are left to ``to_json``."""
    if not any(_has_fraction(dtype) for _, _, dtype in members):
        return _written([_plain(v, dtype).alias(n) for n, v, dtype in members])
    parts, run = [], []
    for name, value, dtype in [*members, (None, None, None)]:
        if run and (dtype is None or _has_fraction(dtype)):
            parts.append(_between_braces(_written(run)))
            run = []
        if dtype is None:
            break
        if _has_fraction(dtype):
            label = F.lit(json.dumps(name, ensure_ascii=False) + ":")
            parts.append(F.concat(label, _or_null(_value_text(value, dtype))))
        else:
            run.append(_plain(value, dtype).alias(name))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _value_text(value: Column, dtype: T.DataType) -> Column:
    """JSON text of a value, null for null; what holds no fractional number is left to ``to_json``."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(value)
    if not _has_fraction(dtype):
        text = _written([_plain(value, dtype).alias("v")])
        return F.when(value.isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6))
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), _object([(f.name, value.getField(f.name), f.dataType) for f in fields]))
    if isinstance(dtype, T.ArrayType):
        texts = F.transform(value, lambda x: _or_null(_value_text(x, dtype.elementType)))
        return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    entries = F.transform(
        F.array_sort(F.map_entries(value), _by_key),
        lambda e: F.concat(
            _value_text(e["key"].cast("string"), T.StringType()),
            F.lit(":"),
            _or_null(_value_text(e["value"], dtype.valueType)),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def _written(members: Sequence[Column]) -> Column:
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def _between_braces(text: Column) -> Column:
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _or_null(text: Column) -> Column:
    return F.coalesce(text, F.lit("null"))


def _has_fraction(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_fraction(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_fraction(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_fraction(dtype.valueType)
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def _has_special(
    fields: Mapping[str, Column], types: Mapping[str, T.DataType], text: Column
) -> Column:
    """Whether the text has a character to escape.

    Only strings can hold one, so it is enough to look at the string members,
    and at the whole text if there are members with an inner structure.
    """
    special = f"[{''.join(ESCAPES)}]"
    inner = any(isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) for t in types.values())
    if inner or any(c in name for name in fields for c in ESCAPES):
        return F.rlike(text, F.lit(special))
    strings = [fields[n] for n, t in types.items() if isinstance(t, T.StringType)]
    found = [F.coalesce(F.rlike(s, F.lit(special)), F.lit(False)) for s in strings]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def reject_reason(
    df: DataFrame, json_columns: Sequence[str] = (), columns: Sequence[str] | None = None
) -> Column:
    """Why a row cannot be a message, or null: a NaN or infinite number, or bad JSON text.

    Only ``columns`` are looked at, by default all. Text in ``json_columns`` has to
    be JSON; leave out those that are sent as plain text.
    """
    reasons = []
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        bad = _has_nonfinite(F.col(_quoted(field.name)), field.dataType)
        if bad is not None:
            reasons.append(F.when(bad, F.lit(f"number not finite: {field.name}")))
    for name in json_columns:
        column = F.col(_quoted(name))
        broken = column.isNotNull() & F.try_parse_json(column).isNull()
        reasons.append(F.when(broken, F.lit(f"malformed json: {name}")))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def split_rejects(
    df: DataFrame, json_columns: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The rows that can be sent, and the others with a ``bad_reason``."""
    flagged = df.withColumn("bad_reason", reject_reason(df, json_columns))
    good = flagged.filter(F.col("bad_reason").isNull()).drop("bad_reason")
    return good, flagged.filter(F.col("bad_reason").isNotNull())


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _plain(value: Column, dtype: T.DataType) -> Column:
    """The value in the form that ``to_json`` writes as wanted."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return nano_text(value)
    if isinstance(dtype, T.ArrayType) and _needs_work(dtype.elementType):
        return F.transform(value, lambda x: _plain(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_plain(value.getField(f.name), f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(value), _by_key)
        if _needs_work(dtype.valueType):
            entries = F.transform(
                entries,
                lambda e: F.struct(e["key"].alias("key"), _plain(e["value"], dtype.valueType).alias("value")),
            )
        return F.map_from_entries(entries)
    return value


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def _needs_work(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _needs_work(dtype.elementType)
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.StructType, T.MapType))


def _has_nonfinite(value: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if isinstance(dtype, T.ArrayType):
        if _has_nonfinite(F.lit(None), dtype.elementType) is None:
            return None
        return F.exists(value, lambda x: _has_nonfinite(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        if _has_nonfinite(F.lit(None), dtype.valueType) is None:
            return None
        return F.exists(F.map_values(value), lambda x: _has_nonfinite(x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        parts = [_has_nonfinite(value.getField(f.name), f.dataType) for f in dtype.fields]
        parts = [F.coalesce(p, F.lit(False)) for p in parts if p is not None]
        return reduce(lambda a, b: a | b, parts) if parts else None
    return None
