"""Documents without a schema: JSON objects whose keys differ from row to row.

A document is text. Its members are taken as a map of variants, so each keeps the
type it has in its own row, a key that a document lacks stays absent from its
message, and a null that it has stays null.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicebox.functions.jsontext import ESCAPES, number_text, once

#: Strings, numbers and what stands between them, in a text that is known to be JSON.
_TOKENS = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'
#: A number with a point or an exponent at least; it may stand in a string, too.
_FRACTION = r"[0-9][.eE]"


def members(text: Column) -> Column:
    """Key → value of a JSON object; null for text that is none (or has a key twice)."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def value_text(value: Column) -> Column:
    """JSON text of a variant as messages have it: sorted keys, shortest digits; ``null`` for none."""
    return F.coalesce(once(F.to_json(value), _with_short_numbers), F.lit("null"))


def _with_short_numbers(text: Column) -> Column:
    def written(token: Column) -> Column:
        is_fraction = F.rlike(token, F.lit(r"^-?[0-9][0-9]*[.eE]"))
        return F.when(is_fraction, once(token.try_cast("double"), number_text)).otherwise(token)

    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), written)
    return F.when(F.rlike(text, F.lit(_FRACTION)), F.array_join(tokens, "")).otherwise(text)


def document_text(
    text: Column, constants: Mapping[str, str], drop: tuple[str, ...] = ()
) -> Column:
    """The document as a message: without the keys of ``drop``, with ``constants`` in place of its own values.

    Keys are sorted by their bytes. Null where the text is no object.
    """
    added = {k: json.dumps(v, ensure_ascii=False) for k, v in constants.items()}
    gone = F.array(*[F.lit(k) for k in (*drop, *added)])
    fixed = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("text")) for k, v in added.items()]

    def whole(found: Column) -> Column:
        own = F.transform(
            F.filter(F.map_entries(found), lambda e: ~F.array_contains(gone, e["key"])),
            lambda e: F.struct(e["key"].alias("key"), value_text(e["value"]).alias("text")),
        )
        every = F.array_sort(F.concat(own, F.array(*fixed))) if fixed else F.array_sort(own)
        parts = F.transform(every, lambda e: F.concat(_quoted_text(e["key"]), F.lit(":"), e["text"]))
        return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

    def escaped(message: Column) -> Column:
        out = message
        for char, escape in ESCAPES.items():
            out = F.replace(out, F.lit(char), F.lit(escape))
        return F.when(F.rlike(message, F.lit(f"[{''.join(ESCAPES)}]")), out).otherwise(message)

    return once(whole(members(text)), escaped)


def _quoted_text(value: Column) -> Column:
    text = F.to_json(F.struct(value.alias("k")))
    return F.substr(text, F.lit(6), F.length(text) - 6)


def document_reason(text: Column, name: str) -> Column:
    """Why a document cannot be a message, or null."""
    parsed = F.try_parse_json(text)
    return F.when(text.isNull() | parsed.isNull(), F.lit(f"malformed json: {name}")).when(
        members(text).isNull(), F.lit(f"not a document: {name}")
    )


def has_member(text: Column, key: str, value: str) -> Column:
    """Whether the member is the string ``value``; a number or any other type is no string."""
    return F.coalesce(F.to_json(F.try_element_at(members(text), F.lit(key))) == _quoted_text(F.lit(value)), F.lit(False))


def member_time(text: Column, key: str) -> Column:
    """A member's text as a time; null if it is absent or no time."""
    found = F.try_element_at(members(text), F.lit(key))
    text_of = F.get_json_object(F.concat(F.lit('{"v":'), F.to_json(found), F.lit("}")), "$.v")
    return text_of.try_cast("timestamp_ntz")
