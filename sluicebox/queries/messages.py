"""Rows as messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.jsontext import json_text, split_rejects
from sluicebox.operators.messages import document_messages, with_value
from sluicebox.queries.profile import NANO
from sluicebox.queries.registry import (
    conversations,
    documents,
    event_documents,
    events,
    lineitem,
    orders,
    query,
)
from sluicebox.sources.dataset import long_form

FIELDS = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]


def json_sql(members: dict[str, str]) -> str:
    """SQL of the message text with the given members, already in key order."""
    body = ", ".join(f"'{name}': {value}" for name, value in members.items())
    text = f"cast(to_json({{{body}}}) as varchar)"
    for char, escape in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = f"replace({text}, '{char}', '{escape}')"
    return text


# A whole number has no point in a message.
NUMBER = "case when {0} = trunc({0}) and abs({0}) < 1e15 then to_json(cast({0} as bigint)) else to_json({0}) end"

EVENT_MEMBERS = {
    "_measurement": "'events'",
    "_time": NANO.format("ts"),
    "event_id": "event_id",
    "event_type": "event_type",
    "props": "props",
    "user_id": "user_id",
    "value": NUMBER.format("value"),
}
ORDER_MEMBERS = {
    "_collection": "'orders'",
    "_database": "'warehouse'",
    "_source": "'mongodb'",
    "o_custkey": "o_custkey",
    "o_orderdate": NANO.format("o_orderdate"),
    "o_orderpriority": "o_orderpriority",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": NUMBER.format("o_totalprice"),
}
DOCUMENT_MEMBERS = {
    "_collection": "'documents'",
    "_database": "'warehouse'",
    "_source": "'mongodb'",
    "lang": "lang",
    "n_chars": "n_chars",
    "source": "source",
    "text": "text",
}


@query(f"select event_id, {json_sql(EVENT_MEMBERS)} as value from events")
def series_messages(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    return with_value(ds.df, ds, ["event_id"])


@query(
    f"""
    select event_id, {json_sql({**EVENT_MEMBERS, "props": "cast(props as json)"})} as value from events
    """
)
def nested_messages(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    return with_value(ds.df, ds, ["event_id"], nested=True)


@query(f"select {json_sql(ORDER_MEMBERS)} as value from orders")
def document_messages_without_id(spark: SparkSession, sf: str) -> DataFrame:
    return document_messages(orders(spark, sf, hide_keys=True))


@query(
    f"""
    select doc_id, md5({json_sql(DOCUMENT_MEMBERS)}) as value_md5,
           cast(strlen({json_sql(DOCUMENT_MEMBERS)}) as bigint) as bytes
    from documents
    """
)
def long_text_messages(spark: SparkSession, sf: str) -> DataFrame:
    ds = documents(spark, sf)
    return with_value(ds.df, ds, ["doc_id"]).select(
        "doc_id", F.md5("value").alias("value_md5"), F.octet_length("value").cast("bigint").alias("bytes")
    )


@query(
    f"""
    select conv_id, turn, {json_sql({
        "_collection": "'conversations'", "_database": "'warehouse'", "_source": "'mongodb'",
        "conv_id": "conv_id", "role": "role", "text": "text", "turn": "turn"})} as value
    from conversations
    """
)
def conversation_messages(spark: SparkSession, sf: str) -> DataFrame:
    ds = conversations(spark, sf)
    return with_value(ds.df, ds, ["conv_id", "turn"])


def _mixed(*members: tuple[str, str]) -> str:
    return json_sql({"_collection": "'mixed'", "_database": "'warehouse'", "_source": "'mongodb'", **dict(members)})


# A message has the members of its own document only; a null that is there stays.
MIXED = f"""
    case event_id % 4
         when 0 then {_mixed(("props", "cast(props as json)"), ("t", NANO.format("ts")))}
         when 1 then {_mixed(("t", NANO.format("ts")), ("user_id", "user_id"), ("value", NUMBER.format("value")))}
         when 2 then {_mixed(("note", "null"), ("t", "17"))}
         else {_mixed(
             ("deep", """cast('{"a":"<x>","z":[1.5,2000,"1.0E5"]}' as json)"""),
             ("t", NANO.format("ts")), ("tag", "event_type"))} end
"""


@query(f"select event_id, {MIXED} as value from events")
def schemaless_messages(spark: SparkSession, sf: str) -> DataFrame:
    ds = event_documents(spark, sf)
    return with_value(ds.df, ds, ["event_id"])


_LONG = """
    select * from (unpivot (select l_shipdate as "_time", 'lineitem' as "_measurement", l_returnflag,
                                   l_discount, l_extendedprice, l_quantity, l_tax from lineitem)
                   on l_discount, l_extendedprice, l_quantity, l_tax into name "_field" value "_value")
"""


@query(
    f"""
    select l_returnflag, "_field", "_measurement", count(*) as records, round(sum("_value"), 2) as total,
           min("_time") as first_ts
    from ({_LONG}) group by all
    """
)
def series_long_form(spark: SparkSession, sf: str) -> DataFrame:
    rows = long_form(lineitem(spark, sf), FIELDS, ["l_returnflag"])
    return rows.groupBy("l_returnflag", "_field", "_measurement").agg(
        F.count("*").alias("records"),
        F.round(F.sum("_value"), 2).alias("total"),
        F.min("_time").alias("first_ts"),
    )


_LONG_MEMBERS = {
    "_field": '"_field"',
    "_measurement": '"_measurement"',
    "_time": NANO.format('"_time"'),
    "_value": NUMBER.format('"_value"'),
    "l_returnflag": "l_returnflag",
}


@query(
    f"""
    select value, count(*) as copies from (select {json_sql(_LONG_MEMBERS)} as value from ({_LONG}))
    group by value
    """
)
def long_form_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = long_form(lineitem(spark, sf), FIELDS, ["l_returnflag"])
    # Equal rows are counted before they become texts, so that each text is written and shuffled once.
    # Grouping takes -0.0 for 0.0; the second column keeps them apart.
    minus = F.col("_value").isNotNull() & (F.col("_value") == 0) & F.col("_value").cast("string").startswith("-")
    equal = rows.groupBy(*rows.columns, minus.alias("_minus")).agg(F.count("*").alias("copies"))
    signed = equal.withColumn("_value", F.when(F.col("_minus"), F.lit(-0.0)).otherwise(F.col("_value"))).drop("_minus")
    texts = signed.select(json_text(signed.drop("copies")).alias("value"), "copies")
    return texts.groupBy("value").agg(F.sum("copies").alias("copies"))


_SPOILT = """
    select l_linenumber, l_shipmode_json,
           case when isnan(q) or isinf(q) then 'number not finite: l_quantity'
                when not json_valid(l_shipmode_json) then 'malformed json: l_shipmode_json' end as bad_reason
    from (select l_linenumber,
                 case when l_linenumber = 7 then 'NaN'::double
                      when l_linenumber = 6 then 'Infinity'::double else l_quantity end as q,
                 case when l_linestatus = 'O' then '{"s": "O"}' else '{"s": ' end as l_shipmode_json
          from lineitem)
"""


def _spoilt(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` with numbers and JSON text that cannot be sent."""
    line = F.col("l_linenumber")
    quantity = (
        F.when(line == 7, float("nan")).when(line == 6, float("inf")).otherwise(F.col("l_quantity"))
    )
    text = F.when(F.col("l_linestatus") == "O", '{"s": "O"}').otherwise('{"s": ')
    return lineitem(spark, sf).df.select(
        "l_linenumber", quantity.alias("l_quantity"), text.alias("l_shipmode_json")
    )


@query(
    f"""
    select bad_reason, l_linenumber, count(*) as records from ({_SPOILT})
    where bad_reason is not null group by all
    """
)
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = split_rejects(_spoilt(spark, sf), ["l_shipmode_json"])
    return bad.groupBy("bad_reason", "l_linenumber").agg(F.count("*").alias("records"))


@query(
    f"""
    select l_linenumber, l_shipmode_json, count(*) as records from ({_SPOILT})
    where bad_reason is null group by all
    """
)
def accepted_rows(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = split_rejects(_spoilt(spark, sf), ["l_shipmode_json"])
    return good.groupBy("l_linenumber", "l_shipmode_json").agg(F.count("*").alias("records"))
