"""Documents whose keys differ from row to row."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sluicebox import MessageLog, dataset_detail, export, scratch_dir, time_range
from sluicebox.functions.documents import document_text
from sluicebox.operators.messages import document_messages
from sluicebox.sources.dataset import documents_of

LABELS = {"_source": "mongodb", "_collection": "c", "_database": "d"}
BAD = ["[1, 2]", "{", '{"a": 1, "a": 2}', None, "", "7", '"text"', "null"]


def collection(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, doc string")
    return documents_of(df, database="d", table="c", document="doc", keys=["n"], **options)


def messages(spark, texts):
    return [r["value"] for r in document_messages(collection(spark, texts)).collect()]


def test_absent_keys_stay_absent_and_nulls_stay(spark):
    got = messages(spark, ['{"b": 1}', '{"a": null, "_id": "x"}', "{}"])
    assert [json.loads(v) for v in got] == [{**LABELS, "b": 1}, {**LABELS, "a": None}, LABELS]


def test_values_keep_their_types_and_labels_win(spark):
    text = '{"n": 1, "f": 1.0, "s": "1.0", "t": true, "l": [1.50, "2.0", null, {"z": 1e2, "a": -0.5}], "_source": "own"}'
    (value,) = messages(spark, [text])
    assert value == (
        '{"_collection":"c","_database":"d","_source":"mongodb","f":1,"l":[1.5,"2.0",null,{"a":-0.5,"z":100}],'
        '"n":1,"s":"1.0","t":true}'
    )


@pytest.mark.parametrize("number", ["1e21", "1e-7", "123456789012345678", "0.1", "1E5", "12345678901234567890.5", "-0.000025", "1e300"])
def test_numbers_are_written_as_everywhere(spark, number):
    (value,) = messages(spark, ['{"x": [%s], "y": "%s"}' % (number, number)])
    got = json.loads(value)
    assert [float(x) for x in got["x"]] == [float(number)] and got["y"] == number
    assert number != "123456789012345678" or got["x"] == [int(number)]
    assert ("1e+21" in value) == (number == "1e21")


def test_keys_are_sorted_quoted_and_escaped(spark):
    text = json.dumps({"z": "<&>", "a\"b": " ", "A": "\\u003c", "é": "🙂", "_": "\n", "": 1})
    (value,) = messages(spark, [text])
    assert json.loads(value) == {**json.loads(text), **LABELS}
    assert list(json.loads(value)) == sorted(json.loads(value), key=lambda k: k.encode())
    assert not any(c in value for c in "<>& \n") and "\\u003c\\u0026\\u003e" in value


def test_text_that_is_no_document_is_rejected_with_a_reason(spark):
    ds = collection(spark, ['{"a": 1}', *BAD, '{"b": 2}'])
    log = MessageLog(scratch_dir(spark, "documents"), 2)
    result = export(ds, log, "t", jobs=2)
    done = result.accounting.first()
    assert (done["planned"], done["produced"], done["rejected"], done["matches"]) == (10, 2, 8, True)
    reasons = {r["n"]: r["bad_reason"] for r in result.rejects.collect()}
    assert reasons == {
        1: "not a document: doc", 2: "malformed json: doc", 3: "malformed json: doc", 4: "malformed json: doc",
        5: "malformed json: doc", 6: "not a document: doc", 7: "not a document: doc", 8: "not a document: doc",
    }
    sent = [json.loads(bytes(r["value"])) for r in log.read(spark, "t").collect()]
    assert sorted(sent, key=lambda v: v.get("a", 0)) == [{**LABELS, "b": 2}, {**LABELS, "a": 1}]


def test_no_text_no_message(spark):
    df = spark.createDataFrame([(t,) for t in BAD], "t string")
    assert {r[0] for r in df.select(document_text(F.col("t"), LABELS)).collect()} == {None}


def test_detail_has_the_columns_of_the_first_document(spark):
    ds = collection(spark, ['{"b": [1.0, 2], "_id": 5, "a": "x", "c": null}', '{"z": 1}', '{"a": 7, "q": 1, "b": true}'])
    row = dataset_detail(ds).first()
    assert row["count"] == 3 and row["columns"] == ["a", "b", "c"] and (row["start"], row["end"]) == ("", "")
    assert row["data"] == [["x", "[1,2]", None], ["7", "true", None]]


def test_detail_of_no_documents_and_of_bad_ones(spark):
    assert dataset_detail(collection(spark, ["{}"]).with_df(collection(spark, ["{}"]).df.filter("false"))).first()["count"] == 0
    row = dataset_detail(collection(spark, ["{", '{"a": 1}'])).first()
    assert row["count"] == 2 and row["columns"] == []


def test_tags_compare_strings_only(spark):
    ds = collection(spark, ['{"k": "1"}', '{"k": 1}', '{"j": "1"}', '{"k": "1", "j": 2}', "{", '{"k": null}', '{"k": ["1"]}'])
    assert [r["n"] for r in ds.selected(("k", "1")).collect()] == [0, 3]
    assert ds.selected(("k", "")).count() == 7 and ds.selected(("a.b", "x")).count() == 0


def test_times_come_from_a_member(spark):
    texts = ['{"t": "2024-01-02T03:04:05.5Z"}', '{"t": "2024-01-01T00:00:00Z"}', '{"t": 7}', '{"u": 1}', '{"t": "soon"}']
    ds = collection(spark, texts, time_member="t")
    row = time_range(ds).first()
    assert tuple(row) == ("2024-01-01T00:00:00.000Z", "2024-01-02T03:04:05.500Z")
    assert [r["n"] for r in ds.selected(window=("2024-01-02T00:00:00Z", None)).collect()] == [0]
    assert "_document_time" not in document_messages(ds).first()["value"]
