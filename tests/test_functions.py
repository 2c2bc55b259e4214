"""Column functions (§2.8) on hand-written edge sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeward.functions import columns as fx
from lakeward.operators import search


def test_split_tags_edges(spark):
    df = spark.createDataFrame([("",), (None,), ("a",), (" a , b ",), ("a,,b",)], "tags string")
    got = [r[0] for r in df.select(fx.split_tags("tags")).collect()]
    assert got == [[], [], ["a"], ["a", "b"], ["a", "", "b"]]


def test_asset_tags_positions(spark, sample):
    rows = fx.asset_tags(sample["assets"]).orderBy("asset_id", "tag_pos").collect()
    assert [(r.asset_id, r.tag_pos, r.tag) for r in rows] == [
        ("A1", 1, "customer"), ("A1", 2, "segments"), ("A1", 3, "audience"), ("A3", 1, "finance")]


def test_parse_columns_forms(spark):
    texts = [
        ('[{"name":"id","type":"INT","nullable":false,"description":"key"},{"name":"v"}]', 2),
        ('{"a":"INT","b":"STRING"}', 2),
        ("{}", None),
        ("[]", None),
        ("not json", None),
        (None, None),
        ("[1, 2]", 2),          # array of non-objects: still two columns
        ('   {"x":"DATE"}', 1),  # leading blanks
        ("{'a':'INT'}", None),  # single quotes are not JSON
    ]
    df = spark.createDataFrame([(t,) for t, _ in texts], "s string")
    got = [r[0] for r in df.select(F.coalesce(F.size(fx.parse_columns("s")), F.lit(-1))).collect()]
    want = [n if n is not None else -1 for _, n in texts]
    assert got == want


def test_parse_columns_object_defaults(spark):
    df = spark.createDataFrame([('{"a":"INT"}',)], "s string")
    c = df.select(fx.parse_columns("s")[0].alias("c")).first().c
    assert (c.name, c.type, c.nullable, c.description) == ("a", "INT", True, "")


def test_encode_columns_drops_blank_names(spark):
    df = spark.createDataFrame([('[{"name":"a","type":"INT"},{"name":"  ","type":"X"}]',)], "s string")
    out = df.select(fx.encode_columns(fx.parse_columns("s"))).first()[0]
    assert out == '[{"name":"a","type":"INT"}]'


def test_name_checks(spark):
    df = spark.createDataFrame([("  gold ",), ("",), ("   ",), ("x" * 65,), (None,)], "n string")
    rows = df.select(fx.clean_name("n", 64).alias("c"), fx.name_ok("n", 64).alias("ok")).collect()
    assert [(r.c, r.ok) for r in rows] == [("gold", True), ("", False), ("", False), ("x" * 65, False),
                                           (None, False)]


def test_source_family(spark):
    df = spark.createDataFrame([("Snowflake",), ("bigquery",), ("s3",), ("kafka",), ("csv",), ("graphql",),
                                ("oracle",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(fx.source_family("t")).collect()]
    assert got == ["snowflake", "cloud", "bucket", "stream", "document", "api", "cylinder", "cylinder", "cylinder"]


def test_notification_text(spark):
    df = spark.createDataFrame([("u@x", "Sales", None), ("u@x", "Sales", ""), ("u@x", "Sales", "pls")],
                               "r string, a string, m string")
    rows = df.select(fx.notification_subject("a"), fx.notification_body("r", "a", "m")).collect()
    assert rows[0][0] == "Access request for data asset: Sales"
    assert "Message: (none)" in rows[0][1] and "Message: (none)" in rows[1][1]
    assert "Message: pls" in rows[2][1]
    assert rows[2][1].startswith("User u@x has requested access to the data asset 'Sales'.")


def test_search_wildcards_live_and_backslash_literal(spark):
    df = spark.createDataFrame([
        ("1", "shipments_fact", None), ("2", "50% off", "x"), ("3", "a\\b", "y"), ("4", "ÄPFEL", "Ä"),
        ("5", "other", "SHIPMENTS daily")], "id string, name string, description string")

    def ids(q):
        return sorted(r.id for r in search.search_assets(df, q).collect())

    assert ids("shipments") == ["1", "5"]
    assert ids("_") == ["1", "2", "3", "4", "5"]  # '_' stays a live wildcard
    assert ids("%") == ["1", "2", "3", "4", "5"]
    assert ids("\\b") == ["3"]                     # backslash is literal
    assert ids("äpfel") == ["4"]
    assert ids("") == ["1", "2", "3", "4", "5"] and ids(None) == ["1", "2", "3", "4", "5"]


def test_parse_columns_reads_the_whole_document(spark):
    cases = {'[{"name":"x"}] garbage': None, '{"a":"1"} x': None, '[{"name":"x"}],[{': None, '{}},{': None, '1],[2': None,
             '{"a":"1","b":"2","a":"3"}': [("a", "3"), ("b", "2")], '{"a":null}': [("a", "null")], '\n\t {"a":"T"} \n': [("a", "T")],
             '{"a":1,"b":true}': [("a", "1"), ("b", "true")], '[{"name":null,"type":"T"}]': [(None, "T")], '"text"': None, '': None, ' ': None}
    df = spark.createDataFrame(list(cases.items()) and [(k,) for k in cases], "s string")
    got = {r.s: None if r.c is None else [(x["name"], x["type"]) for x in r.c] for r in df.select("s", fx.parse_columns("s").alias("c")).collect()}
    assert got == cases
