"""Field functions: MIME normalisation, UTF-16 truncation, lengths."""

import pytest

from respscore.functions.text import content_length, js_slice, mime_type, status_or_zero

MIME = [
    (None, "unknown"), ("", "unknown"), ("Text/HTML; charset=utf-8", "text/html"),
    (" application/json ;q=1", "application/json"), ("; charset=x", ""), ("   ", ""),
    ("\ttext/plain ", "text/plain"), ("image/svg+xml", "image/svg+xml"),
]


@pytest.mark.parametrize("header,expected", MIME)
def test_mime(spark, header, expected):
    df = spark.createDataFrame([(header,)], "h string")
    assert df.select(mime_type("h").alias("m")).first().m == expected


def test_js_slice_counts_utf16_units(spark):
    emoji = "\U0001F600"
    long_ascii = "a" * 60000
    astral = emoji * 30000            # 60000 UTF-16 units, 30000 code points
    cut_mid = "b" * 51199 + emoji     # pair straddles unit 51200
    df = spark.createDataFrame([(long_ascii,), (astral,), (cut_mid,), ("short",), (None,)], "t string")
    out = [r.s for r in df.select(js_slice("t", 51200).alias("s")).collect()]
    assert len(out[0]) == 51200
    assert out[1] == emoji * 25600
    assert out[2] == "b" * 51199
    assert out[3] == "short" and out[4] is None
    whole = df.select(js_slice("t", None).alias("s")).collect()
    assert len(whole[0].s) == 60000


def test_lengths_and_status(spark):
    df = spark.createDataFrame([("héllo", None), (None, 404)], "b string, s int")
    r = df.select(content_length("b").alias("n"), status_or_zero("s").alias("s")).collect()
    assert [(x.n, x.s) for x in r] == [(6, 0), (0, 404)]


def test_binary_body_length_and_text(spark):
    from respscore.operators.features import response_features

    df = spark.createDataFrame([(1, True, 200, "text/html", bytearray(b"ok \xff ok"))],
                               "id long, has_response boolean, status_code int, "
                               "content_type_header string, body binary")
    f = response_features(df, ["id"]).first()
    assert f.content_length == 7
    assert f.fingerprint != 0
    assert f.method == "" and f.url == "" and f.location is None


def test_binary_prefix_keeps_the_first_characters(spark):
    from respscore.functions.text import body_text
    from pyspark.sql.types import BinaryType

    text = "\U0001F600" * 10 + "abc" * 50          # 4-byte characters first
    df = spark.createDataFrame([(bytearray(text.encode("utf-8")),)], "b binary")
    got = df.select(body_text("b", BinaryType(), max_chars=20).alias("t")).first().t
    assert got.startswith(text[:20])
    whole = df.select(body_text("b", BinaryType()).alias("t")).first().t
    assert whole == text
