"""FNV-1a / SimHash vectors; the Arrow kernel, the Spark UDF and the
pure-DataFrame plan must agree with each other and with the vectors."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from respscore.functions import simhash as S
from respscore.functions.text import fingerprint_hex

FNV = {"a": "af63dc4c8601ec8c", "hello": "a430d84680aabd0b", "html": "888bb1cc15ef7930",
       "200": "603ec818278d901d"}

SIMHASH = [
    ("", "0000000000000000"),
    ("a", "af63dc4c8601ec8c"),
    ("hello world", "0410d84600088803"),
    ("Hello, WORLD! hello", "a430d84680aabd0b"),
    ("!!! ???", "0000000000000000"),
    ("é", "0000000000000000"),
    ("état 200", "4016881804088014"),
    ("a b", "af63dc4c8601e084"),
    ("<html><body>ok</body></html>", "8889f58f95cf7bb5"),
    ('{"error":"not found"}', "217ad29d75850f7b"),
    ("İx", "af63e44c86001204"),
]


@pytest.mark.parametrize("token,expected", FNV.items())
def test_fnv_vectors(token, expected):
    assert S.to_hex(S.fnv1a64(token)) == expected


def test_fnv_vectorised_matches_scalar():
    words = ["a", "hello", "html", "200", "x" * 300, "q", "zz9"]
    got = S.fnv1a64_array(pa.array(words))
    assert [format(int(v), "016x") for v in got] == [S.to_hex(S.fnv1a64(w)) for w in words]


def test_fnv_on_sliced_array():
    arr = pa.array(["skip", "a", "hello"]).slice(1)
    assert [format(int(v), "016x") for v in S.fnv1a64_array(arr)] == [FNV["a"], FNV["hello"]]


@pytest.mark.parametrize("text,expected", SIMHASH)
def test_simhash_vectors_kernel(text, expected):
    assert S.to_hex(S.simhash_texts([text])[0]) == expected


def test_simhash_null_is_zero():
    assert S.simhash_texts([None]) == [0]


def _brute(text):
    import re
    v = [0] * 64
    for tok in re.findall(r"[a-z0-9]+", text.lower()):
        h = S.fnv1a64(tok)
        for b in range(64):
            v[b] += 1 if (h >> b) & 1 else -1
    return S.to_signed(sum(1 << b for b in range(64) if v[b] > 0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcxyz019 ,.é!-", max_size=40), min_size=1, max_size=12))
def test_kernel_matches_brute_force(texts):
    assert S.simhash_texts(texts) == [_brute(t) for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta", "gamma", "7", "zz"]), min_size=0, max_size=15))
def test_token_order_does_not_matter(words):
    a = " ".join(words)
    b = " ".join(reversed(words))
    assert S.simhash_texts([a]) == S.simhash_texts([b])


def test_spark_udf_and_frame_agree_with_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, (t, _) in enumerate(SIMHASH)] + [(len(SIMHASH), None)]
    df = spark.createDataFrame(rows, "k long, t string")
    udf = {r.k: r.fp for r in df.select("k", fingerprint_hex(S.simhash64("t")).alias("fp")).collect()}
    frame = {r.k: r.fp for r in S.simhash_frame(df, "t")
             .select("k", fingerprint_hex("fingerprint").alias("fp")).collect()}
    expected = {i: h for i, (_, h) in enumerate(SIMHASH)}
    expected[len(SIMHASH)] = "0000000000000000"
    assert udf == expected
    assert frame == expected
    native = df.select(F.lit("hello").alias("w")).limit(1).select(fingerprint_hex(S.fnv1a64_col("w")).alias("h"))
    assert native.first().h == FNV["hello"]


def test_udf_and_frame_agree_on_documents(spark):
    from conftest import SF001
    from respscore.sources.tables import read_table

    d = read_table(spark, SF001, "documents").select("doc_id", "text")
    a = d.select("doc_id", S.simhash64("text").alias("fp"))
    b = S.simhash_frame(d, "text")
    diff = a.join(b, "doc_id").where("fp <> fingerprint").count()
    assert diff == 0 and a.count() == b.count() == d.count()


def test_hamming_properties(spark):
    df = spark.createDataFrame([(5, 5), (0, -1), (-1, 0), (1, 2)], "a long, b long")
    got = [r.h for r in df.select(S.hamming("a", "b").alias("h")).collect()]
    assert got == [0, 64, 64, 2]


def test_kernel_slicing_matches_single_pass(monkeypatch):
    texts = [("alpha beta gamma " * (i % 7)) + f"w{i}" for i in range(200)] + ["", None]
    whole = S.simhash_texts(texts)
    monkeypatch.setattr(S, "CHUNK_TOKENS", 5)
    assert S.simhash_texts(texts) == whole


def test_frame_hashes_tokens_of_any_length(spark):
    """Word edges and what goes beyond the compiled steps, repeats, rows without tokens and equal rows."""
    words = [("x7" * 40)[:n] for n in range(1, 35)]
    texts = [" ".join(words), *words, "a " * 3000 + "b" * 200, "z" * 500, "", "...", None, "a b", "a b"]
    df = spark.createDataFrame([(i % 40, t, "k") for i, t in enumerate(texts)], "k long, t string, more string")
    got = sorted((r.k, r.more, r.fingerprint) for r in S.simhash_frame(df, "t").collect())
    assert got == sorted((i % 40, "k", fp) for i, fp in enumerate(S.simhash_texts(texts)))


def test_frame_keeps_votes_not_tokens(spark):
    """What is kept and shuffled is at most two rows of votes a text, however many words it has."""
    from respscore import session

    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(20)], "k long, t string").repartition(4)
    since = session.mark()
    try:
        out = S.simhash_frame(df, "t")
        spark_, kind, what = session._held[-1]
        kept = spark_.read.parquet(what) if kind == "table" else what
        assert kept.count() == 40 and out.count() == 20
    finally:
        session.release(since)


def test_kernel_cuts_at_text_edges(monkeypatch):
    """Texts lie in one buffer without a gap; chunks end within a text and slices begin within the buffer."""
    texts = ["ab", "cd", "", "ef gh", None, "é9", "x", "", "İk 7\u00e9z", "q" * 300, " ", "zz", ""]
    want = [0 if t is None else _brute(t) for t in texts]
    lowered = pa.array([None if t is None else t.lower() for t in texts], type=pa.string())
    for chunk in (1, 3, 1 << 17):
        monkeypatch.setattr(S, "CHUNK_TOKENS", chunk)
        assert S.simhash_texts(texts) == want
        for at in range(len(texts)):
            assert S.simhash_lowered(lowered.slice(at, 5)).tolist() == want[at: at + 5]
        assert S.simhash_lowered(lowered.cast(pa.large_string())).tolist() == want


def test_udf_gets_texts_not_token_lists(spark, capsys):
    """No string is made per token on the JVM side."""
    df = spark.createDataFrame([(1, "Hello, WORLD! hello")], "k long, t string").select(S.simhash64("t").alias("fp"))
    df.explain()
    p = capsys.readouterr().out
    assert "ArrowEvalPython" in p and "regexp_extract_all" not in p
    assert S.to_hex(df.first().fp) == dict(SIMHASH)["Hello, WORLD! hello"]
