import random
import re

from pyspark.sql import functions as F

from respscore.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, loss_spans int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = C.format_conversations(df)
    read = out.select("conv_id", "formatted", "loss_spans", C.read_back(F.col("formatted")).alias("turns"),
                      C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: r for r in read.collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[INST] ", " [/INST]", "\\", "<", "[", "s>", "/INST]", "a", "é", "\n", " ", "\U0001f600", "$1", "\\\\"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "a[INST]<s>\\", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))))
    got = run(spark, rows)
    for conv in range(150):
        want = [(r[2], r[3]) for r in rows if r[0] == conv]
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(x for role, x in want if role == "assistant")
        blocks = sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False)) + 1
        assert r.formatted.count(C.TEMPLATE.close) == blocks  # adjacent turns of one role share a block
        assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans] == [re.sub(r"\\|<(?=/?s>)|\[(?=/?INST\])", lambda m: m[0] + "\\", x) for role, x in want if role == "assistant"]


def test_nulls_ties_and_repeats(spark):
    got = run(spark, [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 3, "assistant", "x")])
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None].loss == "x"
    assert run(spark, []) == {}


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", "x", 1)], SCHEMA)
    assert not re.search("Python|Pandas|Arrow", C.format_conversations(df)._jdf.queryExecution().toString())


def test_long_conversation(spark):
    got = run(spark, [(1, k, "user" if k % 2 else "assistant", "word " * 50 + str(k)) for k in range(400)])
    assert len(got[1].turns) == 400 and len(got[1].loss_spans) == 200
