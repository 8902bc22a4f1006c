import re

import pytest

from helpers import edge_rows, frame
from respscore.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    rep = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(rep))


def test_measures_match_a_plain_model(spark):
    rows = edge_rows() + [(7000, "a b c a b c # | x", "s"), (7001, "x " * 200, "s")]
    got = Q.ledger(frame(spark, rows).select("doc_id", "text", "size"), carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[m] for m in Q.MEASURES) == model(r.text), r.text


def test_bits_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "s"), (2, "few words", "s"), (3, "x y z " * 60, "s"), (4, " ".join(f"w{i}###" for i in range(60)), "s"),
            (5, "\n".join([good] * 1), "s"), (6, "\n".join(["same line"] * 3), "s")]
    led = Q.ledger(frame(spark, rows))
    bits = {r.doc_id: r.failed_bits for r in led.collect()}
    by = {r.name: 1 << r.bit for r in Q.RULES}
    assert bits[1] == 0 and bits[2] == by["few_words"] and bits[3] & by["repeated_windows"] and bits[4] == by["symbols"]
    assert {r.doc_id for r in led.where(Q.passes(1)).collect()} == {1, 4, 5}
    assert {r.doc_id for r in led.where(Q.passes(2)).collect()} == {1, 5}
    cut = {r.rule: (r.n_failed, r.n_alone) for r in Q.ablations(led, 2).collect()}
    assert cut["symbols"] == (1, 1)
    assert cut["few_words"][0] == sum(bool(b & by["few_words"]) for b in bits.values())
    diff = {(r.kept_old, r.kept_new): r.n for r in Q.compare_policies(led, 1, 2).collect()}
    assert diff == {(True, True): 2, (True, False): 1, (False, False): 3}


def test_keep_passing_keeps_rows_and_columns(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = frame(spark, [(1, good, "s"), (1, good, "s"), (None, good, None), (2, "few", "s"), (3, None, "s")])
    out = Q.keep_passing(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    assert Q.keep_passing(docs.limit(0)).count() == 0 and Q.ledger(docs.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = Q.keep_passing(frame(spark, [(1, "a", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("version", Q.POLICIES)
def test_masks_name_rules_once(version):
    assert bin(Q.mask(version)).count("1") == len(set(Q.POLICIES[version]))
    assert len({r.bit for r in Q.RULES}) == len(Q.RULES)
