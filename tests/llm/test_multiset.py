import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import edge_rows, frame, texts
from respscore.llm import multiset as M


def test_sums_are_homomorphic():
    some = [t or "" for t in texts(1, 30)]
    for a, b in zip(some, some[1:], strict=False):
        pa, pb = M.paragraphs(a), M.paragraphs(b)
        assert (M.total(pa + pb) == M.total(pb + pa)).all()
        assert (M.insert(M.total(pa), pb) == M.total(pa + pb)).all()
        assert (M.delete(M.total(pa + pb), pa) == M.total(pb)).all()
        assert (M.edit(M.total(pa), a, M.edited(a, b)) == M.total(M.paragraphs(M.edited(a, b)))).all()
        assert pa == pb or sorted(pa) == sorted(pb) or (M.total(pa) != M.total(pb)).any()
    shuffled = some[3].split("\n")
    random.Random(1).shuffle(shuffled)
    assert (M.total(M.paragraphs("\n".join(shuffled))) == M.total(M.paragraphs(some[3]))).all()


def test_likeness():
    rng = random.Random(2)
    parts = [f"sentence {rng.random()}" for _ in range(100)]
    fp = M.total(parts)
    assert M.likeness(fp, fp) == 1.0 and M.likeness(np.zeros(256, np.uint16), np.zeros(256, np.uint16)) == 1.0
    assert M.likeness(fp, np.zeros(256, np.uint16)) == 0.0
    assert abs(M.likeness(fp, M.total(parts[:50] + [f"other {k}" for k in range(50)])) - 0.5) < 0.2
    assert M.likeness(fp, M.total([f"other {k}" for k in range(100)])) < 0.25
    many = M.total(["same"] * 70000)  # lanes wrap modulo 2^16
    assert (M.delete(many, ["same"] * 69999) == M.total(["same"])).all()


def model(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        changed = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        fp, ed, nx = (M.total(M.paragraphs(x)) for x in (t, changed, after))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.tobytes().hex(), ed.tobytes().hex(), M.likeness(fp, ed), M.likeness(fp, nx)))
    return out


def test_edits_match_a_plain_model(spark):
    rows = [r for r in {r[0]: r for r in edge_rows() if r[0] is not None}.values()] + [(None, "last one\nof all", "a"), (8000, "x. y. " * 40000, "a")]
    for some in (rows, rows[:1], rows[:2]):
        for n in (1, 7):
            got = M.edits(frame(spark, some).repartition(n)).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, model(some)))
    assert M.edits(frame(spark, rows).limit(0)).count() == 0


def test_equal_texts_and_repeated_rows(spark):
    rows = edge_rows()
    got = M.edits(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    plain = {r.doc_id: bytes(r.fingerprint).hex() for r in M.fingerprints(frame(spark, [r for r in rows if r[0] not in (3, None)])).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in got if r.doc_id in plain)


def exact(text):
    """Lanes as plain integers, without any modulus."""
    paragraphs = [p for p in text.split("\n") if p and not p.isspace()]
    signs = Counter((b"paragraph", p) for p in paragraphs) + Counter((b"sentence", x) for p in paragraphs for x in re.split(r"(?<=[.!?])\s+", p))
    lanes = [0] * 256
    for (kind, x), n in signs.items():
        raw = hashlib.blake2b(x.encode(), digest_size=32, person=kind).digest()
        for k in range(256):
            lanes[k] += n if raw[k // 8] >> (7 - k % 8) & 1 else -n
    return lanes


def cosine(a, b):
    dot, norm = sum(x * y for x, y in zip(a, b, strict=True)), math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return min(max(dot / norm, 0.0), 1.0) if norm else float(a == b)


@pytest.mark.parametrize("n", [10000, 20000, 40000, 70000])
def test_likeness_of_many_repeats_matches_exact_sums(n):
    for line in ("x. y.", "same"):
        texts = [f"{line}\n" * n, f"{line}\n" * (n // 2), f"{line}\n" * n + "a few\nother lines. And more.", "nothing alike"]
        marks, sums = [M.total(M.paragraphs(t)) for t in texts], [exact(t) for t in texts]
        for mark, lanes in zip(marks, sums, strict=True):
            assert mark.view(f"i{mark.itemsize}").tolist() == lanes
        for i in range(4):
            for j in range(4):
                assert M.likeness(marks[i], marks[j]) == pytest.approx(cosine(sums[i], sums[j]), abs=1e-9)


def test_edits_of_many_repeats_match_exact_sums(spark):
    rows = [(4, "x. y.\n" * 20000, "a"), (3, "other. text\n" * 3000, "a"), (2, "same\n" * 70000, "b"), (1, "same\n" * 35000, "b"), (None, "x. y. " * 40000, "b")]
    for k, r in enumerate(sorted(M.edits(frame(spark, rows)).collect(), key=lambda r: r.doc_id or 0, reverse=True)):
        text, after = rows[k][1], rows[(k + 1) % len(rows)][1]
        changed = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        assert r.doc_id == rows[k][0]
        assert r.near_edited == pytest.approx(cosine(exact(text), exact(changed)), abs=1e-9)
        assert r.near_next == pytest.approx(cosine(exact(text), exact(after)), abs=1e-9)


def test_rows_without_id_and_of_one_id_are_split(spark):
    """A third of rows has no id and a third one id: parts stay even, and every row still meets its next."""
    from respscore.llm.common import Workspace

    rows = [(None if k % 3 == 0 else 77 if k % 3 == 1 else k, f"text {k} of many. And more.", "a") for k in range(3000)] + [(-9, "last id", "a")]
    docs = frame(spark, rows)
    ws = Workspace(spark, "parts")
    dealt = M.with_next(docs.select("doc_id", "text"), ws).where("NOT peek").groupBy("part").count().collect()
    assert sum(r["count"] for r in dealt) == len(rows) and max(r["count"] for r in dealt) <= 3 * len(rows) / 8
    assert len([r for r in dealt if r["count"] > 100]) >= 6
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = M.edits(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, set()).add(r.edited_sha256)
    assert len(texts[77]) == 1001 and len(texts[None]) == 1000 and order[0][0] == 2999


def test_ranges_of_ids():
    upward, first, width = M.id_ranges([5, 5, 5, 9, 12], 6, 100, 60)
    assert upward.tolist() == [4, 5, 9, 12] and width.tolist() == [1, 1, 1, 3, 1, 3] and first.tolist() == [0, 1, 2, 3, 6, 7]
    at = [len(upward) - np.searchsorted(upward, i, side="left") for i in (20, 12, 10, 9, 6, 5, 4, 1)]
    assert at == [0, 1, 1, 2, 2, 3, 4, 4]
    assert [x.tolist() for x in M.id_ranges([], 1, 0, 0)] == [[], [0, 1], [1, 1]]
