import random
import re

import numpy as np
import xxhash

from helpers import edge_rows, frame
from respscore.llm import simhash as S
from respscore.llm.common import Workspace
from respscore.llm.components import components
from respscore.llm.golay import BITS, decode, nearby


def model(text, width=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + width]) for i in range(len(ws) - width + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def closure(ids, fps, bits=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_code_is_perfect():
    rng = np.random.default_rng(0)
    index = np.unique(decode(rng.integers(0, 1 << BITS, 200000, dtype=np.uint32)))
    assert len(index) == 4096
    words = rng.integers(0, 1 << BITS, 200, dtype=np.uint32)
    n, keys = nearby(words, BITS)
    assert n.max() <= 6 and len(keys) == n.sum()


def test_any_three_bits_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for p in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(p)
    ka, kb = (set(zip(*map(np.ndarray.tolist, S.golay_keys(x)), strict=True)) for x in (a, b))
    assert {r for r, _ in ka & kb} == set(range(3000))


def test_fingerprints(spark):
    rows = edge_rows()
    got = S.fingerprints(frame(spark, rows), carry=["doc_id", "text", "size"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fp % (1 << 64) == model(r.text), r.text


def near_rows():
    rng = random.Random(2)
    rows = [(i, t, s) for i, t, s in edge_rows()]
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    for k in range(120):  # a dense cloud of near copies
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(400)] = f"v{rng.randrange(500)}"
        rows.append((2000 - k, " ".join(w), "a"))
    return rows


def test_components_match_brute_force_for_any_bucket(spark):
    rows = near_rows()
    fps = [model(t) for _, t, _ in rows]
    want = sorted(zip((str(r[0]) for r in rows), (format(f, "016x") for f in fps), map(str, closure([r[0] for r in rows], fps)), strict=True))
    for bucket in (S.BUCKET, 3):
        got = S.near_duplicates(frame(spark, rows), bucket=bucket).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert S.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_forest_spans_without_all_pairs():
    fps = np.arange(64, dtype=np.uint64)
    left, right = S.forest(fps, 3)
    assert sum(map(len, left)) == sum(map(len, right)) == 63


def test_keep_one_of_each_group(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    fps = [model(t) for _, t, _ in rows]
    comp = closure(list(range(len(rows))), fps)
    kept = out.collect()
    assert len(kept) == len(set(comp))
    assert len({model(r.text) for r in kept}) == len(kept)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300), (-5, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 300: -5, 301: -5}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0
