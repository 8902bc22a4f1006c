"""The whole pipeline against plain Python: rules, line dedup, components, targets of the mix, library ids and digests."""

import hashlib
import random
import re

import sentencepiece
import xxhash

import corpus_pipeline as P
from helpers import frame
from respscore.llm import piecebpe
from respscore.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    rep = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(w) >= Q.MIN_WORDS and 100 * len(rep) <= Q.MAX_REPEAT_PCT * len(w) and 2 * len(w) <= chars <= 15 * len(w)
            and 10 * symbols <= len(w) and 2 * (len(lines) - len(set(lines))) <= len(lines))


def without_repeats(rows):
    """Rows by id, a null one last, without windows of three lines that occur earlier."""
    seen, out = set(), []
    for i, text, source in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, covered = text.split("\n"), set()
        for k in range(len(lines) - 2):
            if tuple(lines[k:k + 3]) in seen:
                covered |= {k, k + 1, k + 2}
            seen.add(tuple(lines[k:k + 3]))
        if len(covered) < len(lines):
            out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in covered), source))
    return out


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(len(w) - 2)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def one_of_each(rows):
    fps, root = [fingerprint(t) for _, t, _ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [r for k, r in enumerate(rows) if root[k] == k]


def level(sizes, share=1.5, most=2.0):
    """Targets by bisection; weights 3, 1, 2 in the order of the sources."""
    weights, lo, hi = [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sizes))], 0.0, 1e9
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < share * sum(sizes) else (lo, mid)
    return [min(most * s, w * lo) for s, w in zip(sizes, weights, strict=True)]


def test_run_matches_plain_python(spark, tmp_path):
    rng = random.Random(5)
    good = lambda n: "\n".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(900)) for _ in range(12)) for _ in range(n))
    shared = good(4)
    rows = [(k, good(rng.randint(6, 14)) + ("\n" + shared + "\n" + good(5) if k % 7 == 0 else ""), ["a", "b", "c", None][k % 4]) for k in range(60)]
    rows += [(100 + k, rows[k][1], "a") for k in range(4)]  # copies
    near = " ".join(f"n{k}" for k in range(400))
    rows += [(200 + k, near.replace(f"n{k + 7} ", "changed "), "b") for k in range(4)] + [(None, good(9), "c")]
    rows += [(300, "few words", "a"), (301, "x y z " * 60, "b"), (302, None, "a"), (303, "", None), (304, " ".join(f"w{k}###" for k in range(60)), "c")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")

    left = one_of_each(without_repeats([r for r in rows if passes(r[1])]))
    assert 200 in {r[0] for r in left} and len(left) < len(rows) - 8
    got = P.run(spark, str(tmp_path)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=piecebpe.model_path())
    kept, times = {r[0]: r for r in left}, {}
    for r in got:
        i, text, source = kept[r.doc_id]
        ids = sp.encode(text)
        assert (r.lang, r.source, r.n_tokens, list(r.ids)) == ("en", source, len(ids), ids)
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        times[i] = times.get(i, 0) + 1
    words = {i: len(WORD.findall(t)) for i, t, _ in left}
    order = sorted({r[2] for r in left}, key=lambda s: (s is None, s or ""))
    of = {s: [r[0] for r in left if r[2] == s] for s in order}
    for s, target in zip(order, level([sum(words[i] for i in of[s]) for s in order]), strict=True):
        n = [times.get(i, 0) for i in of[s]]
        assert max(n) - min(n) <= 1 and max(n) <= 2
        assert abs(sum(words[i] * k for i, k in zip(of[s], n, strict=True)) - target) <= max(words[i] for i in of[s]) / 2 + 1e-6, s
