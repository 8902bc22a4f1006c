import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import edge_rows, frame
from respscore.llm import align as A
from respscore.llm.piecebpe import model_path


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A.byte_path())
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=model_path())


def tokens(text, libraries):
    """(id, bytes) of both sides with the libraries alone."""
    t, sp = libraries
    alphabet = A.byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    return a, b


def model(texts, libraries):
    """Rows of the contract, by walking every text's bytes and listing every link."""
    docs = []
    for text in texts:
        a, b = tokens(text, libraries) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        ends = [set(np.cumsum([len(x) for _, x in s]).tolist()) for s in (a, b)]
        both, groups = sorted(ends[0] & ends[1]), []
        sides = [[], []]
        for s, side in enumerate((a, b)):
            at, k = 0, 0
            for i, x in side:
                at += len(x)
                while at > both[k]:
                    k += 1
                sides[s].append((i, k))
        for k in range(len(both)):
            groups.append(([i for i, g in sides[0] if g == k], [i for i, g in sides[1] if g == k])) if len(both) < 200 else None
        if len(both) >= 200:
            groups = [([], []) for _ in both]
            for s in (0, 1):
                for i, g in sides[s]:
                    groups[g][s].append(i)
        docs.append((len(a), len(b), groups))
    held = Counter()
    for _, _, groups in docs:
        held.update({(i, j) for x, y in groups for i in x for j in y})
    most = Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for na, nb, groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((na, nb, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


ODD = ["a" * 700, "ab" * 333, " ", "  two  spaces   here ", "<|endoftext|> and </s> [INST]", "▁marked", "x▁y", "\n\n line\r\n", "\x00 nul", "ﬁ Å ½", "1234567890" * 30,
       "=" * 301, "don't you've WE'RE", "中文字符\U0001f600\U0001f468‍\U0001f469", "é" * 99, "a\tb c　d"]


def test_against_the_libraries_and_every_link(spark, libraries):
    rows = edge_rows(4, 20) + [(5000 + k, t, "a") for k, t in enumerate(ODD)] + [(5001, ODD[1], "b"), (None, ODD[4], None)]
    want = sorted((str(r[0]), *w) for r, w in zip(rows, model([t for _, t, _ in rows], libraries), strict=True))
    for head in (A.HEAD_ROWS, 20, 0):  # every pair broadcast, few, none
        got = A.corpus_links(frame(spark, rows), A.byte_path(), model_path(), head_rows=head).collect()
        assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert sum(w[1] == 0 for w in want) >= 4 and any(w[4] > 5000 for w in want)


def test_groups_are_an_output(spark, libraries):
    rows = [(k, t, "a") for k, t in enumerate(ODD)]
    for r in A.align(frame(spark, rows), A.byte_path(), model_path(), groups=True).collect():
        a, b = tokens(ODD[r.doc_id], libraries)
        if r.n_a:
            assert (r.a_ids, r.b_ids) == ([i for i, _ in a], [i for i, _ in b])
            assert sum(r.a_in_group) == r.n_a and sum(r.b_in_group) == r.n_b and len(r.a_in_group) == r.n_groups
            assert sum(x.times for x in r.links) == r.n_links == sum(p * q for p, q in zip(r.a_in_group, r.b_in_group, strict=True))


def test_coalescing_against_shared_ends():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = [np.unique(np.append(rng.integers(1, 60, rng.integers(0, 30)), 60)) for _ in range(2)]
        starts = [np.append(0, c[:-1]) for c in cuts]
        a, b = A.coalesce(starts[0], cuts[0], starts[1], cuts[1])
        shared = np.intersect1d(*cuts)
        for got, end in ((a, cuts[0]), (b, cuts[1])):
            assert got.tolist() == np.searchsorted(shared, end).tolist()


def test_empty_tables(spark):
    empty = frame(spark, edge_rows()).limit(0)
    assert A.corpus_links(empty, A.byte_path(), model_path()).count() == 0
    none = A.corpus_links(frame(spark, [(1, None, "a"), (2, "", "b")]), A.byte_path(), model_path()).collect()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, "", 0, 0) for r in none) and len(none) == 2


def test_registered_query(spark, libraries):
    from conftest import SF001

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(docs, model([r.text for r in docs], libraries), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in A.op12_alignment(spark, SF001).collect()}
    assert got == want
