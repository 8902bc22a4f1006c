import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from helpers import edge_rows, frame
from helpers import texts as some_texts
from respscore.llm import bytebpe as B
from respscore.llm import counts as C
from respscore.llm import idfiles as I
from respscore.llm.common import Workspace


def edge_texts():
    return some_texts(4, 30)


@pytest.mark.parametrize("ordinary", [False, True])
def test_encodes_as_the_library(ordinary, monkeypatch):
    own, lib = B.ByteBpe(I.tokenizer_path(), ordinary), Tokenizer.from_file(I.tokenizer_path())
    lib.encode_special_tokens = ordinary
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", " \n", "a", "the", "'s", "9", "42", "é", "中", "<|endoftext|>", "!", "...", "\t", " ", "\x00", "\x1c", "　", " x", "\r\n"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(8000)] + [None, *edge_texts()]
    ids, n = own.encode(pa.array(some))
    for text, got in zip(some, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == lib.encode(text or "", add_special_tokens=False).ids, repr(text)
    monkeypatch.setattr(B, "CACHE_WORDS", 5)
    again, m = B.ByteBpe(I.tokenizer_path(), ordinary).encode(pa.array(some))
    assert (again == ids).all() and (m == n).all()


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 20, 32])
def test_packing(bits):
    ids = np.random.default_rng(0).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = I.pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8) and (I.unpack(raw, 1001, bits) == ids).all()


@pytest.mark.parametrize("bits", [11, 16])
def test_random_access(bits):
    rng = np.random.default_rng(1)
    docs = [(i if i != 3 else None, rng.integers(0, 1 << bits, n).astype(np.uint32)) for i, n in enumerate([0, 5, 1000, 1, 0, 333])]
    f = io.BytesIO()
    out = I.Shard(f, bits, 64)
    for i, ids in docs:
        out.add(i, ids)
    out.close()
    shard = I.ShardReader(f)
    assert [(i, x.tolist()) for i, x in shard.documents(most=100)] == [(i, x.tolist()) for i, x in docs]
    flat = np.concatenate([x for _, x in docs])
    for start, n in ((0, 0), (0, 1), (63, 2), (64, 64), (100, 700), (1338, 1)):
        assert (shard.read_ids(start, n) == flat[start:start + n]).all()
    with pytest.raises(ValueError):
        I.ShardReader(io.BytesIO(bytes(100)))


def rows_and_ids(ordinary=False):
    lib = Tokenizer.from_file(I.tokenizer_path())
    lib.encode_special_tokens = ordinary
    rows = [*edge_rows(), (8000, "a <|endoftext|> b", "a"), (8001, "word " * 60000, "a")]
    return rows, [lib.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]


def test_written_in_order_and_read_back(spark):
    rows, ids = rows_and_ids()
    ws = Workspace(spark, "t")
    shards = ws.keep(I.write_ids(frame(spark, rows).repartition(7), f"{ws.path}/files", I.tokenizer_path(), 0, block_ids=128), "shards")
    got = sorted((tuple(r) for r in I.read_documents(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    crc = lambda x: zlib.crc32(np.array([*x, 0], "<u4").tobytes())
    assert sorted((str(i), n, c) for i, _, n, c in got) == sorted((str(i), len(x) + 1, crc(x)) for (i, *_), x in zip(rows, ids, strict=True))
    empty = ws.keep(I.write_ids(frame(spark, rows).limit(0), f"{ws.path}/none", I.tokenizer_path(), 0), "none")
    assert I.read_documents(empty).count() == 0


@pytest.mark.parametrize("block_bytes", [4, 10, 1000, C.BLOCK_BYTES])
def test_separator_scan_of_any_blocks(spark, block_bytes):
    rng = np.random.default_rng(4)
    ws = Workspace(spark, "t")
    want = []
    for k, lengths in enumerate([[0, 0, 3, 50, 0], [700], [], [1, 2, 3] * 30, [9]]):
        flat = []
        for n in lengths:
            flat += [*rng.integers(0, 100, n).tolist(), 999]
        if k == 4:
            flat += [5, 6, 7]  # a document without its end
        path = f"{ws.path}/f/part-{k}.tokens"
        C.write_whole(path, lambda f, x=flat: f.write(np.array(x, "<u2").tobytes()))
        want += [(k, i, n, True) for i, n in enumerate(lengths)] + ([(k, 1, 3, False)] if k == 4 else [])
    got = C.count_tokens(C.flat_files(spark, f"{ws.path}/f"), 2, 999, block_bytes).collect()
    assert sorted((int(r.path[-8]), r.place, r.n_tokens, r.ended) for r in got) == sorted(want)


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_one_file_of_many_blocks_is_scanned_in_stretches(spark, monkeypatch, most):
    """Documents of many stretches, stretches of many documents; the lists of counts are in no window."""
    monkeypatch.setattr(C, "SUPER", most)
    rng = np.random.default_rng(7)
    lengths = [0, 500, 0, 0, 3, 260, *rng.integers(0, 9, 200).tolist(), 1000, 2]
    flat = [x for n in lengths for x in [*[1] * n, 999]] + [5] * 70
    ws = Workspace(spark, "t")
    C.write_whole(f"{ws.path}/f/part-0.tokens", lambda f: f.write(np.array(flat, "<u2").tobytes()))
    files = C.flat_files(spark, f"{ws.path}/f")
    got = sorted((r.place, r.n_tokens, r.ended) for r in C.count_tokens(files, 2, 999, 32).collect())
    assert got == [(i, n, True) for i, n in enumerate(lengths)] + [(len(lengths), 70, False)]
    plan = C.block_places(C.scan_blocks(files, 2, 999, 32))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("inner#" in line for line in plan.splitlines() if "Window" in line)


def test_counts_of_documents(spark, tmp_path):
    rows, ids = rows_and_ids(True)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = C.op2_separator_scan(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(x)) for (i, *_), x in zip(rows, ids, strict=True))


def test_scratch_paths_name_their_store(spark):
    """A path without a scheme is in Spark's default file system, so it is never taken for a mounted one."""
    assert re.match("[a-z0-9]+:/", Workspace(spark, "t").path)
