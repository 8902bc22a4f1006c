"""64-bit SimHash of word tokens with FNV-1a token hashes.

Two implementations that must agree on every row:

* ``simhash64`` - an Arrow UDF over the lower-cased text column.  The Python
  worker cuts, hashes (vectorised FNV-1a) and counts tokens in the Arrow
  buffer of a batch's texts with numpy, so no string is made per token, on
  the JVM side or in Python, and nothing shuffles.
* ``simhash_frame`` - a pure DataFrame plan (hash tokens where they are cut,
  sum votes per row) used as an independent cross-check.

Fingerprints are unsigned 64-bit values carried in BIGINT (same bit
pattern); Hamming distance is ``bit_count(a ^ b)``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .constants import FNV64_OFFSET, FNV64_PRIME, HASH_BITS
from .text import _col, tokens

_MASK64 = (1 << 64) - 1


# ---------------------------------------------------------------- reference
def fnv1a64(token: str) -> int:
    """FNV-1a over UTF-16 code units (tokens are ASCII), unsigned result."""
    h = FNV64_OFFSET
    for ch in token:
        h = ((h ^ ord(ch)) * FNV64_PRIME) & _MASK64
    return h


def to_signed(u: int) -> int:
    return u - (1 << 64) if u >= (1 << 63) else u


def to_hex(v: int) -> str:
    return format(v & _MASK64, "016x")


# ------------------------------------------------------------ Arrow kernel
def _offsets(arr: pa.Array) -> np.ndarray:
    """Offsets of a (large_)string or (large_)list array, relative to its slice."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_list(arr.type)
    dtype = np.int64 if wide else np.int32
    raw = np.frombuffer(arr.buffers()[1], dtype=dtype)
    return raw[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)


def _fnv1a64_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Vectorised FNV-1a of the byte spans ``data[start: start + len]``, as uint64.

    Spans are processed longest first, so at character position j the
    still-active ones form a prefix and each step is one gather, one XOR
    and one wrapping multiply over that prefix."""
    hs = np.full(len(starts), FNV64_OFFSET, dtype=np.uint64)
    if len(starts) == 0:
        return hs
    top = int(lens.max())
    order = np.argsort((top - lens).astype(np.min_scalar_type(top)), kind="stable")  # narrow numbers sort by radix
    at = starts[order]
    neg_lens = -lens[order]                      # ascending
    prime = np.uint64(FNV64_PRIME)
    for j in range(top):
        k = int(np.searchsorted(neg_lens, -j, side="left"))   # spans longer than j
        head = hs[:k]
        head ^= data[at[:k] + j]
        head *= prime
    out = np.empty_like(hs)
    out[order] = hs
    return out


def _bytes(arr: pa.Array) -> np.ndarray:
    """The bytes that a string array's offsets point into."""
    buf = arr.buffers()[2]
    return np.zeros(0, dtype=np.uint8) if buf is None else np.frombuffer(buf, dtype=np.uint8)


def fnv1a64_array(words: pa.Array) -> np.ndarray:
    """Vectorised FNV-1a of every string in ``words`` (no nulls), as uint64."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    offs = _offsets(words)
    return _fnv1a64_spans(_bytes(words), offs[:-1], np.diff(offs))


# bit j of byte value v, for v in 0..255 (rows) and j in 0..7 (columns)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1,
                           bitorder="little").astype(np.int64)

# bytes of a token: [a-z0-9]
_TOKEN_BYTE = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8))

# tokens hashed and counted at a time: bounds worker memory whatever the size
# of an Arrow batch or of one text, and keeps the histograms in the cache
CHUNK_TOKENS = 1 << 17


def _token_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of lower-cased texts that lie in ``data`` one after the other; a text's
    edge ends a token even where the next text goes on with one."""
    inside = _TOKEN_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def simhash_lowered(texts: pa.Array) -> np.ndarray:
    """SimHash (as int64 bit pattern) of each lower-cased text of a string array.

    A null or a text without tokens gives 0.  Bit i is set iff more than half of the
    row's token occurrences have bit i set (vote > 0, ties give 0).

    Votes are counted a byte at a time: for byte position k of the token
    hashes, a bincount over (row, byte value) gives a rows x 256 histogram,
    and histogram @ bit-table(256 x 8) gives the set-bit counts of bits
    8k..8k+7 for every row.  A row's counts are summed over the chunks it reaches into."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n_rows = len(texts)
    if n_rows == 0:
        return np.zeros(0, dtype=np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    offs = _offsets(texts)
    data, offs = _bytes(texts)[offs[0]: offs[-1]], offs - offs[0]
    starts, ends = _token_spans(data, offs)
    counts = np.diff(np.searchsorted(starts, offs))
    ones = np.zeros((n_rows, HASH_BITS), dtype=np.int64)
    for at in range(0, len(starts), CHUNK_TOKENS):
        own = starts[at: at + CHUNK_TOKENS]
        hash_bytes = _fnv1a64_spans(data, own, ends[at: at + CHUNK_TOKENS] - own).astype("<u8").view(np.uint8).reshape(-1, 8)
        rows, place = np.unique(np.searchsorted(offs, own, side="right") - 1, return_inverse=True)  # rows with tokens here
        base = place * 256
        for k in range(8):
            hist = np.bincount(base + hash_bytes[:, k], minlength=len(rows) * 256)
            ones[rows, 8 * k: 8 * k + 8] += hist.reshape(-1, 256) @ _BYTE_BITS
    set_bits = (2 * ones > counts[:, None]).astype(np.uint8)
    packed = np.packbits(set_bits, axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1).astype(np.uint64).view(np.int64)


def simhash_texts(texts: list[str | None]) -> list[int]:
    """Convenience for tests: SimHash of Python strings (tokenised like Spark)."""
    lowered = pa.array([None if t is None else t.lower() for t in texts], type=pa.string())
    return [int(v) for v in simhash_lowered(lowered)]


# Ship this module's code with the UDF (pickled by value), so executors need
# only numpy and pyarrow, not this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


if hasattr(F, "arrow_udf"):  # Spark 4.1+: Arrow arrays in and out, no pandas
    @F.arrow_udf(LongType())
    def _simhash_lowered_udf(texts: pa.Array) -> pa.Array:
        return pa.array(simhash_lowered(texts), type=pa.int64())
else:  # pragma: no cover - older Spark: the same kernel behind a pandas UDF
    import pandas as pd

    @F.pandas_udf(LongType())
    def _simhash_lowered_udf(texts: pd.Series) -> pd.Series:
        return pd.Series(simhash_lowered(pa.array(texts, type=pa.string())))


def simhash64(text: Column | str) -> Column:
    """SimHash of a text column (caller applies any truncation first)."""
    return _simhash_lowered_udf(F.lower(_col(text)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits between two 64-bit fingerprints."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


# ------------------------------------------------ DataFrame implementation
def _fnv_step(h: Column, c: Column) -> Column:
    """One FNV-1a step ((h ^ c) * prime mod 2^64) without 64-bit overflow.

    prime = 2^40 + 435, so with x = hi*2^32 + lo the product mod 2^64 is
    2^32 * (hi*435 + lo*2^8 + carry) + (lo*435 mod 2^32), every partial
    product staying below 2^42."""
    x = h.bitwiseXOR(c)
    lo = x.bitwiseAND(F.lit(0xFFFFFFFF))
    hi = F.shiftrightunsigned(x, 32)
    lo_p = lo * F.lit(435)
    high = (hi * F.lit(435) + F.shiftleft(lo, 8) + F.shiftrightunsigned(lo_p, 32)).bitwiseAND(
        F.lit(0xFFFFFFFF))
    return F.shiftleft(high, 32).bitwiseOR(lo_p.bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv1a64_col(token: Column | str) -> Column:
    """FNV-1a 64 of an ASCII token as a native expression (BIGINT bit pattern)."""
    t = _col(token)
    chars = F.transform(F.split(t, ""), lambda ch: F.ascii(ch).cast("bigint"))
    chars = F.when(F.length(t) == 0, F.array().cast("array<bigint>")).otherwise(chars)
    return F.aggregate(chars, F.lit(to_signed(FNV64_OFFSET)).cast("bigint"), _fnv_step)


# characters of a token that are hashed by compiled steps, in words of 7 (a BIGINT holds 7 without its sign)
STEP_CHARS, WORD_CHARS = 14, 7


def _with_fnv(df: DataFrame, token: str, out: str, *others: Column) -> DataFrame:
    """``others`` of ``df`` plus ``out``, the FNV-1a 64 of an ASCII ``token`` that is not null (empty: 0).

    One projection per character: each refers to the state before it several times, so Spark keeps
    them apart and compiles them with what follows.  A lambda is not compiled; only what a token
    has beyond ``STEP_CHARS`` characters goes through it."""
    t = F.col(token)
    steps = df
    for at in range(0, STEP_CHARS, WORD_CHARS):  # 7 bytes as a number, zeros beyond the end
        word = F.conv(F.hex(F.rpad(F.substring(t, at + 1, WORD_CHARS), WORD_CHARS, "\0")), 16, 10).cast("bigint")
        steps = steps.withColumn(f"_w{at}", F.coalesce(F.when(F.length(t) > at, word), F.lit(0)))
    steps = steps.withColumn(out, F.lit(to_signed(FNV64_OFFSET)).cast("bigint"))
    for i in range(STEP_CHARS):
        code = F.shiftrightunsigned(F.col(f"_w{i - i % WORD_CHARS}"), 8 * (WORD_CHARS - 1 - i % WORD_CHARS)).bitwiseAND(F.lit(255).cast("bigint"))
        steps = steps.withColumn("_k", code)
        steps = steps.withColumn(out, F.when(F.col("_k") > 0, _fnv_step(F.col(out), F.col("_k"))).otherwise(F.col(out)))
    rest = F.transform(F.split(F.substr(t, F.lit(STEP_CHARS + 1)), ""), lambda ch: F.ascii(ch).cast("bigint"))
    whole = F.when(F.length(t) > STEP_CHARS, F.aggregate(rest, F.col(out), _fnv_step)).when(F.length(t) > 0, F.col(out)).otherwise(F.lit(0).cast("bigint"))
    return steps.select(*others, whole.alias(out))


def simhash_frame(df: DataFrame, text: str) -> DataFrame:
    """``df`` (minus the ``text`` column) plus ``fingerprint``, computed with a
    pure DataFrame plan; every row is kept, equal ones too.

    Tokens are hashed where they are cut (native FNV-1a expression) and their
    votes summed per row in the same task, so no token is shuffled or stored:
    what is kept is a row's votes, twice (its first token's, the others'), whatever
    its length.  Votes of two bits are summed in one BIGINT,
    in halves of 32 bits that an array's length cannot fill, so the aggregate has
    32 plain sums and stays small enough to be compiled.  The other columns
    travel with a row's first token alone.  A row with no token keeps its
    place (posexplode_outer) and gets 0."""
    from ..session import materialize

    carry = [c for c in df.columns if c != text]
    numbered = df.select(F.struct(*[F.col(c) for c in carry]).alias("_c") if carry else F.lit(None).alias("_c"), F.col(text).alias("_x"),
                         F.monotonically_increasing_id().alias("_row"))  # before the tokens are exploded
    occ = numbered.select("_row", "_c", F.posexplode_outer(tokens("_x")).alias("_p", "_t"))
    head = F.coalesce(F.col("_p"), F.lit(0)) == 0
    occ = occ.select("_row", F.coalesce("_t", F.lit("")).alias("_t"), head.alias("_head"), F.when(head, F.col("_c")).alias("_c"))
    hashed = _with_fnv(occ, "_t", "_h", *[F.col(c) for c in ("_row", "_head", "_c")], (F.col("_t") != "").cast("bigint").alias("_n"))
    half = HASH_BITS // 2
    low = F.lit(1).cast("bigint")
    pair = lambda i: F.shiftrightunsigned("_h", i).bitwiseAND(low).bitwiseOR(
        F.shiftleft(F.shiftrightunsigned("_h", i + half).bitwiseAND(low), 32))
    # sums of a task's rows before anything is moved
    counted = materialize(hashed.groupBy("_row", "_head", "_c").agg(F.sum("_n").alias("_n"), *[F.sum(pair(i)).alias(f"_o{i}") for i in range(half)]))
    votes = counted.groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("_n", *[f"_o{i}" for i in range(half)])])
    ones = lambda i: F.col(f"_o{i}").bitwiseAND(F.lit(0xFFFFFFFF)) if i < half else F.shiftrightunsigned(f"_o{i - half}", 32)
    fp = F.lit(0).cast("bigint")
    for i in range(HASH_BITS):
        fp = fp.bitwiseOR(F.when(2 * ones(i) > F.col("_n"),
                                 F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0)))
    rows = counted.where("_head").select("_row", "_c").join(votes.select("_row", fp.alias("fingerprint")), "_row")
    return rows.select(*[F.col("_c")[c].alias(c) for c in carry], "fingerprint")
