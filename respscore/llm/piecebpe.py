"""SentencePiece BPE encoding and decoding through a merge-type prefix table (operator 7).

For every prefix of a word the encoding ends in one certain token.  The table
stores that token: an automaton finds all vocabulary pieces that end at a
position, longest first, and the first that is compatible with the token
before it is the one.  Two tokens are compatible if no merge would cross
between them; undoing their merges, latest first, tells.  The ids of the word
are then read from the table backwards.

No piece holds a word character before the space mark, so a text falls apart
into words (space mark and what follows), and likewise between any two
characters that no piece holds side by side; each distinct part is done once
from a bounded cache.  Pieces of several space marks rank below all others
and are merged last, which ``_spaces`` does.  A character outside the
vocabulary stands alone as its UTF-8 bytes.

Defined results: a null or empty text has no ids and decodes to an empty
text; repeated rows are encoded alike; an empty table gives an empty result;
other columns are carried only where named.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import slices, table
from .process import kept
from .words import FIRST, Words, encode_words

MARK = "▁"  # the library's space mark
CACHE_WORDS = 120_000  # runs of characters kept by a worker; words, which take less, six times as many
SLICE_BYTES = 4 << 20  # text that a task holds ids for at once
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_CARE = rf"  |[{MARK}{FIRST}]|\A |\A\z| \z| \n"  # texts that single spaces alone don't cut into words
_NEVER = 1 << 40


class PieceBpe:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(sp.get_piece_size())
        self.bytes_id, self.surface, ordinary = {}, [], []
        for i in kinds:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_id[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            elif sp.is_control(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                ordinary.append((piece, i, sp.get_score(i)))
        self.controls = {i for i in kinds if sp.is_control(i)}
        self.marked = {i for p, i, _ in ordinary if p.startswith(MARK)}
        spaces = [x for x in ordinary if len(x[0]) > 1 and not x[0].strip(MARK)]
        words = [x for x in ordinary if len(x[0]) == 1 or x[0].strip(MARK)]
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) for p, _, _ in words):
            raise ValueError("a piece crosses a space mark")
        if any("\n" in p for p, _, _ in ordinary):
            raise ValueError("a piece holds a line break")
        scores = [s for p, _, s in words if len(p) > 1]
        if len(set(scores)) < len(scores):
            raise ValueError("pieces of equal rank")
        if spaces and max(s for _, _, s in spaces) >= min(scores):
            raise ValueError("pieces of space marks rank above others")
        self.space_id = {len(p): (i, s) for p, i, s in spaces}
        self.pieces, self.found = words, None

    def _fit(self) -> None:
        """Order of merges, how each piece comes about, and the automaton of pieces that do; only encoding needs them."""
        import ahocorasick

        words = self.pieces
        order = sorted(words, key=lambda x: -x[2])
        self.id_of = {p: i for p, i, _ in words}
        self.inside = {p[k:k + 2] for p, _, _ in words for k in range(len(p) - 1)}  # neighbours that some piece joins
        self.rank, self.parts, self.text, self.fits = {}, {}, {}, {}
        self.words = Words(self._make, 6 * CACHE_WORDS)
        self.runs: dict[str, bytes] = {}
        self.mark = array("i", [self.id_of[MARK]]).tobytes()
        found = ahocorasick.Automaton()
        for p, i, _ in words:
            self.text[i] = p
            if len(p) == 1:
                self.rank[i] = -1
                found.add_word(p, (1, i))
        for r, (p, i, _) in enumerate(order):
            if len(p) == 1:
                continue
            for cut in range(1, len(p)):  # the split whose halves stay apart under all earlier merges
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a in self.rank and b in self.rank and self._apart(a, b, r):
                    self.parts[i], self.rank[i] = (a, b), r
                    found.add_word(p, (len(p), i))
                    break
        found.make_automaton()
        self.found = found

    def _apart(self, a: int, b: int, below: int) -> bool:
        """Whether no merge that ranks before ``below`` crosses from token ``a`` to token ``b``."""
        while True:
            crossing = self.rank.get(self.id_of.get(self.text[a] + self.text[b]), _NEVER)
            if crossing < below:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra > rb:  # the left token's last merge came later: a tie goes to the left
                below, a = ra, self.parts[a][1]
            elif rb >= 0:
                below, b = rb + 1, self.parts[b][0]
            else:
                return True

    def _table(self, word: str) -> list[int]:
        """Ids of a run of known characters: the prefix table forwards, the ids backwards."""
        last, fits, done = [-1] * (len(word) + 1), self.fits, 0
        for end, (n, i) in self.found.iter(word):
            end += 1
            if end == done:  # a longer piece has been found for this prefix
                continue
            before = last[end - n]
            if end > n:
                ok = fits.get(pair := before << 20 | i)
                if ok is None:
                    if len(fits) >= 2 * CACHE_WORDS:
                        fits.clear()
                    ok = fits[pair] = self._apart(before, i, _NEVER)
                if not ok:
                    continue
            last[end], done = i, end
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= len(self.text[last[at]])
        return ids[::-1]

    def _make(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = [self._word(w) for w in words.to_pylist()]
        return np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64)

    def _word(self, word: str) -> bytes:
        """Ids (int32) of a word behind a space or at the beginning of a text (a space mark goes before it),
        or behind a line break (``word`` begins with it): cut between neighbours that no piece joins."""
        text = word if word[:1] == "\n" else MARK + word.removeprefix(FIRST)
        cuts = [0, *(k for k in range(1, len(text)) if text[k - 1:k + 1] not in self.inside), len(text)]
        return b"".join([self._run(text[s:e]) for s, e in pairwise(cuts)])

    def _run(self, run: str) -> bytes:
        """Ids of characters that pieces may join: known ones, or one that is in no piece."""
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) >= CACHE_WORDS:
                self.runs.clear()
            ids = self.runs[run] = array("i", self._table(run) if run[0] in self.id_of else [self.bytes_id[x] for x in run.encode()]).tobytes()
        return ids

    def _spaces(self, n: int) -> list[int]:
        """Ids of ``n`` space marks that nothing else has merged: best piece first, leftmost on ties."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(left: int) -> None:
            if 0 <= left and after[left] < n and (x := self.space_id.get(total := size[left] + size[after[left]])):
                heapq.heappush(heap, (-x[1], left, total))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, total = heapq.heappop(heap)
            right = after[left] if size[left] else n
            if right >= n or size[left] + size[right] != total:
                continue
            size[left], size[right], after[left] = total, 0, after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [self.space_id[s][0] if s > 1 else self.id_of[MARK] for s in size if s]

    def _after_spaces(self, chunk: str) -> bytes:
        """Ids of one or more space marks and the word behind them."""
        word = chunk.lstrip(MARK)
        marks = len(chunk) - len(word)
        ids = self._word(FIRST + word) if word else self.mark
        if marks == 1:
            return ids
        alone = ids.startswith(self.mark)  # the last mark went with no piece of the word
        return array("i", self._spaces(marks - 1 + alone)).tobytes() + ids[4 * alone:]

    def _whole(self, text: str) -> bytes:
        """A text with runs of spaces, or with space marks of its own."""
        return b"".join(map(self._after_spaces, _WORDS.findall(MARK + text.replace(" ", MARK)))) if text else b""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, int32, and how many each has), as the library's encode."""
        if self.found is None:
            self._fit()
        ids, n = encode_words(texts, _CARE, self._whole, self.words)
        return ids.view(np.int32), n

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, as the library's decode: bytes that are no UTF-8 become U+FFFD each."""
        ids = ids.tolist()
        parts, run = [], []
        if self.controls.isdisjoint(ids):
            run = ids
        else:
            for i in ids:  # a control id ends a run of byte ids
                if i in self.controls:
                    parts.append(run)
                    run = []
                else:
                    run.append(i)
        parts = [x for x in [*parts, run] if x]
        raw = [b"".join(map(self.surface.__getitem__, x)) for x in parts]
        if parts and parts[0][0] in self.marked:
            raw[0] = raw[0][1:]
        return "".join(map(_lenient, raw))


def _lenient(raw: bytes) -> str:
    """UTF-8 to text; a byte that is no part of a character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at:at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


def codec(path: str) -> PieceBpe:
    return kept(("piecebpe", path), lambda: PieceBpe(path))


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with its text column replaced by an ``ids`` column (ARRAY<INT>) and, where ``decoded`` names
    one, a column of what those ids decode to (made in the same pass).  No shuffle."""
    names, more = [c for c in df.columns if c != text], [decoded] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(model)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
            for start, end in slices(sizes, SLICE_BYTES):
                part = b.slice(start, end - start)
                flat, n = bpe.encode(part.column(text))
                ends = np.cumsum(n)
                made = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))]
                if decoded:
                    made.append(pa.array([bpe.decode(x) for x in np.split(flat, ends[:-1])], pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made], names=[*names, ids, *more])

    schema = df.drop(text).schema.add(ids, ArrayType(IntegerType()))
    return df.mapInArrow(run, schema.add(decoded, "string") if decoded else schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with its ids column replaced by a ``text`` column.  No shuffle."""
    names = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(model)
        for b in batches:
            sizes = [4 * n for n in pc.fill_null(pc.list_value_length(b.column(ids)), 0).to_pylist()]
            for start, end in slices(sizes, SLICE_BYTES):
                part = b.slice(start, end - start)
                texts = [bpe.decode(np.array(x or [], np.int32)) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, text])

    return df.mapInArrow(run, df.drop(ids).schema.add(text, "string"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text, encoded and decoded again."""
    both = encode(docs.select("doc_id", "text"), model, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_piece_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
