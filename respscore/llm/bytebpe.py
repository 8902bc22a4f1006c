"""Byte-level BPE ids with the tokenizers library, each distinct word encoded once.

The vocabulary's pre-tokenizer never joins what stands before a single space
with what follows it: a space goes with the visible character behind it.  The
same holds for both sides of a single line break.  Texts are therefore cut
there, the library encodes each distinct word once, and ids are put together
from bounded caches.  Texts with other or repeated white space are cut only
before a single space between visible characters, which is as safe.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .process import kept
from .words import FIRST, Words, encode_words, gather

# White space other than space and line break, or two in a row: texts that hold any of it are cut with care.
_CARE = f"[ \n]{{2}}|[{FIRST}" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
AT_ONCE = 20_000  # new words encoded by one call: the library holds some 200 bytes an id meanwhile
CACHE_WORDS = 1_000_000  # words kept by a worker, some 50 bytes each


class ByteBpe:
    """Encoder; ``ordinary`` reads the strings of special tokens in a text as ordinary text."""

    def __init__(self, path: str, ordinary: bool = False, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.words = Words(self._make, most)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]  # an id of its own in this vocabulary

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _many(self, words: pa.Array, before: str, keep_lines: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each behind a line break and ``before``, some at once, and how many each has.  The line
        break is an id of its own there: it parts the words, and stays where it belongs to them."""
        some = []
        for k in range(0, len(words), AT_ONCE):
            text = "".join([f"\n{before}{w}" for w in words[k:k + AT_ONCE].to_pylist()])
            some.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate([np.zeros(0, np.uint32), *some])
        at = np.flatnonzero(ids == self.line)
        n = np.diff(at, append=len(ids))
        return (ids, n) if keep_lines else (np.delete(ids, at), n - 1)

    def _make(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        line, first = pc.starts_with(words, "\n"), pc.starts_with(words, FIRST)
        alone = pc.or_(pc.match_substring(words, "<|"), pc.or_(pc.equal(words, ""), pc.or_(pc.equal(words, "\n"), pc.equal(words, FIRST))))
        parts = []
        for mask, cut, before in ((line, 1, ""), (first, 1, ""), (pc.invert(pc.or_(line, first)), 0, " ")):
            mask = pc.and_not(mask, alone)
            parts.append((mask, *self._many(pc.utf8_slice_codeunits(words.filter(mask), cut), before, not parts)))
        single = [self._alone(w) for w in words.filter(alone).to_pylist()]
        parts.append((alone, np.frombuffer(b"".join(single), np.uint32), np.array([len(x) // 4 for x in single], np.int64)))
        order = np.concatenate([np.flatnonzero(mask.to_numpy(zero_copy_only=False)) for mask, _, _ in parts])
        return gather(np.concatenate([ids for _, ids, _ in parts]), np.cumsum(np.concatenate([n for _, _, n in parts])), np.argsort(order))

    def _alone(self, word: str) -> bytes:
        """Ids of an empty word, or one with the beginning of a special token's string."""
        if word[:1] == "\n":
            return self._ids("\n") + self._ids(word[1:])
        return self._ids(word[1:] if word[:1] == FIRST else " " + word)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._ids, _BEFORE_SPACE.split(text)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, uint32, and how many each has), as the library's encode without added tokens."""
        return encode_words(texts, _CARE, self._whole, self.words)


def encoder(path: str, ordinary: bool = False) -> ByteBpe:
    return kept(("bytebpe", path, ordinary), lambda: ByteBpe(path, ordinary))
