"""Encoding texts word by word: Arrow cuts them, finds the distinct words and those that are known;
Python sees new words alone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FIRST = "\0"  # marks a text's first word


def gather(ids: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words at some places one after another, ids of each) of words that end at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]])[:len(ends)]
    n = (ends - starts)[places]
    upto = np.cumsum(n)
    at = np.repeat((starts[places] - (upto - n)).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], n


class Words:
    """A table of words and their ids (32 bits).  ``make`` gives those of new words: ids one after another,
    and how many each has.

    Bounded: when new words would make more than ``most``, those that are not in use now are dropped."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int):
        self.make, self.most = make, most
        self.words, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, words: pa.Array) -> np.ndarray:
        """Places in the table of some distinct words."""
        at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return at.to_numpy()
        if len(self.words) + at.null_count > self.most:
            used = pc.drop_null(at).to_numpy()
            self.words = self.words.take(pa.array(used))
            self.ids, n = gather(self.ids, self.ends, used)
            self.ends = np.cumsum(n)
            at = pc.index_in(words, value_set=self.words)
        known, new = len(self.words), words.filter(at.is_null())
        ids, n = self.make(new)
        self.words = pa.concat_arrays([self.words, new])
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, ids])
        places = pc.fill_null(at, -1).to_numpy().copy()
        places[places < 0] = np.arange(known, known + len(new), dtype=places.dtype)
        return places


def encode_words(texts: pa.Array, care: str, whole: Callable[[str], bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, ids per text); a null text is empty.

    Texts are cut at single spaces and before line breaks.  ``words`` makes the ids of distinct words:
    one that begins with FIRST begins a text, one that begins with a line break stands right behind it,
    any other stands behind a space.  ``whole`` does the texts that match ``care``, a pattern that
    holds FIRST."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    hard = pc.match_substring_regex(texts, care)
    easy = pc.replace_substring(texts.filter(pc.invert(hard)), "\n", " \n")
    cut = pc.split_pattern(pc.binary_join_element_wise(FIRST, easy, ""), " ")
    bounds = cut.offsets.to_numpy()
    coded = cut.flatten().dictionary_encode()
    places = words(coded.dictionary)[coded.indices.to_numpy()]
    flat, n = gather(words.ids, words.ends, places)
    upto = np.concatenate([[0], np.cumsum(n)])[bounds - bounds[0]] if len(bounds) else np.zeros(1, np.int64)
    if not hard.true_count:
        return flat, np.diff(upto)
    parts, k = [], 0
    for text, is_hard in zip(texts, hard.to_pylist(), strict=True):
        if is_hard:
            parts.append(np.frombuffer(whole(text.as_py()), np.uint32))
        else:
            parts.append(flat[upto[k]:upto[k + 1]])
            k += 1
    return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
