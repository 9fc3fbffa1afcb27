"""Token ids of whole texts with a public tokenizer file.

The tokenizer drops white space and never joins across it, so a text has the
ids of its words one after the other. It also cuts words into runs of letters,
single digits and runs of anything else, and ignores case; for words of plain
ASCII that is done here, for many texts at once. So each different piece is
given to the library once, and the ids of a text are put together from those.
Words with other characters, apostrophes or ``<`` (which can begin a special
token) are given to it whole. Tests compare the ids of any texts with the
library's own.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quizlens.llm.codes import GRAMS, Sums, Words, byte_codes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
KEPT_UNITS = 200_000  # units remembered by a process; beyond that it starts afresh
PIECE_BYTES = 1 << 18  # text worked on at a time

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[[ord("'"), ord("<")]] = False
#: 1 letters, 2 digits, 3 the rest
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Units:
    """The pieces of all texts that are encoded on their own, one after the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        n = len(data)
        odd = np.concatenate([[0], np.cumsum(~_PLAIN[data])])
        self.whole_word = odd[words.ends] > odd[words.starts]
        mark = np.zeros(n + 1, np.int8)
        mark[words.starts[self.whole_word]] += 1
        mark[words.ends[self.whole_word]] -= 1
        whole = np.cumsum(mark, dtype=np.int8)[:-1] > 0
        kind = _KIND[data]
        first = np.zeros(n, bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first &= ~whole & _PLAIN[data]
        word_first = np.zeros(n, bool)
        word_first[words.starts] = True
        first |= word_first
        self.starts = np.flatnonzero(first)
        word = np.cumsum(word_first)[self.starts] - 1
        self.ends = word if not len(word) else np.minimum(
            np.append(self.starts[1:], n), words.ends[word])
        self.whole_word = self.whole_word[word]
        self.data = np.where(whole, data, _LOWER[data])
        self.bounds = np.searchsorted(self.starts, offsets)

    def codes(self) -> np.ndarray:
        return Sums(byte_codes(self.data), GRAMS).of(self.starts, self.ends)


class WordEncoder:
    """Ids of all texts of a piece."""

    def __init__(self, path: str = TOKENIZER):
        # Tasks run side by side already; more threads would only take memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)     # codes of units, sorted
        self.first = np.zeros(0, np.int64)      # where the ids of each begin
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, codes: np.ndarray, units: Units, places: np.ndarray) -> None:
        text = units.data.tobytes()
        spans = list(zip(units.starts[places].tolist(), units.ends[places].tolist()))
        found: list[list[int]] = [[]] * len(spans)
        whole = units.whole_word[places]
        for i in np.flatnonzero(~whole).tolist():
            a, b = spans[i]
            found[i] = [t.id for t in self.model.tokenize(text[a:b].decode())]
        at = np.flatnonzero(whole).tolist()
        for first in range(0, len(at), 5_000):
            some = at[first:first + 5_000]
            encoded = self.tokenizer.encode_batch_fast(
                [text[slice(*spans[i])].decode() for i in some], add_special_tokens=False)
            for i, e in zip(some, encoded):
                found[i] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(
            (i for ids in found for i in ids), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.known, codes)  # both are sorted
        self.known = np.insert(self.known, at, codes)
        self.first = np.insert(self.first, at, first)
        self.size = np.insert(self.size, at, size)

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of every unit among the known ones, and the bounds of each text in them."""
        units = Units(data, offsets)
        codes = units.codes()
        unique, place, inverse = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_UNITS:
            self.forget()
        at = np.searchsorted(self.known, unique)
        at[at == len(self.known)] = 0
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            self.learn(unique[new], units, place[new])
            at = np.searchsorted(self.known, unique)
        return at[inverse], units.bounds

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at, bounds = self.places(data, offsets)
        total = np.concatenate([[0], np.cumsum(self.size[at])])
        return np.diff(total[bounds])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text in them."""
        at, bounds = self.places(data, offsets)
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(total[-1]) + np.repeat(self.first[at] - total[:-1], size)
        return self.ids[source], total[bounds]


def encoder_of(path: str) -> WordEncoder:
    """This process's encoder of a tokenizer file, with the units that it has met.

    It is kept in a module of its own: tasks bring a copy of this package each.
    """
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]
