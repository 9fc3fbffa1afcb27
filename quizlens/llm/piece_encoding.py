"""SentencePiece ids of whole texts by a table of last tokens, and back.

Merging by score has a property that makes a table do: the tokens of a prefix
are the first tokens of the text, and a row of tokens is the encoding of its
text if and only if every two neighbours are the encoding of theirs. So each
prefix has one last token: of the tokens that an automaton finds ending there,
the one that goes with the last token of the prefix before it. The ids follow
from the end of the table backwards.

Two characters that no piece holds next to each other are never in one token. A
text is cut there into units, and each process keeps the ids of the units it has
met. A unit of any length, such as a long text without such a cut, goes through
the same table, whose size is the unit's length.

Supported are BPE models without normalization, as described in their file;
others raise an error when they are loaded. Null and empty texts have just the
end id and decode to an empty text. Repeated rows are encoded each time. Extra
columns are ignored. Without documents the results are empty.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

MODEL = public_tokenizers.path("piece_bpe_32k.model")
KEPT_UNITS = 800_000   # remembered by a process
KEPT_PAIRS = 400_000
LONG_UNIT = 64         # longer units are not remembered
SPACE = "▁"       # fixed value: stands for a blank in pieces
#: Texts whose ids tell apart models with another normalization.
_PROBES = ("  A ﬁ x\t\nÅ  12 ", "▁a▁ ½Ω", " ", "　Ａ\u0000b")


class PieceEncoder:
    """Encodes by the table, decodes by the library."""

    def __init__(self, path: str = MODEL):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        ids = [i for i in range(lib.get_piece_size())
               if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any(lib.is_unused(i) for i in ids):
            raise ValueError(f"{path}: unused pieces are not supported")
        self.end = lib.eos_id()
        self.id_of = {lib.id_to_piece(i): i for i in ids}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in ids}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        # Characters that pieces hold beside others have a number; which of them are
        # neighbours in a piece is a table over these numbers.
        pairs = {pair for piece in self.id_of for pair in zip(piece, piece[1:])}
        letters = sorted({letter for pair in pairs for letter in pair})
        self.number = np.zeros(sys.maxunicode + 1, np.uint16)
        self.number[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        self.inner = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        left, right = (self.number[[ord(x) for x in side]] for side in zip(*pairs))
        self.inner[left, right] = True
        self.units: dict[str, tuple[list[int], str]] = {}
        self.older: dict[str, tuple[list[int], str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.take_apart()
        for text in _PROBES:
            if self.encode(text)[0] != lib.encode(text, add_eos=True):
                raise ValueError(f"{path}: a model that is not supported")

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None, bool]:
        """Tokens of a short text by its merges: the best score first, then the leftmost.

        Also the two parts of the last merge, and whether scores only fell.
        """
        parts, last, score, falling = list(text), None, np.inf, True
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            at = scores.index(best)
            last = parts[at], parts[at + 1]
            falling, score = falling and best <= score, best
            parts[at:at + 2] = ["".join(last)]
        return parts, last, falling

    def take_apart(self) -> None:
        """Which pieces are tokens at all, how each one comes about, and when.

        Pieces that share a score, or whose merges are not in falling order, are
        odd: their pairs are tested by merging them.
        """
        sharing = Counter(self.score.values())
        self.halves: dict[str, tuple[str, str]] = {}
        self.made: dict[str, float] = {}  # single characters are there from the start
        self.odd: set[str] = set()
        for piece, score in self.score.items():
            parts, last, falling = self.merges(piece)
            if parts == [piece]:
                if last:
                    self.halves[piece], self.made[piece] = last, score
                    if sharing[score] > 1 or not falling:
                        self.odd.add(piece)

    def compatible(self, left: str, right: str) -> bool:
        """Whether both stay as they are next to each other; ``left`` may be empty.

        The merges of both are undone, the latest one first. Neighbours that face
        each other meanwhile must not be a piece whose merge would have come before
        the next merge of either; of equal merges the left one comes first.
        """
        if not left:
            return len(right) == 1 or right in self.halves
        if left in self.odd or right in self.odd:
            return self.merges(left + right)[0] == [left, right]
        if not (len(right) == 1 or right in self.halves):
            return False
        left_until = right_until = -np.inf
        while True:
            score = self.score.get(left + right)
            if score is not None and score > left_until and score >= right_until:
                return False
            left_made, right_made = self.made.get(left, np.inf), self.made.get(right, np.inf)
            if left_made < right_made:
                left_until, left = left_made, self.halves[left][1]
            elif right_made < np.inf:
                right_until, right = right_made, self.halves[right][0]
            else:
                return True

    def tokens(self, unit: str) -> list[str]:
        """The tokens of a unit, from its table of last tokens."""
        last: list[str | None] = ["", *[None] * len(unit)]
        pairs = self.pairs
        for end, token in self.automaton.iter(unit):
            if last[end + 1] is None:
                start = end + 1 - len(token)
                before = last[start]
                if before is None:  # no piece ends there: a character that is none
                    before = last[start] = unit[start - 1]
                fits = pairs.get((before, token))
                if fits is None:
                    if len(pairs) > KEPT_PAIRS:
                        pairs.clear()
                    fits = pairs[before, token] = self.compatible(before, token)
                if fits:
                    last[end + 1] = token
        found, end = [], len(unit)
        while end:
            found.append(last[end] or unit[end - 1])
            end -= len(found[-1])
        return found[::-1]

    def unit(self, unit: str) -> tuple[list[int], str]:
        """The ids of a unit, and the same as text.

        Of the units that were met, those used since the last half was dropped stay.
        """
        entry = self.older.get(unit)
        if entry is None:
            ids = []
            for token in self.tokens(unit):
                known = self.id_of.get(token)
                ids += [known] if known is not None else [
                    self.byte_ids[b] for b in token.encode()]
            entry = ids, " ".join(map(str, ids))
        if len(unit) <= LONG_UNIT:
            if len(self.units) >= KEPT_UNITS // 2:
                self.older, self.units = self.units, {}
            self.units[unit] = entry
        return entry

    def cut(self, text: str) -> list[str]:
        """The units of a text: it is cut where no piece has both neighbours side by side."""
        codes = self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ends = (np.flatnonzero(~self.inner[codes[:-1], codes[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)])]

    def encode(self, text: str) -> tuple[list[int], str]:
        """All ids of a text with the end id, and the same as text."""
        if not text:
            return [self.end], str(self.end)
        ids, digits = [], []
        for unit in self.cut(SPACE + text.replace(" ", SPACE)):
            entry = self.units.get(unit) or self.unit(unit)
            ids += entry[0]
            digits.append(entry[1])
        ids.append(self.end)
        digits.append(str(self.end))
        return ids, " ".join(digits)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encoder_of(path: str) -> PieceEncoder:
    """This process's encoder of a model file.

    It is kept in a module of its own: tasks bring a copy of this package each.
    """
    kept = sys.modules.setdefault("_kept_pieces", types.ModuleType("_kept_pieces")).__dict__
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def rows_in(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[pa.DataType],
            row, size: int = 500) -> Iterator[pa.RecordBatch]:
    """``row`` of (doc_id, value) for every row, in batches that stay small."""
    for batch in batches:
        for first in range(0, len(batch), size):
            some = batch.slice(first, size)
            rows = [row(doc_id.as_py(), value.as_py())
                    for doc_id, value in zip(some.column(0), some.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids of every row, the end id last."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        yield from rows_in(batches, ["doc_id", "ids"], [pa.int64(), pa.list_(pa.int32())],
                           lambda doc_id, text: (doc_id, encoder.encode(text)[0]))

    return texts_of(docs).mapInArrow(emit, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ``encode``; null ids are none."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        yield from rows_in(batches, ["doc_id", "text"], [pa.int64(), pa.string()],
                           lambda doc_id, ids: (doc_id, encoder.decode(ids or [])))

    return encoded.select("doc_id", "ids").mapInArrow(emit, "doc_id long, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row the number of ids, and hashes of the ids and of the text decoded from them.

    Encoded, decoded and hashed in one task: ids, four bytes each, are not moved.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)

        def digest(doc_id: int | None, text: str) -> tuple:
            ids, digits = encoder.encode(text)
            return (doc_id, len(ids), hashlib.sha256(digits.encode()).hexdigest(),
                    hashlib.sha256(encoder.decode(ids).encode()).hexdigest())

        yield from rows_in(batches, names, [pa.int64(), pa.int64(), pa.string(), pa.string()],
                           digest)

    return texts_of(docs).mapInArrow(
        emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
