"""Token ids of whole texts with a public tokenizer, at the speed of looking up distinct units.

Both pre-tokenizers used here split a text where a run of white space begins, after a lone line
feed, and between a letter and one of ``. , ; : ! ?``. Text between two such places has the same
ids wherever it stands, so every distinct unit is encoded once per task and its ids are gathered
for all its occurrences; the memory of units goes with the task, the vocabulary stays with the worker. Texts with rarer white space, or with the content of a token that was added to the vocabulary
(``<|endoftext|>``, which the library takes out of a text before it splits it), are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidewell.llm.common import slices, utf8

#: Distinct units that a task remembers before it starts afresh: bounds its memory, changes no result.
REMEMBERED = 200_000
SLICE_BYTES = 1 << 20
#: White space outside ASCII, as UTF-8.
RARE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?")] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_symbols() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids of texts by the tokenizers library; remembers the ids of units as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        # texts that are encoded whole: all of them, if an added token is looked for after normalisation
        self.whole_only = self.lower and any(t.normalized for t in added)
        self.odd = re.compile(b"|".join([RARE_SPACE, *(re.escape(t.content.encode()) for t in added)]))
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """At a task's end: the worker also serves steps that need no tokens."""
        self.known.clear()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        if len(self.known) + len(units) > REMEMBERED:
            self.known.clear()
        symbols, rest = byte_symbols(), []
        for unit in units:
            word = unit.lstrip("\t\n\x0b\x0c\r ") if self.lower else unit
            if LETTERS.fullmatch(word if self.lower or word[:1] != " " else word[1:]):  # a single pre-token: straight to the model
                word = unicodedata.normalize("NFC", word).lower() if self.lower else word
                tokens = self.model.tokenize(word.encode().decode("latin-1").translate(symbols))
                self.known[unit] = array("I", [t.id for t in tokens]).tobytes()
            else:
                rest.append(unit)
        for unit, ids in zip(rest, self.whole(rest), strict=True):
            self.known[unit] = ids

    def _units(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where units begin in data; starts: where texts begin."""
        space = SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[starts] = True
        cut[1:-1] |= space[1:] & ~space[:-1]
        lone = (data[1:-1] == 10) & ~space[:-2] & ~space[2:]
        cut[2:-1] |= lone
        letter = ASCII_LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:-1] |= PUNCTUATION[data[1:]] & letter[:-1]
        cut[len(data)] = True
        return np.flatnonzero(cut)

    def encode(self, column) -> tuple:
        """Yields (lo, hi, ids, bounds) for row ranges: the ids of row i are ids[bounds[i - lo]:bounds[i - lo + 1]]."""
        data, off = utf8(column)
        for first, end in slices(off, SLICE_BYTES):
            for lo, hi, odd in self._runs(data, off, first, end):
                part, base = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                if not len(part):
                    yield lo, hi, np.zeros(0, np.uint32), np.zeros(hi - lo + 1, np.int64)
                elif odd:
                    raw = part.tobytes()
                    each = [np.frombuffer(x, np.uint32) for x in self.whole([raw[a:b].decode() for a, b in zip(base[:-1], base[1:], strict=True)])]
                    yield lo, hi, np.concatenate(each), np.cumsum([0, *map(len, each)])
                else:
                    yield lo, hi, *self._by_units(part, base)

    def _runs(self, data: np.ndarray, off: np.ndarray, first: int, end: int):
        """(lo, hi, odd): consecutive rows that are all encoded whole (odd) or all by units."""
        odd = np.full(end - first, self.whole_only)
        if not self.whole_only:
            found = [m.start() for m in self.odd.finditer(memoryview(data[off[first] : off[end]]))]
            odd[np.searchsorted(off[first : end + 1] - off[first], found, "right") - 1] = True
        cuts = np.flatnonzero(odd[1:] != odd[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), end - first], strict=True):
            yield first + a, first + b, bool(odd[a])

    def _by_units(self, part: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = self._units(part, base)
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(part)).dictionary_encode()
        distinct, which = units.dictionary.to_numpy(zero_copy_only=False), units.indices.to_numpy()
        found = list(map(self.known.get, distinct))
        if missing := [i for i, x in enumerate(found) if x is None]:
            self._learn([distinct[i] for i in missing])
            for i in missing:
                found[i] = self.known[distinct[i]]
        n = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        pool, first = np.frombuffer(b"".join(found), np.uint32), np.concatenate(([0], np.cumsum(n)[:-1]))
        each = n[which]
        ends = np.cumsum(each)
        ids = pool[np.repeat(first[which] - ends + each, each) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(cuts, base)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
