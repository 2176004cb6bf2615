"""Token ids of whole texts by the ``tokenizers`` library, with each distinct word encoded once per worker.

A single space between two characters that aren't white space always begins a new pre-token in the
byte-level and word-end patterns this is used with, so the stretches between such spaces encode
independently of each other; so does a single line feed, which is a pre-token of its own, and so do
letters and the stops or commas that follow them. A text whose white space is all of that kind is cut there, its
stretches are looked up in a bounded table and the library encodes only those not met yet; every other
text is encoded by the library as a whole. Either way the ids are the library's ids for the whole text.
"""

from __future__ import annotations

import gc
import os
from array import array
from collections.abc import Iterable, Sequence
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct stretches in each of the two generations that a worker keeps (about 90 MB each). When the
#: younger is full it becomes the older one; what is met again moves to the younger.
CACHE_WORDS = 300_000
#: Texts encoded by one call to the library.
_CALL = 20_000

#: Byte-level models spell each byte as a letter: printable ones as themselves, the others by the letters from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class CachedEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        normalizer = self.tokenizer.normalizer
        self.normalizes = normalizer is not None
        self.lowers = self.normalizes and normalizer.normalize_str("A") == "a"
        self.ids = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1)]
        self.mark: str | None = None
        self.mark = self._find_mark()
        self.limit = cache_words
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.old_first: dict[str, bytes] = {}
        self.old_rest: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), _CALL):
            coded = self.tokenizer.encode_batch_fast(list(texts[i : i + _CALL]), add_special_tokens=False)
            out.extend([array("I", e.ids).tobytes() for e in coded])
        return out

    def _encode_letters(self, words: Sequence[str], lead: str) -> list[bytes]:
        """As ``_encode`` of words of letters only: one pre-token each, which the model takes as it is."""
        if self.mark is None:
            return self._encode([lead + w for w in words])
        out: list[bytes] = []
        tokenize, mark, ids = self.tokenizer.model.tokenize, self.mark if lead else "", self.ids
        for w in words:
            if w.isascii():
                spelt = w
            elif not self.normalizes or is_normalized("NFC", w):
                spelt = w.encode().decode("latin-1").translate(_BYTE_LETTERS)
            else:
                spelt = None
            if spelt is None or self.lowers and w != w.lower():
                out.extend(self._encode([lead + w]))
            else:
                out.append(b"".join([ids[t.id] for t in tokenize(mark + spelt)]))
        return out

    def _find_mark(self) -> str | None:
        """What stands for the space before a word in the model's alphabet; None if the model's input is of another kind."""
        sample = ["a", "word", "stra\u00dfe", "\u4e2d", "na\u00efve", "\u017ea\u0142o\u015b\u0107"]
        want = self._encode([" " + w for w in sample])
        for self.mark in (" ".translate(_BYTE_LETTERS), ""):
            if self._encode_letters(sample, " ") == want:
                return self.mark
        return None

    @staticmethod
    def _independent(piece: str) -> bool:
        bare = piece[1:] if piece[:1] == "\n" else piece
        return bool(bare) and not bare[0].isspace() and not bare[-1].isspace() and "<|" not in bare

    def _learn(self, table: dict[str, bytes], old: dict[str, bytes], new: Iterable[str], lead: str) -> None:
        """Add the stretches of ``new`` that may be cut out; ``lead`` stands before those without a line feed."""
        letters: set[str] = set()
        ended, broken, whole = [], [], []
        held = old.get
        for w in new:
            ids = held(w)
            if ids is not None:
                table[w] = ids
            elif w.isalpha():
                letters.add(w)
            else:
                stem = w.rstrip(".,")
                if stem.isalpha():
                    # Letters and the stops after them are different pre-tokens.
                    ended.append((w, stem))
                elif stem[:1] == "\n" and stem[1:].isalpha():
                    broken.append((w, stem))
                elif self._independent(w):
                    whole.append(w)
        letters.update([stem for _, stem in ended])
        stems = list(letters.difference(table))
        table.update(zip(stems, self._encode_letters(stems, lead), strict=True))
        table.update(zip(whole, self._encode([w if w[0] == "\n" else lead + w for w in whole]), strict=True))
        firsts = list({stem[1:] for _, stem in broken}.difference(self.first))
        self.first.update(zip(firsts, self._encode_letters(firsts, ""), strict=True))
        stops = list({w[len(stem) :] for w, stem in (*ended, *broken)}.union(("\n",)).difference(self.stops))
        self.stops.update(zip(stops, self._encode(stops), strict=True))
        for w, stem in ended:
            table[w] = table[stem] + self.stops[w[len(stem) :]]
        for w, stem in broken:
            table[w] = self.stops["\n"] + self.first[stem[1:]] + self.stops[w[len(stem) :]]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # strings and bytes in a large table make no cycles
        try:
            return self._encode_texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_texts(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.rest) + len(self.first) > self.limit:
            self.old_first, self.old_rest, self.first, self.rest = self.first, self.rest, {}, {}
            self.stops = {}
        if self.lowers:  # the library lowers each letter alone; only a final sigma is different for a whole word
            texts = [t if "\u03a3" in t else t.lower() for t in texts]
        if not texts:
            return []
        self.first[""] = b""  # of a text that begins with a space, which is the next word's
        spaced = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n")
        words = pc.split_pattern(spaced, " ")
        starts, flat = words.offsets.to_numpy()[:-1], words.values
        heads = flat.take(pa.array(starts)).to_numpy(zero_copy_only=False).tolist()
        coded = flat.dictionary_encode()
        place, known = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(self.first, self.old_first, set(heads) - self.first.keys(), "")
        self._learn(self.rest, self.old_rest, [w for w in known if w not in self.rest], " ")
        # The ids of each distinct stretch lie once in one array, and the texts are gathered from it.
        each = list(map(self.rest.get, known))
        absent = np.zeros(len(each), dtype=bool)
        if None in each:
            absent[[i for i, x in enumerate(each) if x is None]] = True
            each = [x or b"" for x in each]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) >> 2
        pool = np.frombuffer(b"".join(each), dtype="<u4")
        count, gone = sizes[place], absent[place]
        count[starts], gone[starts] = 0, False
        lost = np.logical_or.reduceat(gone, starts)
        at = np.cumsum(sizes) - sizes
        ends = np.cumsum(count)
        ids = pool[np.repeat(at[place] - (ends - count), count) + np.arange(ends[-1])]
        bounds = np.append((ends - count)[starts], ends[-1]).tolist()
        out: list[bytes | None] = []
        whole: list[int] = []
        for i, head in enumerate(map(self.first.get, heads)):
            if head is None or lost[i]:
                out.append(None)
                whole.append(i)
            else:
                out.append(head + ids[bounds[i] : bounds[i + 1]].tobytes())
        for i, coded_text in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = coded_text
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder_for(path: str, cache_words: int = CACHE_WORDS) -> CachedEncoder:
    """This worker's encoder of a file, with the words that earlier tasks have met."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = CachedEncoder(path)
    _ENCODERS[path].limit = cache_words
    return _ENCODERS[path]
