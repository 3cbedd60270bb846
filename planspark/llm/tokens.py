"""Exact token ids of whole texts by a public tokenizer file, with a memo of pre-tokens.

``word_bpe_49k.json`` cuts text into pre-tokens (runs of letters, single digits, runs of other marks)
before it merges, and merges never cross them, so the ids of a text are the joined ids of its
pre-tokens. Three ways, chosen text by text, give the same ids:

* Latin-1 texts: many at once, cut and looked up as arrays; pre-tokens are told apart by a 64-bit key,
* texts with apostrophe endings or characters up to U+012F: the file's pattern and a memo of strings,
* texts where lower-casing or composing could move a cut, or with a special token's spelling: whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: Pre-tokens kept a worker (about 150 bytes each); the memo starts anew beyond it.
MEMO = 800_000
#: Characters handled at once as arrays.
CHUNK = 400_000

#: Outside this set lower-casing, composition or white space may change the cut; such texts go whole.
_UNUSUAL = re.compile("[^\x20-\x7e\n\r\t\xa1-į]|<\\|")
_BEYOND_ARRAYS = re.compile("[^\x20-\x7e\n\r\t\xa1-\xff]|<\\||'[sStTrRvVmMlLdD]")
#: The file's own pattern over lower-cased characters that pass the first test.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-į]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-į]+")

_LOWER = np.array([ord(chr(i).lower()) if ord(chr(i).lower()) < 256 else i for i in range(256)], np.uint8)
_KIND = np.array([0 if chr(i) in " \n\r\t" else 1 if chr(i).isalpha() else 2 if chr(i).isnumeric() else 3 for i in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(2 * CHUNK + 4, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_SLOTS = 1 << 21
#: Byte-level vocabularies spell bytes that do not print as the characters from U+0100 on.
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class _Memo(dict):
    """Lower-cased pre-token -> ids as bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO // 4:
            self.clear()
        out = self[word] = self.encode(word).tobytes()
        return out


class Encoder:
    """Ids as little-endian bytes of ``dtype`` (two bytes an id where the vocabulary allows)."""

    def __init__(self, name: str = WORD_BPE):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = os.path.basename(name) == WORD_BPE
        self.memo = _Memo(self._word)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.n, self.at, self.size = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used = np.zeros(1 << 14, self.dtype), 0

    def _word(self, word: str) -> np.ndarray:
        return np.array([t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LEVEL))], self.dtype)

    def ids(self, text: str | None) -> bytes:
        """The ids of one text; null is the empty text."""
        text = text or ""
        if self.by_word and not _UNUSUAL.search(text):
            return b"".join(map(self.memo.__getitem__, _PIECES.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        held: list[bytes | None] = []
        chunk: list[tuple[int, bytes]] = []
        chars = 0
        for text in texts:
            if text and self.by_word and len(text) <= CHUNK and not _BEYOND_ARRAYS.search(text):
                chunk.append((len(held), text.encode("latin-1")))
                held.append(None)
                chars += len(text) + 1
            else:
                held.append(self.ids(text))
            if chars > CHUNK:
                self._fill(chunk, held)
                yield from held
                held, chunk, chars = [], [], 0
        self._fill(chunk, held)
        yield from held

    def _fill(self, chunk: list[tuple[int, bytes]], held: list) -> None:
        if not chunk:
            return
        low = _LOWER[np.frombuffer(b"\n" + b"\n".join(t for _, t in chunk) + b"\n", np.uint8)]
        kind = _KIND[low]
        first = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        first = np.append(first, len(low))
        real = kind[first[:-1]] != 0
        start, end = first[:-1][real], first[1:][real]
        total = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _POWER[: len(low)])])
        key = (total[end] - total[start]) * _INVERSE[start]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
        key[key == 0] = 1
        entry = self._entries(key, start, end, low)
        size = self.size[entry]
        stop = np.cumsum(size)
        where = np.repeat(self.at[entry] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        ids = self.pool[where]
        edge = np.cumsum([1 + len(t) for _, t in chunk])
        words = np.searchsorted(start, edge)
        cuts = np.concatenate([[0], np.concatenate([[0], stop])[words]])
        for (k, _), a, b in zip(chunk, cuts[:-1], cuts[1:], strict=True):
            held[k] = ids[a:b].tobytes()

    def _entries(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray) -> np.ndarray:
        if self.n > MEMO:
            self._forget()
        found = np.full(len(key), -1, np.int64)
        todo, slot = np.arange(len(key)), (key % _SLOTS).astype(np.int64)
        missing = []
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            found[todo[hit]] = self.entry[slot[hit]]
            missing.append(todo[there == 0])
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) % _SLOTS
        missing = np.concatenate(missing) if missing else np.zeros(0, np.int64)
        if len(missing):
            new, where, back = np.unique(key[missing], return_index=True, return_inverse=True)
            text = low.tobytes().decode("latin-1")
            words = [text[i:j] for i, j in zip(start[missing[where]].tolist(), end[missing[where]].tolist(), strict=True)]
            found[missing] = self._add(new, words)[back]
        return found

    def _add(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """Numbers of new entries."""
        model, ids, size = self.tokenizer.model.tokenize, [], []
        for word in words:
            got = [t.id for t in model(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LEVEL))]
            ids += got
            size.append(len(got))
        numbers = np.arange(self.n, self.n + len(words))
        while self.n + len(words) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.at))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[numbers] = size
        self.at[numbers] = self.used + np.cumsum(size) - size
        self.n, self.used = self.n + len(words), self.used + len(ids)
        todo, slot = np.arange(len(keys)), (keys % _SLOTS).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.entry[slot[put]] = keys[todo[put]], numbers[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) % _SLOTS
        return numbers


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = WORD_BPE) -> Encoder:
    """One encoder a Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
