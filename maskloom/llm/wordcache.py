"""A library tokenizer that asks the library once per distinct run of non-space characters.

Every pre-tokenizer used here ends a token where white space follows other text, so a text's
ids are those of its pieces, one after another; pieces repeat, whole texts do not.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

# Texts in which every white space is one space or line feed between two other characters.
_IRREGULAR = f"[{WHITE_SPACE.replace(' ', '').replace(chr(10), '')}]|[ \n][ \n]|^[ \n]|[ \n]$"
_CLOSING = frozenset(".,;:!?|)")  # single marks that pre-tokenizers part from a word before them
_SPACED = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_WORDS = re.compile(f"[^{WHITE_SPACE}]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class CachedTokenizer:
    """Ids of texts as little-endian uint32 bytes. ``spaces``: white space is part of the vocabulary.

    A new piece goes through the library's normalizer, pre-tokenizer and model; a plain word skips
    the first two, which would leave it whole. Known pieces live in two generations, so that
    frequent ones outlast a full cache.

    ``added``: the strings of added tokens in a text get those tokens' ids, as the library does unless
    its ``encode_special_tokens`` is set; texts that could hold one are given to it whole.
    """

    ENTRIES = 350_000
    LONGEST = 200

    def __init__(self, definition: str, spaces: bool, added: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(definition)
        self.spaces, self.library = spaces, library
        starts = {re.escape(t.content.lower()[:2]) for t in library.get_added_tokens_decoder().values()} if added else set()
        self.marks = "(?i)" + "|".join(sorted(starts)) if starts else None
        self.model, self.normalizer, self.pre_tokenizer = library.model, library.normalizer, library.pre_tokenizer
        self.find = (_SPACED if spaces else _WORDS).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def encode(self, texts) -> list[bytes]:
        """Ids of every text (null: none).

        Texts with regular white space are split and their words numbered by Arrow kernels, so
        that Python looks at each distinct word of a group once; others go piece by piece.
        """
        texts = (texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).fill_null("")
        out: list[bytes] = [b""] * len(texts)
        marked = pc.match_substring_regex(texts, self.marks).to_numpy(zero_copy_only=False) if self.marks else np.zeros(len(texts), bool)
        plain = ~marked & pc.invert(pc.match_substring_regex(texts, _IRREGULAR)).to_numpy(zero_copy_only=False)
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
        regular = np.flatnonzero(plain & (sizes > 0))
        group = np.cumsum(sizes[regular]) >> 22
        for g in np.unique(group):
            mine = regular[group == g]
            for at, ids in zip(mine.tolist(), self._encode_regular(texts.take(pa.array(mine)))):
                out[at] = ids
        for at in np.flatnonzero(marked).tolist():
            out[at] = array("I", self.library.encode(texts[at].as_py(), add_special_tokens=False).ids).tobytes()
        for at in np.flatnonzero(~plain & ~marked).tolist():
            known = self.known
            out[at] = b"".join([known[p] if p in known else self._learn(p) for p in self.find(texts[at].as_py())])
        self._turn()
        _give_back()
        return out

    def _turn(self) -> None:
        if len(self.known) > self.ENTRIES:
            self.known, self.older = {}, self.known

    def _encode_regular(self, texts: pa.Array) -> list[bytes]:
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_of_text = lines.offsets.to_numpy()
        word_of_line = words.offsets.to_numpy()
        numbered = words.flatten().dictionary_encode()
        code = numbered.indices.to_numpy().astype(np.int64)
        word_of_text = word_of_line[line_of_text]
        if self.spaces:  # how a word begins: 0 nothing before it, 1 a space, 2 a line feed
            lead = np.ones(len(code), np.int64)
            lead[word_of_line[:-1]] = 2
            lead[word_of_text[:-1]] = 0
            kinds, code = np.unique(code * 3 + lead, return_inverse=True)
            strings = numbered.dictionary.take(pa.array(kinds // 3)).to_pylist()
            pieces = [("", " ", "\n")[k] + s for k, s in zip((kinds % 3).tolist(), strings)]
        else:
            pieces = numbered.dictionary.to_pylist()
        known = self.known
        each = [known[p] if p in known else self._learn(p) for p in pieces]
        flat = np.frombuffer(b"".join(each), "<u4")
        n = np.array([len(x) for x in each], np.int64) >> 2
        first = np.cumsum(n) - n
        n_word = n[code]
        ends = np.cumsum(n_word)
        total = int(ends[-1])
        place = np.arange(total, dtype=np.int64) + np.repeat(first[code] - (ends - n_word), n_word)
        ids = flat[place].tobytes()
        cut = np.concatenate([[0], ends])[word_of_text] * 4
        self._turn()
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _learn(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self._ask(piece)).tobytes()
        if len(piece) <= self.LONGEST:
            self.known[piece] = ids
        return ids

    def _ask(self, piece: str) -> list[int]:
        tokenize = self.model.tokenize
        return [t.id for p in self._parts(piece) for t in tokenize(p)]

    def _parts(self, piece: str) -> list[str]:
        space = self.spaces and piece[0] == " "
        word, mark = piece[1:] if space else piece, ""
        if word and word[-1] in _CLOSING:
            word, mark = word[:-1], word[-1]
        if word.isalpha():
            if self.spaces:
                letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
                head = self.letters[32] + letters if space else letters
            elif word.isascii():
                head = word.lower()
            else:
                head = "".join([c.lower() for c in word])
                head = "".join([self.letters[b] for b in head.encode()]) if head.isalpha() and unicodedata.is_normalized("NFC", word) else ""
            if head:
                return [head, mark] if mark else [head]
        if self.normalizer is not None:
            piece = self.normalizer.normalize_str(piece)
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(piece)]


def _give_back() -> None:
    """Return freed pages to the system; a worker otherwise keeps those of its largest batch."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)
_loaded: dict[bytes, CachedTokenizer] = {}


def cached_tokenizer(definition: str, spaces: bool) -> CachedTokenizer:
    """One tokenizer per Python worker, kept over tasks."""
    key = hashlib.md5(f"{spaces}{definition}".encode()).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = CachedTokenizer(definition, spaces)
    return _loaded[key]
