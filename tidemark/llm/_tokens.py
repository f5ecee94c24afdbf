"""Whole-text encoding with the tokenizers library, through a bounded cache of words.

The library spends most of its time on words it has met before. Between two
characters that are not white space a single space always ends one pre-token
and starts the next, so a text cut there can be encoded part by part without
changing one id; each part's ids are then kept. Texts whose white space is
irregular go to the library in larger parts cut at the same safe places.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer, pre_tokenizers

END_ID = 2

#: Bytes of parts and ids kept per worker and kind of place, each part with what a dictionary adds, and the longest part kept.
CACHE_BYTES, CACHE_ENTRY, CACHE_CHARS = 224 << 20, 200, 32
#: Characters the library gets at a time.
PART_CHARS = 32_768

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


class _Irregular(Exception):
    pass


class _Parts(dict):
    """Part of a text -> its ids as unsigned 32-bit integers of this machine.

    When half the bytes are in use they become the older half, and the older half
    before them goes; parts that are met again move over, so common ones stay.
    """

    def __init__(self, owner: "CachedTokenizer", lead: str):
        self.owner, self.lead, self.prefix = owner, lead, owner.space if lead else ""
        self.bytes, self.older = 0, {}

    def _kept(self, part: str, ids: bytes) -> bytes:
        if len(part) <= CACHE_CHARS:
            self.bytes += CACHE_ENTRY + len(part) + len(ids)
            if 2 * self.bytes > CACHE_BYTES:
                self.older = dict(self)
                self.clear()
                self.bytes = CACHE_ENTRY + len(part) + len(ids)
            self[part] = ids
        return ids

    def __missing__(self, part: str) -> bytes:
        ids = self.older.pop(part, None)
        if ids is not None:
            return self._kept(part, ids)
        if part.isalpha():
            return self._kept(part, self.owner.word_ids(self.prefix, part))
        if not part or part[-1].isspace():
            raise _Irregular
        if part[-1] in ",." and (word := part[:-1]).isalpha():
            ids = self[word] + self.owner.marks[part[-1]]
            return self._kept(part, ids) if word in self else ids
        if "\n" in part:
            lines = part.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                rest = self.owner.first
                return self[lines[0]] + b"".join([self.owner.newline + rest[x] for x in lines[1:]])
        return self._kept(part, self.owner.library_ids(self.lead + part))


class CachedTokenizer:
    """``ids(text)`` equals the library's own encoding without special tokens, packed as bytes.

    Handles the two kinds of tokenizer file in use here: byte-level BPE that keeps
    white space, and lower-casing BPE with word ends that drops it.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.drops_space = self.library.normalizer is not None
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # the byte-level letter of each byte, found through the library: UTF-8 of these covers all bytes in use
        self.letter = {}
        for c in map(chr, [*range(32, 127), *range(0x80, 0x800, 31), *range(0xC0, 0x180)]):
            for byte, x in zip(c.encode(), letters(c)[0][0], strict=True):
                self.letter[byte] = x
        self.space = self.letter[32]
        self.newline = b"" if self.drops_space else self.library_ids("\n")
        self.marks = {c: self.library_ids(c) for c in ",."}
        self.first = _Parts(self, "")
        self.later = self.first if self.drops_space else _Parts(self, " ")
        self.first.prefix = ""

    def library_ids(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def word_ids(self, prefix: str, word: str) -> bytes:
        """Ids of one word of letters; the model itself is asked where nothing can change the word before it."""
        if word.isascii():
            units = word
        elif len(word) < 200 and max(word) < "\u0180":
            units = word.encode().decode("latin-1").translate(self.letter)
        else:
            return self.library_ids(" " + word if prefix else word)
        return array("I", [t.id for t in self.library.model.tokenize(prefix + units)]).tobytes()

    def whole(self, text: str) -> bytes:
        """The library's ids, asked for in parts that end before a safe space."""
        out, start = [], 0
        while len(text) - start > PART_CHARS:
            cut = _SAFE.search(text, start + PART_CHARS)
            if cut is None:
                break
            out.append(self.library_ids(text[start : cut.start()]))
            start = cut.start()
        out.append(self.library_ids(text[start:]))
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.drops_space:
            if "Σ" in text or "İ" in text:  # their lower case depends on the neighbours or has two characters
                return self.whole(text)
            text = text.lower()
        parts = text.split(" ")
        try:
            head = self.first[parts[0]]
            return head + b"".join(map(self.later.__getitem__, parts[1:]))
        except _Irregular:
            return self.whole(text)


_LOADED: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of a file, kept for the life of the worker."""
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]
