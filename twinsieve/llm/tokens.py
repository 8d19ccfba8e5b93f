"""Token ids of whole texts with a tokenizer file of the tokenizers library.

The word tokenizers used here cut at white space and drop it, so a text's ids are those of its white-space separated
words in a row. Each worker keeps the ids of words it has met, and the library encodes only the others. This holds
for tokenizers whose pre-tokenizer never joins characters across white space; others are encoded text by text.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Entries that a worker's caches hold each; bounds its memory, and has no effect on results.
CACHE_ENTRIES = 360_000

_ENCODERS: dict[tuple[str, int], "Encoder"] = {}
#: Texts of these characters stay as they are under NFC, have one-to-one small letters, and white space is ASCII.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_alphabet() -> list[str]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


_BYTES = _byte_alphabet()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> "Encoder":
    """The worker's encoder for a file, made once."""
    key = (path, cache_entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, cache_entries)
    return _ENCODERS[key]


class Encoder:
    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cache_entries
        self.words, self.old_words = {}, {}
        self.pieces, self.old_pieces = {}, {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            bool(steps)
            and steps[0].get("type") == "Split"
            and steps[0].get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and steps[0].get("invert") is True
            and normal == ["NFC", "Replace", "Lowercase"]
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        )

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token of small letters, or of other plain characters."""
        found = self.old_pieces.get(piece)
        if found is None:
            name = piece if piece.isascii() else "".join([_BYTES[b] for b in piece.encode()])
            found = np.array([t.id for t in self.tokenizer.model.tokenize(name)], dtype="<u4").tobytes()
        if len(self.pieces) >= self.limit // 2:
            self.old_pieces, self.pieces = self.pieces, {}
        self.pieces[piece] = found
        return found

    def _word(self, word) -> bytes:
        """Ids of a word that the younger cache lacks: plain ones are strings in small letters, others bytes."""
        found = self.old_words.get(word)
        if found is None:
            if isinstance(word, str):
                get, make = self.pieces.get, self._piece
                found = b"".join([ids if (ids := get(p)) is not None else make(p) for p in _PIECES.findall(word)])
            else:
                found = self._whole(word.decode("utf-8"))
        if len(self.words) >= self.limit // 2:
            self.old_words, self.words = self.words, {}
        self.words[word] = found
        return found

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a text in UTF-8 as little-endian unsigned 32-bit integers; none for a null."""
        if not text:
            return b""
        whole = text.decode("utf-8")
        if not self.by_word or any(s in text for s in self.special):
            return self._whole(whole)
        words = whole.lower().split() if _PLAIN.fullmatch(whole) else text.split()
        get, make = self.words.get, self._word
        return b"".join([ids if (ids := get(w)) is not None else make(w) for w in words])
