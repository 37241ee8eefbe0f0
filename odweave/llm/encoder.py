"""Token ids of whole texts, exactly as the tokenizers library gives them.

The library cuts a text into pieces and merges each piece on its own, so equal pieces have equal ids. Each different piece
is merged by the library's model once and then remembered in a bounded memo. Texts are cut into chunks at spaces here, if the
tokenizer's own settings are ones for which this is safe. Chunks of plain characters are cut by the patterns below, other
chunks (other scripts, typographic marks, control characters) and all texts under other settings by the library's own
normalizer and pre-tokenizer. Only texts that hold one of the tokenizer's added strings go whole through the library's
``encode``. All ways give the same ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path
from struct import Struct, pack

from tokenizers import Tokenizer

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*")
# How the two public vocabularies cut a text into pieces, on the plain characters above, and the settings in their
# files (normalizer, pre-tokenizer) that say so.
_BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_BYTE_SETTINGS = None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_SETTINGS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: Marks that often end a chunk: each is a piece of its own after a word.
_ENDING = frozenset(".,;:!?)")
#: Longer pieces are merged each time and not remembered, so that a memo's size in bytes is bounded as well.
REMEMBERED = 256


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write bytes that do not print as the letters from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def as_letters(piece: str) -> str:
    """A piece in the spelling of a byte-level vocabulary."""
    return piece.encode().decode("latin-1").translate(BYTE_LETTERS)


class Memo(dict):
    """A bounded memo of ``compute`` for strings. When it is full, its entries become the old half, and those still in use return."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(key) > REMEMBERED:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Uneven(Exception):
    """A chunk next to further white space: the text must be cut as a whole."""


class Encoder:
    """``encode(text)`` gives what ``of_ids`` makes of the ids, joined over the text by ``join``."""

    def __init__(self, path: str, of_ids: Callable[[list[int]], object], join: Callable, memo: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normalizer, self.pre_tokenizer, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the memos below take its place
        self.added = self._added_strings()
        file = json.loads(Path(path).read_text())
        settings = file["normalizer"], file["pre_tokenizer"]
        self.words = settings == _WORD_SETTINGS  # lower-cased words without white space
        late = any(t.normalized for t in self.tokenizer.get_added_tokens_decoder().values())  # looked for in the normalized text
        self.in_chunks = not late and (self.words or settings == _BYTE_SETTINGS)
        self.before = "" if self.words else as_letters(" ")
        self.of_ids, self.join = of_ids, join
        self.pieces = Memo(self._piece, memo // 4)
        self.chunks = Memo(self._chunk, memo)
        self.letters = Memo(self._merge, memo // 4)
        self.others = Memo(self._other_chunk, memo // 4)

    def _normal(self, text: str) -> str:
        return text if self.normalizer is None else self.normalizer.normalize_str(text)

    def _added_strings(self) -> re.Pattern | None:
        """What the library may look for before it cuts a text: the added tokens, as they are and normalized."""
        strings = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        strings |= {self._normal(s) for s in strings}
        return re.compile("|".join(map(re.escape, sorted(strings - {""})))) if strings - {""} else None

    def _holds_added(self, text: str) -> bool:
        return self.added is not None and self.added.search(text) is not None

    def _merge(self, letters: str):
        return self.of_ids([t.id for t in self.model.tokenize(letters)])

    def _piece(self, piece: str):
        return self._merge(as_letters(piece))

    def _chunk(self, chunk: str):
        if chunk.isalpha():
            return self._merge(self.before + (chunk if chunk.isascii() else as_letters(chunk)))
        if self.words:
            return self.join(map(self.pieces.__getitem__, _WORD_PIECES.findall(chunk)))
        word, last = chunk[:-1], chunk[-1:]
        if last in _ENDING and word.isalpha():
            return self.join((self.chunks[word], self.pieces[last]))
        if not chunk or chunk[0].isspace() or last.isspace():
            raise _Uneven
        first, *more = _BYTE_PIECES.findall(f" {chunk}")
        if more and first[1:].isalpha():
            return self.join([self.chunks[first[1:]], *map(self.pieces.__getitem__, more)])
        return self.join(map(self.pieces.__getitem__, [first, *more]))

    def _cut(self, text: str):
        return self.join(map(self.pieces.__getitem__, _BYTE_PIECES.findall(text)))

    def _whole(self, text: str):
        return self.of_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _by_library(self, text: str):
        """The library cuts, the memo merges."""
        normal = self._normal(text)
        pieces = [(normal, None)] if self.pre_tokenizer is None else self.pre_tokenizer.pre_tokenize_str(normal)
        return self.join([self.letters[piece] for piece, _ in pieces])

    def _other_chunk(self, chunk: str):
        """A chunk of a text that has other than plain characters. It need not have some itself."""
        if self.words:
            return self.join(map(self.chunks.__getitem__, chunk.lower().split())) if _PLAIN.fullmatch(chunk) else self._by_library(chunk)
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Uneven
        return self.chunks[chunk] if _PLAIN.fullmatch(chunk) else self._by_library(f" {chunk}")

    def encode(self, text: str):
        if self._holds_added(text) or not self.in_chunks and self._holds_added(self._normal(text)):
            return self._whole(text)
        if not self.in_chunks:
            return self._by_library(text)
        plain = _PLAIN.fullmatch(text) is not None
        if self.words:
            chunks = map(self.chunks.__getitem__, text.lower().split()) if plain else map(self.others.__getitem__, text.split(" "))
            return self.join(chunks)
        cut, chunks = (self._cut, self.chunks) if plain else (self._by_library, self.others)
        first, _, rest = text.partition(" ")
        if not rest or not first or first[-1].isspace():
            return cut(text)
        try:
            return self.join([cut(first), *map(chunks.__getitem__, rest.split(" "))])
        except _Uneven:
            return cut(text)


_SHORT = [Struct(f"<{n}I").pack for n in range(32)]


def little_endian(ids: list[int]) -> bytes:
    return _SHORT[len(ids)](*ids) if len(ids) < len(_SHORT) else pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def id_encoder(path: str) -> Encoder:
    """Encodes to little-endian unsigned 32-bit ids; one per Python worker."""
    return Encoder(path, little_endian, b"".join, memo=600_000)
