"""Token ids of whole texts through bounded caches of words and of their parts.

These vocabularies never join characters across ASCII white space, so a text's ids are those of its words in order.
Running text repeats most words, and new words are mostly known parts (a word, its capitals, the marks after it); only unseen parts reach
the tokenizer. So many parts are remembered, and only as many words as are frequent.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from weakref import WeakValueDictionary

from tideline.llm.common import tokenizer

#: Words that are remembered, and parts of words. Texts have about five times as many different words as parts.
WORDS, PARTS = 200_000, 300_000


class Cache(dict):
    """Values by key, made by `make` when first asked for; forgets all when it holds `limit` of them."""

    held: WeakValueDictionary[int, Cache] = WeakValueDictionary()

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.held[id(self)] = self

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def forget_all() -> None:
    """Empty every cache of this process. Python workers go from stage to stage, and what one has remembered is of no use in the next."""
    for cache in list(Cache.held.values()):
        cache.clear()


#: Printable ASCII and the letters of western Europe: composed already, and of known classes.
_PLAIN = re.compile(r"[\x21-\x7EÀ-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_names() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def id_cache(path: str) -> Cache:
    """UTF-8 words to their ids as unsigned 32-bit bytes, by the `tokenizers` library, no special tokens.

    Words of plain characters are split here as the vocabulary's rules split them and go straight to the library's merge
    model; all others go through its whole tokenizer. (Tests hold both against each other.) What other caches hold is forgotten first.
    """
    forget_all()
    whole = tokenizer(path)
    merge, names = whole.model.tokenize, _byte_names()

    def part(shown: str) -> bytes:
        if not _PLAIN.fullmatch(shown):
            return array("I", whole.encode(shown, add_special_tokens=False).ids).tobytes()
        text = shown if shown.isascii() else shown.encode().decode("latin-1").translate(names)
        return array("I", [x.id for x in merge(text)]).tobytes()

    parts = Cache(part, PARTS)

    def word(data: bytes) -> bytes:
        if data.isalpha():  # ASCII letters only
            return parts[data.decode().lower()]
        shown = data.decode()
        if _PLAIN.fullmatch(shown):
            return b"".join(map(parts.__getitem__, _PARTS.findall(shown.lower())))
        return parts[shown]

    return Cache(word, WORDS)


def pieces_of(text: str, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of about `size` bytes of text, so a very long one needs no more memory than that."""
    data, at = text.encode(), 0
    while at < len(data):
        end = at + size
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        yield data[at:end].split()
        at = end


def ids_of(text: str, cache: Cache) -> Iterator[bytes]:
    for words in pieces_of(text):
        yield b"".join(map(cache.__getitem__, words))
