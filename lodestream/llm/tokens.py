"""Token ids of whole texts by a public tokenizer, with a memo of words.

The vocabulary used here splits at white space before anything else and looks at no neighbouring word, so a text's ids
are its words' ids in a row; tests hold this against encoding whole texts. Words are encoded by the tokenizers library
and remembered. ``Ids.check`` refuses vocabularies for which this does not hold.
"""

from __future__ import annotations

import json
import re

from .shared import Memo


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_vocabulary(path: str | None) -> str:
    """The vocabulary file as text (a few MB, whatever the input), to be sent to the executors."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


#: Words of printable ASCII and Latin-1 letters: NFC and lower-casing act on each of their characters alone.
_PLAIN = re.compile("[!-~À-ÿ]+").fullmatch
#: The vocabulary's split pattern (fixed value), for lower-cased words of that kind.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character: itself, or from U+0100 on if it has none."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Ids:
    """Texts to ids. One memo, of ``most`` words, is kept for each vocabulary in a Python worker."""

    _made: dict[tuple[int, int], Ids] = {}

    def __new__(cls, vocabulary: str, most: int = 200_000):
        return cls._made.get((hash(vocabulary), most)) or super().__new__(cls)

    def __init__(self, vocabulary: str, most: int = 200_000):
        if self._made.get((hash(vocabulary), most)) is self:
            return
        from tokenizers import Tokenizer

        self.check(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.parts = Memo(self._part, most=most // 2)
        self.memo = Memo(self._word, most=most)
        self._made[hash(vocabulary), most] = self

    @staticmethod
    def check(vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or first["behavior"] != "Removed" or "[^\\s\\p{L}\\p{N}]+" not in first["pattern"]["Regex"] or any(x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("this vocabulary doesn't split texts at white space as assumed here")

    def _part(self, part: bytes) -> bytes:
        text = part.decode()
        if not part.isascii():
            text = part.decode("latin-1").translate(self.letters)
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(text)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            return self.parts[word.lower()]
        if _PLAIN(text) and "<|" not in text:
            return b"".join([self.parts[x.encode()] for x in _SPLIT(text.lower())])
        return b"".join([x.to_bytes(4, "little") for x in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __call__(self, text: bytes | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a null text has none."""
        return b"".join(map(self.memo.__getitem__, text.split())) if text else b""
