"""Token ids of a byte-level BPE vocabulary, equal to those of its tokenizer file."""

from __future__ import annotations

import json
import re

import numpy as np


LONG_SPACE = 10_000  # white space in a row that the fast encoder, which recurses over it, is given
_SPACE = re.compile(r"\s+")


def read_vocabulary(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def _bytes_of_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def has_long_space(text: str) -> bool:
    """Whether there are `LONG_SPACE` characters of white space in a row."""
    if len(text) < LONG_SPACE or len(text) - sum(map(len, text.split())) < LONG_SPACE:
        return False
    return any(m.end() - m.start() >= LONG_SPACE for m in _SPACE.finditer(text))


class ByteBpe:
    """Encodes texts; ids come packed as integers of ``dtype``."""

    def __init__(self, vocabulary: bytes):
        import public_tokenizers
        import tiktoken

        given = json.loads(vocabulary)
        letters = _bytes_of_letters()
        self.special = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in p): i for p, i in given["model"]["vocab"].items() if p not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if max([*ranks.values(), *self.special.values()]) < 1 << 16 else "<u4")
        self.file, self.library = vocabulary, None
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ids(self, text: str) -> list[int]:
        """Strings of special tokens inside the text are those tokens."""
        if has_long_space(text):
            return self._library_ids(text)
        if self.cut is None or not any(s in text for s in self.special):
            return self.core.encode_ordinary(text)
        found: list[int] = []
        for i, part in enumerate(self.cut.split(text)):
            found += [self.special[part]] if i % 2 else self.core.encode_ordinary(part)
        return found

    def _library_ids(self, text: str) -> list[int]:
        """The same ids by the file's own library, slower but safe for any text."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file.decode())
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        return np.array(self.ids(text), self.dtype).tobytes()
