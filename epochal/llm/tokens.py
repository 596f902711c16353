"""Byte-level BPE ids and counts that equal those of the ``tokenizers`` library for the same file.

``tokenizers`` decides. Texts made only of ASCII and Latin letters, digits, signs and plain white space are encoded by
``tiktoken`` over the same merges, which is several times faster and gives the same ids; any other text (other scripts,
control characters, unusual spaces, special strings) goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Fixed by the byte-level BPE format: how a text falls into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same rule for plain texts in the syntax of ``re``.
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Letters, signs and white space about which all the libraries agree.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«¬®-±´¶-¸»¿-ɏ]*")


def _bytes_of_chars() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer file, opened in one process."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of Spark share the cores
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        alphabet = _bytes_of_chars()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if self.plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    @property
    def split_exactly(self) -> bool:
        """Whether the library's own pre-tokens of a text are all that its count depends on."""
        return self.exact.normalizer is None and self.exact.pre_tokenizer is not None

    def exact_pieces(self, text: str) -> list[str]:
        """The library's pre-tokens of a text without special strings, in its byte alphabet."""
        return [p for p, _ in self.exact.pre_tokenizer.pre_tokenize_str(text)]

    def exact_length(self, piece: str) -> int:
        return len(self.exact.model.tokenize(piece))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
