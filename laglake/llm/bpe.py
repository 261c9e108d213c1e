"""Byte-level BPE ids of whole texts.

The ranks come from the tokenizer's file and are run by ``tiktoken``, whose ids for ordinary text equal those of the
``tokenizers`` library with the same vocabulary at several times its speed (a test compares the two). Texts
that hold one of the file's special tokens go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from array import array


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies use for bytes: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = path

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            from tokenizers import Tokenizer
            return array("I", Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids).tobytes()
        return self.ranked.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One instance per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]
