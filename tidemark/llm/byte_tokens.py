"""Ids of the byte-level vocabulary, in Python workers.

The tokenizers file holds vocabulary and merges; its ids of merged tokens grow with
the merges' ranks, so the same file serves as the rank table of the faster tiktoken
encoder.  Ids are those of the tokenizers library (tests compare them); strings of
special tokens in a text become their ids, as there.  A text that the faster encoder
gives up on (runs of some million white space characters) goes to the tokenizers library.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

#: The pattern that cuts text for this vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, inverted."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """The encoder for a tokenizers file; made once in each worker."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    made = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> list[int]:
        try:
            return made.encode(text, allowed_special=allowed, disallowed_special=())
        except ValueError:
            return library(path).encode(text, add_special_tokens=False).ids

    return encode


@functools.cache
def library(path: str):
    """The tokenizers library's encoder without truncation and padding."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made
