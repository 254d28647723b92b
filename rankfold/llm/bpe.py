"""Byte-level BPE vocabulary: loading, whole-text encoding, word splitting.

The vocabulary file is a parameter. Per worker process each file is loaded once.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import public_tokenizers


LONG_BLANKS = 10_000  # blanks in a row beyond which the fast encoder is not used


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(piece bytes -> id, special text -> id) of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    vocab = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return vocab, special


@lru_cache(maxsize=2)
def piece_list(path: str) -> list[bytes]:
    """Piece bytes by id (the id-to-piece table; one entry per vocabulary id)."""
    vocab, special = pieces(path)
    out = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for piece, i in vocab.items():
        out[i] = piece
    for text, i in special.items():
        out[i] = text.encode()
    return out


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """Encoder of whole texts with the file's ids (checked against the tokenizers library in the tests)."""
    import tiktoken

    vocab, special = pieces(path)
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens=special)


@lru_cache(maxsize=2)
def library_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def whole_text_encoder(path: str):
    """Function from a text to its ids. The fast encoder's pattern goes back over a run of blanks with one stack entry
    per blank and gives up on long runs, so texts with such a run are encoded by the library."""
    import re

    fast, blanks = fast_encoder(path), re.compile(rf"\s{{{LONG_BLANKS}}}")

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_BLANKS and blanks.search(text):
            return library_encoder(path).encode(text, add_special_tokens=False).ids  # loaded only where such a text is met
        return fast.encode(text, allowed_special="all")

    return encode


@lru_cache(maxsize=1)
def word_pattern():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def special_pattern(path: str):
    import re

    _, special = pieces(path)
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


def split_words(text: str, path: str) -> list[str]:
    """The words that BPE merges never cross, in order; special strings are words of their own."""
    cut, find = special_pattern(path), word_pattern().findall
    if cut is None or not cut.search(text):
        return find(text)
    out: list[str] = []
    for i, part in enumerate(cut.split(text)):
        out.extend([part] if i % 2 else find(part))
    return out
