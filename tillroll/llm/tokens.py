"""Byte-level BPE tokenizers of the public vocabulary files, loaded once per Python worker.

``byte_bpe_50k.json`` and its rank file hold one vocabulary; both libraries split and merge alike
(checked over every code point in the tests), and the rank file's library is several times faster.
The JSON library reads its added special token inside a text as that token, and so does ``encoder``.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import tiktoken

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


@lru_cache(maxsize=None)
def ranks(name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=None)
def encoder(name: str = "byte_bpe_50k.tiktoken") -> tiktoken.Encoding:
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name),
                             special_tokens={SPECIAL: SPECIAL_ID})
