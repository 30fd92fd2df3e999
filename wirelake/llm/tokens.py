"""Byte-level BPE ids, shared by the token operators.

The rank file holds the vocabulary of the ``.json`` file and its encoder gives
the same ids several times faster; a text that spells a special token is left
to the ``tokenizers`` library, which maps it to the special id.
"""

from __future__ import annotations

import base64
import os
from functools import cache

END_OF_TEXT = "<|endoftext|>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranks(path: str):
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str, path: str) -> list[int]:
    fast = _ranks(path)
    if fast is None or END_OF_TEXT in text:
        return _library(path).encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)
