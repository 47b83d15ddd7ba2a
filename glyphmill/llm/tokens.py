"""Token ids of the public byte-level BPE vocabularies.

The ids are those of ``Tokenizer.from_file(<name>.json).encode(text,
add_special_tokens=False)``. The same vocabulary as ranks, in a faster encoder,
makes them for ordinary texts; texts with the literal special token or with very
long runs without white space go to the tokenizer itself. Tests hold both
against each other.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

SPECIAL = "<|endoftext|>"
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


@lru_cache(maxsize=2)
def _exact(path: str) -> Tokenizer:
    """The tokenizer itself; few workers ever need it, so it is read on demand."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(f"{os.path.splitext(path)[0]}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a vocabulary that is named, not given as a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class TokenIds:
    """Callable text -> array of ids for a vocabulary's name or path."""

    def __init__(self, vocabulary: str):
        self.path = vocabulary_path(vocabulary)
        self.fast = _fast(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text or _LONG_RUN.search(text):
            return np.array(_exact(self.path).encode(text, add_special_tokens=False).ids, "u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())
