"""Sizes of texts in tokens of a public tokenizer (byte-level BPE given as a file of ranks)."""

from __future__ import annotations

import base64
import os
import sys

import numpy as np

#: Where the ranks are on every node, and the published pattern (a fixed value) that splits text before the merges.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """Encodes text; strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.lengths[k] = len(token)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token of the text ends."""
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])


def tokenizer(path: str = RANKS) -> Tokenizer:
    """The tokenizer of a file, loaded once in a process."""
    kept = sys.__dict__.setdefault("_corpusloom_tokenizers", {})
    if path not in kept:
        kept[path] = Tokenizer(path)
    return kept[path]
