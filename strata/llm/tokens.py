"""Token ids of whole texts with a public byte-level vocabulary."""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np

# Fixed value: how the vocabulary's pre-tokeniser splits a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Control characters that libraries may or may not count as white space.
UNSURE = re.compile("[\x1c-\x1f\x85]")
PLAIN_BELOW = 0xC9  # no UTF-8 byte of a code point below U+0240 is higher or equal


class WholeText:
    """Ids as unsigned 16-bit numbers.

    ``path``: the tokenizer's file.  ``ranks``: the same vocabulary as tiktoken ranks, or none.  With them texts whose characters
    both libraries classify alike (code points below U+0240 without unsure control characters) are encoded by
    tiktoken, which gives the same ids faster; all others by the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None):
        self.path, self.fast = path, None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})

    @cached_property
    def model(self):
        """The tokenizer, which takes memory only where a text needs it."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True
        return model

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint16)
        if self.fast and (text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < PLAIN_BELOW) and not UNSURE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint16)


_MODELS: dict[str, WholeText] = {}  # a worker's, kept from task to task


def whole_text(path: str, ranks: str | None) -> WholeText:
    key = f"{path} {ranks}"
    if key not in _MODELS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _MODELS[key] = WholeText(path, ranks)
    return _MODELS[key]
