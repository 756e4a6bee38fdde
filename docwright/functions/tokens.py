"""Token counts by a subword vocabulary."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class BpeCounter:
    """Counts the tokens of a text by the tokenizer file at ``path``, without special tokens. Each Python worker loads it once."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        return len(_tokenizer(self.path).encode(text, add_special_tokens=False).ids)
