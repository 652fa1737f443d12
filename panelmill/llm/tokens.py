"""Where the production tokenizer's file is."""

from __future__ import annotations

#: Name of the file among the public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
