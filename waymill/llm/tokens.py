"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd

#: Folder of the public vocabulary files and the vocabulary used unless another is named.
FOLDER = os.environ.get("WAYMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@functools.cache
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    path = vocabulary if os.path.isabs(vocabulary) else os.path.join(FOLDER, vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: pd.Series, vocabulary: str | None = None) -> list[int]:
    """Tokens of each text; 0 for null."""
    enc = encoding(vocabulary or VOCABULARY)
    return [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in texts]
