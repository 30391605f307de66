"""Encoding with a public byte-level BPE vocabulary, shared by token counts and packing."""

from __future__ import annotations

import base64
import functools
import json
from pathlib import Path

import public_tokenizers
import tiktoken

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(4)
def encoder(path: str = BYTE_BPE) -> tiktoken.Encoding:
    """The encoder of a vocabulary file of the tokenizers library, or of a rank file.

    A byte-level BPE file of the tokenizers library lists merges in rank order; the ids of its pieces
    need not be ranks, so ids come from its vocabulary. Special tokens' strings are ordinary text.
    """
    if path.endswith(".tiktoken"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    else:
        model = json.loads(Path(path).read_text())["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        piece = lambda s: bytes(back[c] for c in s)
        ranks = {piece(t): i for t, i in model["vocab"].items() if all(c in back for c in t) and not (t.startswith("<|") and t.endswith("|>"))}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
