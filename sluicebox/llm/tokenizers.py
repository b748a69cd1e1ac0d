"""Byte-level BPE: ranks from a tiktoken file, merges, and the proof of whole tokens."""

from __future__ import annotations

import base64

import regex

#: The public pre-tokenisation pattern of the 50k byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one pre-token: the pair of the least rank is merged until none is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def whole_tokens(ranks: dict[bytes, int]) -> set[str]:
    """Vocabulary strings that are one pre-token and whose merges end in one token: the proof is the merge itself.

    A pre-token equal to one of them counts 1; bytes that aren't UTF-8, and strings that the
    pattern splits, aren't among them.
    """
    pattern = regex.compile(PATTERN)
    found = set()
    for token in ranks:
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(text) and len(merge(token, ranks)) == 1:
            found.add(text)
    return found


def encoding(ranks: dict[bytes, int]):  # noqa: ANN201
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
