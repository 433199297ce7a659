"""Byte-level BPE encoding with a cache of words, for use inside tasks."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

SPECIAL = "<|endoftext|>"
#: White space other than the space and the line feed, however a library defines it.
OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Pieces(dict):
    """ids, as uint32 bytes, of what stands from one single space or line feed to the next.

    The vocabulary's pattern lets a space begin the next token and never ends
    a token between a word and a space, so such pieces encode independently.
    When it is full, the cache takes no more; what it lacks is encoded anew.
    """

    def __init__(self, encode, most: int) -> None:  # noqa: ANN001
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece if piece[:1] == "\n" else " " + piece)
        if len(self) < self.most and len(piece) <= 40:
            self[piece] = ids
        return ids


class Encoder:
    """ids of a ``tokenizers`` file, by its twin of ranks where a text has no special cases."""

    def __init__(self, path: str, cache: int = 100_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from public_tokenizers import PATTERN

        self.path, self._whole = path, None
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pieces = _Pieces(self._plain, cache)
        #: bytes that each id stands for; a special token is its text
        self.width = np.full(max(ranks.values()) + 2, len(SPECIAL), np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def _plain(self, text: str) -> bytes:
        return np.array(self._ranks.encode_ordinary(text), np.uint32).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian uint32 bytes."""
        if not text:
            return b""
        if SPECIAL in text or OTHER_SPACE.search(text):
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self.path)
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return self._plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self._plain(first) if first else b"") + b"".join(map(self._pieces.__getitem__, rest))


@lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder of a tokenizer file, by default byte_bpe_50k.json of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path)
