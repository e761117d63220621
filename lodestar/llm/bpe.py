"""Byte-level BPE through the public libraries, fast on ordinary text and safe on any.

The ids are those that ``tokenizers`` gives for the vocabulary file. Ordinary texts go through the
rank table of the same vocabulary, which is built from that file; texts with added tokens or with
very long runs go to the library itself, whose time stays near-linear there. Texts may be cut into
pre-tokens here only if all their characters are ``SETTLED``: which code points are letters or numbers
depends on the Unicode version that a library was built with.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import regex

#: Runs of one kind beyond this length make rank merging slow: the library takes them.
LONG_RUN = 1000
#: The split of byte-level BPE: fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose kinds of characters are the same in all Unicode versions of these libraries.
SETTLED = r"\x00-ԯ‐-⁤₠-₿　-〿ぁ-ゖァ-ヺ一-龥가-힣！-～\U0001F300-\U0001F64F"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        self.added = [x["content"] for x in spec["added_tokens"]]
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.unsettled = regex.compile(f"[^{SETTLED}]").search

    def odd(self, text: str) -> bool:
        """Whether the text has an added token or a run too long for merging by rank."""
        if any(x in text for x in self.added):
            return True
        return len(text) > LONG_RUN and (max(map(len, text.split()), default=0) > LONG_RUN or regex.search(r"\s{%d}" % LONG_RUN, text) is not None)

    def ids(self, text: str) -> np.ndarray:
        if self.odd(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text; None if it must be encoded as a whole, by :meth:`ids`."""
        if not text.isascii() and self.unsettled(text) or self.odd(text):
            return None
        return self.split(text)

    def piece(self, piece: str) -> int:
        """Number of ids of one pre-token."""
        return len(self.ranks._encode_single_piece(piece.encode()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
