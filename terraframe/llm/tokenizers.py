"""The public byte-level BPE vocabulary, for use inside tasks."""

from __future__ import annotations

import base64
import re

import numpy as np

CHUNK = 1 << 20
# Fixed values of the vocabulary: its special tokens.
SPECIAL = {"<|endoftext|>": 50256}
#: A single space between two other characters always begins a pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in pieces of some ``size`` characters, cut only where a pre-token begins."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size)
        to = m.start() if m else len(text)
        out.append(text[at:to])
        at = to
    return out


class ByteBpe:
    """Token ids of the 50k byte-level vocabulary.

    The rank file holds the same vocabulary as the tokenizer's JSON file and
    gives the same ids several times faster; a test holds them against each other.
    ``special``: a special token in a text is its own id, as that file has it; else it is ordinary text.
    """

    def __init__(self, path: str | None = None, special: bool = True):
        import public_tokenizers
        import tiktoken

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = public_tokenizers.PATTERN
        self.special = frozenset(SPECIAL if special else ())
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=SPECIAL if special else {})

    def ids(self, text: bytes | str) -> list[int]:
        text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
        if any(s in text for s in self.special):
            return self.encoding.encode(text, allowed_special=self.special, disallowed_special=())
        return self.encoding.encode_ordinary(text)

    def array(self, text: bytes | str) -> np.ndarray:
        """The ids as unsigned 32-bit numbers; a long text is encoded a piece at a time."""
        text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
        return np.concatenate([np.array(self.ids(t), "<u4") for t in chunks(text)])
