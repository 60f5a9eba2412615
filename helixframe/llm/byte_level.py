"""A byte-level BPE vocabulary file (JSON) as a fast encoder whose tokens' bytes are known."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np

#: A longer run of white space is more than the fast encoder's regular expressions can take.
LONG_SPACE = 20_000


def byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevelEncoder:
    """Ids and bytes of tokens. The vocabulary's own special tokens are ordinary text; ``marks`` are tokens of their own after its ids."""

    def __init__(self, spec_json: str, pattern: str, marks: Sequence[str] = ()):
        import tiktoken

        at, spec = byte_of_char(), json.loads(spec_json)
        special, vocab = {t["content"] for t in spec["added_tokens"]}, spec["model"]["vocab"]
        ranks = {bytes(at[c] for c in token): i for token, i in vocab.items() if token not in special}
        first = 1 + max(*vocab.values(), *(t["id"] for t in spec["added_tokens"]))
        self.marks = {m: first + k for k, m in enumerate(marks)}
        self.tokens: list[bytes] = [b""] * (first + len(marks))
        for token, i in ranks.items():
            self.tokens[i] = token
        for mark, i in self.marks.items():
            self.tokens[i] = mark.encode()
        self.lengths = np.array([len(x) for x in self.tokens], dtype=np.int64)
        self._json, self._slow, self._allowed = spec_json, None, set(marks)
        self._fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.marks)

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG_SPACE and re.search(rf"\s{{{LONG_SPACE}}}", text):
            return self._encode_slowly(text)
        return self._fast.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=())

    def _encode_slowly(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import AddedToken, Tokenizer

            self._slow = Tokenizer.from_str(self._json)
            # The strings of special tokens in a text are then ordinary text; marks are added tokens, but not special.
            self._slow.encode_special_tokens = True
            self._slow.add_tokens([AddedToken(m, normalized=False, special=False) for m in self.marks])
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
