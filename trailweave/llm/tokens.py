"""Token ids of a public byte-level BPE vocabulary.

The ids are those of the vocabulary's own library. That library is slow on words it has not met, so texts made of
plain Latin letters, digits, ASCII signs and white space are merged by ``tiktoken`` instead, whose ranks are the
same file's ids (a byte-level vocabulary numbers its tokens in the order of its merges). For such texts the
vocabulary's splitting pattern is narrowed to those characters, and without runs of white space it needs no
look-ahead. All other texts, and those that hold a special token's string, go to the library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from pathlib import Path

_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*")
_RUN = re.compile(r"\s\s")
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|"


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        signs = _byte_signs()
        vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
        ranks = {bytes(signs[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        self.plain, self.runs = (Encoding(n, pat_str=_SPLIT + p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer for n, p in (("plain", r"\s"), ("runs", r"\s+(?!\S)|\s+")))

    def __call__(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        return bytes((self.runs if _RUN.search(text) else self.plain)(text, set()))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)
