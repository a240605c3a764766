"""Token ids of whole texts by a tokenizer file.

A byte-level BPE file whose merges are numbered in order is the same vocabulary as a table of ranks, which
tiktoken applies several times faster than the library that wrote the file. Texts with an added special string
or a very long run without a cut go to that library, and so does every text of any other kind of file. Tests
compare both; all code points, one by one in several contexts, have given equal ids.
"""
from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np

RUN_CHARS = 1 << 16  # a run without a cut that is longer is left to the library
WHITE_RUN = re.compile(r"\s{65536}")

# Fixed value: the pattern by which byte-level tokenizers cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if visible, else the next free one
    from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Tokens with their ranks if the file is plain byte-level BPE with ids in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    letters, vocab = _byte_letters(), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab.get("".join(m), -1) for m in merges]
    if made != sorted(set(made)) or not set(letters) <= set(vocab) or len(vocab) != len(made) + 256:
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Ids as the `tokenizers` library gives them for a .json file, added special strings handled as by
    default, without begin or end tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = ranks_of(path)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, text: str) -> bool:
        return (self.fast is None or any(a in text for a in self.added)
                or len(text) > RUN_CHARS and (max(map(len, text.split()), default=0) > RUN_CHARS or WHITE_RUN.search(text) is not None))

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self._by_library(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self._by_library(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(text))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library's version."""
    import tokenizers

    h = hashlib.sha256(tokenizers.__version__.encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()
