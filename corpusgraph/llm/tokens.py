"""Token ids of texts by a public byte-level BPE vocabulary (a ``tokenizers`` JSON file; its path is a parameter)."""

from __future__ import annotations

import json
import sys
import types

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
# A longer stretch without a blank goes to the tokenizers library, whose merge loop is not quadratic in it.
LONG_WORD = 2000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Encoder:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``.

    ``ordinary``: strings of special tokens in a text are ordinary text. Texts go through tiktoken's faster loop
    over the same vocabulary; those with a special token's string or a very long word go to ``tokenizers``.
    """

    def __init__(self, path: str, ordinary: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = ordinary
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.specials = [] if ordinary else [t["content"] for t in model.get("added_tokens", [])]
        added = {t["content"] for t in model.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.specials) or (
                len(text) >= LONG_WORD and (max(map(len, text.split()), default=0) >= LONG_WORD or " " * LONG_WORD in text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One encoder for each worker process. Functions are shipped by value, so a module of this package is new in
    each task; the cache is therefore held by a module of its own in the process."""
    cache = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__.setdefault("made", {})
    if (path, ordinary) not in cache:
        cache[path, ordinary] = Encoder(path, ordinary)
    return cache[path, ordinary]
