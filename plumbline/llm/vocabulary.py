"""Public byte-level vocabularies: token ids and the bytes of each id.

The vocabulary file is named by the caller and read where the tasks run; it is never copied.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The split pattern that belongs to byte-level vocabularies of this family.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabulary:
    """Encodes whole texts with the vocabulary of one ``tokenizers`` file.

    ``encode`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``: a special token that stands in a text is
    that token. ``encode_plain`` takes such strings for ordinary text. The library's encoder needs four times the processor time
    of a ranked merge over the same vocabulary (1.7 against 7 MB a second and core), so texts go through
    the ranked merge built from the same file; a text that it refuses (runs of white space beyond its
    stack) goes through ``tokenizers`` itself. Tests hold the two against each other.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._exact, self._exact_plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._exact_plain.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["content"]: t["id"] for t in described.get("added_tokens", []) if t.get("special")}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        self._ranked = tiktoken.Encoding(path, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        of_id = {i: token for token, i in ranks.items()} | {i: token.encode("utf-8") for token, i in special.items()}
        #: The bytes of each id, and their number.
        self.tokens = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        self.token_bytes = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self._encoded(lambda: self._ranked.encode(text, allowed_special="all"), self._exact, text)

    def encode_plain(self, text: str) -> np.ndarray:
        return self._encoded(lambda: self._ranked.encode_ordinary(text), self._exact_plain, text)

    def _encoded(self, ranked, exact, text: str) -> np.ndarray:
        try:
            return np.array(ranked(), np.uint32)
        except BaseException as error:  # the native encoder raises its own panic type
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)


class PieceVocabulary:
    """Encodes whole texts with one ``sentencepiece`` model; ``tokens`` are the bytes of each piece (U+2581 is a space, <0xHH> a byte)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        byte = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in pieces]
        self.tokens = [bytes([int(m[1], 16)]) if m else p.replace("\u2581", " ").encode("utf-8") for p, m in zip(pieces, byte, strict=True)]
        self.token_bytes = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text, num_threads=1), np.uint32)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> PieceVocabulary:
    """One model per worker process."""
    return PieceVocabulary(path)
