"""Token ids of whole texts with a public tokenizer file, word by word through a bounded cache.

The pre-tokenizer of the word tokenizers drops white space and never joins across it, and Unicode
composition never joins a blank with what follows, so the ids of a text are the ids of its blank-separated
pieces in order. Each worker keeps the ids of twice `CACHE` pieces at most; pieces it hasn't seen go to the
tokenizers library. `tests/llm` compares with encoding whole texts.
"""
from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa

CACHE = 200_000
LONGEST = 64
MARKS = string.punctuation.replace("'", "")
GROUP = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _bare(tokenizer) -> Callable[[str], bytes] | None:
    """For lower-casing byte-level files: ids of one run of small Latin letters straight from the library's model, past regex and normalizer that leave such a run whole."""
    parts = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"]:
        return None
    # the byte-level alphabet: bytes without a visible sign stand as the signs from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    tokenize = tokenizer.model.tokenize

    def bare(word: str) -> bytes:
        return array("I", [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(signs))]).tobytes()

    return bare


class _Pieces(dict):
    """piece -> ids as bytes; a piece that isn't there is worked out, the ones used before longest ago go in bulk."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.older, self.bare = tokenizer, {}, _bare(tokenizer)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.work_out(piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def work_out(self, piece: str) -> bytes:
        if piece.isalpha():
            if piece.isascii():
                low = piece.lower()
                if low != piece:
                    return self[low]
                if self.bare:
                    return self.bare(low)
            elif self.bare and max(piece) < "\u0180" and "\u0130" not in piece:
                return self.bare(piece.lower())
        else:
            core = piece.rstrip(MARKS)
            if core != piece and core.isalpha():  # letters and then marks: the pre-tokenizer splits them too
                return self[core] + self[piece[len(core):]]
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.pieces = _Pieces(tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, without an end id."""
        find = self.pieces.__getitem__
        return [b"".join(map(find, blank_split(t))) for t in texts]


def blank_split(text: str) -> list[str]:
    """Pieces between blanks; four control signs that str.split() takes for blanks aren't any to the tokenizers."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return re.split("[ \t\n\r]+", text)
    return text.split()


@cache
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker: a reused worker keeps what its earlier tasks have seen."""
    return Encoder(path)


def text_groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about `GROUP` characters; a null is an empty text."""
    first, some, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        some.append(text)
        size += len(text)
        if size >= GROUP:
            yield first, some
            first, some, size = i + 1, [], 0
    if some:
        yield first, some
