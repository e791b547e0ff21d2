"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 8).

Method: *forced-boundary splitting*. A byte pair that occurs inside no vocabulary token can never be
merged over, so the place between its two bytes is a cut in every encoding of every text. Texts are cut
at such places, the fragments are encoded independently and their ids are concatenated.

The vocabulary's own word pattern runs before the merges and looks one character ahead in runs of white
space. A cut is therefore taken only where the pattern, too, splits alike on both sides:

* after a line feed that follows a non-space and precedes a non-space, and
* between an ASCII letter and ``" x"`` where x is an ASCII letter.

Both are checked against the pair table of the vocabulary at hand when an encoder is built; a class of
cuts whose pairs do occur inside some token is switched off, so another vocabulary stays exact.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_TOKENIZERS = "/opt/tokenizers"
#: The word pattern published with the rank files (fixed value).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A forced boundary is taken at the first chance after so many characters; fragments of a few hundred
#: tokens keep very long texts cheap, while shorter ones would only add calls.
FRAGMENT = 1024

_encoders: dict[str, "ForcedBoundaryEncoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file at ``path``: token bytes to id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def inner_pairs(tokens) -> np.ndarray:
    """256 x 256 table: does the byte pair occur inside some token?"""
    seen = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        if len(token) > 1:
            raw = np.frombuffer(token, dtype=np.uint8)
            seen[raw[:-1], raw[1:]] = True
    return seen


class ForcedBoundaryEncoder:
    """Encoder of one vocabulary; ``special`` strings in a text are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding(
            "own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.pairs = inner_pairs(ranks)
        letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", dtype=np.uint8)
        # Bytes that can follow a line feed at a cut: ASCII visibles whose pair is inside no token.
        free = [chr(b) for b in range(33, 127) if not self.pairs[10, b]]
        cuts = [r"(?<=\S\n)(?=[" + re.escape("".join(free)) + "])"] if free else []
        if not self.pairs[letters, 32].any():
            cuts.append(r"(?<=[A-Za-z])(?= [A-Za-z])")
        self.cut = re.compile("|".join(cuts)) if cuts else None

    def fragments(self, text: str) -> list[str]:
        """``text`` cut at forced boundaries; the pieces joined give ``text``."""
        if len(text) <= FRAGMENT or self.cut is None:
            return [text]
        out, start = [], 0
        while len(text) - start > FRAGMENT:
            found = self.cut.search(text, start + FRAGMENT)
            if found is None:
                break
            out.append(text[start : found.start()])
            start = found.start()
        out.append(text[start:])
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; null and empty texts have none."""
        if not text:
            return []
        encode = self.encoding.encode_ordinary
        parts = self.fragments(text)
        return encode(text) if len(parts) == 1 else [i for x in parts for i in encode(x)]


def encoder(path: str) -> ForcedBoundaryEncoder:
    """The encoder of the rank file ``path``, one per Python worker."""
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryEncoder(path)
    return _encoders[path]


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizers: str = DEFAULT_TOKENIZERS,
    vocabulary: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row ``(id_col, ids)`` per input row; a narrow map without any shuffle.

    Null and empty texts give an empty list; repeated rows stay repeated; blank texts are encoded like
    any other text; other columns of ``docs`` are ignored, whatever their names. An empty table gives an
    empty table. Texts of any length are encoded whole.
    """
    path = os.path.join(tokenizers, vocabulary)
    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # bounds the ids held at once
                part = batch.slice(at, 1024)
                ids = [enc.encode(x) for x in part.column(1).to_pylist()]
                lists = pa.array(ids, type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return narrow.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", tokenizers: str = DEFAULT_TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``(id_col, text)`` of rows ``(id_col, ids)``: the bytes of the tokens joined; null lists give empty texts."""
    path = os.path.join(tokenizers, vocabulary)
    narrow = encoded.select(id_col, "ids")
    kind = narrow.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).encoding.decode_bytes
        for batch in batches:
            texts = [decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return narrow.mapInArrow(run, f"`{id_col}` {kind}, text string")
