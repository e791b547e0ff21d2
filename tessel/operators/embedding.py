"""Embedders: texts to vectors.

``Embedder`` is the interface; anything with ``dim`` and ``encode(list[str]) -> ndarray`` fits and is run in Arrow
batches, one instance per Python worker. ``HashingEmbedder`` needs no model and is the default.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.request import Request, urlopen

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9]+")

LOCAL_LIMIT = 99_999  # more chunks than this go to the remote embedder
LOCAL_BATCH, REMOTE_BATCH = 16, 128


class Embedder(Protocol):
    """What an embedder must offer; ``encode`` may raise, and then the job fails: no vector is made up."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token states (batch, tokens, dim) where the mask is 1; all-masked rows give zeros."""
    weight = mask[:, :, None].astype(states.dtype)
    return (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def normalized(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def choose_embedder(n_chunks: int, local: str, remote: str, limit: int = LOCAL_LIMIT) -> str:
    """The remote embedder above the limit, the local one up to it."""
    return remote if n_chunks > limit else local


def embedder_choice(n_chunks: Column, local: str = "local", remote: str = "remote", limit: int = LOCAL_LIMIT) -> Column:
    """``choose_embedder`` on a column of counts."""
    return F.when(n_chunks > limit, remote).otherwise(local)


def reordered(results: list[dict], key: str = "index", value: str = "embedding") -> list:
    """Answers of a batched service in the order of the request."""
    return [r[value] for r in sorted(results, key=lambda r: r[key])]


class HashingEmbedder:
    """Bag of hashed tokens: bucket = first 32 bits of the token's md5 modulo ``dim``; unit length.

    Buckets of tokens are remembered per worker and emptied at a limit, so md5 runs once per different token.
    """

    def __init__(self, dim: int = 64, limit: int = 500_000):
        self.dim, self.limit = dim, limit
        self._known: dict[str, int] = {}

    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit vectors; texts without tokens give zeros."""
        known = self._known
        if len(known) > self.limit:
            known.clear()
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            found = _TOKEN.findall(text.lower())
            for token in set(found).difference(known):
                known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
            if found:
                out[i] = np.bincount(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)), minlength=self.dim)
        return normalized(out)


class ServiceEmbedder:
    """Vectors from a batched service: ``post(texts, kind)`` sends one request and returns its answer.

    An answer is a list of ``{"index", "embedding"}`` in any order. Requests that raise are tried again, waiting longer
    each time; the last failure is raised. Texts to be stored and texts to search by are told apart by ``kind``.
    """

    def __init__(self, post: Callable[[list[str], str], list[dict]], dim: int, batch: int = REMOTE_BATCH, tries: int = 3, wait: float = 1.0):
        self.post, self.dim, self.batch, self.tries, self.wait = post, dim, batch, tries, wait

    def _ask(self, texts: list[str], kind: str) -> list:
        for n in range(self.tries):
            try:
                return reordered(self.post(texts, kind))
            except Exception:  # noqa: BLE001 - a service may fail in any way
                if n + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**n)
        raise ValueError("no tries")

    def encode(self, texts: list[str], kind: str = "document") -> np.ndarray:
        out = [v for i in range(0, len(texts), self.batch) for v in self._ask(texts[i : i + self.batch], kind)]
        return np.asarray(out, dtype=np.float32).reshape(len(texts), self.dim)

    def encode_query(self, text: str) -> np.ndarray:
        return self.encode([text], "query")[0]


def web_service(url: str, model: str, token: str | None = None, send: Callable[[str, bytes, dict[str, str]], bytes] | None = None) -> Callable[[list[str], str], list[dict]]:
    """``post`` of a ``ServiceEmbedder`` for a service that takes ``{"input", "model", "input_type"}`` as JSON and answers ``{"data": [...]}``."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def by_web(address: str, body: bytes, head: dict[str, str]) -> bytes:
        with urlopen(Request(address, data=body, headers=head), timeout=120) as answer:
            return answer.read()

    def post(texts: list[str], kind: str) -> list[dict]:
        body = json.dumps({"input": texts, "model": model, "input_type": kind}).encode()
        return json.loads((send or by_web)(url, body, headers))["data"]

    return post


class PooledEmbedder:
    """Sentence vectors from token states: ``run(texts)`` gives states (batch, tokens, dim) and their mask.

    ``run`` wraps any encoder, such as a session of a local runtime; states are averaged over unmasked tokens and scaled
    to unit length.
    """

    def __init__(self, run: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dim: int, batch: int = LOCAL_BATCH):
        self.run, self.dim, self.batch = run, dim, batch

    def encode(self, texts: list[str]) -> np.ndarray:
        parts = [normalized(masked_mean(*self.run(texts[i : i + self.batch]))) for i in range(0, len(texts), self.batch)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dim))


def embed(rows: DataFrame, embedder, text_col: str = "content", out_col: str = "embedding", batch: int = LOCAL_BATCH) -> DataFrame:
    """``rows`` with a vector column, made in Arrow batches; a null text counts as an empty one.

    A worker that gets a wrong shape or a failing service raises: vectors are never replaced by random ones.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out_col)
    kept = [f.name for f in rows.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [t or "" for t in part.column(kept.index(text_col)).to_pylist()]
            got = [np.asarray(embedder.encode(texts[i : i + batch]), dtype=np.float32) for i in range(0, len(texts), batch)]
            flat = np.concatenate(got) if got else np.zeros((0, embedder.dim), dtype=np.float32)
            if flat.shape != (len(texts), embedder.dim):
                raise ValueError(f"embedder gave {flat.shape}, expected {(len(texts), embedder.dim)}")
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), embedder.dim).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*kept, out_col])

    return rows.select(*kept).mapInArrow(run, f"{fields}, `{out_col}` array<float>")
