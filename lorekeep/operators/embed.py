"""Embedding and reranking hooks for Arrow batches.

An embedder turns a list of texts into vectors; one object per task serves all
its batches.  `HashedEmbedder` is the built-in deterministic one: a bag of
words hashed into a fixed number of places, at unit length.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import pytext as P

BATCH_ITEMS, BATCH_CHARS = 64, 128_000  # of a request


class Embedder(Protocol):
    """May have `most_chars`, the longest text it takes, None for no limit; without, it is half of `BATCH_CHARS`."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class HashedEmbedder:
    """FNV-1a of each lower-cased word, counted modulo the dimension, divided by the norm."""

    most_chars = None

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array([t.lower() for t in texts], pa.large_string())))
        row = pc.list_parent_indices(words).to_numpy()
        flat = pc.dictionary_encode(words.flatten())  # every different word is hashed once
        full = flat.dictionary.to_numpy(zero_copy_only=False) != ""
        place = _fnv(flat.dictionary)[flat.indices.to_numpy()] % np.uint64(self.dim)
        keep = full[flat.indices.to_numpy()]
        v = np.bincount(row[keep] * self.dim + place[keep].astype(np.int64), minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=v, where=n > 1e-10).tolist()


def _fnv(words: pa.Array) -> np.ndarray:
    """FNV-1a of the bytes of each word, all words one byte further at a time."""
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    h = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    left = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")  # words with so many bytes
    for i, n in enumerate(left.tolist()):
        at = order[:n]
        h[at] = (h[at] ^ data[offsets[at] + i]) * np.uint64(0x100000001B3)
    return h


class HttpEmbedder:
    """A server that takes {"model", "input": [texts]} and gives {"data": [{"embedding": [...]}]} or {"embeddings": [...]}, in order."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 60.0, most_chars: int | None = BATCH_CHARS // 2):
        self.url, self.model, self.key, self.timeout, self.most_chars = url, model, key, timeout, most_chars

    def embed(self, texts: list[str]) -> list[list[float]]:
        got = _posted(self.url, {"model": self.model, "input": texts}, self.key, self.timeout)
        vectors = got["embeddings"] if "embeddings" in got else [d["embedding"] for d in sorted(got["data"], key=lambda d: d.get("index", 0))]
        if len(vectors) != len(texts):
            raise OSError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors


class HttpReranker:
    """A server that takes {"query", "documents"} and gives {"results": [{"index", "relevance_score"}]}; what it leaves out has 0."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 60.0):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def score(self, query: str, texts: list[str]) -> list[float]:
        out = [0.0] * len(texts)
        if texts:
            for r in _posted(self.url, {"model": self.model, "query": query, "documents": texts}, self.key, self.timeout)["results"]:
                out[r["index"]] = float(r["relevance_score"])
        return out


def _posted(url: str, body: dict, key: str | None, timeout: float) -> dict:
    import json
    import urllib.request

    headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
        return json.load(r)


def first_working(makers: list[Callable[[], Embedder]], dim: int) -> Callable[[], Embedder]:
    """The first of several embedders, in order, that answers a probe with vectors of `dim` values; a wrong size is never adapted silently."""
    said = []
    for make in makers:
        try:
            size = len(make().embed(["probe"])[0])
        except Exception as e:  # whatever keeps a provider from answering
            said.append(f"{e}")
            continue
        if size == dim:
            return make
        said.append(f"{size} values")
    raise ValueError(f"no embedder gives {dim} values: {'; '.join(said)}")


class OverlapReranker:
    """Share of the query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(t.lower().split())) / len(q) if q else 0.0 for t in texts]


def _with_retries(call: Callable, texts: list[str], tries: int = 10, alone: int = 3, failed: Callable | None = None):
    """A batch with retries; when it keeps failing, each text by itself; a text that fails alone raises."""
    for n in range(tries):
        try:
            return call(texts)
        except OSError:  # network trouble of a remote embedder
            if failed:
                failed()
            time.sleep(min(30.0, 0.1 * 2**n))
    if len(texts) == 1:
        raise RuntimeError("embedding failed")
    return [_with_retries(call, [t], alone)[0] for t in texts]


def _within(text: str, most: int | None) -> list[str]:
    """The text in pieces of at most `most` characters, at sentence ends where there are any."""
    out, at = [], 0
    while most is not None and len(text) - at > most:
        out.append(P.cut_sentence(text[at : at + most + 1], most) or text[at : at + most])
        at += len(out[-1])
    return [*out, text[at:]]


def _mean(vectors: list[list[float]], weights: list[int]) -> list[float]:
    total = sum(weights)
    return [sum(w * x for w, x in zip(weights, xs, strict=True)) / total for xs in zip(*vectors, strict=True)]


def embedded(df: DataFrame, keep: list[str], text: str = "text", make: Callable[[], Embedder] = HashedEmbedder, out: str = "vector", govern: Callable | None = None) -> DataFrame:
    """`keep` and the vector of each text, in requests of at most 64 texts and 128,000 characters; null texts give null.

    `govern` makes a governor for each task, which sets the sizes of requests by their latency (streaming.control.Governor).

    A text too long for the embedder goes in pieces; its vector is their mean, weighted by length.
    """
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        model, sizes = make(), govern() if govern else None
        most = getattr(model, "most_chars", BATCH_CHARS // 2)
        for b in batches:
            texts = b.column(text).to_pylist()
            pieces = [(i, p) for i, t in enumerate(texts) if t is not None for p in _within(t, most)]
            got: dict[int, list] = {}
            at = 0
            while at < len(pieces):  # the next request, as large as it may be now
                items, chars = (sizes.items, sizes.chars) if sizes else (BATCH_ITEMS, BATCH_CHARS)
                ips = pieces[at : at + items]
                ips = ips[: P.embed_batches([len(p) for _, p in ips], items, chars).count(0)]
                begun = time.monotonic()
                for (i, p), v in zip(ips, _with_retries(model.embed, [p for _, p in ips], failed=sizes.failed if sizes else None), strict=True):
                    got.setdefault(i, []).append((v, len(p)))
                if sizes:
                    sizes.took(time.monotonic() - begun)
                at += len(ips)
            vectors = [None if i not in got else got[i][0][0] if len(got[i]) == 1 else _mean(*zip(*got[i], strict=True)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(vectors, pa.list_(pa.float32()))], schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def reranked(df: DataFrame, query: str, keep: list[str], text: str = "text", make: Callable[[], Reranker] = OverlapReranker) -> DataFrame:
    """`keep` and the reranker's score of each candidate text."""
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(model.score(query, [t or "" for t in b.column(text).to_pylist()]), pa.float64())], schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
