"""The embedder interface, the hashed stand-in, and how an index is built from chunks."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame

from ..errors import ArtifactError
from ..functions.text import count_tokens
from ..sources.files import save_index
from .retrieval import embed_words


class Embedder(Protocol):
    """Turns (key, text) into (key, vector) of unit length; ``identity`` names it in manifests."""

    dim: int
    most_tokens: int

    def identity(self) -> dict: ...

    def count_tokens(self, text: Column) -> Column: ...

    def embed(self, frame: DataFrame, key: str) -> DataFrame: ...


class HashedWords:
    """Bags of words hashed into ``dim`` buckets."""

    def __init__(self, dim: int = 64, most_tokens: int = 8192) -> None:
        self.dim, self.most_tokens = dim, most_tokens

    def identity(self) -> dict:
        return {"embedder": "hashed-words", "dim": self.dim}

    def count_tokens(self, text: Column) -> Column:
        return count_tokens(text)

    def embed(self, frame: DataFrame, key: str) -> DataFrame:
        return embed_words(frame, key, self.dim)


def too_long(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, n_tokens) of the chunks that the embedder would have to cut."""
    counted = chunks.select("chunk_id", embedder.count_tokens(chunks["text"]).alias("n_tokens"))
    return counted.filter(counted["n_tokens"] > embedder.most_tokens)


def ensure_fits(chunks: DataFrame, embedder: Embedder) -> None:
    """An error if a chunk is too long: texts are never cut. It names the first twenty; ``too_long`` has all."""
    over = too_long(chunks, embedder)
    if n := over.count():
        first = [r[0] for r in over.orderBy("chunk_id").select("chunk_id").limit(20).collect()]
        raise ArtifactError(f"{n} chunks are too long to embed", expected=f"{embedder.most_tokens} tokens at most", actual=first, recovery="use smaller chunks")


def build_index(chunks: DataFrame, embedder: Embedder, path: str, facts: dict) -> None:
    """Writes the index of chunks (chunk_id, text), with the embedder's identity in its manifest. Searching never builds one."""
    ensure_fits(chunks, embedder)
    save_index(embedder.embed(chunks, "chunk_id"), path, facts | embedder.identity(), embedder.dim)
