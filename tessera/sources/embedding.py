"""Embedding providers, a deterministic offline one, and embedding behind a cache."""

from __future__ import annotations

import asyncio
import functools
import hashlib
import json
import urllib.error
import urllib.request
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import xxh3_hex

BATCH = 64
# What servers say of a text that is too long.
TOO_LONG = ("context length", "input length", "too long")
# Models and the public tokenizers that count their tokens.
TOKENIZERS = {
    "all-minilm": "sentence-transformers/all-MiniLM-L6-v2", "nomic-embed-text": "nomic-ai/nomic-embed-text-v1", "mxbai-embed-large": "mixedbread-ai/mxbai-embed-large-v1",
    "bge-large": "BAAI/bge-large-en-v1.5", "bge-m3": "BAAI/bge-m3", "snowflake-arctic-embed": "Snowflake/snowflake-arctic-embed-l",
}


class Provider(Protocol):
    """What embeds texts. It is sent to executors, so it must pickle; it may open connections when first used there."""

    name: str
    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Unit-free vectors from the md5 of a text: 8 nibbles over 15. Offline and the same everywhere."""

    name, dimension = "hash", 8

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[int(c, 16) / 15.0 for c in hashlib.md5(t.encode()).hexdigest()[: self.dimension]] for t in texts]


class TextTooLong(ValueError):
    pass


def overflowed(status: int, message: str) -> bool:
    """Whether a server's refusal says that a text is too long for the model."""
    return status == 400 and any(x in message.lower() for x in TOO_LONG)


@functools.cache
def token_counter(model: str):
    """What counts a model's tokens, or None where its tokenizer isn't known or can't be had; a tag after ":" is ignored."""
    known = TOKENIZERS.get(model.split(":", 1)[0])
    try:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_pretrained(known) if known else None
    except Exception:
        return None
    return None if loaded is None else lambda text: len(loaded.encode(text).ids)


class HttpProvider:
    """A server that takes {"model", "input": [...]} and answers {"data": [{"embedding"}]} or {"embeddings": [...]}.

    Without ``dimension``, it is asked for once by embedding a word.
    """

    def __init__(self, url: str, model: str, dimension: int | None = None, key: str = "", timeout: float = 60):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout
        self.name, self._dimension = f"http:{model}", dimension

    @property
    def dimension(self) -> int:
        if self._dimension is None:
            self._dimension = len(self.embed_batch(["dimension"])[0])
        return self._dimension

    def _post(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as answer:
                said = json.load(answer)
        except urllib.error.HTTPError as e:
            message = e.read().decode("utf-8", "replace")
            if overflowed(e.code, message):
                raise TextTooLong(message) from e
            raise ConnectionError(f"{self.url}: status {e.code}: {message[:200]}") from e
        except OSError as e:
            raise ConnectionError(f"{self.url}: {e}") from e
        return said["embeddings"] if "embeddings" in said else [x["embedding"] for x in sorted(said["data"], key=lambda x: x.get("index", 0))]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return halved(self._post, texts)

    async def aembed_batch(self, texts: list[str]) -> list[list[float]]:
        """The same for callers in an event loop, which isn't held up."""
        return await asyncio.to_thread(self.embed_batch, texts)


def halved(embed, texts: list[str]) -> list[list[float]]:
    """``embed``, with a batch that is too long halved, and a text that is too long the mean of its halves."""
    if not texts:
        return []
    try:
        return embed(texts)
    except TextTooLong:
        if len(texts) > 1:
            middle = len(texts) // 2
            return halved(embed, texts[:middle]) + halved(embed, texts[middle:])
        if len(texts[0]) < 2:
            raise
        middle = len(texts[0]) // 2
        a, b = (halved(embed, [t])[0] for t in (texts[0][:middle], texts[0][middle:]))
        return [[(x + y) / 2 for x, y in zip(a, b, strict=True)]]


def embed(texts: DataFrame, provider: Provider, text: str = "content", batch: int = BATCH) -> DataFrame:
    """``texts`` with ``embedding``, in batches of ``batch``."""

    @F.pandas_udf("array<float>")
    def vectors(values: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = []
        for a in range(0, len(values), batch):
            out += [None if v is None else np.asarray(v, np.float32) for v in provider.embed_batch([t or "" for t in values.iloc[a : a + batch]])]
        return pd.Series(out, index=values.index)

    return texts.withColumn("embedding", vectors(F.col(text)))


def embed_cached(texts: DataFrame, cache: DataFrame, provider: Provider, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(``texts`` with embedding and hit, rows to append to the cache).

    Of equal texts one is embedded, and only if the cache (content_hash, provider, embedding) doesn't have it.
    ``texts`` may have content_hash already.
    """
    keyed = texts if "content_hash" in texts.columns else texts.withColumn("content_hash", xxh3_hex(F.col(text)))
    own = cache.filter(F.col("provider") == provider.name).select("content_hash", "embedding")
    missed = keyed.groupBy("content_hash").agg(F.min(text).alias(text)).join(own, "content_hash", "left_anti")
    fresh = embed(missed, provider, text).select("content_hash", F.lit(provider.name).alias("provider"), "embedding")
    known = own.withColumn("hit", F.lit(True)).unionByName(fresh.select("content_hash", "embedding").withColumn("hit", F.lit(False)))
    return keyed.join(known, "content_hash"), fresh


def cache_use(texts: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """One row: texts, hits, misses, and distinct misses, which are what would be embedded."""
    marked = texts.join(cache.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("texts"), F.count_if("known").alias("hits"), F.count_if(F.col("known").isNull()).alias("misses"), F.count_distinct(F.when(F.col("known").isNull(), F.col(key))).alias("to_embed"))
