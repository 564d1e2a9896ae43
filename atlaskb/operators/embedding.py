"""Embedders as batch functions of texts, and the step that applies one to a table."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int) -> Embedder:
    """A deterministic embedder without a model: words hashed to signed places, at unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def service_embedder(address: str, model: str, chars: int = 6000, seconds: float = 120.0) -> Embedder:
    """An embedder that asks a service: POST address/api/embed with model and input, answered by embeddings. Texts are cut to
    the service's limit. It fails if the service does; resilient() says what then."""
    import json
    import urllib.request

    def embed(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": [t[:chars] for t in texts]}).encode()
        request = urllib.request.Request(f"{address.rstrip('/')}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            found = json.load(answer)["embeddings"]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} embeddings for {len(texts)} texts")
        return found

    return embed


def resilient(embedder: Embedder, dim: int) -> Embedder:
    """A batch that fails is tried text by text; a text that fails gets the zero vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        try:
            return embedder(texts)
        except Exception:  # noqa: BLE001  the service failed on the batch; single texts decide
            out = []
            for text in texts:
                try:
                    out += embedder([text])
                except Exception:  # noqa: BLE001
                    out.append([0.0] * dim)
            return out

    return embed


def embed(df: DataFrame, embedder: Embedder, dim: int, text_col: str = "text", batch: int = 16, chars: int = 6000) -> DataFrame:
    """df with a column `embedding` of the first `chars` characters of the text, the embedder's limit."""
    safe, others = resilient(embedder, dim), df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            texts = [(t or "")[:chars] for t in got[text_col].to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in safe(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(vectors, pa.list_(pa.float32()))], [*others, "embedding"])

    return df.mapInArrow(rows, df.select("*", F.array().cast("array<float>").alias("embedding")).schema)
