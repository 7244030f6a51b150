"""Embeddings: a provider protocol, providers by name, and a deterministic hashing embedder."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Local models by key: name, dimension, size in MB.
MODELS = {
    "minilm-l6": ("all-MiniLM-L6-v2", 384, 22),
    "minilm-l12": ("all-MiniLM-L12-v2", 384, 33),
    "bge-small": ("BAAI/bge-small-en-v1.5", 384, 33),
    "bge-base": ("BAAI/bge-base-en-v1.5", 768, 110),
}


class Provider(Protocol):
    """What a model must offer; it is made once a task by the factory given to ``embed_with``."""

    dimension: int
    model_name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_single(self, text: str) -> list[float]: ...


def post_json(url: str, body: dict, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, data=json.dumps(body).encode(), headers={"Content-Type": "application/json", **headers}, method="POST")
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.loads(answer.read())


class HashProvider:
    """The vectors of ``hash_embed``, one text at a time."""

    model_name = "hash"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_single(self, text: str) -> list[float]:
        x = np.zeros(self.dimension)
        for word in re.findall(r"[a-z0-9]+", text.lower()):
            digest = hashlib.sha1(word.encode()).hexdigest()
            x[int(digest[:4], 16) % self.dimension] += 1.0 if digest[4] < "8" else -1.0
        n = np.linalg.norm(x)
        return (x / n if n else x).tolist()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_single(t) for t in texts]


@dataclass
class RemoteProvider:
    """A model behind an address: texts are posted in batches, ``read`` takes the vectors out of an answer. post can be replaced."""

    url: str
    dimension: int
    model_name: str
    token: str = ""
    batch: int = 512
    texts_key: str = "texts"
    extra: dict = field(default_factory=dict)
    read: Callable[[dict], list] = lambda answer: answer["vectors"]
    post: Callable[[str, dict, dict], dict] = post_json

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, headers = [], {"Authorization": f"Bearer {self.token}"} if self.token else {}
        for lo in range(0, len(texts), self.batch):
            out += self.read(self.post(self.url, {self.texts_key: texts[lo : lo + self.batch], "model": self.model_name, **self.extra}, headers))
        if out and len(out[0]) != self.dimension:
            warnings.warn(f"{self.model_name} gives {len(out[0])} dimensions, not {self.dimension}", stacklevel=2)
        return out

    def embed_single(self, text: str) -> list[float]:
        return self.embed([text])[0]


def _in_order(answer: dict) -> list:
    return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]


#: Providers by name: each makes one from its settings. ``register`` adds others, such as a local model.
FACTORIES: dict[str, Callable[[dict], Provider]] = {
    "hash": lambda c: HashProvider(int(c.get("dimension", 64))),
    "custom": lambda c: RemoteProvider(c["endpoint"].rstrip("/") + "/embed", int(c["dimension"]), c.get("model", "custom"), c.get("token", "")),
    "hosted": lambda c: RemoteProvider(c["endpoint"], int(c["dimension"]), c["model"], c.get("token", ""), 512, "input", read=_in_order),
    "hosted_documents": lambda c: RemoteProvider(c["endpoint"], int(c["dimension"]), c["model"], c.get("token", ""), 128, "input", {"input_type": "document"}, _in_order),
}


def register(name: str, factory: Callable[[dict], Provider]) -> None:
    FACTORIES[name] = factory


def create_provider(config: dict) -> Provider:
    """The provider that config["provider"] names (hash where it names none); an unknown name is an error."""
    name = config.get("provider", "hash")
    if name not in FACTORIES:
        raise ValueError(f"unknown provider {name}; there are {', '.join(sorted(FACTORIES))}")
    return FACTORIES[name](config)


def is_cached(name: str, folder: str) -> bool:
    """Whether a model's files are in a cache folder of the usual layout."""
    for own in (f"models--{name.replace('/', '--')}", f"models--sentence-transformers--{name.replace('/', '--')}"):
        snapshots = Path(folder) / own / "snapshots"
        if snapshots.is_dir() and any(snapshots.iterdir()):
            return True
    return False


def model_list(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """key, name, dimension, size_mb and cached (in the folder, if one is given) of the local models."""
    rows = [(k, *v, folder is not None and is_cached(v[0], folder)) for k, v in MODELS.items()]
    return spark.createDataFrame(rows, "key string, name string, dimension int, size_mb int, cached boolean")


class _Cells(dict):
    """Twice the coordinate of a word, and one more where its sign is minus; as many as ``CELLS`` words are remembered."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        if len(self) >= CELLS:
            self.clear()
        digest = hashlib.sha1(word.encode()).hexdigest()
        self[word] = found = int(digest[:4], 16) % self.dimension * 2 + (digest[4] >= "8")
        return found


CELLS, _WORDS = 1 << 16, re.compile(r"[a-z0-9]+")


def hash_embed(docs: DataFrame, keys: list[str], text: str, dimension: int = 64) -> DataFrame:
    """keys and vector: words hashed to a signed coordinate, unit length; a text without words, or none, is all zeros. Each row has its own vector, made where the row is."""
    schema = StructType([*(docs.schema[k] for k in keys), StructField("vector", ArrayType(DoubleType()))])

    def run(batches):
        cells, arrow = _Cells(dimension), to_arrow_schema(schema)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_000):
                batch = whole.slice(lo, 1_000)
                x = np.zeros((batch.num_rows, dimension))
                for i, t in enumerate(batch.column(len(keys))):
                    words = _WORDS.findall(t.as_py() or "")
                    if words:
                        n = np.bincount([cells[w] for w in words], minlength=2 * dimension)
                        x[i] = n[::2] - n[1::2]
                n = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dimension, pa.int32()), pa.array(x.ravel()), type=arrow.field("vector").type)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], vectors], schema=arrow)

    return docs.select(*keys, F.lower(F.col(text)).alias("_text")).mapInArrow(run, schema)


def embed_with(factory, text: Column, batch: int = 32) -> Column:
    """An iterator UDF over a provider: the model is made once a task; vectors get unit length."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in series:
            out = []
            for lo in range(0, len(s), batch):
                x = np.asarray(model.embed([t or "" for t in s.iloc[lo : lo + batch]]), dtype=np.float32)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                out.extend(np.divide(x, n, out=np.zeros_like(x), where=n > 0).tolist())
            yield pd.Series(out)

    return run(text)
