"""Embeddings: what turns a batch of objects into vectors."""

from __future__ import annotations

import importlib
import io
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
import xxhash


class ObjectEmbedding(ABC):
    """Subclasses are built from keyword arguments kept in self.kwargs, so that an index can store and rebuild them.

    embed(batch) gets the objects' columns as a DataFrame with external_id and gives a matrix,
    one row per object, or (matrix, external_ids) if an object may have several vectors.
    """

    def __init__(self, **kwargs):
        self.kwargs = kwargs

    @property
    @abstractmethod
    def dimensions(self) -> int: ...

    def load(self) -> None:
        """Called once in each worker process before the first batch."""

    @abstractmethod
    def embed(self, batch: pd.DataFrame): ...


class HashingEmbedding(ObjectEmbedding):
    """Signed counts of the hashed words of a text column, at length 1; no model needed."""

    def __init__(self, dimensions: int = 64, column: str = "text", seed: int = 0):
        super().__init__(dimensions=dimensions, column=column, seed=seed)

    @property
    def dimensions(self) -> int:
        return self.kwargs["dimensions"]

    def embed(self, batch):
        d, seed = self.kwargs["dimensions"], self.kwargs["seed"]
        out = np.zeros((len(batch), d), np.float32)
        for i, text in enumerate(batch[self.kwargs["column"]].fillna("")):
            for w in str(text).lower().split():
                h = xxhash.xxh64_intdigest(w, seed)
                out[i, h % d] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


class ColumnEmbedding(ObjectEmbedding):
    """Vectors that the objects bring along in a column."""

    def __init__(self, dimensions: int, column: str = "vector"):
        super().__init__(dimensions=dimensions, column=column)

    @property
    def dimensions(self) -> int:
        return self.kwargs["dimensions"]

    def embed(self, batch):
        return np.array(batch[self.kwargs["column"]].tolist(), np.float32).reshape(len(batch), self.dimensions)


class RandomEmbedding(ObjectEmbedding):
    """Uniform numbers seeded by external_id, for trials."""

    def __init__(self, dimensions: int = 2048, seed: int = 0):
        super().__init__(dimensions=dimensions, seed=seed)

    @property
    def dimensions(self) -> int:
        return self.kwargs["dimensions"]

    def embed(self, batch):
        return np.stack([np.random.default_rng([self.kwargs["seed"], int(i) & (1 << 64) - 1]).random(self.dimensions) for i in batch["external_id"]]).astype(np.float32) if len(batch) else np.zeros((0, self.dimensions), np.float32)


class SentenceEmbedding(ObjectEmbedding):
    """A sentence-transformers model over a text column, where that library and the model are there."""

    def __init__(self, model: str, dimensions: int, column: str = "text"):
        super().__init__(model=model, dimensions=dimensions, column=column)

    @property
    def dimensions(self) -> int:
        return self.kwargs["dimensions"]

    def load(self) -> None:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("SentenceEmbedding needs the library sentence-transformers") from e
        self._model = SentenceTransformer(self.kwargs["model"])

    def embed(self, batch):
        return self._model.encode(batch[self.kwargs["column"]].tolist(), convert_to_numpy=True).astype(np.float32)


def _library(name: str, user: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise RuntimeError(f"{user} needs the library {name.split('.')[0]}") from e


def _pictures(batch: pd.DataFrame, column: str, user: str) -> list:
    """The images of a column of encoded bytes, decoded."""
    image = _library("PIL.Image", user)
    return [image.open(io.BytesIO(bytes(x))).convert("RGB") for x in batch[column]]


class _ModelEmbedding(ObjectEmbedding):
    @property
    def dimensions(self) -> int:
        return self.kwargs["dimensions"]


class LangChainEmbedding(_ModelEmbedding):
    """A LangChain embedding class ("package.module.Class") over a text column; `arguments` are given to it."""

    def __init__(self, embedding_class: str, dimensions: int, arguments: dict | None = None, column: str = "text"):
        super().__init__(embedding_class=embedding_class, dimensions=dimensions, arguments=arguments or {}, column=column)

    def load(self) -> None:
        module, _, name = self.kwargs["embedding_class"].rpartition(".")
        self._model = getattr(_library(module, type(self).__name__), name)(**self.kwargs["arguments"])

    def embed(self, batch):
        return np.asarray(self._model.embed_documents(batch[self.kwargs["column"]].fillna("").tolist()), np.float32).reshape(len(batch), self.dimensions)


class ImageModelEmbedding(_ModelEmbedding):
    """A transformers image model over a column of encoded images: the mean of its last hidden states."""

    def __init__(self, model: str, dimensions: int, column: str = "image"):
        super().__init__(model=model, dimensions=dimensions, column=column)

    def load(self) -> None:
        t = _library("transformers", type(self).__name__)
        self._processor, self._model = t.AutoImageProcessor.from_pretrained(self.kwargs["model"]), t.AutoModel.from_pretrained(self.kwargs["model"])

    def embed(self, batch):
        x = self._processor(images=_pictures(batch, self.kwargs["column"], type(self).__name__), return_tensors="pt")
        states = np.asarray(self._model(**x).last_hidden_state.detach().numpy(), np.float32)
        return states.reshape(len(batch), -1, self.dimensions).mean(1)


class ResNetEmbedding(_ModelEmbedding):
    """The pooled features of a Keras ResNet50V2 over a column of encoded images."""

    def __init__(self, dimensions: int = 2048, column: str = "image", side: int = 224):
        super().__init__(dimensions=dimensions, column=column, side=side)

    def load(self) -> None:
        self._module = _library("tensorflow.keras.applications.resnet_v2", type(self).__name__)
        self._model = self._module.ResNet50V2(include_top=False, pooling="avg")

    def embed(self, batch):
        side = self.kwargs["side"]
        x = np.stack([np.asarray(p.resize((side, side)), np.float32) for p in _pictures(batch, self.kwargs["column"], type(self).__name__)])
        return np.asarray(self._model.predict(self._module.preprocess_input(x)), np.float32).reshape(len(batch), self.dimensions)


class ColPaliEmbedding(_ModelEmbedding):
    """A ColPali model over page images or, with kind "text", over queries: several vectors an object."""

    def __init__(self, model: str, dimensions: int = 128, column: str = "image", kind: str = "image"):
        super().__init__(model=model, dimensions=dimensions, column=column, kind=kind)

    def load(self) -> None:
        m = _library("colpali_engine.models", type(self).__name__)
        self._model, self._processor = m.ColPali.from_pretrained(self.kwargs["model"]), m.ColPaliProcessor.from_pretrained(self.kwargs["model"])

    def embed(self, batch):
        column = self.kwargs["column"]
        x = self._processor.process_images(_pictures(batch, column, type(self).__name__)) if self.kwargs["kind"] == "image" else self._processor.process_queries(batch[column].fillna("").tolist())
        out = np.asarray(self._model(**x).detach().numpy(), np.float32)
        return out.reshape(-1, self.dimensions), np.repeat(batch["external_id"].to_numpy(), out.shape[1])
