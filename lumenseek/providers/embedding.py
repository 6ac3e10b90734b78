"""Embedding providers: an offline one and the two HTTP services.

A provider maps prepared texts to vectors. Preparation (identifier split,
task prefix) is done by Spark before, see ``models``.
"""

from __future__ import annotations

import hashlib
import math
import time
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

from lumenseek import fixed_values as fv
from lumenseek.config import Settings
from lumenseek.providers.models import EmbeddingModel, embedding_model
from lumenseek.providers.transport import (
    HttpFailure, JsonTransport, RequestBudget, ServiceError, hosted_error, local_error)


def normalize(vector: list[float]) -> list[float]:
    norm = math.sqrt(sum(v * v for v in vector))
    return vector if norm == 0 else [v / norm for v in vector]


class EmbeddingProvider(ABC):
    """Interface of all providers; instances are pickled to the executors."""

    name: str
    model: EmbeddingModel
    batch_limit: int | None = None
    tokens_used: int = 0
    failures: dict[int, str] = {}

    @property
    def dimensions(self) -> int:
        return self.model.dimensions

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors in input order; ``[]`` marks a text that failed.

        ``failures`` then says why, by position in the texts of this call.
        """

    def embed_query(self, text: str) -> list[float]:
        """Vector of one search text; a failure is an error, as there is nothing to go on with."""
        vector = self.embed([text])[0]
        if not vector:
            raise ServiceError(self.failures.get(0, "empty vector"))
        return vector

    def check_connection(self) -> bool:
        return True

    def is_model_available(self, model: str | None = None) -> bool:
        """Whether the service has ``model``, by default the provider's own."""
        return True

    def shared_by(self, tasks: int) -> None:
        """Told how many tasks call the service at a time."""

    def open(self) -> None:
        """Called once per task before the first text."""

    def dispose(self) -> None:
        """Called once per task after the last text."""


@lru_cache(maxsize=1 << 16)
def _slot(token: str) -> tuple[int, int]:
    digest = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16), 1 if digest[8] < "8" else -1


class HashProvider(EmbeddingProvider):
    """Offline provider: signed token counts in md5-chosen buckets, unit length."""

    name = "hash"

    def __init__(self, dimensions: int = 64):
        self.model = EmbeddingModel(f"hash-{dimensions}", dimensions, 1 << 30, None, None, True)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            sums = [0.0] * self.dimensions
            for token, count in Counter(text.lower().split(" ")).items():
                if token:
                    bucket, sign = _slot(token)
                    sums[bucket % self.dimensions] += sign * count
            out.append(normalize(sums))
        return out


class LocalServerProvider(EmbeddingProvider):
    """Local model server: one request per text, each text tried by itself."""

    name = "ollama"

    def __init__(self, model: str, url: str = "http://localhost:11434", transport=None, *,
                 sleep: Callable[[float], None] = time.sleep):
        self.model = embedding_model("ollama", model)
        self.url, self._transport, self.sleep = url, transport, sleep

    @property
    def transport(self):
        if self._transport is None:
            self._transport = JsonTransport(self.url)
        return self._transport

    def check_connection(self) -> bool:
        try:
            self.transport.call("/api/tags", timeout=5)
            return True
        except Exception:
            return False

    def list_models(self) -> list[str]:
        try:
            return [m["name"] for m in self.transport.call("/api/tags").get("models", [])]
        except Exception as error:
            raise local_error(error) from error

    def is_model_available(self, model: str | None = None) -> bool:
        try:
            return any((model or self.model.name) in name for name in self.list_models())
        except ServiceError:
            return False

    def embed_one(self, text: str) -> list[float]:
        try:
            reply = self.transport.call("/api/embeddings", {"model": self.model.name, "prompt": text})
            vector = [float(v) for v in reply["embedding"]]
        except Exception as error:
            raise local_error(error) from error
        return normalize(vector) if self.model.normalize else vector

    def embed_query(self, text: str) -> list[float]:
        return self.embed_one(text)

    def embed(self, texts: list[str]) -> list[list[float]]:
        self.failures = {}
        return [self._tried(i, t) for i, t in enumerate(texts)]

    def _tried(self, place: int, text: str) -> list[float]:
        """The vector after up to three tries; the other texts are not sent again."""
        for wait in fv.RETRY_SECONDS:
            try:
                return self.embed_one(text)
            except ServiceError as error:
                self.failures[place] = str(error)
                self.sleep(wait)
        return []


class HostedProvider(EmbeddingProvider):
    """Hosted service: one request per slice of up to 100 texts.

    ``per_minute`` is the account's limit of requests; None is for a service without one.
    """

    name = "openai"
    batch_limit = fv.HOSTED_BATCH

    def __init__(self, model: str, api_key: str, organization: str = "", *,
                 url: str = "https://api.openai.com/v1", concurrency: int = 1, transport=None,
                 per_minute: float | None = fv.HOSTED_EMBED_PER_MINUTE):
        self.model = embedding_model("openai", model)
        self.url, self.api_key, self.organization = url, api_key, organization
        self._transport, self.account_limit = transport, per_minute
        self.shared_by(concurrency)

    def __getstate__(self):
        return {**self.__dict__, "_budget": None}

    def shared_by(self, tasks: int) -> None:
        """Every task may send its share of the requests per minute."""
        limit = self.account_limit
        self.per_minute, self._budget = None if limit is None else max(1.0, limit / tasks), None

    @property
    def transport(self):
        if self._transport is None:
            headers = {"Authorization": f"Bearer {self.api_key}"}
            if self.organization:
                headers["OpenAI-Organization"] = self.organization
            self._transport = JsonTransport(self.url, headers)
        return self._transport

    @property
    def budget(self) -> RequestBudget | None:
        if self._budget is None and self.per_minute is not None:
            self._budget = RequestBudget(self.per_minute)
        return self._budget

    def check_connection(self) -> bool:
        try:
            self.transport.call("/models", timeout=5)
            return True
        except Exception:
            return False

    def is_model_available(self, model: str | None = None) -> bool:
        try:
            return any(m.get("id") == (model or self.model.name) for m in self.transport.call("/models").get("data", []))
        except HttpFailure:
            return False

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for start in range(0, len(texts), self.batch_limit):
            part = texts[start:start + self.batch_limit]
            if self.budget:
                self.budget.acquire()
            try:
                reply = self.transport.call("/embeddings", {"input": part, "model": self.model.name})
            except Exception as error:
                raise hosted_error(error) from error
            # The reply may come in any order; its index says which text it is for.
            rows = sorted(reply["data"], key=lambda item: item["index"])
            self.tokens_used += reply.get("usage", {}).get("total_tokens", 0)
            out += [[float(v) for v in item["embedding"]] for item in rows]
        return out


def create_provider(settings: Settings, api_key: str | None = None, transport=None) -> EmbeddingProvider:
    """Provider named by the settings; the hosted one without a key gives way to the local one."""
    kind = settings.embedding_provider
    if kind == "hash":
        return HashProvider(settings.hash_dimensions)
    if kind == "openai" and api_key:
        return HostedProvider(settings.openai_embedding_model, api_key, settings.openai_organization,
                              transport=transport)
    if kind in ("ollama", "openai"):
        return LocalServerProvider(settings.ollama_embedding_model, settings.ollama_url, transport)
    raise ValueError(f"unknown embedding provider {kind!r}")
