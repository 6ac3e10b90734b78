"""Batched provider calls with retry, inside one task."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from lumenseek import fixed_values as fv


@dataclass
class BatchResult:
    vectors: list[list[float]] = field(default_factory=list)
    failed: list[int] = field(default_factory=list)
    errors: dict[int, str] = field(default_factory=dict)

    @property
    def success_count(self) -> int:
        return len(self.vectors) - len(self.failed)

    @property
    def failure_count(self) -> int:
        return len(self.failed)


class BatchPolicy:
    """Batch size with its bounds, growth and halving."""

    def __init__(self, batch_size: int = 32):
        self.set_size(batch_size)

    def set_size(self, size: int) -> None:
        low, high = fv.BATCH_SIZE_RANGE
        if not low <= size <= high:
            raise ValueError(f"Batch size must be between {low} and {high}")
        self.size = size

    def adjust(self, increase: bool) -> int:
        low, high = fv.BATCH_SIZE_RANGE
        self.size = (min(math.floor(self.size * fv.BATCH_GROWTH), high) if increase
                     else max(self.size // 2, low))
        return self.size


class BatchEmbedder:
    """Runs texts through a provider batch by batch; order in is order out.

    A batch whose request fails is tried up to ``tries`` times, then its texts
    one by one; a text that the provider gave up on is not sent again. Texts
    that still fail get an empty vector and their error text, and the run
    goes on, so one bad text never fails a Spark task.
    """

    def __init__(self, embed: Callable[[list[str]], list[list[float]]], *, batch_size: int = 32,
                 failures: Callable[[], dict[int, str]] = dict, tries: int = 3, pause: float = fv.PAUSE_BETWEEN_BATCHES,
                 item_pause: float = fv.PAUSE_BETWEEN_ITEMS, sleep: Callable[[float], None] = time.sleep):
        self.embed, self.failures, self.tries, self.sleep = embed, failures, tries, sleep
        self.pause, self.item_pause = pause, item_pause
        self.policy = BatchPolicy(batch_size)

    def run(self, texts: list[str], on_progress: Callable[[int, int], None] | None = None) -> BatchResult:
        result = BatchResult()
        size = self.policy.size
        for start in range(0, len(texts), size):
            batch = texts[start:start + size]
            vectors, errors = self._batch(batch)
            if not any(vectors):
                self.policy.adjust(False)
            result.vectors += vectors
            result.failed += [start + i for i, v in enumerate(vectors) if not v]
            result.errors.update({start + i: e for i, e in errors.items()})
            if on_progress:
                on_progress(min(start + size, len(texts)), len(texts))
            if self.pause and start + size < len(texts):
                self.sleep(self.pause)
        return result

    def _batch(self, batch: list[str]) -> tuple[list[list[float]], dict[int, str]]:
        for attempt in range(self.tries):
            try:
                vectors = self._checked(batch)
                return vectors, {i: e for i, e in self.failures().items() if not vectors[i]}
            except Exception:
                self.sleep(fv.RETRY_SECONDS[min(attempt, len(fv.RETRY_SECONDS) - 1)])
        vectors: list[list[float]] = []
        errors: dict[int, str] = {}
        for i, text in enumerate(batch):
            try:
                vectors += self._checked([text])
            except Exception as error:
                vectors.append([])
                errors[i] = str(error)
            if self.item_pause:
                self.sleep(self.item_pause)
        return vectors, errors

    def _checked(self, batch: list[str]) -> list[list[float]]:
        vectors = self.embed(batch)
        if len(vectors) != len(batch):
            raise ValueError(f"provider returned {len(vectors)} vectors for {len(batch)} texts")
        return vectors
