"""Embedding a text column through a provider, in Arrow batches inside tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenseek.functions.vector import has_vector
from lumenseek.providers.batching import BatchEmbedder
from lumenseek.providers.embedding import EmbeddingProvider
from lumenseek.schema import EMBEDDED
from lumenseek.session import ship_package

#: Requests whose texts and vectors are Python objects at a time; the rest of an Arrow batch stays in its buffers.
SLICE = 16


def embed(df: DataFrame, prepared, provider: EmbeddingProvider, *, batch_size: int | None = None,
          pause: float = 0.0, tries: int = 3, max_concurrency: int | None = None,
          sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds ``vector``, ``tokens_used`` and ``embed_error`` for a prepared text column.

    The vector stays in its text's row, so nothing is ever joined by position.
    ``max_concurrency`` bounds how many tasks call a service at a time, by an
    exchange that leaves the stages before it their own partitions; leave it out
    for providers that run inside the task. A request budget is divided by it,
    or by the session's cores. ``batch_size`` is what the service takes in a
    request, or 32. ``sleep`` waits between tries and requests.
    """
    ship_package(df.sparkSession)
    size = batch_size or provider.batch_limit or 32
    size = min(size, provider.batch_limit or size)
    provider.shared_by(max_concurrency or df.sparkSession.sparkContext.defaultParallelism)
    if max_concurrency:
        df = df.repartition(max_concurrency)

    step = SLICE * size
    kind = to_arrow_type(EMBEDDED)

    @F.arrow_udf(EMBEDDED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider.open()
        embedder = BatchEmbedder(provider.embed, failures=lambda: provider.failures, batch_size=size,
                                 pause=pause, item_pause=pause / 2, tries=tries, sleep=sleep)

        def embedded(texts: list) -> pa.Array:
            before = provider.tokens_used
            done = embedder.run(texts)
            used = [provider.tokens_used - before] + [0] * (len(texts) - 1)
            columns = [done.vectors, used, [done.errors.get(i) for i in range(len(texts))]]
            return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))

        try:
            for texts in batches:
                parts = []
                for at in range(0, len(texts), step):
                    if at and pause:
                        sleep(pause)
                    parts.append(embedded(texts.slice(at, step).to_pylist()))
                yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        finally:
            provider.dispose()

    # Nondeterministic, so that no filter on the result is pushed below the call
    # and makes it a second time.
    done = df.withColumn("_embedded", run.asNondeterministic()(prepared))
    return done.select(
        *df.columns, F.col("_embedded.vector").alias("vector"),
        F.col("_embedded.tokens_used").alias("tokens_used"),
        F.when(has_vector(F.col("_embedded.vector")), F.lit(None)).otherwise(
            F.coalesce("_embedded.error", F.lit("empty vector"))).alias("embed_error"))


def retry_failed(embedded: DataFrame, prepared, provider: EmbeddingProvider, *, key: str = "id",
                 **options) -> DataFrame:
    """Embed only the failed rows again and put their vectors in place."""
    from lumenseek.operators.batching import merge_retried, split_failed

    _, failed = split_failed(embedded)
    again = embed(failed.drop("vector", "tokens_used", "embed_error"), prepared, provider, **options)
    return merge_retried(embedded, again, key)
