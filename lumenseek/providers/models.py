"""Registry of embedding models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from lumenseek import fixed_values as fv
from lumenseek.functions import text as tx
from lumenseek.providers import preparation


@dataclass(frozen=True)
class EmbeddingModel:
    name: str
    dimensions: int
    max_tokens: int
    query_prefix: str | None
    document_prefix: str | None
    normalize: bool

    @property
    def task_prefix_supported(self) -> bool:
        return self.query_prefix is not None

    def prepare(self, text: str, *, is_query: bool | None = None, preprocess: bool = True) -> str:
        """Driver-side preparation; the prefix is added only if the use is known."""
        if preprocess:
            text = preparation.split_identifiers(text)
        prefix = None
        if is_query is not None:
            prefix = self.query_prefix if is_query else self.document_prefix
        return f"{prefix} {text}" if prefix else text

    def prepared(self, text: Column, *, is_query: bool | None = None, preprocess: bool = True) -> Column:
        """Table-side twin of :meth:`prepare`."""
        if preprocess:
            text = tx.split_identifiers(text, hyphens=True)
        if is_query is None:
            return text
        return tx.with_prefix(self.query_prefix if is_query else self.document_prefix, text)


def index_prepared(text: Column, *, is_query: bool = False) -> Column:
    """Preparation of the index path: hyphens stay, the prefix is always added."""
    prefix = fv.INDEX_QUERY_PREFIX if is_query else fv.INDEX_DOCUMENT_PREFIX
    return tx.with_prefix(prefix, tx.split_identifiers(text, hyphens=False))


def embedding_model(provider: str, name: str) -> EmbeddingModel:
    try:
        dims, tokens, query, document, normalize = fv.EMBEDDING_MODELS[(provider, name)]
    except KeyError:
        raise ValueError(f"unknown embedding model {name!r} of provider {provider!r}") from None
    return EmbeddingModel(name, dims, tokens, query, document, normalize)


def models_of(provider: str) -> list[str]:
    return [name for owner, name in fv.EMBEDDING_MODELS if owner == provider]
