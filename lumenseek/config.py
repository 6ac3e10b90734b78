"""Settings with the documented defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from lumenseek import fixed_values as fv

_BOUNDS = {
    "chunk_size": (100, 2000),
    "max_file_size": (1024, 1048576),
    "batch_size": (1, 100),
    "health_check_interval": (0, 600),
    "search_result_limit": (5, 100),
    "min_similarity": (0.0, 1.0),
}


@dataclass(frozen=True)
class Settings:
    """Everything that can change a result, plus the provider choices.

    ``chunk_size``, ``auto_index``, ``preferred_chunker``, ``tree_sitter_enabled``
    and ``index_model`` are accepted so that existing settings load; like
    in the tool being replaced, they do not influence any result.
    """

    chunk_size: int = 500
    max_file_size: int = 102400
    exclude_patterns: tuple[str, ...] = tuple(fv.EXCLUDE_GLOBS)
    supported_languages: tuple[str, ...] = tuple(fv.SCAN_EXTENSIONS)
    auto_index: bool = True
    batch_size: int = 32
    health_check_interval: int = 120
    preferred_chunker: str = "auto"
    tree_sitter_enabled: bool = True
    search_result_limit: int = 20
    min_similarity: float = 0.5
    enable_hybrid_search: bool = False
    embedding_provider: str = "ollama"
    ollama_url: str = "http://localhost:11434"
    ollama_embedding_model: str = "nomic-embed-text"
    openai_embedding_model: str = "text-embedding-3-small"
    openai_organization: str = ""
    index_model: str = "nomic-embed-text"
    enable_query_expansion: bool = False
    query_expansion_provider: str = "ollama"
    ollama_expansion_model: str = "llama3.2"
    openai_expansion_model: str = "gpt-4o-mini"
    hash_dimensions: int = field(default=64)

    def __post_init__(self) -> None:
        for name, (low, high) in _BOUNDS.items():
            value = getattr(self, name)
            if not low <= value <= high:
                raise ValueError(f"{name}={value} is outside [{low}, {high}]")

    def with_values(self, **changes) -> "Settings":
        known = {f.name for f in fields(self)}
        unknown = set(changes) - known
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **changes)
