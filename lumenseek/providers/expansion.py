"""Query expansion: providers, reply parsing and the bounded memo."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from lumenseek import fixed_values as fv
from lumenseek.config import Settings
from lumenseek.providers.preparation import trim
from lumenseek.providers.transport import JsonTransport, RequestBudget


@dataclass(frozen=True)
class ExpansionResult:
    original_query: str
    synonyms: list[str] = field(default_factory=list)
    related_terms: list[str] = field(default_factory=list)
    cached: bool = False
    tokens_used: int | None = None

    @property
    def expanded_query(self) -> str:
        return " ".join([self.original_query, *self.synonyms, *self.related_terms])


def parse_reply(reply: str) -> tuple[list[str], list[str]]:
    """Synonyms and related terms of a model reply; anything unreadable gives none.

    The table-side twin is ``functions.text.expansion_terms``.
    """
    block = re.search(r"\{.*\}", reply, re.S)
    try:
        parsed = json.loads(block[0]) if block else {}
    except ValueError:
        parsed = {}

    def terms(key: str) -> list[str]:
        items = parsed.get(key) if isinstance(parsed, dict) else None
        return [t for t in items if isinstance(t, str) and t] if isinstance(items, list) else []

    return terms("synonyms"), terms("related")


def prompt(query: str, synonyms: int, related: int, hint: str) -> str:
    return (
        f"List search terms for this code search.\nSearch: {query}\nCode base: {hint}\n"
        f"Give at most {synonyms} synonyms and at most {related} related technical terms.\n"
        'Answer with one JSON object and nothing else: {"synonyms": [...], "related": [...]}'
    )


class LocalServerExpansion:
    name = "ollama"

    def __init__(self, model: str, url: str = "http://localhost:11434", transport=None):
        self.model, self.transport = model, transport or JsonTransport(url)

    def check_connection(self) -> bool:
        try:
            self.transport.call("/api/tags", timeout=5)
            return True
        except Exception:
            return False

    def expand(self, query: str, *, synonyms: int, related: int, hint: str, timeout: float) -> ExpansionResult:
        """A failing service gives the query itself, never an error."""
        try:
            reply = self.transport.call("/api/generate", {
                "model": self.model, "prompt": prompt(query, synonyms, related, hint), "stream": False,
                "options": {"temperature": fv.EXPANSION_TEMPERATURE}}, timeout=timeout)
            return ExpansionResult(query, *parse_reply(reply["response"]))
        except Exception:
            return ExpansionResult(query)


class HostedExpansion:
    name = "openai"

    def __init__(self, model: str, api_key: str, organization: str = "", *,
                 url: str = "https://api.openai.com/v1", transport=None):
        headers = {"Authorization": f"Bearer {api_key}"}
        if organization:
            headers["OpenAI-Organization"] = organization
        self.model, self.transport = model, transport or JsonTransport(url, headers)
        self.budget = RequestBudget(fv.HOSTED_EXPAND_PER_MINUTE)

    def check_connection(self) -> bool:
        try:
            self.transport.call("/models", timeout=5)
            return True
        except Exception:
            return False

    def expand(self, query: str, *, synonyms: int, related: int, hint: str, timeout: float) -> ExpansionResult:
        self.budget.acquire()
        try:
            reply = self.transport.call("/chat/completions", {
                "model": self.model, "temperature": fv.EXPANSION_TEMPERATURE,
                "max_tokens": fv.EXPANSION_TOKEN_CAP,
                "messages": [{"role": "user", "content": prompt(query, synonyms, related, hint)}],
            }, timeout=timeout)
            terms = parse_reply(reply["choices"][0]["message"]["content"])
            return ExpansionResult(query, *terms, tokens_used=reply.get("usage", {}).get("total_tokens"))
        except Exception:
            return ExpansionResult(query)


class QueryExpander:
    """Expansion with a memo of 100 entries; the oldest entry gives way."""

    def __init__(self, provider=None, cache_size: int = fv.EXPANSION_CACHE_SIZE):
        self.provider, self.cache_size = provider, cache_size
        self._memo: dict[str, ExpansionResult] = {}

    @property
    def enabled(self) -> bool:
        return self.provider is not None

    @property
    def provider_name(self) -> str | None:
        return self.provider.name if self.provider else None

    def clear(self) -> None:
        self._memo.clear()

    def detailed(self, query: str, *, synonyms: int = fv.EXPANSION_SYNONYMS,
                 related: int = fv.EXPANSION_RELATED, hint: str = "source code",
                 timeout: float = 5.0) -> ExpansionResult:
        if not self.provider:
            return ExpansionResult(query)
        key = f"{trim(query.lower())}:{synonyms}:{related}"
        if key in self._memo:
            return replace(self._memo[key], cached=True)
        try:
            result = self.provider.expand(query, synonyms=synonyms, related=related, hint=hint, timeout=timeout)
        except Exception:
            return ExpansionResult(query)
        if len(self._memo) >= self.cache_size:
            del self._memo[next(iter(self._memo))]
        self._memo[key] = result
        return result

    def expand(self, query: str, **options) -> str:
        return self.detailed(query, **options).expanded_query


def create_expander(settings: Settings, api_key: str | None = None, transport=None) -> QueryExpander:
    """Expander of the settings; the hosted one without a key leaves expansion off."""
    kind = settings.query_expansion_provider
    if not settings.enable_query_expansion or kind == "none":
        return QueryExpander()
    if kind == "ollama":
        return QueryExpander(LocalServerExpansion(settings.ollama_expansion_model, settings.ollama_url, transport))
    if kind == "openai":
        if not api_key:
            return QueryExpander()
        return QueryExpander(HostedExpansion(settings.openai_expansion_model, api_key,
                                             settings.openai_organization, transport=transport))
    raise ValueError(f"unknown expansion provider {kind!r}")
