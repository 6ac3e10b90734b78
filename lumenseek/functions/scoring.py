"""Display scores, re-rank signals, progress and report arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lumenseek import fixed_values as fv
from lumenseek.functions.text import WS_JAVA, fixed_decimals, literal_map, spread_tokens


def display_score(similarity: Column) -> Column:
    return F.floor(similarity * 100 + 0.5).cast("int")


def low_relevance(similarity: Column) -> Column:
    return similarity < fv.LOW_RELEVANCE_BELOW


def _parts_of(token: str) -> list[str]:
    """All substrings of a token that are tokens themselves, longest first."""
    found = {token[i:j] for i in range(len(token)) for j in range(i + 1, len(token) + 1)}
    kept = [p for p in found if len(p) > 1 or ord(p) > 0xFFFF]
    return sorted(kept, key=lambda p: (-len(p), p))


def token_match_ratio(query_tokens: list[str], text: Column) -> Column:
    """Share of query tokens that lie inside, or contain, some token of a text.

    White space separates tokens and query tokens have none, so "inside some
    token" is a plain substring test on the spread text, and "contains some
    token" is one pattern over the parts of the query token. No token array is
    built per row.
    """
    if not query_tokens:
        return F.lit(0.0)
    spread = spread_tokens(F.lower(text))
    hits = None
    for token in query_tokens:
        parts = "|".join(re.escape(p) for p in _parts_of(token))
        whole = f"(?:^|{WS_JAVA})(?:{parts})(?:{WS_JAVA}|$)"
        hit = F.when(F.contains(spread, F.lit(token)) | spread.rlike(whole), 1).otherwise(0)
        hits = hit if hits is None else hits + hit
    return hits / F.lit(len(query_tokens))


def path_match(query_tokens: list[str], path: Column) -> Column:
    """1 if any query token lies inside any token of a path, else 0."""
    spread = spread_tokens(F.lower(path))
    hit = F.lit(False)
    for token in query_tokens:
        hit = hit | F.contains(spread, F.lit(token))
    return F.when(hit, 1.0).otherwise(0.0)


def type_bonus(chunk_type: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(fv.TYPE_BONUS), chunk_type), F.lit(fv.DEFAULT_TYPE_BONUS))


def rerank_score(similarity: Column, ratio: Column, path: Column, bonus: Column) -> Column:
    w = fv.RERANK_WEIGHTS
    return w["similarity"] * similarity + w["tokens"] * ratio + w["path"] * path + w["type"] * bonus


def percentage(current: Column, total: Column) -> Column:
    return F.floor(current / total * 100 + 0.5).cast("int")


def band_percentage(phase: str, fraction: Column) -> Column:
    """Overall progress of an index run inside the band its phase owns."""
    start, width = fv.PROGRESS_BANDS[phase]
    return F.lit(float(start)) + fraction * width


def processing_seconds(chunks: Column, batch_size: int) -> Column:
    return (F.ceil(chunks / batch_size) * fv.SECONDS_PER_BATCH).cast("long")


def success_rate_text(ok: Column, total: Column) -> Column:
    return fixed_decimals(F.try_divide(ok, total) * 100, 1)


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count > 1, "s").otherwise(""))


def result_tooltip(similarity: Column, chunk_type: Column, start: Column, end: Column) -> Column:
    """Text lines of a result's tooltip, without the code block."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Score: "), display_score(similarity).cast("string"), F.lit("% (similarity: "),
                 fixed_decimals(similarity * 100, 1), F.lit("%)")),
        F.when(low_relevance(similarity), "Low Relevance - May not be relevant to your query"),
        F.concat(F.lit("Type: "), chunk_type),
        F.concat(F.lit("Lines: "), start.cast("string"), F.lit("-"), end.cast("string")),
    )
