"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from lumenseek import fixed_values as fv


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])


def lookup(table: dict, key: Column, default) -> Column:
    """Value of a small fixed table for ``key``, else ``default``."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.element_at(literal_map(table), key), default)


#: The same class as ``fv.WS``, written so that java.util.regex decides on an
#: ordinary character after two checks instead of eight.
WS_JAVA = (
    r"[\t\n\x0B\f\r \x{00A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
)
_WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff")


def trim_ws(c: Column) -> Column:
    """Strip ECMAScript white space on both ends (Spark's trim strips only blanks)."""
    return F.btrim(c, F.lit(_WS_CHARS))


def is_blank(c: Column) -> Column:
    return trim_ws(c) == ""


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS_JAVA}+", " "))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, the unit every length rule counts in."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _split_case(c: Column) -> Column:
    c = F.regexp_replace(c, fv.LOWER_UPPER, "$1 $2")
    return F.regexp_replace(c, fv.ACRONYM_WORD, "$1 $2")


def split_identifiers(c: Column, *, hyphens: bool) -> Column:
    """Spread identifiers into words.

    ``hyphens=True`` is the query-side form, ``False`` the index-side form,
    which leaves hyphens alone.
    """
    c = F.regexp_replace(_split_case(c), "_", " ")
    if hyphens:
        c = F.regexp_replace(c, "-", " ")
    return collapse_ws(c)


def with_prefix(prefix: str | None, c: Column) -> Column:
    return F.concat(F.lit(f"{prefix} "), c) if prefix else c


def spread_tokens(c: Column) -> Column:
    """Lower-case text with identifiers split and delimiters made blanks."""
    return F.lower(F.regexp_replace(_split_case(c), fv.TOKEN_DELIMITERS, " "))


def tokenize(c: Column) -> Column:
    """Lower-case search tokens of two or more characters, duplicates kept."""
    # A single astral character is two UTF-16 units and therefore stays.
    return F.filter(
        F.split(spread_tokens(c), f"{WS_JAVA}+"),
        lambda t: (F.length(t) > 1) | t.rlike(r"[\x{10000}-\x{10FFFF}]"),
    )


def token_estimate(c: Column) -> Column:
    """Estimated model tokens: 3.5 characters each plus 0.3 per newline."""
    squeezed = F.regexp_replace(c, "[ \t]+", " ")
    newlines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    raw = utf16_length(squeezed) / F.lit(fv.CHARS_PER_TOKEN) + newlines * F.lit(fv.TOKENS_PER_NEWLINE)
    return (
        F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0)
        .otherwise(F.greatest(F.lit(1), F.floor(raw + 0.5)))
        .cast("int")
    )


def token_estimate_simple(c: Column) -> Column:
    return (
        F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0)
        .otherwise(F.greatest(F.lit(1), F.ceil(utf16_length(c) / fv.CHARS_PER_TOKEN_SIMPLE)))
        .cast("int")
    )


def identifier_name(text: Column, chunk_type: Column) -> Column:
    """Declared name for the eight chunk types that have one, else NULL."""
    out = None
    for kind, pattern in fv.IDENTIFIER_NAME.items():
        name = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        out = F.when(chunk_type == kind, name) if out is None else out.when(chunk_type == kind, name)
    return out


def type_label(chunk_type: Column) -> Column:
    return lookup(fv.TYPE_LABELS, chunk_type, chunk_type)


def type_plural(chunk_type: Column) -> Column:
    return lookup(fv.TYPE_PLURALS, chunk_type, chunk_type)


def type_icon(chunk_type: Column) -> Column:
    return lookup(fv.TYPE_ICONS, chunk_type, fv.DEFAULT_ICON)


def embedding_input(language: Column, file_path: Column, chunk_type: Column, text: Column) -> Column:
    """What gets embedded for a chunk: language, file, kind, name, blank line, code."""
    from lumenseek.functions.paths import base_name

    name = identifier_name(text, chunk_type)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.upper(language), F.lit("]")),
        F.nullif(base_name(file_path), F.lit("")),
        type_label(chunk_type),
        F.concat(F.lit("Name: "), name),
        F.lit(""),
        text,
    )


def preview(text: Column, width: int = fv.PREVIEW_WEB) -> Column:
    return F.substring(collapse_ws(text), 1, width)


def tree_preview(text: Column) -> Column:
    dots = F.when(utf16_length(text) > fv.PREVIEW_TREE, "...").otherwise("")
    return F.concat(preview(text, fv.PREVIEW_TREE), dots)


def html_escape(c: Column) -> Column:
    """Escape as a browser does when a text node is serialised."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def fixed_decimals(value: Column, digits: int) -> Column:
    """Decimal text of a non-negative number, halves rounded up on its binary value."""
    scale = 10 ** digits
    n = F.floor(value * scale + 0.5).cast("long")
    whole = F.floor(n / scale).cast("long")
    return F.concat(
        whole.cast("string"), F.lit("."), F.lpad((n - whole * scale).cast("string"), digits, "0")
    )


def expansion_terms(reply: Column, key: str) -> Column:
    """Non-empty string items of one list in the JSON object inside a model reply.

    The object spans from the first ``{`` to the last ``}``; a reply that does
    not parse, or whose field is no list, gives an empty list.
    """
    block = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    # Variant keeps each item's own type, so numbers and null are not
    # turned into text the way an ARRAY<STRING> schema would turn them.
    items = F.try_variant_get(F.try_parse_json(block), f"$.{key}", "array<variant>")
    texts = F.transform(
        F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.try_variant_get(v, "$", "string"),
    )
    kept = F.filter(texts, lambda s: F.length(s) > 0)
    return F.coalesce(kept, F.array().cast("array<string>"))


def expanded_query(query: Column, synonyms: Column, related: Column) -> Column:
    return F.concat_ws(" ", query, synonyms, related)
