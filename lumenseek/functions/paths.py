"""Path functions: extension, base name, exclusion globs, relative paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lumenseek import fixed_values as fv
from lumenseek.functions.text import fixed_decimals


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; '' for none and for dot-files."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def is_supported(path: Column, extensions=tuple(fv.SCAN_EXTENSIONS)) -> Column:
    return extension(path).isin(*extensions)


def loose_regex(glob: str) -> str:
    """The loose exclusion rule: unanchored, dots unescaped, stars rewritten in turn."""
    return glob.replace("**", ".*").replace("*", "[^/]*").replace("?", ".")


def strict_regex(glob: str) -> str:
    """Real glob semantics, anchored; ``**/`` also matches no directory at all."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def is_excluded(path: Column, globs=tuple(fv.EXCLUDE_GLOBS), *, strict: bool = False) -> Column:
    """True where any glob matches; ``strict=False`` is the tool's own loose rule."""
    if not globs:
        return F.lit(False)
    to_regex = strict_regex if strict else loose_regex
    normal = F.replace(path, F.lit("\\"), F.lit("/"))
    return normal.rlike("|".join(f"(?:{to_regex(g)})" for g in globs))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; other paths stay as they are."""
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 2, 2**31 - 1)).otherwise(path)


def display_path(path: Column, root: str) -> Column:
    """Tree form of the relative path: only whole directory names count."""
    return F.when(path == root, "").when(
        F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 2**31 - 1)
    ).otherwise(path)


def format_bytes(size: Column) -> Column:
    """'0 B', else two decimals in the largest unit that leaves at least 1.

    Dividing by a power of two is exact, so rounding on the integer keeps
    the digits of the binary value.
    """
    size = size.cast("long")
    out = F.when(size == 0, "0 B")
    for i, unit in enumerate(fv.BYTE_UNITS):
        text = F.concat(fixed_decimals(size / F.lit(1024 ** i), 2), F.lit(f" {unit}"))
        if i + 1 < len(fv.BYTE_UNITS):
            out = out.when(size < F.lit(1024 ** (i + 1)), text)
        else:
            out = out.otherwise(text)
    return out
