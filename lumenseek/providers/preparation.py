"""Query-side text preparation on the driver (one query at a time).

The table-side twin is ``functions.text.split_identifiers``.
"""

from __future__ import annotations

import re

from lumenseek import fixed_values as fv

_WS = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", fv.WS)


def split_identifiers(text: str, *, hyphens: bool = True) -> str:
    text = re.sub(fv.LOWER_UPPER, r"\1 \2", text)
    text = re.sub(fv.ACRONYM_WORD, r"\1 \2", text)
    text = text.replace("_", " ")
    if hyphens:
        text = text.replace("-", " ")
    return re.sub(f"^{_WS}+|{_WS}+$", "", re.sub(f"{_WS}+", " ", text))


def trim(text: str) -> str:
    return re.sub(f"^{_WS}+|{_WS}+$", "", text)


def tokenize(text: str) -> list[str]:
    """Driver-side twin of ``functions.text.tokenize``."""
    text = re.sub(fv.LOWER_UPPER, r"\1 \2", text)
    text = re.sub(fv.ACRONYM_WORD, r"\1 \2", text)
    text = re.sub(fv.TOKEN_DELIMITERS, " ", text).lower()
    return [w for w in re.split(f"{_WS}+", text) if len(w) > 1 or (w and ord(w) > 0xFFFF)]
