"""Tokens shared by the text operators."""

from __future__ import annotations

import re

#: A term: letters A-Z and U+00C0 to U+00FF without the two signs among them, three or more in a run.
TERM = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]{3,}")


def terms_of(text: str | None) -> list[str]:
    """Terms of a text in order, lower-cased after they were cut out; null counts as empty."""
    found = TERM.findall(text) if text else None
    return " ".join(found).lower().split(" ") if found else []
