"""Text predicates that fold and trim exactly as far as the data model says."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, functions as F


def ascii_lower(column) -> Column:
    """Lower case of A-Z only; other scripts stay as they are."""
    return F.translate(column, ascii_uppercase, ascii_lowercase)


def ascii_lower_text(text: str) -> str:
    return text.translate(str.maketrans(ascii_uppercase, ascii_lowercase))


def is_blank(column) -> Column:
    """Null, empty or Unicode white space only."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNull() | column.rlike(r"(?U)^\s*$")
