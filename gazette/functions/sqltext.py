"""Small helpers to write expressions as SQL text.

Long expressions go to Spark as one text: building them from Column objects costs a driver round trip per node.
"""

from __future__ import annotations


def raw(pattern: str) -> str:
    """A regular expression as a raw SQL literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def literal(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def group(text: str, pattern: str, index: int) -> str:
    return f"regexp_extract({text}, {raw(pattern)}, {index})"


def number(text: str, pattern: str, index: int, default: int | None = None) -> str:
    """A group as an integer; an empty group gives ``default``, or null."""
    value = f"try_cast({group(text, pattern, index)} AS INT)"
    return value if default is None else f"coalesce({value}, {default})"


def lookup(values: dict[str, str | int], key: str) -> str:
    """Look ``key`` up in a literal map; null when it is not there."""
    pairs = ", ".join(f"{literal(name)}, {literal(value)}" for name, value in values.items())
    return f"try_element_at(map({pairs}), {key})"
