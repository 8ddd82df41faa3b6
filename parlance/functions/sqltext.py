"""Small helpers for column builders that write SQL expression text.

Rule tables become long expressions; one parsed string is built far faster than
thousands of single Column calls, and reads like the SQL it is.
"""

from __future__ import annotations


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(pattern: str) -> str:
    """Raw string literal, for patterns."""
    return 'r"' + pattern + '"'


def texts(values) -> str:
    return "array(" + ", ".join(text(v) for v in values) + ")"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once per row.

    Binding keeps long expressions linear in size even where the optimizer
    copies them, such as into a pushed-down filter."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
