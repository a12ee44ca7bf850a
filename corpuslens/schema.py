"""Levels of the text-object tree and their key columns."""

from __future__ import annotations

LEVELS = ("doc", "div1", "div2", "div3", "para", "sent", "word")
#: Key columns of an object of each level.
KEYS = {level: LEVELS[: k + 1] for k, level in enumerate(LEVELS)}
SENTENCE = KEYS["sent"]
PARAGRAPH = KEYS["para"]


def keys_of(level: str) -> tuple[str, ...]:
    """Key columns of a level; ``div`` is any depth of division and has no key of its own."""
    if level not in KEYS:
        raise ValueError(f"unknown level: {level}")
    return KEYS[level]


def known_columns(given: list[str] | tuple[str, ...], there: list[str]) -> list[str]:
    """The given column names, if all are there."""
    if missing := [c for c in given if c not in there]:
        raise ValueError(f"unknown fields: {', '.join(missing)}")
    return list(given)
