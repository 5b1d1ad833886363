"""Identifiers: ASCII letters, digits, underscores, hyphens and full stops, starting with a letter or underscore."""

from __future__ import annotations

import re


def is_valid(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", name) is not None


def upper(name: str) -> str:
    return "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in name)


def lower(name: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)
