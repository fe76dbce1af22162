"""Names and phrases, on the driver."""

from __future__ import annotations

import re
import unicodedata


def question_text(text: str) -> str:
    """Lower case, compatibility forms, no possessives, and only letters, digits, & _ - between single spaces."""
    text = unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'").lower()
    text = re.sub(r"'s\b", "", text)
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9&_-]+", " ", text)).strip()


def label_text(text: object) -> str:
    text = unicodedata.normalize("NFKC", str(text)).lower()
    return re.sub(r"[^a-z0-9]+", " ", text).strip()


def unique_names(names: list[str]) -> list[str]:
    """Repeated names numbered from _2 on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def safe_stem(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "document"
