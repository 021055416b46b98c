"""Byte-level BPE vocabularies as rank tables (bounded by the vocabulary: tens of thousands of entries)."""

from __future__ import annotations

import base64
import json

_ENCODINGS: dict = {}


def _printable() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a vocabulary file in the .tiktoken or the .json form, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            data, byte = json.load(f), _printable()
            special = {t["content"] for t in data.get("added_tokens", ())}
            return {bytes(byte[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a .json vocabulary file -> id; a .tiktoken file has none.

    They are matched in the text before it is split, as the tokenizers library does by default. Forms that need more than
    the literal string are refused.
    """
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    added = data.get("added_tokens", ())
    names = [t["content"] for t in added]
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) or data.get("normalizer") or any(a != b and a.startswith(b) for a in names for b in names):
        raise ValueError("added tokens are matched literally only")
    return {t["content"]: t["id"] for t in added}


def encoding(ranks: dict[bytes, int], pattern: str, key: str, added: dict[str, int] | None = None):
    """The encoder of a vocabulary, made once in each Python worker."""
    own = (key, tuple(sorted((added or {}).items())))
    if own not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[own] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    return _ENCODINGS[own]
