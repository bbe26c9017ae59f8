"""Canonical JSON of a document on the driver: keys by UTF-16 code units, strings in NFC."""

from __future__ import annotations

import json
import math
import unicodedata
from typing import Any


class NotCanonical(ValueError):
    pass


ABSENT = object()  # a key with this value is left out


def code_units(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


def normal(value: Any) -> Any:
    """value with NFC strings and ordered keys; refuses what JSON has no form for."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise NotCanonical(f"not a finite number: {value}")
        return int(value) if value.is_integer() else value
    if isinstance(value, (list, tuple)):
        return [normal(None if v is ABSENT else v) for v in value]
    if isinstance(value, dict):
        out: dict[str, Any] = {}
        for key, v in value.items():
            if not isinstance(key, str):
                raise NotCanonical(f"a key that is no string: {key!r}")
            if v is ABSENT:
                continue
            name = unicodedata.normalize("NFC", key)
            if name in out:
                raise NotCanonical(f"two keys with one normal form: {name!r}")
            out[name] = normal(v)
        return dict(sorted(out.items(), key=lambda kv: code_units(kv[0])))
    raise NotCanonical(f"no JSON for {type(value).__name__}")


def serialize(value: Any, pretty: bool = False) -> str:
    text = json.dumps(normal(value), ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
    return text + "\n" if pretty else text


def identity(value: Any) -> str:
    """A string equal for equal documents, whatever their keys' order."""
    return serialize(value)


def code_points(s: str) -> str:
    return " ".join(f"U+{ord(c):04X}" for c in s)
