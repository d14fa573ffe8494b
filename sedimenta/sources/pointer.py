"""RFC 6901 JSON pointers."""

from __future__ import annotations

import re

SHAPE = re.compile(r"(?:/(?:[^~/]|~0|~1)*)*")
INDEX = re.compile(r"0|[1-9][0-9]*")
ABSENT = object()


def tokens(pointer: str) -> tuple[str, ...] | None:
    """The steps of a pointer; None if it isn't one.  The empty pointer is the whole document."""
    if not SHAPE.fullmatch(pointer):
        return None
    return tuple(t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:])


def resolve(value, steps: tuple[str, ...]):
    """What a pointer leads to, or ABSENT."""
    for step in steps:
        if isinstance(value, dict):
            value = value.get(step, ABSENT)
        elif isinstance(value, list) and INDEX.fullmatch(step) and int(step) < len(value):
            value = value[int(step)]
        else:
            return ABSENT
        if value is ABSENT:
            return ABSENT
    return value
