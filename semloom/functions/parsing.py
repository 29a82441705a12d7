"""Reading model replies: booleans, JSON, and one-to-many shaping."""

from __future__ import annotations

import json
import re
from typing import Any

_ANSWER = re.compile(r"answer\s*:", re.I)


def answer_part(reply: str) -> str:
    """What stands after ``ANSWER:`` up to ``---``; the whole reply without that mark."""
    m = _ANSWER.search(reply)
    return reply[m.end() :].split("---", 1)[0].strip() if m else reply.strip()


def parse_boolean(reply: str | None) -> bool | None:
    """True or False by the first of the two words asked for, ``true`` winning; None if the reply has neither."""
    part = answer_part(reply or "").lower()
    return True if "true" in part else False if "false" in part else None


def parse_answer_json(reply: str | None) -> Any:
    """The outermost object or list in a reply; comments, ``\\_`` and line ends are forgiven. None if there is none."""
    part = answer_part(reply or "")
    spots = [i for i in (part.find("{"), part.find("[")) if i >= 0]
    if not spots:
        return None
    start = min(spots)
    end = part.rfind("}" if part[start] == "{" else "]")
    body = part[start : end + 1].replace("\\_", "_")
    for attempt in (body, re.sub(r"(?m)(^|\s)//[^\n]*$|/\*.*?\*/", " ", body).replace("\n", " ")):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None


def shape_many(answer: Any, names: list[str]) -> list[dict]:
    """Records of a one-to-many answer: a list of objects, an object of lists, or one object; missing fields are None."""
    if isinstance(answer, dict):
        if any(isinstance(answer.get(n), list) for n in names):
            size = max(len(v) for n in names if isinstance(v := answer.get(n), list))
            return [{n: v[i] if isinstance(v := answer.get(n), list) and i < len(v) else None if isinstance(answer.get(n), list) else answer.get(n) for n in names} for i in range(size)]
        answer = [answer]
    return [{n: x.get(n) for n in names} for x in answer if isinstance(x, dict)] if isinstance(answer, list) else []
