"""Read JSON that a language model wrapped in prose or cut off."""

from __future__ import annotations

import json
import re


def repair(text: str | None) -> str:
    """A JSON text: what stands first in ``text``, with a cut-off last element left out.

    Null and empty texts give ``[]``; a text without any bracket raises ValueError.
    """
    if not text or not text.strip():
        return "[]"
    fence = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    body = fence[1] if fence else text
    at = min((i for i in (body.find("["), body.find("{")) if i >= 0), default=-1)
    if at < 0:
        raise ValueError("no JSON in the text")
    body = body[at:].strip()
    try:
        return json.dumps(json.JSONDecoder().raw_decode(body)[0])
    except ValueError:
        pass
    # places where a value has just ended, and the brackets open there
    open_, ends, string, escaped = [], [], False, False
    for i, c in enumerate(body):
        if string:
            string, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
            continue
        if c == '"':
            string = True
        elif c in "[{":
            open_.append("]" if c == "[" else "}")
        elif c in "]}":
            if open_:
                open_.pop()
            ends.append((i + 1, "".join(reversed(open_))))
    for candidate in [re.sub(r",\s*([\]}])", r"\1", body), *(body[:i] + rest for i, rest in reversed(ends))]:
        try:
            return json.dumps(json.loads(candidate))
        except ValueError:
            continue
    return "[]"
