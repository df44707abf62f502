"""Redact values of sensitive keys at any depth of a JSON object text.

Key matching uses the producers' fixed pattern on decoded keys. JSON of unbounded depth cannot
be rewritten with built-in column functions, so a small Arrow-batched helper goes through the
tokens; texts that can't name a sensitive key reach it as null. What can't be read as JSON is
replaced as a whole, since a secret in it couldn't be found.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the sensitive-key pattern of the producer clients (case-insensitive).
SENSITIVE_KEY = r"token|secret|api.?key|authorization|cookie|passkey|signature|magnet"
REDACTED = "[REDACTED]"
_KEY = re.compile(SENSITIVE_KEY, re.IGNORECASE)


_TOKEN = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([{}\[\],:]))')


def _compact(text: str) -> str:
    """The text without white space and with sensitive values replaced; numbers keep their text.

    One pass over the tokens with an explicit stack, so any depth will do; ValueError if it is no JSON.
    """
    out, stack, at, end = [], [], 0, len(text.rstrip(" \t\r\n"))
    expect, secret, hidden = "value", False, None  # hidden: depth of the value that is left out

    def put(piece: str) -> None:
        if hidden is None:
            out.append(piece)

    while at < end:
        token = _TOKEN.match(text, at)
        if not token or expect == "end":
            raise ValueError("not JSON")
        at, (string, scalar, mark) = token.end(), token.groups()
        if string is not None and expect in ("key", "key or close"):
            key = json.loads(string)
            put(json.dumps(key, ensure_ascii=False))
            expect, secret = "colon", bool(_KEY.search(key))
            continue
        if mark == ":" and expect == "colon":
            put(":")
            expect = "value"
            if secret and hidden is None:
                out.append(json.dumps(REDACTED))
                hidden = len(stack)
            continue
        if mark == "," and expect == "comma or close":
            put(",")
            expect = "key" if stack[-1] == "{" else "value"
            continue
        if mark in ("{", "[") and expect in ("value", "value or close"):
            put(mark)
            stack.append(mark)
            expect = "key or close" if mark == "{" else "value or close"
            continue
        if mark in ("}", "]") and expect.endswith("close") and stack[-1] + mark in ("{}", "[]"):
            stack.pop()
            put(mark)
        elif mark is None and expect in ("value", "value or close"):
            put(scalar if string is None else json.dumps(json.loads(string), ensure_ascii=False))
        else:
            raise ValueError("not JSON")
        if hidden is not None and len(stack) == hidden:
            hidden = None
        expect = "comma or close" if stack else "end"
    if expect != "end":
        raise ValueError("not JSON")
    return "".join(out)


def redact_json_text(text: str | None) -> str | None:
    """Redacted text; null and text that can't name a sensitive key stay as they are, other
    text that is no JSON becomes the mark itself."""
    if text is None or not (_KEY.search(text) or "\\u" in text):
        return text
    try:
        return _compact(text)
    except ValueError:
        return REDACTED


@F.pandas_udf(StringType())
def _redact_udf(texts: pd.Series) -> pd.Series:
    return texts.map(redact_json_text)


def redact_sensitive(col) -> Column:
    """JSON object text with every sensitive key's value replaced by ``[REDACTED]``."""
    c = F.col(col) if isinstance(col, str) else col
    # a key can name a secret in plain text or through a JSON escape; other texts go to Python as null
    suspect = c.rlike(f"(?i)({SENSITIVE_KEY})") | c.contains("\\u")
    return F.when(suspect, _redact_udf(F.when(suspect, c))).otherwise(c)
