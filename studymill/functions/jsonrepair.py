"""Tolerant reading of JSON arrays that a model wrote (JSN01, JSN02)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scan(text: str) -> str:
    """JSON from near-JSON: double quotes, quoted keys, no trailing commas, closed strings and brackets."""
    out: list[str] = []
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "\"'":
            i, word = read_string(text, i + 1, c)
            out.append(json.dumps(word, ensure_ascii=False))
            continue
        if c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            drop_comma(out)
            if stack:
                stack.pop()
            out.append(c)
            i += 1
            if not stack:
                break
            continue
        elif m := re.compile(r"[A-Za-z_][\w-]*(?=\s*:)").match(text, i):
            out.append(json.dumps(m[0]))
            i = m.end()
            continue
        out.append(c)
        i += 1
    drop_comma(out)
    while stack and out and out[-1] == ":":
        out.pop()
    return "".join(out) + "".join(reversed(stack))


def drop_comma(out: list[str]) -> None:
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()


def read_string(text: str, i: int, quote: str) -> tuple[int, str]:
    """(position behind it, value) of a string; a quote inside it is one that no separator follows."""
    word: list[str] = []
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            e = text[i + 1]
            if e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                word.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
            else:
                word.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
                i += 2
        elif c == quote and re.match(r"\s*([,:\]}]|$)", text[i + 1 : i + 40]):
            return i + 1, "".join(word)
        else:
            word.append(c)
            i += 1
    return i, "".join(word)


def repaired(text: str | None) -> str | None:
    """The first JSON array in text as JSON; one object is an array of one; null if there is none."""
    if not text:
        return None
    text = re.sub(r"```(?:json)?", "", text).replace("“", '"').replace("”", '"')
    at = min((k for k in (text.find("["), text.find("{")) if k >= 0), default=-1)
    if at < 0:
        return None
    for attempt in (lambda: json.JSONDecoder().raw_decode(text[at:])[0], lambda: json.loads(scan(text[at:]))):
        try:
            found = attempt()
        except (ValueError, IndexError):
            continue
        found = found if isinstance(found, list) else [found]
        return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    return None


def repair_json(column: Column) -> Column:
    """repaired() of each text, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repaired)

    return F.pandas_udf(run, "string")(column)
