"""JSN01: the JSON in a model's answer, as a VARIANT."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def strict(c: Column) -> Column:
    """c as a VARIANT if the whole of it is one JSON value, else null. The engine's own parser passes over what follows a value, so c is read as a field between two others."""
    read = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit(',"end":1}')))
    fields = F.try_variant_get(read, "$", "map<string,variant>")
    return F.when((F.size(fields) == 2) & (F.try_variant_get(read, "$.end", "int") == 1), F.try_variant_get(read, "$.v", "variant"))


def objects_end(text: str | None) -> str | None:
    """text up to the end of its last complete object that stands in no other one; null without one."""
    end, depth, quoted, escaped = 0, 0, False, False
    for k, c in enumerate(text or ""):
        if escaped:
            escaped = False
        elif quoted and c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                end = k + 1
    return text[:end] if end > 1 else None


def parsed(c: Column) -> Column:
    """The first array or object in c without code fences, read strictly; of an object with something behind it, the part up to the last complete object is read.

    Of an array with something behind it, or cut off, nothing is read: there the rule puts a bracket before that part and
    one behind it, so one stays open. Only what the engine's parser can't read is scanned in Python.
    """

    def scanned(texts: pd.Series) -> pd.Series:
        return texts.map(objects_end)

    clean = F.btrim(F.regexp_replace(F.regexp_replace(c, "```json\n?", ""), "```\n?", ""), F.lit(" \t\n\r"))
    part = bound(clean, lambda x: F.regexp_extract(x, r"(?s)[\[{].*", 0))

    def read(x: Column) -> Column:
        whole = strict(x)
        rest = F.pandas_udf(scanned, "string")(F.when(whole.isNull() & F.startswith(x, F.lit("{")), x))
        return F.coalesce(whole, strict(rest))

    return read(part)
