"""Plans written once in the SQL that Spark and DuckDB share.

A plan names its input tables in braces. For Spark every input is a DataFrame that spark.sql() gets as an argument, so
Catalyst sees one tree from the Parquet scans on and no view is left behind. The same text, with the inputs as common
table expressions, is the DuckDB query that the plan is held against.

Where the two dialects differ, the text has one of the markers below. Fixtures that have a program in forms.FORMS are made
by it on Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .forms import FORMS

#: marker: (Spark, DuckDB); \1, \2 are its arguments, which hold no comma at their top level
MARKERS = {
    "JSONTEXT": (r"get_json_object(\1, \2)", r"json_extract_string(\1, \2)"),
    "MICROS": (r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", r"epoch_us(\1)"),
    "JOINED": (r"listagg(\1, ',') WITHIN GROUP (ORDER BY \2)", r"string_agg(\1, ',' ORDER BY \2)"),
    "ITEM": (r"get(\1, CAST(\2 AS INT))", r"list_extract(\1, CAST(\2 AS INT) + 1)"),
    "SIZE": (r"CAST(size(\1) AS BIGINT)", r"CAST(len(\1) AS BIGINT)"),
    "WORDS": (r"filter(split(\1, ' '), x -> x <> '')", r"list_filter(string_split(\1, ' '), lambda x: x <> '')"),
    "SWAP": (r"regexp_replace(\1, \2, \3)", r"regexp_replace(\1, \2, \3, 'g')"),
    "MATCHES": (r"(\1 RLIKE \2)", r"regexp_matches(\1, \2)"),
    "EXPLODED": (r"explode(\1)", r"unnest(\1)"),
    "PDF_OF": (r"(\1 % 10 + 10 * CAST(floor(\1 / 100) AS BIGINT))", r"(\1 % 10 + 10 * CAST(floor(\1 / 100) AS BIGINT))"),
    "HAS": (r"array_contains(\1, \2)", r"list_contains(\1, \2)"),
    "EACH": (r"transform(\1, x -> \2)", r"list_transform(\1, lambda x: \2)"),
    "SORTED": (r"sort_array(\1)", r"list_sort(\1)"),
    "SUMOF": (r"aggregate(\1, 0L, (s, x) -> s + x)", r"list_sum(\1)"),
    "PUT": (r"concat(\1, array(\2))", r"list_append(\1, \2)"),
    "ONE": (r"array(\1)", r"[\1]"),
    "UPTO": (r"sequence(\1, \2)", r"generate_series(\1, \2)"),
    "UNIQUE": (r"array_distinct(\1)", r"list_filter(\1, lambda x, i: list_position(\1, x) = i)"),
    "ALLOF": (r"regexp_extract_all(\1, \2, 0)", r"regexp_extract_all(\1, \2)"),
    "DISTANCE": (r"levenshtein(\1, \2)", r"levenshtein(\1, \2)"),
    "PICK": (r"regexp_extract(\1, \2, 1)", r"regexp_extract(\1, \2, 1)"),
    "ASCIILESS": (r"regexp_replace(\1, '[\\\\x00-\\\\x7F]', '')", r"regexp_replace(\1, '[\\x00-\\x7F]', '', 'g')"),
    "DOT": (r"aggregate(zip_with(\1, \2, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0e0, (s, x) -> s + x)", r"list_sum(list_transform(list_zip(\1, \2), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"),
    "HEAD": (r"slice(\1, 1, \2)", r"list_slice(\1, 1, \2)"),
    "TEXTOF": (r"array_join(\1, ' ')", r"array_to_string(\1, ' ')"),
    "HOLDS": (r"contains(\1, \2)", r"contains(\1, \2)"),
    "GATHERED": (r"transform(array_sort(collect_list(named_struct('a', \2, 'b', \3))), s -> s.b)", r"list(\1 ORDER BY \2, \3)"),
    "LINES": (r"listagg(\1, '\n\n') WITHIN GROUP (ORDER BY \2)", r"string_agg(\1, E'\n\n' ORDER BY \2)"),
    "REPEATED": (r"repeat(\1, \2)", r"repeat(\1, \2)"),
    "PARTS": (r"split(\1, '[|]')", r"string_split(\1, '|')"),
}


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose bracket opens at text[at], and where it ends."""
    out, depth, start, quoted = [], 0, at + 1, False
    for k in range(at, len(text)):
        c = text[k]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                return [*out, text[start:k].strip()], k + 1
        elif c == "," and depth == 1:
            out.append(text[start:k].strip())
            start = k + 1
    raise ValueError(f"unbalanced brackets: {text[at : at + 80]}")


def in_dialect(text: str, which: int) -> str:
    """text with its markers replaced, innermost last. which: 0 Spark, 1 DuckDB."""
    while m := re.search(rf"\b({'|'.join(MARKERS)})\(", text):
        args, end = arguments(text, m.end() - 1)
        new = re.sub(r"\\(\d)", lambda d: args[int(d[1]) - 1], MARKERS[m[1]][which])
        text = text[: m.start()] + new + text[end:]
    return text


#: Tables that the caller has as Parquet.
SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass
class Plan:
    """A query text and the fixture texts that it may name."""

    sql: str
    fixtures: dict[str, str]

    def inputs(self, sql: str | None = None) -> list[str]:
        """Fixtures that are needed, each after those it needs."""
        out: list[str] = []
        for name in dict.fromkeys(re.findall(r"\{(\w+)\}", self.sql if sql is None else sql)):
            if name in self.fixtures:
                out += [x for x in [*self.inputs(self.fixtures[name]), name] if x not in out]
        return out

    def frame(self, spark: SparkSession, tables: Callable[[str], DataFrame]) -> DataFrame:
        made: dict[str, DataFrame] = {}

        def named(name: str) -> DataFrame:
            if name not in made:
                if name not in self.fixtures:
                    return tables(name)
                program, needs = FORMS.get(name, (None, ()))
                made[name] = program(*map(named, needs)) if program else run(self.fixtures[name])
            return made[name]

        def run(sql: str) -> DataFrame:
            text = in_dialect(sql, 0)
            return spark.sql(text, **{n: named(n) for n in set(re.findall(r"\{(\w+)\}", text))})

        return run(self.sql)

    def duckdb(self) -> str:
        ctes = [f"{n} AS ({in_dialect(self.fixtures[n], 1)})" for n in self.inputs()]
        body = in_dialect(self.sql, 1)
        head = f"WITH RECURSIVE {', '.join(ctes)} " if ctes else ""
        text = f"{head}SELECT * FROM ({body}) AS q"
        return re.sub(r"\{([a-z]\w*)\}", r"\1", text)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.frame(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
