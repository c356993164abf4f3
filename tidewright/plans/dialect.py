"""One SQL text for Spark and for the oracle.

Queries are written once over the names of the tables; the few functions that are spelled
differently are macros.  Spark gets the tables as DataFrames by name (no temporary views),
so scans stay prunable and nothing leaks into the session's catalog.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MACROS = {
    "OCTETS": ("octet_length({0})", "octet_length(encode({0}))"),
    "SHA256": ("sha2({0}, 256)", "sha256({0})"),
    "IDIV": ("(({0}) div ({1}))", "(({0}) // ({1}))"),
    "RATIO": ("CAST({0} AS DOUBLE) / {1}", "{0} / {1}"),
    "LASTPART": ("element_at(split({0}, '/'), -1)", "list_extract(string_split({0}, '/'), -1)"),
    "EXPLODE_RANGE": ("explode(sequence({0}, {1}))", "unnest(range({0}, ({1}) + 1))"),
    "AT": ("element_at({0}, {1})", "list_extract({0}, {1})"),
    "MATCHES": ("({0} RLIKE {1})", "regexp_matches({0}, {1})"),
    "EXTRACT1": ("regexp_extract({0}, {1}, 1)", "regexp_extract({0}, {1}, 1)"),
    "COUNTIF": ("count_if({0})", "count(*) FILTER (WHERE {0})"),
    "MILLIS": ("unix_millis({0})", "epoch_ms({0})"),
    "JOINED": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "SORTED_LIST": ("sort_array(collect_list({0}))", "list_sort(list({0}))"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose opening bracket is at ``at``, and the place behind it."""
    depth, begin, found, quoted = 0, at + 1, [], False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*found, text[begin:i].strip()], i + 1
        elif c == "," and depth == 1:
            found.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError("a call is not closed")


def spelled(sql: str, spark: bool) -> str:
    """``sql`` with its macros written for Spark or for the oracle."""
    while m := re.search(rf"\b({'|'.join(MACROS)})\(", sql):
        arguments, end = _arguments(sql, m.end() - 1)
        sql = sql[: m.start()] + MACROS[m[1]][0 if spark else 1].format(*arguments) + sql[end:]
    return sql


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = spelled(sql, True).replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return run


def oracle(sql: str) -> str:
    return spelled(sql, False)
