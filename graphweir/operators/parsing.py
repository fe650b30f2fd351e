"""Parsing of model output: JSON bodies, broken JSON, sections, unicode escapes.

Built-in expressions where they suffice; repair and escapes need a scan per
text and run as Arrow-batched functions. Null stays null; text that holds
nothing usable gives null or an empty array.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweir.functions.text import json_body, strip

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


@F.pandas_udf(T.StringType())
def decode_unicode(texts: pd.Series) -> pd.Series:
    """\\uXXXX escapes as characters; surrogate pairs joined, lone surrogates kept as written."""

    def one(text: str | None) -> str | None:
        if text is None or "\\u" not in text:
            return text
        decoded = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        try:
            return decoded.encode("utf-16", "surrogatepass").decode("utf-16")
        except UnicodeDecodeError:
            return text

    return texts.map(one, na_action="ignore")


def _repair(text: str) -> str | None:
    """JSON cut off in its middle, closed: the last incomplete element is dropped, open brackets are closed."""
    start = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if start < 0:
        return None
    text = text[start:]
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text)[0], ensure_ascii=False)
    except ValueError:
        pass
    stack: list[str] = []
    safe = (0, "")  # where the text may be cut, and what closes it there
    quoted = escaped = False
    for k, c in enumerate(text):
        if quoted:
            escaped = c == "\\" and not escaped
            if c == '"' and not escaped:
                quoted = False
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            safe = (k + 1, "".join(reversed(stack)))
        elif c in "}]":
            if not stack:
                break
            stack.pop()
            safe = (k + 1, "".join(reversed(stack)))
        elif c == ",":
            safe = (k, "".join(reversed(stack)))
    closed = text[: safe[0]] + safe[1]
    try:
        return json.dumps(json.loads(closed), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    """The JSON of a text, completed where it breaks off; null where there is none."""
    return texts.map(_repair, na_action="ignore")


def json_response(c: Column, schema: str) -> Column:
    """The JSON body of a response by a schema; single quotes are read as double ones if nothing else parses."""
    body = json_body(c)
    return F.coalesce(F.from_json(body, schema), F.from_json(F.replace(body, F.lit("'"), F.lit('"')), schema))


def section(c: Column, name: str) -> Column:
    """The body of a ``[[ ## name ## ]]`` section, up to the next section."""
    body = F.regexp_extract(c, rf"(?s)\[\[ ## {re.escape(name)} ## \]\]\s*(.*?)\s*(?:\[\[ ## |$)", 1)
    return F.when(body != "", strip(body))


def filtered_facts(c: Column) -> Column:
    """Facts kept by a filter response: arrays of three strings under ``fact``; none if it does not parse."""
    parsed = F.from_json(section(c, "fact_after_filter"), "fact ARRAY<ARRAY<STRING>>")
    return F.coalesce(F.filter(parsed["fact"], lambda f: F.size(f) == 3), F.array().cast("array<array<string>>"))


def named_entities(c: Column) -> Column:
    """Distinct entities of a response {"named_entities": [...]}, in order; none if it does not parse."""
    parsed = F.from_json(json_body(c), "named_entities ARRAY<STRING>")
    return F.coalesce(F.array_distinct(F.filter(parsed["named_entities"], lambda x: x.isNotNull())), F.array().cast("array<string>"))


def response_triples(c: Column) -> Column:
    """Valid distinct triples of a response {"triples": [[s, p, o], ...]}."""
    from graphweir.operators.text import valid_triples

    parsed = F.from_json(json_body(c), "triples ARRAY<ARRAY<STRING>>")
    return F.coalesce(valid_triples(parsed["triples"]), F.array().cast("array<array<string>>"))


def keyword_lists(c: Column) -> Column:
    """High- and low-level keywords of a response: struct<high, low>, texts joined by commas."""
    parsed = F.from_json(json_body(c), "high_level_keywords ARRAY<STRING>, low_level_keywords ARRAY<STRING>")
    return F.struct(F.array_join(parsed["high_level_keywords"], ", ").alias("high"), F.array_join(parsed["low_level_keywords"], ", ").alias("low"))


def rating(c: Column) -> Column:
    """A rating from 0 to 100 in a response; others are null."""
    n = F.regexp_extract(c, r"(\d{1,3}(?:\.\d+)?)", 1).try_cast("double")
    return F.when((n >= 0) & (n <= 100), n)
