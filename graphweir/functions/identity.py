"""Content identities: prefix and md5 of text, equal in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweir.functions.text import strip

UNIT = "\u001f"


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def doc_id(text: Column) -> Column:
    return content_id("doc-", strip(text))


def chunk_id(text: Column) -> Column:
    """Not scoped to a document: equal chunks of different documents are one."""
    return content_id("chunk-", text)


def entity_id(name: Column) -> Column:
    return content_id("ent-", name)


def relation_id(src: Column, tgt: Column) -> Column:
    return content_id("rel-", F.concat(src, tgt))


def schema_relation_id(src: Column, tgt: Column) -> Column:
    return content_id("rel-", F.concat(src, F.lit("->"), tgt))


def fact_id(s: Column, p: Column, o: Column) -> Column:
    """Over the three parts joined by a unit separator; no language's tuple notation is needed."""
    return content_id("fact-", F.concat_ws(UNIT, s, p, o))


def arguments_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(UNIT, *parts))
