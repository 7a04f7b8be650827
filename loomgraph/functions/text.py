"""Column functions on text: sentences, identifiers, labels, responses. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RESPONSE


def sentences(text: Column) -> Column:
    """The sentences of a text: split at blanks after . ! or ?, trimmed, empty ones dropped; null gives none."""
    # Only the ends of the whole text can keep blanks, as a split takes all of those between sentences.
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.filter(F.split(whole, r"(?U)(?<=[.!?])\s+", -1), lambda x: x != "")


def entity_uri(label: Column, ns: str) -> Column:
    """Lower case, blanks to `_`, everything else but a-z, 0-9 and `_` left out, after the namespace."""
    return F.concat(F.lit(ns), F.regexp_replace(F.translate(F.lower(label), " ", "_"), "[^a-z0-9_]", ""))


def property_uri(label: Column, ns: str) -> Column:
    """Lower case and blanks to `_`, after the namespace."""
    return F.concat(F.lit(ns), F.translate(F.lower(label), " ", "_"))


def local_name(iri: Column) -> Column:
    """What follows the last `#`, and in that the last `/`."""
    return F.element_at(F.split(F.element_at(F.split(iri, "#"), -1), "/"), -1)


def snippet(chunk: Column, n: int = 100) -> Column:
    return F.substring(chunk, 1, n)


def response_json(response: Column) -> Column:
    """The JSON of a model's response: all of it, else the first ```json block, else the first ``` block; null without any."""
    def block(opening: str) -> Column:
        body = F.regexp_extract(response, rf"(?s){opening}\s*(.*?)```", 1)
        return F.when(F.contains(response, F.lit("```")) & (body != ""), body)

    whole = F.when(F.try_parse_json(response).isNotNull(), response)
    tagged, bare = block("```json"), block("```")
    return F.when(whole.isNotNull(), whole).when(F.contains(response, F.lit("```json")), tagged).otherwise(bare)


def parsed_response(response: Column) -> Column:
    """struct(entities, relations) of a response; broken or missing parts are empty lists, missing texts empty."""
    x = F.from_json(response_json(response), RESPONSE)
    blank = lambda c: F.coalesce(c, F.lit(""))
    entities = F.transform(
        F.coalesce(x["entities"], F.array().cast("array<struct<text:string,type:string,span:array<int>>>")),
        lambda e: F.struct(blank(e["text"]).alias("text"), blank(e["type"]).alias("type")),
    )
    relations = F.transform(
        F.coalesce(x["relations"], F.array().cast("array<struct<subject:string,predicate:string,object:string>>")),
        lambda r: F.struct(blank(r["subject"]).alias("subject"), blank(r["predicate"]).alias("predicate"), blank(r["object"]).alias("object")),
    )
    return F.struct(entities.alias("entities"), relations.alias("relations"))


def formal(s: Column, p: Column, o: Column) -> Column:
    """The triple as a statement for a checker."""
    return F.struct(
        F.lit("relation").alias("type"), p.alias("predicate"), s.alias("subject"), o.alias("object"),
        F.format_string("%s(%s, %s)", p, s, o).alias("formula"),
    )
