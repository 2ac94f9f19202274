"""What is shown or written: XML results, tag cloud, formatted scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def result_xml(results: DataFrame, scored: bool = True) -> DataFrame:
    """(query_id, peer, result_rank, xml) of results with urn, title, authors (array), abstract, resource_url and, if they are ``scored``, score, pagerank and cited_by."""
    abstract = F.concat(F.lit("["), F.length(F.coalesce("abstract", F.lit(""))), F.lit("] - "), F.coalesce("abstract", F.lit("")))
    plain = ("urn", "title", F.array_join("authors", ", ").alias("authors"), abstract.alias("abstract"), F.col("resource_url").alias("resource"))
    scores = (F.format_string("%f", "score").alias("similarity"), F.format_string("%f", "pagerank").alias("pagerank"), F.col("cited_by").alias("citedby"))
    fields = F.struct(*plain, *(scores if scored else ()))
    return results.select("query_id", "peer", "result_rank", F.to_xml(fields, {"rowTag": "result"}).alias("xml"))


def read_results(xml: DataFrame) -> DataFrame:
    """Results as they are shown: white space out of the urn, authors as text, similarity in percent, citations only if there are any, the resource as a file address."""
    x = F.from_xml("xml", "urn string, title string, authors string, abstract string, resource string, similarity double, pagerank double, citedby bigint", {"rowTag": "result"})
    r = xml.withColumn("r", x)
    percent = F.format_string("VSM similarity ~%d%% (%.3f)", F.floor(F.col("r.similarity") * 100), "r.similarity")
    return r.select(
        "query_id", "peer", "result_rank", F.regexp_replace("r.urn", r"\s", "").alias("urn"), "r.title", "r.authors", percent.alias("similarity"), F.nullif(F.col("r.citedby"), F.lit(0)).alias("cited_by"), F.concat(F.lit("file://"), F.regexp_replace("r.resource", "^file://", "")).alias("resource")
    )


def read_reference_xml(xml: Column) -> Column:
    """Fields of a labelled reference; a bare ampersand is read as "and"."""
    schema = "title string, authors struct<author: array<string>>, booktitle string, pages string, date string"
    return F.from_xml(F.replace(xml, F.lit("&"), F.lit("and")), schema, {"rowTag": "citation"})


def tag_cloud(terms: DataFrame) -> DataFrame:
    """(peer, term, weight, font): font size from 6 to 26 by weight, terms in order; none if all weights are equal. The smallest weight is taken as
    1 at most and the largest as 0 at least."""
    peer = Window.partitionBy("peer")
    low, high = F.least(F.min("weight").over(peer), F.lit(1.0)), F.greatest(F.max("weight").over(peer), F.lit(0.0))
    sized = terms.withColumns({"low": low, "high": high}).where("high > low")
    return sized.select("peer", "term", "weight", F.ceil(F.round(6 + 20 * (F.col("weight") - F.col("low")) / (F.col("high") - F.col("low")), 9)).cast("int").alias("font"))


def term_column(term: Column) -> Column:
    """A term in a field of twenty characters."""
    return F.rpad(F.substring(term, 1, 20), 20, " ")
