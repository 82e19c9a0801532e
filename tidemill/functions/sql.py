"""Functions for SQL: a table function of a page's nodes, and what Python computes, under names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemill.functions import encoding, html, relocation, text


@F.udtf(returnType=html.NODE)
class HtmlNodes:
    """html_nodes(html): the nodes of a page, a row each; none for null."""

    def eval(self, page: str) -> Iterator[tuple]:
        if page is not None:
            yield from html.node_rows(page)


#: Scalar functions by name.
SCALARS = {
    "decode_html_entities": text.decode_html_entities,
    "normalize_unicode": text.normalize_unicode,
    "detect_encoding": encoding.detect_encoding,
    "decode_body": encoding.decode_body,
    "fingerprint_similarity": relocation.similarity,
}


def register(spark: SparkSession) -> list[str]:
    """Makes all of them known to the session's SQL; returns their names."""
    spark.udtf.register("html_nodes", HtmlNodes)
    for name, function in SCALARS.items():
        spark.udf.register(name, function)
    return ["html_nodes", *SCALARS]
