"""Operator 8: main text of pages by consensus paths of their hosts.

Every page votes with the generalised tag-class path of its best container; each host's
most voted path wins, and all pages of the host are extracted again with it. A page
without that path is extracted with its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import map_batches, written
from emberlog.llm.markup import best_container, parse, text_at

# Hosts whose winning paths are broadcast; more are joined by a shuffle.
MOST_BROADCAST_HOSTS = 200_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host); the host is NULL if the url has none."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    return pages.select("page_id", "url", "html", F.nullif(host, F.lit("")).alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes, then the larger score, then the
    first in order. Votes are added up before any shuffle."""

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            found = [best_container(parse(html)) for html in batch.column(1).to_pylist()]
            return {
                "host": batch.column(0),
                "path": [f[0] for f in found],
                "score": [f[1] for f in found],
            }

        return convert

    known = pages.where("host IS NOT NULL AND html IS NOT NULL").select("host", "html")
    votes = (
        map_batches(known, make, "host string, path string, score double")
        .where("path <> ''")
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    )
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return (
        votes.withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .select("host", "path")
    )


def extract(html: str | None, path: str | None) -> str:
    if not html:
        return ""
    page = parse(html)
    text = text_at(page, path) if path else ""
    return text or text_at(page, best_container(page)[0])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``.

    NULL and empty html give an empty text. A page whose url is NULL or has no host
    votes for nobody and is extracted with its own path. Rows may repeat; ids may be
    NULL. Other columns are not read. No rows give none.
    """
    pages = with_host(pages)
    winners = written(host_paths(pages), "host-paths").withColumnRenamed("host", "__host")
    if winners.count() <= MOST_BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    joined = pages.join(winners, pages.host == F.col("__host"), "left")

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            columns = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [extract(html, path) for html, path in zip(*columns)]
            return {
                "page_id": batch.column(0),
                "url": batch.column(1),
                "text": texts,
                "n_chars": [len(t) for t in texts],
            }

        return convert

    schema = "page_id long, url string, text string, n_chars long"
    return map_batches(joined.select("page_id", "url", "html", "path"), make, schema)
