"""Connected components of a link table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import join_hot, written

MOST_ROUNDS = 60


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))


def _stars(links: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours move to the smallest node it knows, then each
    node's smaller ones; both halves of the star contraction in one round. ``total`` is
    the number of links."""
    both = links.unionByName(links.selectExpr("b AS a", "a AS b"))
    large = (
        join_hot(both, _least(both), "a", 2 * total)
        .where("b > a")
        .selectExpr("b AS a", "least(a, least) AS b")
        .where("a <> b")
        .distinct()
    )
    # Now a > b in every row: b is a smaller neighbour of a.
    return (
        join_hot(large, _least(large), "a", 2 * total)
        .selectExpr("explode(array(struct(b AS a, least AS b), struct(a, least AS b))) AS link")
        .select("link.*")
        .where("a <> b")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node that is not the smallest of its component.

    ``links`` has columns a and b. Rounds end when no link changes, after a number of
    them that grows with the logarithm of the longest chain. Every round is written,
    so a lost executor repeats one round; links of a hot node are not gathered.
    """
    current = written(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or state[0] == 0:
            return current.selectExpr("a AS node", "b AS root")
        before = state
        current = written(_stars(current, state[0]), "links")
    raise RuntimeError(f"links still change after {MOST_ROUNDS} rounds")
