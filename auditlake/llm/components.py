"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut, forget


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, component), the component being its smallest node.

    Each round a node points at its smallest neighbour, if that is smaller; these
    pointers are followed to their ends, which hold as many nodes as there are rows
    of nodes, not of links.  Then links are rewritten to the ends and those within
    one dropped, so the links are joined once, and only what still lies between
    groups is joined again.  Minima are taken before the shuffle, so a node with
    very many links is no hot spot.  Every round is written, so lost executors cost
    one round.
    """
    left = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        labels = followed(cut(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels"))
        to = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
        if found is None:
            new = labels.select("node", F.col("label").alias("component"))
        else:
            next_ = labels.select(F.col("node").alias("component"), "label")
            new = cut(found.join(next_, "component", "left").select("node", F.coalesce("label", "component").alias("component")), "labels")
        apart = left.join(to("a"), "a").join(to("b"), "b").where("of_a != of_b")
        rest = cut(apart.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), "links")
        forget(left)
        if found is not None:
            forget(found)
            forget(labels)
        if rest.isEmpty():
            forget(rest)
            return new
        found, left = new, rest


def followed(labels: DataFrame) -> DataFrame:
    """labels (node, label) whose labels are ends: each round a node takes the label of its label, so ways shorten by half."""
    while True:
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        step = labels.join(far, labels["label"] == far["at"])
        new = cut(step.select("node", F.col("label").alias("old"), F.col("far").alias("label")), "labels")
        forget(labels)
        labels = new
        if new.where("old != label").isEmpty():
            return new.select("node", "label")
