"""Adaptive extraction: an element saved under (url, identifier) is found again after a page's redesign.

Candidates of a page are scored inside the page's own UDF call, so what is
shuffled is one snapshot and one page for each key and never their product.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import batched
from ..functions.url import storage_key
from ..kernel import dom, similarity
from ..kernel.css import compile_query
from ..kernel.dom import Page
from .extract import ELEMENT, _element, page_udf

LOG = logging.getLogger("weftline.relocate")
_HIT = f"array<struct<node_id: int, html: string, score: double, element: {ELEMENT}>>"


def _dict(e: dict) -> dict:
    return e | {k: {a["name"]: a["value"] for a in e[k] or []} for k in ("attributes", "parent_attribs")}


def _candidates(p: Page) -> list:
    return [x for x in p.select("*") if x.parent is not None and x.parent.tag[0] != "#"]


def _relocate(threshold: float):
    def run(html: str | None, element: dict | None) -> list[dict]:
        if element is None:
            return []
        p = Page(html)
        nodes = _candidates(p)
        data = [dom.element_data(x) for x in nodes]
        original = _dict(element)
        places = similarity.relocate(original, data, threshold)
        LOG.debug("%d of %d elements are as like a saved %s as any", len(places), len(nodes), original["tag"])
        return [{"node_id": nodes[i].pre, "html": dom.outer_html(nodes[i]), "score": similarity.score(original, data[i]), "element": _element(nodes[i])} for i in places]

    return run


def similarity_score(original: Column, candidate: Column) -> Column:
    """Per cent to two decimals, of two element structs."""
    return batched(lambda a, b: None if a is None or b is None else similarity.score(_dict(a), _dict(b)), "double")(original, candidate)


def similarity_within(html: Column, query: str) -> Column:
    """similarity_score of a page's last match of the query for its first; null if there is none."""
    q = compile_query(query)

    def run(p: Page) -> float | None:
        found = p.select(q)
        return similarity.score(dom.element_data(found[0]), dom.element_data(found[-1])) if found else None

    return page_udf(run, "double", distinct=True)(html, F.lit(""))


def relocate(pages: DataFrame, snapshots: DataFrame, threshold: float = similarity.THRESHOLD) -> DataFrame:
    """pages' columns but html, identifier, node_id, html, score: all elements of the best score that reaches the threshold.

    pages: url, html; snapshots: url, identifier, element (see Snapshots). Joined by lower-case url.
    """
    kept = [c for c in pages.columns if c != "html"]
    s = snapshots.select(F.lower("url").alias("__url"), "identifier", "element")
    both = pages.join(s, F.lower(pages["url"]) == s["__url"]).withColumn("__hit", F.explode(batched(_relocate(threshold), _HIT)(F.col("html"), F.col("element"))))
    return both.select(*kept, "identifier", F.col("__hit.node_id").alias("node_id"), F.col("__hit.html").alias("html"), F.col("__hit.score").alias("score"))


def css_adaptive(pages: DataFrame, query: str, snapshots: DataFrame, identifier: str = "", threshold: float = similarity.THRESHOLD) -> DataFrame:
    """pages' columns but html, pos, node_id, html, element, relocated: matches of the query, or on pages without any the relocated element.

    Rows of pos 0 are what is to be saved as the new snapshot.
    """
    q, name = compile_query(query), identifier or query
    again = _relocate(threshold)
    row = f"array<struct<node_id: int, html: string, element: {ELEMENT}, relocated: boolean>>"

    def run(html: str | None, element: dict | None) -> list[dict]:
        found = Page(html).select(q)
        if found:
            return [{"node_id": x.pre, "html": dom.outer_html(x), "element": _element(x), "relocated": False} for x in found]
        return [{"node_id": h["node_id"], "html": h["html"], "element": h["element"], "relocated": True} for h in again(html, element)]

    kept = [c for c in pages.columns if c != "html"]
    s = snapshots.where(F.col("identifier") == name).select(F.lower("url").alias("__url"), "element")
    both = pages.join(s, F.lower(pages["url"]) == s["__url"], "left")
    return both.select(*kept, F.posexplode(batched(run, row)(F.col("html"), F.col("element"))).alias("pos", "__h")).select(*kept, "pos", "__h.*")


def latest(snapshots: DataFrame) -> DataFrame:
    """The last saved row of each (url, identifier)."""
    w = Window.partitionBy(F.lower("url"), storage_key(F.col("identifier"))).orderBy(F.desc("saved_at"), F.xxhash64("element"))
    return snapshots.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
