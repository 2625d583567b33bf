"""Navigation as joins and windows over the relation of operators.extract.nodes; page: the columns that name a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element'")


def attribute(name: str, attrs: str = "attrs") -> Column:
    """The value of an attribute; null if there is none."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute("class"), r"[ \t\n\f\r]+"), name), F.lit(False))


def search_values(keyword: str, partial: bool = False) -> Column:
    """The attributes whose value is, or holds, the keyword."""
    return F.filter("attrs", lambda a: a["value"].contains(keyword) if partial else a["value"] == keyword)


def attrs_map() -> Column:
    return F.map_from_entries("attrs")


def attrs_keys() -> Column:
    return F.transform("attrs", lambda a: a["name"])


def attrs_values() -> Column:
    return F.transform("attrs", lambda a: a["value"])


def attrs_json() -> Column:
    """The attributes as compact JSON, in their order."""
    return F.to_json(attrs_map())


def has_attribute(name: str) -> Column:
    return F.exists("attrs", lambda a: a["name"] == name)


def json_text() -> Column:
    """The element's own text as a VARIANT; null if it isn't JSON."""
    return F.try_parse_json("text")


def children(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """page, node_id, child_id of the element children."""
    return elements(nodes).select(page, F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"))


def child_counts(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    return children(nodes, page).groupBy(page, "node_id").agg(F.count("*").alias("n_children"))


def siblings(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """page, node_id, sibling_id: an array over a window in place of a self-join, then exploded."""
    e = elements(nodes)
    w = Window.partitionBy(page, "parent_id")
    rows = e.select(page, "node_id", F.collect_list("node_id").over(w).alias("__row"))
    return rows.select(page, "node_id", F.explode(F.filter("__row", lambda x: x != F.col("node_id"))).alias("sibling_id"))


def neighbours(nodes: DataFrame, page: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """nodes of elements with previous_id and next_id, the element siblings beside each; of the columns in carry also previous_ and next_."""
    w = Window.partitionBy(page, "parent_id").orderBy("node_id")
    names = {"id": "node_id"} | {c: c for c in carry}
    return elements(nodes).withColumns({f"{side}_{n}": step(c).over(w) for n, c in names.items() for side, step in (("previous", F.lag), ("next", F.lead))})


def nth_of_type(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """nodes of elements with nth: the place among siblings of the same tag, 0 if there are no others."""
    w = Window.partitionBy(page, "parent_id", "tag")
    return elements(nodes).withColumn("nth", F.when(F.count("*").over(w) > 1, F.row_number().over(w.orderBy("node_id"))).otherwise(0))


def descendants(above: DataFrame, below: DataFrame, page: str = "page_id") -> DataFrame:
    """page, node_id, descendant_id: a join on the page with the containment of intervals as its residual."""
    a = above.select(F.col(page).alias("__p"), F.col("node_id").alias("__pre"), F.col("post").alias("__post"))
    b = below.select(page, F.col("node_id").alias("descendant_id"), "post")
    pairs = a.join(b, (F.col("__p") == F.col(page)) & (F.col("descendant_id") > F.col("__pre")) & (F.col("post") < F.col("__post")))
    return pairs.select(page, F.col("__pre").alias("node_id"), "descendant_id")
