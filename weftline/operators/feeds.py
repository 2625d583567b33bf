"""Feeds as rows: documents (with a column body) to items, URLs and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import batched
from ..kernel import feeds as K
from ..kernel.export import compact


def _items(df: DataFrame, got: Column, body: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != body), F.posexplode(got).alias("pos", "item"))


def csv_items(df: DataFrame, delimiter: str = ",", headers: list[str] | None = None, body: str = "body") -> DataFrame:
    """pos, item (JSON object, keys in the header's order) of each row of a CSV document."""
    return _items(df, batched(lambda t: [compact(i) for i in K.csv_items(t or "", delimiter, headers)], "array<string>")(F.col(body)), body)


def xml_items(df: DataFrame, iterate: str = "item", body: str = "body") -> DataFrame:
    return _items(df, batched(lambda t: [compact(i) for i in K.xml_items(t or "", iterate)], "array<string>")(F.col(body)), body)


def sitemap(df: DataFrame, alternates: bool = False, body: str = "body") -> DataFrame:
    """pos, kind ("page" or "sitemap"), url."""

    def run(t: str | None) -> list[dict]:
        urls, children = K.sitemap(t or "", alternates)
        return [{"kind": "page", "url": u} for u in urls] + [{"kind": "sitemap", "url": u} for u in children]

    got = batched(run, "array<struct<kind: string, url: string>>")(F.col(body))
    kept = [c for c in df.columns if c != body]
    return df.select(*kept, F.posexplode(got).alias("pos", "__s")).select(*kept, "pos", "__s.*")


def shop(df: DataFrame, target: str, url: str = "url", body: str = "body") -> DataFrame:
    """url, pos, kind ("item" or "request"), value (an item as JSON, or a URL)."""
    store = K.Shop.of(target)

    def run(u: str | None, t: str | None) -> list[dict]:
        items, asked = store.parse(u or "", t or "")
        return [{"kind": "item", "value": compact(i)} for i in items] + [{"kind": "request", "value": r} for r in asked]

    got = batched(run, "array<struct<kind: string, value: string>>")(F.col(url), F.col(body))
    return df.select(url, F.posexplode(got).alias("pos", "__s")).select(url, "pos", "__s.*")


def first_variants(items: DataFrame, item: str = "item", order: tuple[str, ...] = ("url", "pos")) -> DataFrame:
    """Items without those whose identifier came before in this order; items without one all stay."""
    identifier = F.get_json_object(item, "$.identifier")
    # Rows without an identifier are spread by their place and all stay.
    w = Window.partitionBy("__id", F.when(F.col("__id").isNull(), F.xxhash64(*order))).orderBy(*order)
    return items.withColumn("__id", identifier).withColumn("__n", F.row_number().over(w)).where("__n = 1 or __id is null").drop("__n", "__id")
