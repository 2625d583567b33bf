"""Items (seq, item as JSON with its keys in order) as JSON, JSON Lines, CSV and XML.

Each format is a table of lines that any writer takes; write_* put a folder of
parts, in parallel, and write_file one file in order, streamed through the
driver a partition at a time.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batched
from ..kernel import export as K
from ..operators.stats import union_of_keys


def header(items: DataFrame) -> list[str]:
    """All keys in first-seen order; they are columns of a table and hence few."""
    return [r["key"] for r in union_of_keys(items).orderBy("place").collect()]


def _objects(items: DataFrame) -> DataFrame:
    return items.where(F.col("item").startswith("{"))


def csv_lines(items: DataFrame) -> DataFrame:
    """seq, line: the header at seq -1, then a line for each object; line ends aren't part of it."""
    names = header(items)
    row = batched(lambda t: K.csv_line(K.flat(json.loads(t).get(n)) for n in names).removesuffix("\r\n"), "string")
    head = items.sparkSession.createDataFrame([(-1, K.csv_line(names).removesuffix("\r\n"))], "seq long, line string")
    return head.unionByName(_objects(items).select(F.col("seq").cast("long").alias("seq"), row(F.col("item")).alias("line")))


def xml_lines(items: DataFrame) -> DataFrame:
    """seq, line: an item element (several text lines) for each object, without the root."""
    return _objects(items).select(F.col("seq").cast("long").alias("seq"), batched(lambda t: K.xml_item(json.loads(t)).removesuffix("\n"), "string")(F.col("item")).alias("line"))


def jsonl_lines(items: DataFrame) -> DataFrame:
    return items.select(F.col("seq").cast("long").alias("seq"), F.col("item").alias("line"))


def json_texts(items: DataFrame, indent: int = 0) -> DataFrame:
    """seq, text: each item as JSON of its own, indented."""
    return items.select(F.col("seq").cast("long").alias("seq"), batched(lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=indent or None), "string")(F.col("item")).alias("text"))


def write_jsonl(items: DataFrame, path: str) -> None:
    items.select("item").write.text(path)


def write_csv(items: DataFrame, path: str) -> None:
    """A folder: the header's part is first in order of seq."""
    csv_lines(items).orderBy("seq").select("line").write.option("lineSep", "\r\n").text(path)


def write_file(items: DataFrame, path: str, kind: str, indent: int = 0) -> None:
    """One file in order of seq, replaced as a whole when it is complete."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        if kind == "csv":
            f.writelines(f"{r['line']}\r\n" for r in csv_lines(items).orderBy("seq").toLocalIterator())
        elif kind == "xml":
            f.write(K.XML_HEAD)
            f.writelines(f"{r['line']}\n" for r in xml_lines(items).orderBy("seq").toLocalIterator())
            f.write(K.XML_FOOT)
        elif kind == "jsonl":
            f.writelines(f"{r['line']}\n" for r in jsonl_lines(items).orderBy("seq").toLocalIterator())
        elif kind == "json":
            pad, begin = ("\n" + " " * indent, "[") if indent else ("", "[")
            some = False
            for r in jsonl_lines(items).orderBy("seq").toLocalIterator():
                text = K.to_json(json.loads(r["line"]), indent).replace("\n", pad) if indent else r["line"]
                f.write(f"{',' if some else begin}{pad}{text}")
                some = True
            f.write(("\n]" if indent else "]") if some else "[]")
        else:
            raise ValueError(f"unknown kind {kind}")
    os.replace(part, path)
