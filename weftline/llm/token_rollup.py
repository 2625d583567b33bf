"""Token counts kept as additive totals by source, language and tokenizer version.

A batch of signed changes is summed to one small delta table in the folder of
its batch id; the folder's success marker, which Spark writes when the job
commits, is the commit.  A batch id that is committed already changes nothing;
a batch that broke off before its marker is written anew.  Totals are the sum of
the last compacted base and of the committed deltas that it doesn't hold.

Changes are rows of (op, source, lang, tokenizer_version, tokens, chars,
old_tokens, old_chars): "insert" adds a document, "delete" takes one away with
the counts that it had, "revise" adds the difference of new and old counts.  A
document that moves to another group is a delete and an insert.

Results for odd input: a null source, language or version is a group of its own;
null counts are 0; rows with another op (or null) are left out; repeated rows
count as often as they stand; an empty batch commits and changes nothing; groups
whose totals are all 0 are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"
CHANGES = "op string, source string, lang string, tokenizer_version string, tokens long, chars long, old_tokens long, old_chars long"


class Rollup:
    """Totals in a folder that all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _committed(self, kind: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        done = [n for n in names if self._exists(f"{self.path}/{kind}/{n}/_SUCCESS")]
        return sorted(n.split("=", 1)[1] for n in done)

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        base = self._base()
        held = [r[0] for r in self._held(base).collect()] if base else []
        return sorted({*held, *self._committed("delta")})

    def _held(self, base: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.path}/held/seq={base}")

    def committed(self, batch_id: str) -> bool:
        """Whether a batch is: by its own marker, or among those that the base holds."""
        base = self._base()
        return self._exists(f"{self.path}/delta/batch={batch_id}/_SUCCESS") or (base is not None and not self._held(base).where(F.col("batch") == batch_id).isEmpty())

    def _base(self) -> str | None:
        both = sorted(set(self._committed("base")) & set(self._committed("held")))
        return both[-1] if both else None

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch; False if it was committed before."""
        if not batch_id or set(batch_id) & set("/=\\:"):
            raise ValueError("a batch id is a plain folder name")
        if self.committed(batch_id):
            return False
        n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        gain = lambda c: F.when(F.col("op") == "revise", n(c) - n(f"old_{c}")).otherwise(sign * n(c))
        rows = changes.where(F.col("op").isin("insert", "delete", "revise"))
        sums = rows.groupBy(*(F.col(k).cast("string").alias(k) for k in KEYS)).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(gain("tokens")).alias("n_tokens"), F.sum(gain("chars")).alias("n_chars"))
        sums.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """The totals after all committed batches."""
        base = self._base()
        deltas = self._committed("delta")
        # Of the base's batches only those whose deltas are still there matter.
        held = {r[0] for r in self._held(base).where(F.col("batch").isin(deltas)).collect()} if base and deltas else set()
        paths = [f"{self.path}/delta/batch={b}" for b in deltas if b not in held]
        if base:
            paths.append(f"{self.path}/base/seq={base}")
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS))
        return sums.where(" or ".join(f"{c} <> 0" for c in TOTALS))

    def compact(self) -> None:
        """Writes the totals as a new base; the deltas that it holds are then removed."""
        ids = self.batches()
        seq = f"{int(self._base() or 0) + 1:09d}"
        self.totals().write.mode("overwrite").parquet(f"{self.path}/base/seq={seq}")
        self.spark.createDataFrame([(i,) for i in ids], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held/seq={seq}")
        for i in ids:
            fs, p = self._fs(f"{self.path}/delta/batch={i}")
            fs.delete(p, True)


@lru_cache(2)
def _ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ranks(path)
        for b in batches:
            counts = np.fromiter((len(coder.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in b.column(0))), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(counts), b.column(3)], names=["source", "lang", "tokens", "chars"])

    return run


def inserts(docs: DataFrame, version: str = "byte_bpe_50k", ranks: str | None = None) -> DataFrame:
    """The insert changes of all documents, with tokens of a public byte-level vocabulary; a null text has none."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    counted = rows.mapInArrow(_count(ranks or default_ranks()), "source string, lang string, tokens long, chars long")
    none = F.lit(None).cast("long")
    return counted.select(F.lit("insert").alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), "tokens", "chars", none.alias("old_tokens"), none.alias("old_chars"))


def revised(changes: DataFrame, old_tokens: Column, old_chars: Column) -> DataFrame:
    """Inserts as revisions of documents that were counted before with other numbers."""
    return changes.withColumns({"op": F.lit("revise"), "old_tokens": old_tokens.cast("long"), "old_chars": old_chars.cast("long")})
