"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, scratch_path, staged
from .registry import query
from .sketch import of_ids

_ENTRY = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, sign int"
_COUNTED = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint"
_DELTA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
GROUP = ("source", "lang", "tokenizer")


class TokenLedger:
    """Totals of documents and tokens by source, language and tokenizer version, kept by signed changes.

    A batch writes its signed entries (minus what a document counted before,
    plus what it counts now), then their sums, then its commit. A batch
    without a commit counts for nothing and is written anew; a committed batch
    is never applied again. Totals are sums over committed batches alone.
    ``compact`` folds the entries of committed batches into a snapshot, so that
    later batches read one row per document and not its history. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch={batch}"

    def _numbers(self, kind: str) -> DataFrame:
        """Rows of a table of marks; none before the first one."""
        try:
            return self.spark.read.parquet(f"{self.root}/{kind}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "batch bigint, snapshot bigint")

    def committed(self, batch: int) -> bool:
        """Whether the batch is committed."""
        return batch in self.batches()

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        return sorted(int(r["batch"]) for r in self._numbers("commits").select("batch").distinct().collect())

    def compact(self) -> None:
        """Write what every document counts after the committed batches as a snapshot; what it covers is written last."""
        batches = self.batches()
        covers = self._numbers("covers")
        number = (covers.agg(F.max("snapshot")).first()[0] or 0) + 1
        self.counted(batches).write.mode("overwrite").parquet(self._path("snapshots", number))
        marks = self.spark.createDataFrame([(b, number) for b in batches], "batch bigint, snapshot bigint")
        marks.coalesce(1).write.mode("append").parquet(f"{self.root}/covers")

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(kind, b) for b in batches])

    def counted(self, batches: list[int] | None = None) -> DataFrame:
        """What every document counts now: ``doc_id, source, lang, tokenizer, tokens``."""
        wanted = set(self.batches() if batches is None else batches)
        covers: dict[int, set[int]] = {}
        for r in self._numbers("covers").select("snapshot", "batch").collect():
            covers.setdefault(r["snapshot"], set()).add(r["batch"])
        # The latest snapshot of wanted batches alone stands for their entries.
        last = max((n for n, b in covers.items() if b <= wanted), default=None)
        entries = self._read("entries", _ENTRY, sorted(wanted - covers.get(last, set())))
        if last is not None:
            entries = entries.unionByName(self._read("snapshots", _COUNTED, [last]).withColumn("sign", F.lit(1)))
        key = ("doc_id", *GROUP, "tokens")
        return entries.groupBy(*key).agg(F.sum("sign").alias("sign")).filter("sign > 0").select(*key)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` once: ``doc_id, source, lang, tokenizer, tokens, deleted``.

        A row replaces what its document counted before, under whatever
        source or tokenizer, or takes it away when ``deleted``. Deleting an
        unknown document changes nothing. If a batch names a document more
        than once, a deletion wins, then the row with the greatest tokenizer,
        tokens, source and language. Rows without an id are ignored; null
        sources and languages are groups of their own. Returns False, and
        does nothing, if the batch is committed already.
        """
        if self.committed(batch):
            return False
        chosen = (changes.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
                  .agg(F.max(F.struct(F.coalesce("deleted", F.lit(False)).alias("deleted"), "tokenizer",
                                      F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"), "source", "lang"))
                       .alias("c")).select("doc_id", "c.*"))
        # Staged: the changes may be costly (tokenised texts) and are read three times.
        chosen = staged(chosen, "chosen")
        before = self.counted([b for b in self.batches() if b != batch]).join(chosen.select("doc_id"), "doc_id", "left_semi")
        signed = before.withColumn("sign", F.lit(-1)).unionByName(
            chosen.filter("not deleted").drop("deleted").withColumn("sign", F.lit(1)))
        columns = [c.split()[0] for c in _ENTRY.split(", ")]
        signed.select(*columns).write.mode("overwrite").parquet(self._path("entries", batch))
        entries = self._read("entries", _ENTRY, [batch])
        (entries.groupBy(*GROUP).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
         .filter("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(self._path("deltas", batch)))
        self.spark.createDataFrame([(batch,)], "batch bigint").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all committed batches, groups without documents left out."""
        deltas = self._read("deltas", _DELTA, self.batches())
        return (deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                .filter("documents <> 0"))


def rank_file_counter(path: str) -> Callable[[], Callable[[str], int]]:
    """Factory of a token counter for a file of byte-level ranks."""
    def load() -> Callable[[str], int]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("counter", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return load


def token_counts(documents: DataFrame, counters: Mapping[str, Callable[[], Callable[[str], int]]]) -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens`` of ``doc_id, source, lang, tokenizer, text``; null texts count nothing."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Callable[[str], int]] = {}
        for batch in batches:
            tokens = []
            for name, text in zip(batch.column("tokenizer").to_pylist(), batch.column("text")):
                if name not in loaded:
                    loaded[name] = counters[name]()
                tokens.append(loaded[name](text.as_py() or ""))
            names = ["doc_id", "source", "lang", "tokenizer"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(tokens, pa.int64())], [*names, "tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "tokenizer", "text").mapInArrow(
        rows, "doc_id bigint, source string, lang string, tokenizer string, tokens bigint")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, poor ones were deleted and toxic ones recounted by another tokenizer.

    The deletion is committed twice; the second time changes nothing.
    """
    import public_tokenizers

    counters = {name: rank_file_counter(public_tokenizers.path(f"{name}.tiktoken"))
                for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = read_table(spark, sf_dir, "labels")
    ledger = TokenLedger(spark, scratch_path(spark, "ledger"))
    every = token_counts(documents.withColumn("tokenizer", F.lit("byte_bpe_50k")), counters)
    ledger.commit(1, every.withColumn("deleted", F.lit(False)))
    gone = labels.filter("quality = 0").select("doc_id", *[F.lit(None).cast("string").alias(c) for c in GROUP],
                                               F.lit(0).cast("bigint").alias("tokens"), F.lit(True).alias("deleted"))
    ledger.commit(2, gone)
    ledger.compact()
    toxic = of_ids(documents, labels.filter("toxic = 1 and quality = 1").select("doc_id"))
    again = token_counts(toxic.withColumn("tokenizer", F.lit("byte_bpe_multi_50k")), counters)
    ledger.commit(3, again.withColumn("deleted", F.lit(False)))
    ledger.commit(2, gone)
    return ledger.totals()
