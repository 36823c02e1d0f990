"""Token counts as delta-maintained rollups.

A batch is a set of signed rows: +1 inserts a document's count, -1 takes it back, and a revised count is a
-1 row with the old count and a +1 row with the new. Additive totals by source, language and tokenizer version
are kept as one small table for each batch, so a commit reads its own rows only, and never the history.
``compact`` sums the batches there are into one table, and reads it from then on; ``vacuum`` deletes tables that nothing names.

A batch's table is written first; it counts once a small entry of the log names it. The entry is moved to its
final name, the batch's id, by a rename that fails if the name is taken, so of several writers of one batch one
wins, and a commit may be repeated after any failure. That rename has to be atomic, as on HDFS or a local disk.
A hot source is summed on the map side before the shuffle.

Versions are regular expressions, counted by Spark's own functions, or files of public tokenizers, whose library
counts in Arrow batches; the registered query has such as SQL can check.

Edge cases: null source, language or version is a key like any other; a null count counts as 0 tokens and a
null sign as +1; a null text has the tokens of an empty one; rows that repeat are counted each; totals that have
come to 0 rows and 0 tokens are left out; an empty batch is a commit too; other columns are ignored. Of copies the
one of the least doc_id, source and language stays, nulls last.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scriptmill.llm.common import hold, join_unique, materialize, scratch_path, utf8_texts

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

#: Tokenizer versions that SQL can express: runs of non-blanks; runs of ASCII letters and digits, and single others.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "parts-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
#: Bytes that a token is taken to have before it is counted.
ESTIMATED_BYTES = 6


class Rollup:
    """The totals under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._root.getFileSystem(conf)
        self._files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), conf)

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._place(f"log/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _log(self) -> list[str]:
        place = self._place("log")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _publish(self, name: str, rows: DataFrame, batches: list[str]) -> bool:
        """Write a table, then its entry. False: another writer's entry was first."""
        data, draft = f"data/{uuid.uuid4().hex}", self._place(f"drafts/{uuid.uuid4().hex}")
        rows.write.parquet(f"{self.path}/{data}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps({"data": data, "batches": batches}), "utf-8"))
        stream.close()
        self._fs.mkdirs(self._place("log"))
        options = self.spark._sc._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._files.rename(draft, self._place(f"log/{name}"), options)
        except Exception:
            if not self._fs.exists(self._place(f"log/{name}")):
                raise
            self._fs.delete(draft, False)
            self._fs.delete(self._place(data), True)
            return False
        return True

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._place(f"log/batch-{quote(batch_id, safe='')}"))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of (source, lang, tokenizer_version, n_tokens, sign) rows. False: it was there."""
        if self.committed(batch_id):
            return False
        sign = F.coalesce(F.col("sign"), F.lit(1)).cast("long")
        own = deltas.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
        return self._publish(f"batch-{quote(batch_id, safe='')}", own, [batch_id])

    def batches(self) -> list[str]:
        return sorted(unquote(n.removeprefix("batch-")) for n in self._log() if n.startswith("batch-"))

    def _tables(self) -> tuple[list[str], list[str], int]:
        """Tables that make up the totals, the batches they hold and the last compaction's number."""
        names = self._log()
        last = max((n for n in names if n.startswith("compact-")), default=None)
        entries = [self._read(last)] if last else []
        held = set(entries[0]["batches"]) if last else set()
        entries += [self._read(n) for n in names if n.startswith("batch-") and unquote(n.removeprefix("batch-")) not in held]
        return [e["data"] for e in entries], [b for e in entries for b in e["batches"]], int(last.removeprefix("compact-")) if last else 0

    def _sum(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{t}" for t in tables])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(self._tables()[0])

    def compact(self) -> bool:
        """Sum all committed batches into one table. False: another compaction was first, or there is nothing to sum."""
        tables, batches, number = self._tables()
        return len(tables) > 1 and self._publish(f"compact-{number + 1:08d}", self._sum(tables), batches)


    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Delete tables that are neither part of the totals nor younger than so many seconds: what compactions have summed, and what
        writers left that failed. Readers that began before may take as long, and so may writers before their entry."""
        place = self._place("data")
        if not self._fs.exists(place):
            return 0
        kept = set(self._tables()[0])
        old = [x for x in self._fs.listStatus(place) if f"data/{x.getPath().getName()}" not in kept and time.time() - x.getModificationTime() / 1000 >= older_than]
        return sum(bool(self._fs.delete(x.getPath(), True)) for x in old)


def tokenizer_counts(docs: DataFrame, paths: list[str]) -> DataFrame:
    """The columns of docs (with text) and v0, v1, ...: each text's tokens by each file of a public tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token_rollup", _counters.clear)
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in utf8_texts(b.column(b.schema.get_field_index("text")))]
            counts = [pa.array(counter(p)(texts), pa.int64()) for p in paths]
            yield pa.RecordBatch.from_arrays([*b.columns, *counts], [*b.schema.names, *(f"v{i}" for i in range(len(paths)))])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(f"v{i}", LongType()) for i in range(len(paths)))]))


_counters: dict = {}


def counter(path: str):
    """What counts many texts' tokens, by the file's kind."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            _counters[path] = lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
    return _counters[path]


def counted(docs: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, a digest of the text, an estimate of its tokens and one count for each version: v0, v1, ..."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.floor(F.octet_length(text) / ESTIMATED_BYTES).alias("estimate"), text.alias("text"))
    wanted = list((versions or VERSIONS).values())
    files = [p for p in wanted if p.endswith((".model", ".json"))]
    if files and files != wanted:
        raise ValueError("versions are regular expressions or tokenizers' files, not both")
    if files:
        return tokenizer_counts(own, files).drop("text")
    return own.select("doc_id", "source", "lang", "digest", "estimate", *[F.regexp_count("text", F.lit(p)).cast("long").alias(f"v{i}") for i, p in enumerate(wanted)])


def deltas(rows: DataFrame, version: str, tokens: str | Column, sign: int) -> DataFrame:
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), (F.col(tokens) if isinstance(tokens, str) else tokens).alias("n_tokens"), F.lit(sign).alias("sign"))


def copies(rows: DataFrame) -> DataFrame:
    """The rows (with digest) that are copies: all of a digest's but the first by doc_id, source and language."""
    own = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(*[x for c in ("doc_id", "source", "lang") for x in (F.col(c).isNull(), F.col(c))], "row")
    first = materialize(own.groupBy("digest").agg(F.min(order).alias("first")).select("digest", F.col("first")["row"].alias("kept")))
    return join_unique(own, first, "digest").where("row <> kept").select(*rows.columns)


def history(docs: DataFrame, path: str | None = None, versions: dict[str, str] | None = None) -> Rollup:
    """Documents entered with an estimated count; then revised to what the first version counts, where that differs: the estimate is
    taken back and the count added; then recounted by the second version; then their exact copies taken back.

    Each batch is sent twice, and all but the last are compacted.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, path or scratch_path(spark))
    names = versions or VERSIONS
    rows = materialize(counted(docs, names))
    first, second = names
    gone = materialize(copies(rows))
    both = deltas(gone, first, "v0", -1).unionByName(deltas(gone, second, "v1", -1))
    other = rows.where("estimate <> v0")
    revised = deltas(other, first, "estimate", -1).unionByName(deltas(other, first, "v0", 1))
    for name, own in (("1-insert", deltas(rows, first, "estimate", 1)), ("1-revise", revised), ("2-recount", deltas(rows, second, "v1", 1)), ("3-delete-copies", both)):
        for _ in range(2):
            rollup.commit(name, own)
        if name == "2-recount":
            rollup.compact()
    return rollup


SQL = """
with kept as (select * from (select *, row_number() over (partition by coalesce(text, '') order by doc_id nulls last, source nulls last, lang nulls last) as r from documents) where r = 1),
counts as (
  select source, lang, 'words-1' as tokenizer_version, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n from kept
  union all
  select source, lang, 'parts-2', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]')) from kept
)
select source, lang, tokenizer_version, count(*) as n_docs, sum(n)::bigint as n_tokens from counts group by all
"""
