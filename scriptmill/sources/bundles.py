"""A table function that takes a table: which script of a page declares the names that another one uses.

    SELECT * FROM js_bundle(TABLE(SELECT page_id, ordinal, source FROM scripts) PARTITION BY page_id ORDER BY ordinal)

``analyze`` gives the result's schema from the table's own: its first column (the page) keeps its name and type, and so does its
second (the script). A partition is a page; only names are held, not its scripts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from scriptmill.sources.facts import _rows, reference_rows, symbol_rows


class JsBundle:
    """For each name that a script uses and doesn't declare: the script of the page that declares it at its top, the first if several
    do, and how often it is used; null where no script declares it."""

    @staticmethod
    def analyze(scripts: AnalyzeArgument) -> AnalyzeResult:
        if not scripts.isTable or len(scripts.dataType.fields) < 3:
            raise ValueError("js_bundle takes a table of page, script and source")
        page, script, source = scripts.dataType.fields[:3]
        if source.dataType != StringType():
            raise ValueError(f"{source.name} holds no text")
        schema = StructType().add(page.name, page.dataType).add(script.name, script.dataType).add("name", StringType()).add("declared_in", script.dataType).add("uses", LongType())
        return AnalyzeResult(schema)

    def __init__(self):
        self.page = None
        self.declared: dict[str, object] = {}
        self.used: dict[tuple[object, str], int] = {}

    def eval(self, row: Row) -> None:
        self.page, script, source = row[0], row[1], row[2]
        for _, scope, name, *_ in _rows(source, symbol_rows):
            if scope == 0 and (name not in self.declared or script < self.declared[name]):
                self.declared[name] = script
        for _, symbol, name, _ in _rows(source, reference_rows):
            if symbol is None:
                self.used[script, name] = self.used.get((script, name), 0) + 1

    def terminate(self) -> Iterator[tuple]:
        for (script, name), uses in self.used.items():
            yield self.page, script, name, self.declared.get(name), uses


def register(spark: SparkSession) -> None:
    spark.udtf.register("js_bundle", F.udtf(JsBundle))


def bundled(scripts: DataFrame, page: str = "page_id", script: str = "ordinal", source: str = "source") -> DataFrame:
    """The table function over a frame."""
    spark = scripts.sparkSession
    register(spark)
    return spark.sql(f"SELECT * FROM js_bundle(TABLE(SELECT `{page}`, `{script}`, `{source}` FROM {{scripts}}) PARTITION BY `{page}` ORDER BY `{script}`)", scripts=scripts)
