"""Arrival of files as a stream: each micro-batch's documents are parsed whole and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.plans.service import DocumentParser
from gridloom.sources.grids import text_cells
from gridloom.sources.xlsx import xlsx_cells


def parse_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, parser: DocumentParser, kind: str = "tsv", sep: str = "\t", files_per_batch: int = 1000) -> StreamingQuery:
    """Starts a query that parses new files below ``folder`` and writes their contents as JSON below ``out``.

    A document is a file, so no state goes from batch to batch; a batch that runs again overwrites its own
    folder, so each document is written once.
    """
    if kind == "xlsx":
        files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("maxFilesPerTrigger", files_per_batch).load(folder)
    else:
        lines = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*.{kind}").option("maxFilesPerTrigger", files_per_batch).load(folder)
        files = lines.select(F.input_file_name().alias("path"), "value")

    def parse(batch: DataFrame, n: int) -> None:
        cells = xlsx_cells(batch) if kind == "xlsx" else text_cells(batch, "path", "value", sep)
        parser.contents(parser.parse(cells)).write.mode("overwrite").json(f"{out}/batch={n}")

    return files.writeStream.foreachBatch(parse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
