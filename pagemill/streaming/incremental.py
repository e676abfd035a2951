"""Pages as they arrive: a stream of page files becomes extracted Markdown, upserted by URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extract_markdown
from ..sources.store import cache_write

PAGES = "page_id bigint, url string, html string"


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def extract_stream(pages: DataFrame, cache: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends what is extracted to the cache table, whose readers take the latest entry of a URL, so that a batch that is run
    again does no harm."""
    writer = extract_markdown(pages).writeStream.foreachBatch(lambda batch, _: cache_write(batch, cache)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
