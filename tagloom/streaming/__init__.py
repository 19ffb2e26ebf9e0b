"""Tag counts over records that arrive as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.counts import tag_counts
from ..operators.records import tag
from ..sources.files import parse_sam


def stream_tag_counts(spark: SparkSession, folder: str, name: str = "CB", files_per_trigger: int = 100) -> DataFrame:
    """Running counts (idx, value, count) of a tag's parts over SAM files that arrive in a folder; for output mode `complete` or `update`."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return tag_counts(parse_sam(lines).select(tag(name).alias(name)), name)
