"""Raw pages: folders of JSON files, and tables of pages or documents.

Every source gives (path, url, content, file_size); path orders the input.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

log = logging.getLogger(__name__)
JSON_SCHEMA = StructType([StructField(n, StringType()) for n in ("url", "content", "encoding")])


def crawl(spark: SparkSession, root: str, files: int = -1, on_error: str = "fail") -> DataFrame:
    """JSON files of one page each, exactly two levels below root; files >= 0 keeps the first so many paths.

    on_error: 'fail' ends the job at a bad file, 'skip' leaves it out.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    _only_folders(spark, root, on_error)
    mode = "FAILFAST" if on_error == "fail" else "DROPMALFORMED"
    raw = spark.read.schema(JSON_SCHEMA).option("multiLine", True).option("mode", mode).json(f"{root}/*/*")
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("content", F.lit("")).alias("content"), F.col("_metadata.file_size").alias("file_size"))
    return raw if files < 0 else raw.orderBy("path").limit(files)


def _only_folders(spark: SparkSession, root: str, on_error: str) -> None:
    """The first level holds folders; a plain file there is an error, or with 'skip' passed over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    files = [str(s.getPath()) for s in found if s.isFile()]
    log.info("%s: %d folders", root, len(found) - len(files))
    if files and on_error == "fail":
        raise NotADirectoryError(files[0])


def from_pages(pages: DataFrame) -> DataFrame:
    """The table of pages (page_id, url, html)."""
    return pages.select(F.col("page_id").alias("path"), "url", F.col("html").alias("content"), F.octet_length("html").cast("long").alias("file_size"))


def from_documents(documents: DataFrame) -> DataFrame:
    """The table of documents (doc_id, text): plain text, each its own URL."""
    return documents.select(F.col("doc_id").alias("path"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("file_size"))
