"""File sources: caches of page blocks as JSON, Markdown documents, tables for evaluation by stem, runs of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


BLOCK = "block_id string, block_type string, page int, content string, bbox struct<x0:double,top:double,x1:double,bottom:double>, source string, num_rows int, num_cols int, numeric_density double, headers array<string>, unit string, meta map<string,string>"


def page_cache(spark: SparkSession, folders: list[str], pattern: str = "*.json") -> DataFrame:
    """Blocks of cached pages: a JSON array of blocks per file. Of files with one name the first folder's counts; `page_no` is the number in the file's name, `place` the block's place."""
    parts = []
    for rank, folder in enumerate(folders):
        raw = spark.read.text(f"{folder}/{pattern}", wholetext=True).withColumn("path", F.input_file_name())
        parts.append(raw.withColumn("rank", F.lit(rank)))
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    files = files.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
    files = files.withColumn("_k", F.row_number().over(W.partitionBy("file").orderBy("rank"))).where("_k = 1")
    # Either an array of blocks or an object with one under "blocks".
    plain, nested = F.from_json("value", f"array<struct<{_as_struct(BLOCK)}>>"), F.from_json("value", f"struct<blocks:array<struct<{_as_struct(BLOCK)}>>>")
    blocks = F.when(F.ltrim("value").startswith("{"), nested["blocks"]).otherwise(plain)
    return files.select("file", F.regexp_extract("file", "([0-9]+)(?=[^0-9]*$)", 1).try_cast("int").alias("page_no"), F.posexplode(blocks).alias("place", "b")).select("file", "page_no", "place", "b.*")


def _as_struct(ddl: str) -> str:
    return ", ".join(part.replace(" ", ":", 1) for part in _fields(ddl))


def _fields(ddl: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[last:k].strip())
            last = k + 1
    return [*out, ddl[last:].strip()]


def markdown_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, line, text): the lines of Markdown files, from 0."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.[^./]*)?$", 1).alias("doc"), "value")
    return raw.select("doc", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


def markdown_tables(lines: DataFrame) -> DataFrame:
    """(doc, table, begin, heading, page, content): runs of table lines with the last heading and page mark above them."""
    w = W.partitionBy("doc").orderBy("line")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    l = lines.withColumn("_pipe", F.trim("text").startswith("|")).withColumn("_h", F.when(F.col("text").rlike("^#{1,6}\\s"), F.trim(F.regexp_replace("text", "^#+\\s+", ""))))
    l = l.withColumn("_p", F.nullif(F.regexp_extract("text", "(?iu)(?:trang|page)\\s*[:#]?\\s*([0-9]+)", 1), F.lit("")).try_cast("int"))
    l = l.withColumns({"heading": F.last("_h", ignorenulls=True).over(up), "page": F.last("_p", ignorenulls=True).over(up), "_new": F.when(F.col("_pipe") & ~F.coalesce(F.lag("_pipe").over(w), F.lit(False)), 1).otherwise(0)})
    l = l.withColumn("table", F.sum("_new").over(up)).where("_pipe")
    return l.groupBy("doc", "table").agg(F.min("line").alias("begin"), F.min_by("heading", "line").alias("heading"), F.min_by("page", "line").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))


def by_stem(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("json", "html", "md")) -> DataFrame:
    """(table_id, format, content): files by their stem; of several formats the last of `suffixes` counts."""
    raw = spark.read.text(f"{folder}/*.{{{','.join(suffixes)}}}", wholetext=True).withColumn("_f", F.input_file_name())
    f = raw.select(F.regexp_extract("_f", "([^/]+)\\.([^./]+)$", 1).alias("table_id"), F.regexp_extract("_f", "\\.([^./]+)$", 1).alias("format"), F.col("value").alias("content"))
    rank = F.array_position(F.array(*[F.lit(s) for s in suffixes]), F.col("format"))
    return f.groupBy("table_id").agg(F.max_by(F.struct("format", "content"), rank).alias("b")).select("table_id", "b.*")


def latest_run(spark: SparkSession, folder: str) -> str | None:
    """The name of the sub-folder with the latest file, by file listings alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    run = F.regexp_extract("path", f"{folder.rstrip('/')}/([^/]+)/", 1)
    row = f.where(run != "").agg(F.max_by(run, F.struct("modificationTime", "path")).alias("r")).first()
    return row["r"] if row else None


def document_metadata(files: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """files (stem, cover) with ticker and year: of the stem's words the first of three or four capitals that is no stop word, else that of a known name on the cover; the stem's last year, else the cover's first."""
    stop = ["PDF", "BCTC", "DOC", "FS", "ANN", "REP", "NAM", "QUY", "RIENG", "HOP"]
    words = F.filter(F.regexp_extract_all(F.upper("stem"), F.lit("(?:^|[^A-Z0-9])([A-Z]{3,4})(?![A-Z0-9])"), 1), lambda x: ~x.isin(stop))
    ticker = F.get(words, F.lit(0))
    for name, code in (known or {}).items():
        ticker = F.coalesce(ticker, F.when(F.lower("cover").contains(name.lower()), F.lit(code)))
    years = F.regexp_extract_all("stem", F.lit("(20[12][0-9])"), 1)
    first = F.nullif(F.regexp_extract("cover", "(20[12][0-9])", 1), F.lit(""))
    return files.withColumn("ticker", ticker).withColumn("year", F.coalesce(F.get(years, F.size(years) - 1), first).try_cast("int"))


__all__ = ["by_stem", "document_metadata", "latest_run", "markdown_documents", "markdown_tables", "page_cache"]
