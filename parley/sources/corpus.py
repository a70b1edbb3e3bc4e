"""Document corpus: listing, extraction, cleaning, caching (SRC-4..7,
SNK-3, SNK-4, AG-9).

The reference extracts PDFs folder by folder into a JSON cache. Here the
raw files are any table with a path and a markup text (the driver's
``pages``), extraction is a pair of regular-expression extractors with the
reference's fallback rule, and every sector is built in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.jsonfn import object_entry_array
from parley.functions.text import base_name, clean_extracted, strip
from parley.schemas import CORPUS_SCHEMA
from parley.session import dealt
from parley.sources.paths import below, exists

# Markup that never carries body text: scripts, styles, comments.
_NON_TEXT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"
_TAG = r"(?s)<[^>]*>"


def paragraph_text(html) -> Column:
    """Primary extractor: the text of ``<p>`` elements, one per line."""
    body = F.regexp_replace(F.col(html) if isinstance(html, str) else html, _NON_TEXT, "")
    paras = F.regexp_extract_all(body, F.lit(_PARAGRAPH), 1)
    return F.array_join(F.transform(paras, lambda p: F.regexp_replace(p, _TAG, "")), "\n")


def all_text(html) -> Column:
    """Fallback extractor: every tag removed (scripts and styles first)."""
    body = F.regexp_replace(F.col(html) if isinstance(html, str) else html, _NON_TEXT, "")
    return F.regexp_replace(body, _TAG, " ")


def extract_with_fallback(primary: Column, fallback: Column) -> Column:
    """SRC-6: the primary text unless it is blank (after a Python-style
    strip) or failed (NULL), then the fallback; a failed fallback gives
    ``''``."""
    return F.when(F.coalesce(F.length(strip(primary)), F.lit(0)) > 0, primary) \
        .otherwise(F.coalesce(fallback, F.lit("")))


def catalog(spark: SparkSession, root: str, ignore_case: bool = True) -> DataFrame:
    """SRC-5: list ``<root>/<sector>/*.pdf`` as ``(sector, path, name)``.

    Only file metadata is read (the binary content column is pruned).
    ``ignore_case=False`` keeps the exact ``.pdf`` suffix only. A missing
    root gives an empty frame."""
    # The suffix test runs in the file listing itself (a glob), so other
    # files never become rows.
    glob = "*.[pP][dD][fF]" if ignore_case else "*.pdf"
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", glob).load(root).select("path"))
    except Exception as e:  # noqa: BLE001 - missing folder -> empty listing
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], "sector string, path string, name string")
        raise
    name = base_name(F.col("path"))
    parts = F.split(below(spark, root, F.col("path")), "/")
    sector = parts[0]
    # Only direct children of a sector folder; deeper files are no sector's.
    return files.filter(F.size(parts) == 2).select(sector.alias("sector"), "path", name.alias("name"))


def build_corpus(raw: DataFrame, path_col: str = "path", markup_col: str = "html",
                 sector_col: str = "sector") -> DataFrame:
    """SRC-7 + AG-9: ``(sector, name, text)`` per file: extract with
    fallback, clean (SC-2), name = base name of the path. Files of one
    sector with the same base name: the last path wins (the reference's
    dict overwrite; listing order there is undefined, path order here, and
    the larger text for equal paths)."""
    text = clean_extracted(extract_with_fallback(paragraph_text(markup_col), all_text(markup_col)))
    df = dealt(raw).select(F.col(sector_col).alias("sector"), F.col(path_col).alias("path"),
                    base_name(F.col(path_col)).alias("name"), text.alias("text"))
    # Last path per (sector, name) as a max over structs: partial
    # aggregation, no sort of a large group of same-named files.
    last = df.groupBy("sector", "name").agg(F.max(F.struct("path", "text")).alias("_l"))
    return last.select("sector", "name", F.col("_l.path").alias("path"), F.col("_l.text").alias("text"))


def pages_as_files(pages: DataFrame) -> DataFrame:
    """The driver's ``pages`` as raw files: path = URL path without query
    or fragment, sector = its first path segment (the language folder)."""
    path = F.regexp_replace(F.regexp_extract(F.col("url"), r"^[a-z]+://[^/]+(/[^?#]*)", 1), "/$", "")
    sector = F.regexp_extract(path, r"^/([^/]+)", 1)
    return pages.select(sector.alias("sector"), F.concat(F.lit("pages"), path).alias("path"), "html")


def write_corpus(corpus: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-3: write the corpus cache partitioned by sector (a later read
    for one sector prunes the others)."""
    corpus.write.mode("overwrite").partitionBy("sector").format(fmt).save(path)


def load_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-4: read a corpus cache; a missing cache is an empty corpus."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        return spark.createDataFrame([], CORPUS_SCHEMA)
    found = spark.read.format(fmt).load(path) if path_has_data(spark, path, fmt) else None
    return spark.createDataFrame([], CORPUS_SCHEMA) if found is None else found


def load_json_corpus(spark: SparkSession, path: str, sector: str | None = None) -> DataFrame:
    """SRC-4 for the reference's cache format: one JSON object
    ``{name: text}`` per file; entries keep their order as ``ordinal``, and a
    repeated name keeps its last text. With several files give each its own
    ``sector``: ``(sector, ordinal)`` is the order of the whole corpus."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], CORPUS_SCHEMA)
        raise
    e = object_entry_array("value", "name", "text", "ordinal")
    return raw.select(F.lit(sector).cast("string").alias("sector"), F.inline(e)) \
        .select("sector", "name", F.col("ordinal").cast("bigint").alias("ordinal"), "text")


def path_has_data(spark: SparkSession, path: str, fmt: str) -> bool:
    """Whether a written folder holds any data file."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/sector=*/*.{fmt}")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.globStatus(pattern) or []) > 0


def load_or_build_corpus(spark: SparkSession, cache_path: str, build) -> DataFrame:
    """SNK-4: read the cache when present, else build it (``build()``
    returns the corpus DataFrame), write it and read it back. A folder counts
    as a cache once its writer committed it (``_SUCCESS``). No staleness check,
    as in the reference."""
    if not exists(spark, f"{cache_path.rstrip('/')}/_SUCCESS"):
        write_corpus(build(), cache_path)
    return load_corpus(spark, cache_path)
