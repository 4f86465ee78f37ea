"""Files as tables of text units, and files written with other texts in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.redact import TOKEN
from umbra.sources import formats

_UNITS = "path string, format string, ctx string, ord int, text string, kind string, error string"


def format_column(path: Column) -> Column:
    """The format of a path by its suffix; null if it isn't supported."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, suffixes in formats.ROUTES.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, size, content) of all files below a path; unsupported ones have a null format."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", format_column(F.col("path")).alias("format"), F.col("length").alias("size"), "content")


def units(files: DataFrame) -> DataFrame:
    """files -> a row per unit: path, format, ctx, ord, text, kind (text or formula), error.

    A file that can't be read is one row with an error; the others go on. A file's units stay in order.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["format"], batch["content"], strict=True):
                try:
                    if kind is None:
                        raise ValueError(f"unsupported file type: {formats.suffix_of(path)}")
                    found = formats.READERS[kind](bytes(content))
                    rows = [(path, kind, ctx, i, text, what, None) for i, (ctx, text, what) in enumerate(found)]
                except Exception as e:  # one broken file must not end the job: its row says what is wrong
                    rows = [(path, kind, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "format", "ctx", "ord", "text", "kind", "error"]).astype({"ord": "Int64"})

    return files.select("path", "format", "content").mapInPandas(read, _UNITS)


def as_units(found: DataFrame) -> DataFrame:
    """The units that detection takes: texts, by their file."""
    return found.where("error is null and kind = 'text'").select(F.col("path").alias("doc_id"), "ctx", "ord", "text")


def text_file_units(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as units; bytes that aren't UTF-8 become replacement characters. Plan time knows nothing of their content."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.lit("").alias("ctx"), F.lit(0).alias("ord"), F.col("value").alias("text"))


def line_units(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files of any size as units, split by Spark: no line is cut, so no value across a border is lost."""
    place = F.col("_metadata.file_block_start")
    read = spark.read.text(path)
    return read.select(F.input_file_name().alias("doc_id"), place.alias("block"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("text")).select("doc_id", F.concat(F.lit("block "), "block").alias("ctx"), "ord", "text")


def json_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """String leaves of JSON texts as units by path, in order; texts that don't parse are one unit."""

    @F.pandas_udf("array<struct<ctx:string,text:string>>")
    def leaves(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"ctx": c, "text": x} for c, x, _ in formats.json_units(t.encode("utf-8", "replace"))] for t in texts], dtype=object)

    each = docs.select(docs[id_col].alias("doc_id"), F.posexplode(leaves(docs[text_col])).alias("ord", "u"))
    return each.select("doc_id", F.col("u.ctx").alias("ctx"), "ord", F.col("u.text").alias("text"))


def replace_in_files(files: DataFrame, spans: DataFrame) -> DataFrame:
    """files and spans(path, ctx, st, en, token), without overlap -> (path, format, content, error) of the files with the spans replaced."""
    by = spans.groupBy("path").agg(F.collect_list(F.struct("ctx", "st", "en", "token")).alias("spans"))
    joined = files.join(by, "path", "left").select("path", "format", "content", "spans")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content, found in batch.itertuples(index=False):
                wanted: formats.Spans = {}
                for s in found if found is not None else ():
                    wanted.setdefault(s["ctx"], []).append((int(s["st"]), int(s["en"]), s["token"]))
                try:
                    if kind is None:
                        raise ValueError(f"unsupported file type: {formats.suffix_of(path)}")
                    row = (path, kind, formats.WRITERS[kind](bytes(content), wanted), None)
                except Exception as e:  # as in units()
                    row = (path, kind, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "format", "content", "error"])

    return joined.mapInPandas(write, "path string, format string, content binary, error string")


def restore_files(files: DataFrame, vault: DataFrame) -> DataFrame:
    """files and vault(path, token, value) -> (path, format, content, error) with the tokens of each file's own vault replaced by their values,
    whatever the format that can be written. Tokens that the vault lacks stay; of several values of a token the least is taken."""
    each = vault.where("token is not null").groupBy("path", "token").agg(F.min("value").alias("value"))
    maps = each.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("tokens"))
    joined = files.join(maps, "path", "left").select("path", "format", "content", "tokens")
    token = re.compile(TOKEN)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content, tokens in batch.itertuples(index=False):
                known = dict(tokens) if tokens is not None else {}
                try:
                    if kind is None:
                        raise ValueError(f"unsupported file type: {formats.suffix_of(path)}")
                    spans: formats.Spans = {}
                    for ctx, text, what in formats.READERS[kind](bytes(content)) if known else ():
                        own = [(m.start(), m.end(), known[m[0]]) for m in token.finditer(text) if m[0] in known]
                        if own and what == "text":
                            spans[ctx] = own
                    row = (path, kind, formats.WRITERS[kind](bytes(content), spans) if spans else bytes(content), None)
                except Exception as e:  # as in units()
                    row = (path, kind, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "format", "content", "error"])

    return joined.mapInPandas(write, "path string, format string, content binary, error string")


def sanitized_name(path: Column) -> tuple[Column, Column]:
    """Names of the sanitized file and of its vault: stem, _sanitized, and the suffix or .vault."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    suffix = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.concat(stem, F.lit("_sanitized"), suffix), F.concat(stem, F.lit("_sanitized.vault"))


def names_file(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file, one a line; blank lines and lines that begin with # don't count, and a missing file has none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "name string")
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


# Words of categories that are no names.
CATEGORIES = ("alle", "total", "annet", "other", "ukjent")


def cleaned_names(raw: DataFrame) -> DataFrame:
    """Names of a statistics table (name): without what stands in parentheses, capitals as title case, categories and single letters left out."""
    bare = F.trim(F.regexp_replace(F.trim("name"), r"\s*\(.*$", ""))
    title = F.when((bare == F.upper(bare)) & (bare != F.lower(bare)), F.initcap(F.lower(bare))).otherwise(bare)
    named = raw.select(title.alias("name"))
    for c in CATEGORIES:
        named = named.where(~F.contains(F.lower("name"), F.lit(c)))
    return named.where("length(name) >= 2").distinct()
