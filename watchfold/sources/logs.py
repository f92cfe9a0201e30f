"""Log sources: files or directories of raw records, batch or stream, to events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.normalize_cloud import normalize_cloudtrail, parsed_records
from ..operators.normalize_flow import normalize_cicids
from ..operators.normalize_text import normalize_auth_log, normalize_syslog

Normalizer = Callable[..., DataFrame]
BROKEN = "_broken_line"

_REGISTRY: dict[str, Normalizer] = {
    "syslog": normalize_syslog,
    "cloudtrail": normalize_cloudtrail,
    "auth_log": normalize_auth_log,
    "auth": normalize_auth_log,
    "cicids": normalize_cicids,
}


def register_source(name: str, normalizer: Normalizer) -> None:
    _REGISTRY[name.lower()] = normalizer


def get_normalizer(name: str) -> Normalizer:
    found = _REGISTRY.get(name.lower())
    if found is None:
        raise ValueError(f"Unknown source type: '{name}'. Available: {list_source_types()}")
    return found


def list_source_types() -> list[str]:
    return list(_REGISTRY)


def read_lines(spark: SparkSession, path, stream: bool = False, **options) -> DataFrame:
    """One row per non-blank trimmed line; undecodable bytes become replacement characters."""
    reader = spark.readStream if stream else spark.read
    text = reader.options(**options).text(path)
    return (text.select(strip(F.col("value")).alias("raw"),
                        F.col("_metadata.file_path").alias("path"))
            .filter(F.length("raw") > 0))


def read_flows(spark: SparkSession, path, stream_schema=None, **options) -> DataFrame:
    """Flow CSV with a header; all columns text, names trimmed; ``path`` is the file, unless it has such a column."""
    options = {"header": True, "mode": "PERMISSIVE", **options}
    if stream_schema is not None:
        df = spark.readStream.schema(stream_schema).options(**options).csv(path)
    else:
        df = spark.read.options(**options).csv(path)
    names = [c.strip() for c in df.columns]
    if "path" not in names:
        df, names = df.select("*", "_metadata.file_path"), [*names, "path"]
    return df.toDF(*names)


def split_flows(spark: SparkSession, path, columns: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Flow CSV as good rows, as ``read_flows`` has them, and a quarantine table of the lines that have another
    number of fields than the header, or than ``columns`` where the files have none."""
    options = {"header": columns is None, **options}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns or spark.read.options(**options).csv(path).columns])
    fields = [F.col(f"`{c}`") for c in schema.names]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])).options(
        **options, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN).csv(path)
    names = [c.strip() for c in schema.names]
    file = [] if "path" in names else [F.col("_metadata.file_path")]
    # The reader refuses to give the broken lines without any field, so both filters count the fields.
    filled = F.size(F.array_compact(F.array(*fields)))
    good = rows.filter(F.col(BROKEN).isNull() & (filled >= 0)).select(*fields, *file).toDF(*names, *["path" for _ in file])
    error = F.concat(F.lit("fields filled: "), filled.cast("string"), F.lit(f" of {len(fields)}"))
    bad = rows.filter(F.col(BROKEN).isNotNull() & (filled >= 0)).select(
        F.col(BROKEN).alias("raw"), F.col("_metadata.file_path").alias("path"), error.alias("found"))
    return good, _quarantine(bad, "cicids", F.col("found"))


def read_events(spark: SparkSession, path, source_type: str, **kwargs) -> DataFrame:
    """Raw files of one source type as events; bad records are left to ``split_bad`` and ``split_flows``."""
    normalize = get_normalizer(source_type)
    if normalize is normalize_cicids:
        return normalize(split_flows(spark, path)[0], **kwargs)
    return normalize(read_lines(spark, path), **kwargs)


def split_bad(lines: DataFrame, source_type: str) -> tuple[DataFrame, DataFrame]:
    """Good records and a quarantine table; of lines, only JSON ones can be malformed (CSV: ``split_flows``).

    The quarantine row names the file and a hash of the record instead of a line number; it keeps the whole
    record, so that it can be replayed, and a preview of 500 characters.
    """
    if source_type.lower() != "cloudtrail":
        empty = lines.filter(F.lit(False))
        return lines, _quarantine(empty, source_type, "")
    parsed = parsed_records(lines)
    good = parsed.filter(~F.col("bad")).drop("rec", "bad")
    return good, _quarantine(parsed.filter("bad"), source_type, "not a JSON object")


def _quarantine(bad: DataFrame, source_type: str, error: str | Column) -> DataFrame:
    path = F.col("path") if "path" in bad.columns else F.lit(None).cast("string")
    return bad.select(F.lit(source_type).alias("source_type"), path.alias("path"),
                      F.sha2("raw", 256).alias("record_hash"),
                      "raw", F.substring("raw", 1, 500).alias("preview"),
                      F.lit(error).alias("error"))


def union_events(*frames: DataFrame) -> DataFrame:
    """Normalized sources as one event table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
