"""Image references as tables: kinds, features, summaries, words of file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


def reference_kind(ref: Column, is_local: Column | None = None) -> Column:
    """empty, inline, remote, local (where is_local) or missing."""
    text = F.lower(F.trim(F.coalesce(ref, F.lit(""))))
    kind = F.when(text == "", "empty").when(text.startswith("data:image/"), "inline").when(text.startswith("http://") | text.startswith("https://"), "remote")
    return (kind.when(is_local, "local") if is_local is not None else kind).otherwise("missing")


def with_local(df: DataFrame, ref: str, files: DataFrame) -> DataFrame:
    """df with is_local and byte content of references that a listing (path, content) has."""
    return df.join(files.select(F.col("path").alias(ref), "content"), ref, "left").withColumn("is_local", F.col("content").isNotNull())


def manifest_features(df: DataFrame, ref: str, content: str | None = None) -> DataFrame:
    """df with kind, ext, sizes, dimensions, aspect and two hash fractions of a reference column."""
    c = F.trim(F.coalesce(F.col(ref), F.lit("")))
    raw = F.coalesce(scalar.data_url_bytes(c), F.col(content) if content else F.lit(None).cast("binary"))
    out = df.withColumns(
        {
            "kind": reference_kind(F.col(ref), F.col(content).isNotNull() if content else None),
            "ext": F.when(F.lower(c).startswith("data:image/"), scalar.extension(F.lit(""), scalar.data_url_mime(c))).otherwise(scalar.extension(c)),
            "basename_len": F.length(F.regexp_extract(scalar.url_path(c), r"([^/]*)$", 1)),
            "ref_len": F.length(c),
            "_raw": raw,
            "hash_0": scalar.hash_fraction(c, 0),
            "hash_1": scalar.hash_fraction(c, 1),
        }
    )
    out = out.withColumns({"is_remote": F.col("kind") == "remote", "has_inline": F.col("kind") == "inline", "byte_size": F.coalesce(F.octet_length("_raw"), F.lit(0)), "width": F.coalesce(scalar.image_size(F.col("_raw"), "width"), F.lit(0)), "height": F.coalesce(scalar.image_size(F.col("_raw"), "height"), F.lit(0))})
    return out.withColumn("aspect", F.coalesce(F.round(F.try_divide("width", "height"), 6), F.lit(0.0))).drop("_raw")


def manifest_summary(featured: DataFrame, label: str | None = None) -> DataFrame:
    """One row (or one for each label): references, processed, fallback, failed and means; of sizes over those that are known, else 0."""
    keys = [label] if label else []
    known = lambda c: F.coalesce(F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 3), F.lit(0.0))
    return featured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("references"), F.count_if(F.col("byte_size") > 0).alias("processed"),
        F.count_if((F.col("byte_size") == 0) & (F.col("kind") == "remote")).alias("fallback"), F.count_if(F.col("kind").isin("missing", "empty")).alias("failed"),
        known("width").alias("mean_width"), known("height").alias("mean_height"), known("byte_size").alias("mean_byte_size"), F.avg("ref_len").alias("mean_ref_len"),
    )


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """label, count: the commonest first, ties by label; rows without a label don't count."""
    rows = df.select(F.trim(F.col(column).cast("string")).alias("label")).where("label <> ''")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "label")


def text_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, extracted (rows with text), and mean length and tokens of these, 0 if there are none."""
    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(text.isNotNull(), c)), 3), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(text).alias("extracted"), mean(F.length(text)).alias("mean_length"), mean(F.size(scalar.tokens(text))).alias("mean_tokens"))


def reference_text(df: DataFrame, ref: str) -> DataFrame:
    """df with text (words of the file name), text_len and token_count."""
    out = df.withColumn("text", scalar.reference_words(F.col(ref)))
    return out.withColumns({"text_len": F.length("text"), "token_count": F.size(scalar.tokens(F.col("text")))})


def top_tokens(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The k commonest lower-case tokens of a text column."""
    return df.select(F.explode(scalar.tokens(F.col(column))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(k)
