"""Task and profile dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read_profiles(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Profile texts, one file each; the slug is the file name without its ending."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
           .text(path, wholetext=True))
    slug = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    files = raw.select(slug.alias("slug"), F.col("_metadata.file_name").alias("_file"), F.col("value").alias("text"))
    return split_front_matter(files, "text", "slug", "_file").drop("_file")


def split_front_matter(df: DataFrame, text: str, slug: str, file: str | None = None) -> DataFrame:
    """Metadata, body and size of each text; without front matter slug and file name give the defaults."""
    meta = tx.front_matter_map(text)
    body = tx.front_matter_body(text)
    return df.select(
        "*", meta.alias("metadata"), body.alias("content")).withColumns({
            "name": F.coalesce(F.col("metadata")["name"], F.col(slug)),
            "description": F.coalesce(F.col("metadata")["description"],
                                      F.concat(F.lit("Custom profile ("), F.col(file or slug), F.lit(")"))),
            "variant": F.col("metadata")["variant"],
            "tokens": tx.approx_tokens("content"),
        }).drop(text)


class Tasks:
    """A task table that narrows step by step."""

    def __init__(self, df: DataFrame):
        self.df = df

    def by_type(self, *types: str) -> "Tasks":
        return Tasks(self.df.where(F.col("task_type").isin(list(types))))

    def by_difficulty(self, *levels: str) -> "Tasks":
        return Tasks(self.df.where(F.col("difficulty").isin(list(levels))))

    def by_name(self, *names: str) -> "Tasks":
        return Tasks(self.df.where(F.col("name").isin(list(names))))

    def by_tag(self, tag: str) -> "Tasks":
        return Tasks(self.df.where(F.array_contains("tags", tag)))

    def descriptions(self) -> DataFrame:
        """Name and description of the tasks that have both."""
        has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
        return self.df.where(has("name") & has("description")).select("name", "description")
