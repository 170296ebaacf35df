"""A project: named tables in one folder of Parquet, and read-only SQL over them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import schema


@dataclass(frozen=True)
class Config:
    """Thresholds of the checks."""

    word_count_min: int = 200
    near_duplicate: float = 0.9
    image_warn: int = 204800
    image_critical: int = 512000
    title_min: int = 30
    title_max: int = 60
    title_px: int = 600
    desc_min: int = 70
    desc_max: int = 160
    desc_px: int = 920
    max_url_length: int = 100
    segments: tuple[tuple[str, str], ...] = ()
    #: Mappings: id, type (css, xpath or regex), expression, extract (text, html or attr), attribute.
    extractors: tuple[dict, ...] = ()
    #: Mappings: id, pattern, is_regex.
    searches: tuple[dict, ...] = ()
    #: What a store knows a page by: its url, or the id that its crawl gives it (several pages may have one url then).
    known_by: str = "url"


@dataclass
class Project:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    config: Config = Config()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = schema.empty(self.spark, name)
        return self.tables[name]

    def with_tables(self, **tables: DataFrame) -> Project:
        return Project(self.spark, self.tables | tables, self.config)

    def cached(self) -> Project:
        """The project with its tables kept by Spark (memory, then disk): many queries then parse pages once.  They have no page sources."""
        return Project(self.spark, {k: v.cache() if k != "html" else v for k, v in self.tables.items()}, self.config)

    def save(self, path: str) -> None:
        """Every table is overwritten on its own; absent ones become empty."""
        for name in schema.DDL:
            table = self[name]
            if name == "meta":  # the version by which a later reader knows what to add
                version = self.spark.createDataFrame([("schema_version", str(schema.SCHEMA_VERSION))], schema.DDL["meta"])
                table = table.where("key <> 'schema_version'").unionByName(version)
            schema.ensure_columns(table, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def valid(cls, spark: SparkSession, path: str) -> bool:
        """Whether a folder holds a project: its pages can be read and have urls."""
        try:
            return "url" in spark.read.parquet(f"{path}/pages").columns
        except AnalysisException:
            return False

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config = Config()) -> Project:
        """Reads what save wrote; columns that an older project lacks are null."""
        tables = {n: schema.ensure_columns(spark.read.option("mergeSchema", "true").parquet(f"{path}/{n}"), n) for n in schema.DDL}
        return cls(spark, tables, config)

    def sql(self, query: str, limit: int = 200) -> DataFrame:
        """Read-only SQL over the tables: SELECT or WITH, at most 1000 rows, the limit pushed into the plan."""
        if not re.match(r"\s*(select|with)\b", query, re.I) or ";" in query.rstrip().rstrip(";"):
            raise ValueError("only one SELECT or WITH statement")
        for name in schema.DDL:
            if re.search(rf"\b{name}\b", query, re.I):
                self[name].createOrReplaceTempView(name)
        out = self.spark.sql(query.rstrip().rstrip(";"))
        return out.limit(max(1, min(limit, 1000)))
