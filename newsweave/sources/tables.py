"""Stored tables: fixed schemas, JSON columns and ordered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave import constants as K

ANALYSIS = (
    "struct<event_type:string,sentiment:string,summary:string,facts:array<struct<claim:string,quote:string>>,"
    "impacts:array<struct<stakeholder:string,direction:string,explanation:string>>,uncertainty:string,mode:string,"
    "model:string,translated_title:string,translated_text:string>"
)
SCHEMAS = {
    "companies": "company_id string, name string, domain string, industry string, aliases array<string>, description string, demo boolean, created_at timestamp",
    "sources": "source_id string, name string, url string, kind string, region string, language string, enabled boolean, status string, last_fetched_at timestamp, error string",
    "articles": "article_id string, company_id string, source_id string, source_name string, title string, url string, text string, published_at timestamp, "
                f"fetched_at timestamp, language string, region string, content_hash string, cluster_id string, analysis {ANALYSIS}, embedding array<float>, "
                "embedding_model string, content_scope string, demo boolean",
    "runs": "run_id string, company_id string, source_id string, started_at timestamp, finished_at timestamp, status string, scanned int, matched int, inserted int, duplicates int, error string",
    "jobs": "job_id string, kind string, company_id string, status string, data string, error string, created_at timestamp, updated_at timestamp",
    "settings": "key string, value string",
    "leases": "key string, expires_at bigint",
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Parquet scan with the declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def companies(df: DataFrame) -> DataFrame:
    return df.orderBy("created_at", "name")


def sources(df: DataFrame) -> DataFrame:
    return df.orderBy("name")


def latest_runs(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("started_at").desc(), "run_id").limit(limit)


def latest_jobs(df: DataFrame, kind: str | None = None, *, limit: int) -> DataFrame:
    return (df.where(F.col("kind") == kind) if kind else df).orderBy(F.col("updated_at").desc(), "job_id").limit(limit)


def decode_json(column: Column, schema: str) -> Column:
    return F.from_json(column, schema)


def encode_json(column: Column) -> Column:
    return F.to_json(column)
