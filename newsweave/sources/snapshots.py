"""Snapshots of matched items: build, seal, manifest retention and verification."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave import constants as K
from newsweave.operators.matching import entity_match
from newsweave.operators.ranking import join_on_keys, newest, top_k, within_quota
from newsweave.session import checkpointed


def build_snapshot(items: DataFrame, companies: DataFrame, cap: int | None = None, text_chars: int | None = None,
                   stream: str = "stream_id") -> tuple[DataFrame, DataFrame]:
    """(entries, source status) of each snapshot stream.  Entries are the newest `cap` matched (item, company)
    pairs, undated last; a stream beyond the cap is flagged as truncated.  Without limits all pairs and whole texts are kept."""
    slim = items.select(stream, "item_id", "source_id", "published_at")
    pairs = checkpointed(entity_match(items, companies).join(slim, "item_id"), "snapshot-pairs")
    order = [newest(F.col("published_at")), F.col("item_id"), F.col("company_id")]
    if cap is None:
        kept = pairs.withColumn("admitted", F.lit(True))
    else:
        kept = within_quota(pairs, [stream], order, cap)
    truncated = kept.groupBy(stream).agg((~F.bool_and("admitted")).alias("truncated"))
    body = F.substring("text", 1, text_chars) if text_chars else F.col("text")
    contents = items.select("item_id", "title", "url", "text", "language")
    entries = kept.where("admitted").join(contents, "item_id").select(stream, "item_id", "company_id", "source_id", "title", "url", body.alias("text"), "published_at", "language")
    scanned = items.groupBy(stream, "source_id").agg(F.count(F.lit(1)).alias("scanned"))
    matched = pairs.groupBy(stream, "source_id").agg(F.count(F.lit(1)).alias("matched"))
    status = scanned.transform(lambda df: join_on_keys(df, matched, [stream, "source_id"], "left")).transform(lambda df: join_on_keys(df, truncated, [stream], "left")).select(
        stream, "source_id", "scanned", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return entries, status


def write_snapshot(entries: DataFrame, path: str, stream: str = "stream_id") -> None:
    entries.write.mode("overwrite").option("compression", "zstd").partitionBy(stream).parquet(path)


def seal(payload: Column, key: Column, aad: str) -> Column:
    """AES-GCM over a payload, bound to `aad`."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(aad))


def unseal(sealed: Column, key: Column, aad: str) -> Column:
    """Payload text; null when the key, the additional data or the bytes are wrong."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string")


@F.pandas_udf(T.BinaryType())
def _compress(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda text: zstandard.compress(text.encode(), 3), na_action="ignore")


@F.pandas_udf(T.StringType())
def _decompress(packed: pd.Series) -> pd.Series:
    def text(raw: bytes) -> str | None:
        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(bytes(raw)).decode()
        except (zstandard.ZstdError, UnicodeDecodeError):
            return None

    return packed.map(text, na_action="ignore")


def pack_and_seal(payload: Column, key: Column, aad: str) -> Column:
    """Compress a payload, then encrypt it: encrypted bytes do not compress, so this comes first."""
    return seal(_compress(payload.cast("string")), key, aad)


def unseal_and_unpack(sealed: Column, key: Column, aad: str) -> Column:
    """Payload text; null when the key, the additional data or the bytes are wrong, or hold no compressed text."""
    return _decompress(F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)))


def manifest_retain(manifest: DataFrame, added: DataFrame, keep: int = K.SNAPSHOTS_KEPT, stream: str = "stream_id") -> DataFrame:
    """Manifest rows after an append, each marked `kept` or expired.  A row with the same id replaces the old
    one; the newest `keep` ids per stream stay."""
    replaced = join_on_keys(manifest, added.select(stream, "snapshot_id"), [stream, "snapshot_id"], "left_anti")
    return within_descending(replaced.unionByName(added.select(*manifest.columns)), stream, keep)


def within_descending(rows: DataFrame, stream: str, keep: int) -> DataFrame:
    newest_ids = top_k(rows, [stream], [F.col("snapshot_id").desc()], keep, "_rank").groupBy(stream).agg(F.min("snapshot_id").alias("_cut"))
    return join_on_keys(rows, newest_ids, [stream]).withColumn("kept", F.coalesce(F.col("snapshot_id") >= F.col("_cut"), F.lit(False))).drop("_cut")


def manifest_verify(payloads: DataFrame, manifest: DataFrame, now: Column) -> DataFrame:
    """Compare each stored payload (snapshot_id, payload, finished_at) with its manifest row (sha256, finished_at)."""
    expected = manifest.select("snapshot_id", F.col("sha256").alias("_sha"), F.col("finished_at").alias("_finished"))
    status = (
        F.when(F.col("_sha").isNull(), "unlisted")
        .when(F.sha2("payload", 256) != F.col("_sha"), "bad_hash")
        .when(~F.col("finished_at").eqNullSafe(F.col("_finished")), "mismatch")
        .when(F.col("finished_at") > now + F.expr(f"INTERVAL {K.FUTURE_SKEW_SECONDS} SECOND"), "future")
        .otherwise("ok")
    )
    return payloads.join(expected, "snapshot_id", "left").withColumn("status", status).drop("_sha", "_finished")
