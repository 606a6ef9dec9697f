"""Sealed mappings: canonical JSON under AES-GCM, by Spark's own functions."""

from __future__ import annotations

import base64
import os
import secrets
from collections.abc import Mapping as MappingOf
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.schemas import MAPPING, METADATA

KEY_VARIABLE = "CLOAKWORK_MAPPING_KEY"
DOCUMENT = f"struct<mappings:array<{MAPPING}>,metadata:{METADATA}>"


class MappingDecryptionError(ValueError):
    """The key is wrong or the sealed mapping is damaged."""


@dataclass(frozen=True, repr=False)
class MappingKey:
    """A 32-byte key as URL-safe base64; it is never a column and never printed."""

    text: str

    def __post_init__(self) -> None:
        try:
            size = len(base64.urlsafe_b64decode(self.text.encode("ascii")))
        except ValueError as error:
            raise ValueError("the mapping key is not URL-safe base64") from error
        if size != 32:
            raise ValueError("the mapping key must have 32 bytes")

    def __repr__(self) -> str:
        return "MappingKey(...)"

    @classmethod
    def generate(cls) -> MappingKey:
        return cls(base64.urlsafe_b64encode(secrets.token_bytes(32)).decode())

    @classmethod
    def from_environment(cls, environment: MappingOf[str, str]) -> MappingKey:
        if not environment.get(KEY_VARIABLE):
            raise ValueError(f"missing {KEY_VARIABLE}")
        return cls(environment[KEY_VARIABLE].strip())

    @classmethod
    def from_file(cls, path: str) -> MappingKey:
        with open(path, encoding="ascii") as f:
            return cls(f.read().strip())

    def column(self) -> Column:
        return F.unbase64(F.lit(self.text.replace("-", "+").replace("_", "/")))


def documents(mappings: DataFrame, metadata: DataFrame) -> DataFrame:
    """(doc_id, document): one JSON text a document, mappings in order of first appearance."""
    fields = ("entity_type", "normalized_original", "occurrences", "original", "replacement")
    record = F.struct("first_no", F.struct(*fields).alias("m"))
    folded = mappings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(record)), lambda r: r["m"]).alias("mappings"))
    joined = metadata.join(folded, "doc_id", "left")
    empty = F.array().cast("array<struct<entity_type:string,normalized_original:string,occurrences:bigint,original:string,replacement:string>>")
    names = sorted(c for c in metadata.columns if c != "doc_id")
    payload = F.struct(F.coalesce("mappings", empty).alias("mappings"), F.struct(*names).alias("metadata"))
    return joined.select("doc_id", F.to_json(payload).alias("document"))


def sealed(docs: DataFrame, key: MappingKey) -> DataFrame:
    """(doc_id, sealed): base64 of the encrypted document; each has its own random vector."""
    cipher = F.aes_encrypt(F.encode("document", "UTF-8"), key.column(), F.lit("GCM"))
    return docs.select("doc_id", F.base64(cipher).alias("sealed"))


def opened(rows: DataFrame, key: MappingKey) -> DataFrame:
    """(doc_id, document); null where the key is wrong or the text is damaged."""
    plain = F.try_aes_decrypt(F.unbase64("sealed"), key.column(), F.lit("GCM"))
    return rows.select("doc_id", F.decode(plain, "UTF-8").alias("document"))


def read_mappings(opened_rows: DataFrame) -> DataFrame:
    """(doc_id, mapping fields..., metadata) of opened documents."""
    parsed = opened_rows.select("doc_id", F.from_json("document", DOCUMENT).alias("d"))
    return parsed.select("doc_id", F.explode("d.mappings").alias("m"), F.col("d.metadata").alias("metadata")).select("doc_id", "m.*", "metadata")


def save(rows: DataFrame, path: str) -> None:
    """Write one sealed document to a file that only its owner can read."""
    text = rows.select("sealed").first()["sealed"]
    descriptor = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(descriptor, "w", encoding="ascii") as f:
        os.fchmod(f.fileno(), 0o600)
        f.write(text)


def load(spark: SparkSession, path: str, key: MappingKey, doc_id: int = 0) -> DataFrame:
    with open(path, encoding="ascii") as f:
        rows = spark.createDataFrame([(doc_id, f.read())], "doc_id bigint, sealed string")
    out = opened(rows, key)
    if out.first()["document"] is None:
        raise MappingDecryptionError("mapping key is invalid or artifact is corrupted")
    return out
