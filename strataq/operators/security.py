"""Encrypted envelopes and the tamper-evident audit chain.

Encryption is Spark's aes_encrypt (AES-256-GCM with authenticated metadata);
keys come from PBKDF2 per tenant, and an outer HMAC covers the whole payload.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import canonical_json

MAGIC, VERSION, ROUNDS = b"SQEN", 1, 100_000
SECRET_VARIABLE = "STRATAQ_MASTER_SECRET"
GENESIS = "00" * 32


def derive(secret: str | None, tenant: str, salt: bytes) -> bytes:
    secret = secret or os.environ.get(SECRET_VARIABLE)
    if not secret:
        raise ValueError("a master secret is needed; there is no default key")
    return hashlib.pbkdf2_hmac("sha256", f"{secret}\0{tenant}".encode(), salt, ROUNDS, 64)


def seal(spark: SparkSession, data: bytes, secret: str | None, tenant: str, meta: dict | None = None) -> bytes:
    salt, nonce = os.urandom(16), os.urandom(12)
    key = derive(secret, tenant, salt)
    aad = canonical_json({"tenant": tenant, **(meta or {})}).encode()
    row = spark.createDataFrame([(bytearray(data), bytearray(key[:32]), bytearray(nonce), bytearray(aad))], "d binary, k binary, n binary, a binary")
    sealed = bytes(row.select(F.aes_encrypt("d", "k", F.lit("GCM"), F.lit("DEFAULT"), "n", "a")).first()[0])
    body = MAGIC + struct.pack(">B", VERSION) + salt + struct.pack(">I", len(aad)) + aad + sealed
    return hmac.new(key[32:], body, "sha256").digest() + body


def unseal(spark: SparkSession, envelope: bytes, secret: str | None, tenant: str) -> tuple[bytes, dict]:
    """Data and metadata; PermissionError for a wrong key or tenant or any changed byte."""
    if len(envelope) < 57 or envelope[32:36] != MAGIC:
        raise ValueError("no envelope")
    mac, body = envelope[:32], envelope[32:]
    key = derive(secret, tenant, body[5:21])
    if not hmac.compare_digest(mac, hmac.new(key[32:], body, "sha256").digest()):
        raise PermissionError("the envelope was changed, or key or tenant are wrong")
    n = struct.unpack(">I", body[21:25])[0]
    aad, sealed = body[25 : 25 + n], body[25 + n :]
    row = spark.createDataFrame([(bytearray(sealed), bytearray(key[:32]), bytearray(aad))], "d binary, k binary, a binary")
    data = row.select(F.try_aes_decrypt("d", "k", F.lit("GCM"), F.lit("DEFAULT"), "a")).first()[0]
    if data is None:
        raise PermissionError("decryption failed")
    return bytes(data), json.loads(aad)


def entry_hash(seq: int, ts: str, event: str, meta: dict, prev: str) -> str:
    return hashlib.sha256(canonical_json({"event": event, "meta": meta, "prev": prev, "seq": seq, "ts": ts}).encode()).hexdigest()


@dataclass
class AuditChain:
    """Append-only; each entry hashes the one before."""

    entries: list[dict] = field(default_factory=list)

    def append(self, event: str, meta: dict, ts: str) -> dict:
        seq, prev = len(self.entries), self.head()
        self.entries.append({"seq": seq, "ts": ts, "event": event, "meta": meta, "prev": prev, "hash": entry_hash(seq, ts, event, meta, prev)})
        return self.entries[-1]

    def head(self) -> str:
        return self.entries[-1]["hash"] if self.entries else GENESIS

    def verify(self) -> bool:
        prev = GENESIS
        for k, e in enumerate(self.entries):
            if e["seq"] != k or e["prev"] != prev or e["hash"] != entry_hash(k, e["ts"], e["event"], e["meta"], prev):
                return False
            prev = e["hash"]
        return True


def chain_rows(df: DataFrame, chain: str, seq: str, payload: str) -> DataFrame:
    """chain, seq, payload, prev, hash: one chain per value of ``chain``, hashed in order of ``seq``.

    A chain is sequential by nature; chains run in parallel, and a chain's rows stream through its task.
    """
    rows = df.select(F.col(chain).cast("string").alias("chain"), F.col(seq).cast("long").alias("seq"), F.col(payload).cast("string").alias("payload")).repartition("chain").sortWithinPartitions("chain", "seq")

    def run(parts):
        import pandas as pd

        last, prev = None, GENESIS
        for part in parts:
            prevs, hashes = [], []
            for c, s, p in zip(part["chain"], part["seq"], part["payload"], strict=True):
                if c != last:
                    last, prev = c, GENESIS
                prevs.append(prev)
                prev = hashlib.sha256(f"{s}|{p}|{prev}".encode()).hexdigest()
                hashes.append(prev)
            yield pd.DataFrame({"chain": part["chain"], "seq": part["seq"], "payload": part["payload"], "prev": prevs, "hash": hashes})

    return rows.mapInPandas(run, "chain string, seq long, payload string, prev string, hash string")


def verify_chain(df: DataFrame) -> DataFrame:
    """chain and ok, in parallel: each row is checked against its own prev, and prev against the row before."""
    from pyspark.sql import Window

    before = F.lag("hash").over(Window.partitionBy("chain").orderBy("seq"))
    own = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "payload", "prev"), 256) == F.col("hash")
    return df.withColumn("ok", own & (F.coalesce(before, F.lit(GENESIS)) == F.col("prev"))).groupBy("chain").agg(F.min("ok").alias("ok"), F.count(F.lit(1)).alias("n"))
