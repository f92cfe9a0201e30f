"""Append-only hash-chained ledgers.

Within one incident each hash needs the one before it, so appending is sequential per incident
and parallel across incidents. Entries stream through a sorted partition with constant state;
no incident is ever collected. Verification uses the stored previous hash, so it is parallel
over entries: entry n meets entry n - 1 by an equi-join on (incident, number).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LEDGER

PAYLOAD_LEDGER = ("incident_id string, seq bigint, payload string, prev_hash string, hash string, "
                  "timestamp string")
GENESIS = "0" * 64


def _fold(step: Callable, columns: list[str], genesis: str | None):
    """A partition function: rows sorted by incident and order in, chained entries out."""
    def run(batches):
        incident, prev, seq = None, None, 0
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["incident_id"] != incident:
                    incident = row["incident_id"]
                    stored = row["_prev"]
                    prev = genesis if pd.isna(stored) else stored
                    seq = 0 if pd.isna(row["_seq"]) else int(row["_seq"])
                seq += 1
                entry = step(row, prev)
                entry.update(incident_id=incident, seq=seq)
                prev = entry.pop("_hash")
                out.append(entry)
            yield pd.DataFrame(out, columns=columns)
    return run


def _ordered(actions: DataFrame, ends: DataFrame | None, order: list[str]) -> DataFrame:
    if ends is None:
        df = actions.withColumns({"_prev": F.lit(None).cast("string"), "_seq": F.lit(None).cast("bigint")})
    else:
        df = actions.join(ends.select("incident_id", F.col("last_hash").alias("_prev"),
                                      F.col("last_seq").alias("_seq")), "incident_id", "left")
    return df.repartition("incident_id").sortWithinPartitions("incident_id", *order)


def last_entries(ledger: DataFrame, hash_col: str = "this_hash") -> DataFrame:
    """Per incident: its last hash and number; combines before the shuffle."""
    return ledger.groupBy("incident_id").agg(F.max_by(hash_col, "seq").alias("last_hash"),
                                             F.max("seq").alias("last_seq"))


def chain_entries(actions: DataFrame, ends: DataFrame | None = None, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Ledger rows for actions (incident_id, action, actor, timestamp text), continuing ``ends``."""
    def step(row, prev):
        body = f"{prev or ''}{row['incident_id']}{row['action']}{row['actor']}{row['timestamp']}"
        digest = hashlib.sha256(body.encode()).hexdigest()
        return {"action": row["action"], "actor": row["actor"], "previous_hash": prev,
                "this_hash": digest, "timestamp": row["timestamp"], "_hash": digest}

    columns = [f.split()[0] for f in LEDGER.split(", ")]
    return _ordered(actions, ends, list(order)).mapInPandas(_fold(step, columns, None), LEDGER)


def chain_payloads(entries: DataFrame, ends: DataFrame | None = None, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Payload ledger rows for (incident_id, payload JSON text, timestamp text).

    The payload is stored in canonical form (sorted keys), which is what the hash covers.
    """
    def step(row, prev):
        canonical = json.dumps(json.loads(row["payload"]), sort_keys=True)
        digest = hashlib.sha256((prev + canonical).encode()).hexdigest()
        return {"payload": canonical, "prev_hash": prev, "hash": digest,
                "timestamp": row["timestamp"], "_hash": digest}

    columns = [f.split()[0] for f in PAYLOAD_LEDGER.split(", ")]
    return _ordered(entries, ends, list(order)).mapInPandas(_fold(step, columns, GENESIS), PAYLOAD_LEDGER)


def _with_previous(ledger: DataFrame, hash_col: str) -> DataFrame:
    before = ledger.select("incident_id", (F.col("seq") + 1).alias("seq"), F.col(hash_col).alias("_before"))
    return ledger.join(before, ["incident_id", "seq"], "left")


def verify_entries(ledger: DataFrame) -> DataFrame:
    """Each entry with ``valid``: its hash recomputed from the stored hash before it."""
    body = F.concat(F.coalesce("_before", F.lit("")), "incident_id", "action", "actor", "timestamp")
    checked = _with_previous(ledger, "this_hash").withColumn("valid", F.sha2(body, 256) == F.col("this_hash"))
    return checked.select("incident_id", "seq", "action", "timestamp", hash_preview("this_hash").alias("hash"),
                          F.coalesce("valid", F.lit(False)).alias("valid"))


def verify_payloads(ledger: DataFrame) -> DataFrame:
    """As ``verify_entries``, and the stored previous hash must be the one actually before."""
    df = _with_previous(ledger, "hash")
    start = F.coalesce("_before", F.lit(GENESIS))
    linked = F.col("prev_hash") == start
    hashed = F.sha2(F.concat(F.col("prev_hash"), F.col("payload")), 256) == F.col("hash")
    return df.select("incident_id", "seq", F.coalesce(linked & hashed, F.lit(False)).alias("valid"))


def chain_status(verified: DataFrame) -> DataFrame:
    return verified.groupBy("incident_id").agg(F.bool_and("valid").alias("valid"),
                                               F.count(F.lit(1)).alias("entries"))


def hash_preview(c: str):
    return F.concat(F.substring(c, 1, 16), F.lit("..."))
