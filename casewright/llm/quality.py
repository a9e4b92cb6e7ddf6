"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: its measurements and its failure bit are stored in the ledger. A policy is
a versioned mask over the bits, so applying one, comparing versions and leave-one-out ablation are bit operations on
the ledger and never touch a text again.

Defined cases: null text has no words and fails as too short; very long texts are measured whole; repeated rows are
judged alike, one row each; an empty table gives an empty ledger; other columns stay out of the ledger.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: (name, SQL test of failure); the position is the bit and never changes, new rules are appended.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("duplicate_lines", "4 * n_dup_lines > 3 * n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Versioned policies: masks over the bits.
POLICIES = {"v1": BASE, "v2": BASE | BIT["symbols"] | BIT["short_words"] | BIT["long_words"] | BIT["duplicate_lines"]}
CURRENT = "v2"

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n = len(seen)
    pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[which] > 1)
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[twice + i] = True
    return int(hit.sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    code_points = int(counts[:128].sum() + counts[192:].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), code_points - int(counts[_SPACE].sum()), int(counts[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def _measure(batches):
    for b in batches:
        rows = [measure_text(t) for t in b.column("text").to_pylist()]
        grid = np.array(rows, np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(grid[:, i]) for i in range(len(MEASURES)))], ["doc_id", *MEASURES])


#: The failure bits of a row of measurements.
BITS = " | ".join(f"CASE WHEN {test} THEN {1 << i}L ELSE 0L END" for i, (_, test) in enumerate(RULES))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed_bits: one bit per failed rule. It is written once, to the shared folder."""
    measured = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).mapInArrow(
        _measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return materialize(measured.withColumn("failed_bits", F.expr(BITS)))


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    mask = POLICIES[version]
    return entries.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn(
        "kept", F.col("failed_bits").bitwiseAND(F.lit(mask | BASE)) == 0)


def ablation(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only: how many fail the rule, and how many would be kept if the policy left it out.

    Documents are first counted by bit pattern (at most 2 ** rules rows), so the ledger is read once for all rules.
    """
    mask = POLICIES[version]
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n, _ in RULES if BIT[n] & mask))).alias("r")
    return patterns.select("bits", "count", one).groupBy("r.rule").agg(
        F.sum(F.expr("CASE WHEN bits & r.bit <> 0 THEN count ELSE 0 END")).alias("n_failed"), F.sum(F.expr("CASE WHEN bits = r.bit THEN count ELSE 0 END")).alias("n_only"))


def rejected_by(entries: DataFrame, old: str, new: str) -> DataFrame:
    """Documents whose verdict differs between two policy versions."""
    verdict = lambda v: F.col("failed_bits").bitwiseAND(F.lit(POLICIES[v])) == 0
    return entries.select("doc_id", verdict(old).alias("kept_old"), verdict(new).alias("kept_new")).where("kept_old <> kept_new")


def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(np.array([measure_text(bytes(t)) for t in texts], np.int64).reshape(-1, len(MEASURES)), columns=MEASURES)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go. The ledger's entry is made beside each row and its bits are tested like the
    ledger's, so nothing is joined or shuffled. Null text has no words and goes; repeated rows are judged alike; columns
    may have any name; an empty table stays empty."""
    measured = F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))
    entries = docs.select(F.struct(*docs.columns).alias("_row"), measured(text_of(docs).cast("binary")).alias("_m")).select("_row", "_m.*")
    return entries.where(f"(({BITS}) & {POLICIES[CURRENT] | BASE}) = 0").select("_row.*")
