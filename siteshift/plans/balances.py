"""Key balances that grow with the extracts: per-key row counts as a stored table later extracts are merged into.

Every merged extract adds one batch of rows (plant, key, n_expected, n_actual), aggregated before it is written, so a
merge reads the new rows only and the state holds a key once per batch that has it. A batch is written under its own
name: merging it again, after a lost driver or a corrected extract, replaces it and counts nothing twice. Reports sum
the batches; ``compacted`` folds them into one where they have become many.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteshift.mapping import DEFAULT_MAPPING, FieldMapping
from siteshift.operators import reconcile as r

STATE = "plant string, key string, n_expected bigint, n_actual bigint, batch string"
COUNTS = ("n_expected", "n_actual")
_BATCH_NAME = re.compile(r"[A-Za-z0-9_-]+")


@dataclass(frozen=True)
class BalanceState:
    """Stored key counts of one sheet below ``folder``."""

    spark: SparkSession
    folder: str
    sheet: str
    mapping: Sequence[FieldMapping]

    def merge(self, batch: str, expected: DataFrame, actual: DataFrame) -> None:
        """Counts one extract of both sides; an empty DataFrame stands for a side that has nothing new."""
        counts = r.key_counts(self.sheet, expected, actual, self.mapping, by_plant=True)
        self._write(batch, counts)

    def rows(self) -> DataFrame:
        """(plant, key, n_expected, n_actual, batch) as stored; empty before the first merge."""
        try:
            return self.spark.read.schema(STATE).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STATE)

    def counts(self, by_plant: bool = False) -> DataFrame:
        """([plant,] key, n_expected, n_actual) over all batches."""
        keys = ["plant", "key"] if by_plant else ["key"]
        return self.rows().groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])

    def balance(self, by_plant: bool = False) -> DataFrame:
        """Headline numbers of all extracts merged so far, as one pass over them would give."""
        counts = self.counts(by_plant)
        return counts.groupBy("plant").agg(*r.balance_sums()) if by_plant else counts.agg(*r.balance_sums())

    def record_count(self, scope: str = "common_keys", tolerance_pct: float = 0.0) -> DataFrame:
        """The record count rule over all extracts merged so far, as one row."""
        return self.balance().select(r.count_rule(scope, tolerance_pct).alias("rule")).select("rule.*")

    def compacted(self, folder: str, batch: str = "all") -> BalanceState:
        """The same state in a new folder, every key once."""
        state = BalanceState(self.spark, folder, self.sheet, self.mapping)
        state._write(batch, self.counts(by_plant=True))
        return state

    def _write(self, batch: str, counts: DataFrame) -> None:
        if not _BATCH_NAME.fullmatch(batch):
            raise ValueError(f"batch name {batch!r} is not made of letters, digits, - and _")
        counts.select("plant", "key", *COUNTS).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")


def balance_state(spark: SparkSession, folder: str, sheet: str, mapping: Sequence[FieldMapping] | None = None) -> BalanceState:
    """The state below folder, which need not exist yet."""
    return BalanceState(spark, folder.rstrip("/"), sheet, DEFAULT_MAPPING[sheet] if mapping is None else mapping)
