"""The run ledger as a table: one row per table that is published and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.functions.names import as_list, col
from layerflow.operators.joins import attach

# Finish codes and states.
SUCCESS_CODE = 0
SUCCESS, FAILED, TIMEOUT, PUBLISHED = "success", "failed", "timeout", "published"
LIVE = "pds_augment"


def upsert_latest(state: DataFrame, updates: DataFrame, key: str | Sequence[str], ts: str) -> DataFrame:
    """Keep the latest row per key. On equal times an update beats the stored row, and the
    larger row beats the smaller, so replaying updates changes nothing. An aggregate, not a
    window: a key with very many updates collapses before the shuffle."""
    keys = as_list(key)
    rest = [c for c in state.columns if c not in keys and c != ts]
    both = state.withColumn("__update", F.lit(0)).unionByName(updates.withColumn("__update", F.lit(1)))
    order = F.struct(col(ts), F.col("__update"), *[col(c) for c in rest])
    latest = both.groupBy(*[col(k) for k in keys]).agg(F.max(order).alias("__row"))
    return latest.select(
        *[col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in state.columns]
    )


def map_status(df: DataFrame, code: str, name: str = "run_status") -> DataFrame:
    """Finish code to status: 0 success, any other code failed, no code timeout. A timeout is
    reported but not stored: leave such rows out before ``upsert_latest``."""
    status = (
        F.when(col(code).isNull(), F.lit(TIMEOUT))
        .when(col(code) == SUCCESS_CODE, F.lit(SUCCESS))
        .otherwise(F.lit(FAILED))
    )
    return df.withColumn(name, status)


def record_runs(ledger: DataFrame, runs: DataFrame, key: str, code: str = "finish_code", ts: str = "run_at") -> DataFrame:
    """The ledger with the latest finished run of each table: ``run_status``, code and time.

    Runs without a code timed out and are not stored. Live tables (kind ``pds_augment``) have
    no run phase and stay as they are, and so does an entry whose stored run is later than all
    new ones. Of runs at the same time the largest code stands, so a replay changes nothing.
    """
    finished = runs.where(col(code).isNotNull() & col(ts).isNotNull())
    latest = finished.groupBy(col(key)).agg(F.max(F.struct(col(ts).alias("at"), col(code).alias("code"))).alias("__run"))
    met = attach(ledger, latest, key, unique=True)
    newer = (
        F.col("__run").isNotNull()
        & ~col("kind").eqNullSafe(F.lit(LIVE))
        & (col(ts).isNull() | (F.col("__run.at") >= col(ts)))
    )
    status = map_status(met.withColumn("__code", F.col("__run.code")), "__code", "__status")
    updated = {
        "run_status": F.when(newer, F.col("__status")).otherwise(col("run_status")),
        code: F.when(newer, F.col("__code")).otherwise(col(code)),
        ts: F.when(newer, F.col("__run.at")).otherwise(col(ts)),
    }
    return status.select(*[updated[c].alias(c) if c in updated else col(c) for c in ledger.columns])


def pending(ledger: DataFrame, layer: str) -> DataFrame:
    """Work left in a layer: published, with a flow id, and not yet run successfully."""
    return ledger.where(
        (col("layer") == layer)
        & (col("publish_status") == PUBLISHED)
        & (F.coalesce(col("flow_luid"), F.lit("")) != "")
        & ~col("run_status").eqNullSafe(F.lit(SUCCESS))
    )


def run_summary(ledger: DataFrame, by: str | Sequence[str], duration: str | None = None) -> DataFrame:
    """Runs per status and the longest duration, per ``by``. The failed themselves are rows
    of ``failed_runs``: their number has no bound, so they are not put in one list."""
    status = F.coalesce(col("run_status"), F.lit(""))
    measures = [F.count(F.lit(1)).alias("n_runs")]
    measures += [F.count_if(status == s).alias(f"n_{s}") for s in (SUCCESS, FAILED, TIMEOUT)]
    if duration:
        measures.append(F.max(col(duration)).alias("max_duration"))
    return ledger.groupBy(*[col(k) for k in as_list(by)]).agg(*measures)


def failed_runs(ledger: DataFrame, by: str | Sequence[str], name: str) -> DataFrame:
    """One row per run that did not succeed; timeouts are failures here."""
    return ledger.where(col("run_status").isin(FAILED, TIMEOUT)).select(
        *[col(k) for k in as_list(by)], col(name), "run_status"
    )
