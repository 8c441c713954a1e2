"""The daily runner as keyed state: one sleeve per symbol, one portfolio row per closed date."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import portfolio as pt
from ..sources.sinks import scratch
from .runner import drain_batches

OUTPUT = "symbol string, day bigint, held double, ret double, mark double, turnover double"
STATE = "held double, mark double, day bigint"


def step(held: float, mark: float | None, target: float, price: float, close: float, note, band: float, cost: float, cash: float):
    """One session of a sleeve, marked from the last mark: returns (held, return, new mark, turnover).

    An outage or pending session keeps the weight and the mark and earns nothing.
    """
    if note is not None or mark is None:
        return held, 0.0, (close if mark is None and note is None else mark), 0.0
    new = target if abs(target - held) > band else held
    opened = held * (price / mark) + (1.0 - held) * (1.0 + cash)
    turnover = abs(new - held * (price / mark) / opened)
    after = opened - cost * turnover * opened
    end = new * after * (close / price) + (1.0 - new) * after
    return new, end - 1.0, close, turnover


def _fold(frames: Iterable[pd.DataFrame], state: tuple, band: float, cost: float, cash: float):
    held, mark, last = state
    rows = pd.concat(list(frames)).sort_values("day")
    out = []
    for r in rows.itertuples(index=False):
        if last is not None and r.day <= last:
            continue  # a session already accounted for: rerunning it is a no-op
        note = r.note or None
        held, ret, mark, turnover = step(held, mark, r.target, r.open, r.close, note, band, cost, cash)
        last = int(r.day)
        out.append((r.day, held, ret, mark, turnover))
    return out, (held, mark, last)


def sleeve_states(sessions: DataFrame, band: float = 0.05, cost: float = 0.002, cash: float = 0.0) -> DataFrame:
    """(symbol, day, target, open, close, note) stream (empty note = live session) -> sleeve rows, with state per symbol."""

    def update(key, frames, state: GroupState):
        start = state.get if state.exists else (0.0, None, None)
        out, end = _fold(frames, start, band, cost, cash)
        state.update(end)
        yield pd.DataFrame(out, columns=["day", "held", "ret", "mark", "turnover"]).assign(symbol=key[0])[["symbol", "day", "held", "ret", "mark", "turnover"]]

    return sessions.groupBy("symbol").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def sleeve_batch(sessions: DataFrame, band: float = 0.05, cost: float = 0.002, cash: float = 0.0) -> DataFrame:
    """The same fold over a finished table (at most one row per symbol and day)."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _end = _fold([pdf], (0.0, None, None), band, cost, cash)
        return pd.DataFrame(out, columns=["day", "held", "ret", "mark", "turnover"]).assign(symbol=pdf["symbol"].iloc[0])[["symbol", "day", "held", "ret", "mark", "turnover"]]

    return sessions.groupBy("symbol").applyInPandas(whole, OUTPUT)


def portfolio_days(sleeves: DataFrame, spark: SparkSession, n_assets: int, grace_days: int = 0, label: str = "portfolio") -> str:
    """Close dates as the stream advances and write one portfolio row per closed date.

    A date is closed once the newest date seen is more than `grace_days` later
    (never by counting symbols); when the source has ended, the dates still
    open are closed too.  Files are named by batch id, so a replayed batch
    overwrites itself.
    """
    root = scratch(spark, label)
    history, out = f"{root}/history", f"{root}/days"

    def settle(target: str, written: list[str], limit: int | None) -> None:
        seen = spark.read.parquet(history)
        last = spark.read.parquet(*written).agg(F.max("day")).first()[0] if written else None
        done = -1 if last is None else last
        w = Window.partitionBy("symbol").orderBy(F.desc("day"))
        old = seen.where(F.col("day") <= done).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= pt.TILT_ROWS + 5).select("symbol", "day", "ret")
        new = seen.where((F.col("day") > done) & (F.lit(True) if limit is None else F.col("day") < limit)).select("symbol", "day", "ret")
        rows = old.unionByName(new)
        dates = new.select("day").distinct()
        ruled = pt.rule(rows, pt.denominators(rows.select("day").distinct(), None, n_assets))
        ruled.join(F.broadcast(dates), "day", "left_semi").select("day", "ret", "present", "exposure").write.mode("overwrite").parquet(target)

    def earlier(before: int) -> list[str]:
        return [path for path in (f"{out}/batch={i}" for i in range(before)) if _exists(spark, path)]

    batches = [0]

    def handle(batch: DataFrame, batch_id: int) -> None:
        batches[0] = max(batches[0], batch_id + 1)
        batch.select("symbol", "day", "ret").write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
        newest = spark.read.parquet(history).agg(F.max("day")).first()[0]
        settle(f"{out}/batch={batch_id}", earlier(batch_id), newest - grace_days * 86_400_000)

    drain_batches(sleeves, handle, label)
    settle(f"{out}/batch={batches[0]}", earlier(batches[0]), None)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
