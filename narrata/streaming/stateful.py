"""Streaming forms of the stateful operators: polled folders, debounce, handled files, job stages, throttled logs, tokens.

Each takes a streaming (or batch) DataFrame and keeps its state by key in the state store, so a restart from the
checkpoint goes on where it stopped. narrata.operators.jobs has the batch form that the tests compare with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from narrata.operators.jobs import ENDED, NEXT, RETRY_SECONDS, STAGES

POLL_SECONDS, TOKEN_SECONDS, LOG_SECONDS, MOST_HELD = 15, 120, 60, 1_000_000


def folder_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """New files of a folder, without hidden and partial ones; trigger it every POLL_SECONDS."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith(".") & ~name.endswith(".part") & (F.col("length") > 0))


def _rows(pdfs: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True).sort_values(list(order), kind="stable")


def debounced(polls: DataFrame) -> DataFrame:
    """poll_no, path, size, mtime -> a row when a file is as it was at the poll before, once for each state of the file."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        poll, size, mtime, reported = state.get if state.exists else (-1, -1, -1.0, False)
        out = []
        for p, s, t in _rows(pdfs, "poll_no")[["poll_no", "size", "mtime"]].itertuples(index=False):
            same = (s, t) == (size, mtime)
            if same and p == poll + 1 and s > 0 and not reported:
                out.append((key[0], int(p), int(s), float(t)))
                reported = True
            elif not same:
                reported = False
            poll, size, mtime = int(p), int(s), float(t)
        state.update((poll, size, mtime, reported))
        yield pd.DataFrame(out, columns=["path", "poll_no", "size", "mtime"])

    return polls.groupBy("path").applyInPandasWithState(step, "path string, poll_no long, size long, mtime double", "poll long, size long, mtime double, reported boolean", "append", GroupStateTimeout.NoTimeout)


def unhandled(files: DataFrame, within: str | None = None) -> DataFrame:
    """Files not seen before by path, size and time; with `within`, state is dropped after so long by event time mtime."""
    key = ["path", "size", "mtime"]
    return files.withWatermark("mtime", within).dropDuplicatesWithinWatermark(key) if within else files.dropDuplicates(key)


def staged(events: DataFrame) -> DataFrame:
    """id, seq, value (wanted stage) -> id, seq, stage, accepted: the job's stage after each event, moved only where allowed."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage = state.get[0] if state.exists else STAGES[0]
        out = []
        for seq, wanted in _rows(pdfs, "seq")[["seq", "value"]].itertuples(index=False):
            ok = wanted in NEXT.get(stage, ()) or wanted in ("failed", "cancelled") and stage not in ENDED
            stage = wanted if ok else stage
            out.append((key[0], seq, stage, ok))
        state.update((stage,))
        yield pd.DataFrame(out, columns=["id", "seq", "stage", "accepted"])

    return events.groupBy("id").applyInPandasWithState(step, "id long, seq long, stage string, accepted boolean", "stage string", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, key: str, seconds: int = LOG_SECONDS) -> DataFrame:
    """key, ts (seconds) -> the events to log, at least `seconds` apart, with the number held back since the last."""

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, 0)
        out = []
        for t in _rows(pdfs, "ts")["ts"]:
            if last is None or t - last >= seconds:
                out.append((k[0], float(t), int(held)))
                last, held = float(t), 0
            else:
                held = min(held + 1, MOST_HELD)
        state.update((last, int(held)))
        yield pd.DataFrame(out, columns=[key, "ts", "suppressed"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, ts double, suppressed long", "last double, held long", "append", GroupStateTimeout.NoTimeout)


def confirmed(actions: DataFrame, seconds: int = TOKEN_SECONDS) -> DataFrame:
    """token, user_id, kind (request or confirm), ts -> confirmations in time, by the requesting user, once for each token."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        user, asked, used = state.get if state.exists else (None, None, False)
        out = []
        for u, kind, t in _rows(pdfs, "ts", "kind")[["user_id", "kind", "ts"]].itertuples(index=False):
            if kind == "request":
                user, asked, used = int(u), float(t), False
            elif asked is not None and not used and u == user and 0 <= t - asked <= seconds:
                out.append((key[0], int(u), asked, float(t)))
                used = True
        if asked is not None:
            state.update((user, asked, used))
        yield pd.DataFrame(out, columns=["token", "user_id", "ts", "confirmed_at"])

    return actions.groupBy("token").applyInPandasWithState(step, "token string, user_id long, ts double, confirmed_at double", "user long, asked double, used boolean", "append", GroupStateTimeout.NoTimeout)


def retry_order(attempts: DataFrame) -> DataFrame:
    """id, ts -> attempts that come RETRY_SECONDS or more after the job's last one that counted."""
    return throttled(attempts.select(F.col("id"), F.col("ts")), "id", RETRY_SECONDS).select("id", "ts")
