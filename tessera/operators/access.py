"""Path guards and request limits."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Folders that are never read, the limiter's window and its rates a minute.
FORBIDDEN = ("/etc", "/private/etc", "/root", "~/.ssh", "~/.aws", "~/.gnupg")
WINDOW_SECONDS, SEARCHES, INDEXINGS = 60, 120, 10


class ForbiddenPath(PermissionError):
    """A path outside the allowed roots, or inside a forbidden one."""


def safe_path(path: str, allowed: list[str] | None = None, forbidden: tuple[str, ...] = FORBIDDEN) -> str:
    """The resolved path, if it is in an allowed root (where given) and in no forbidden one."""
    real = os.path.realpath(os.path.expanduser(path))
    inside = lambda root: os.path.commonpath([real, os.path.realpath(os.path.expanduser(root))]) == os.path.realpath(os.path.expanduser(root))
    if any(map(inside, forbidden)):
        raise ForbiddenPath(f"{path} is in a protected folder")
    if allowed and not any(map(inside, allowed)):
        raise ForbiddenPath(f"{path} is outside the allowed folders")
    return real


def limit_requests(requests: DataFrame, limit: int = SEARCHES, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """request_id, client, ts, allowed: refused if `limit` accepted requests of the client lie within the window.

    What is accepted depends on what was, so a client's requests are read in order, as a
    stream of rows: tasks keep the accepted times of one window only, however many
    requests a client has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, times = None, []
        for b in batches:
            allowed = []
            for c, t in zip(b.client, b.us):
                if c != client:
                    client, times = c, []
                times = [x for x in times if t - x < seconds * 1_000_000]
                allowed.append(len(times) < limit)
                if allowed[-1]:
                    times.append(t)
            yield b.assign(allowed=allowed).drop(columns="us")

    types = dict(requests.dtypes)
    d = requests.select("request_id", "client", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    d = d.repartition("client").sortWithinPartitions("client", "us", "request_id")
    return d.mapInPandas(run, f"request_id {types['request_id']}, client {types['client']}, ts {types['ts']}, allowed boolean")


def offered_load(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """request_id, client, in_window: the requests of a client in the window that ends with each."""
    own = W.partitionBy("client").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return requests.select("request_id", "client", F.count("*").over(own).alias("in_window"))
