"""What a serving layer asks of data: latest readings, request checks, rate limits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS, LIMIT_ANONYMOUS, LIMIT_KNOWN = 60, 3, 5
MAX_QUESTION = 200


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """The newest row of each series, with these fields. One aggregation, no sort."""
    fields = list(fields) if fields is not None else [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*fields), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("__row")).select(*keys, "__row.*")


def series_size(df: DataFrame, keys: Sequence[str], order: Sequence[str], content: Column) -> DataFrame:
    """(keys, n_rows, n_chars, first, last): rows and characters of each series, and the order values at its ends."""
    ends = F.struct(*order)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(content)).alias("n_chars"), F.min(ends).alias("first"), F.max(ends).alias("last"))


def accepted(times: Sequence[float], limit: int, window: float = WINDOW_SECONDS, kept: Sequence[float] = ()) -> tuple[list[bool], list[float]]:
    """(accepted or not, times kept): a request passes if fewer than ``limit`` accepted ones are younger than the window; rejected ones do not count."""
    recent, out = list(kept), []
    for now in times:
        recent = [t for t in recent if t > now - window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(now)
    return out, recent


def rate_limit(requests: DataFrame, user: str, ts: str, tie: str, limit: int = LIMIT_ANONYMOUS, window: float = WINDOW_SECONDS) -> DataFrame:
    """requests with ``accepted``. The rows of a user pass through a task in order, batch by batch, and only accepted times within the window are held."""
    columns = requests.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", accepted boolean"
    ordered = requests.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).repartition(user).sortWithinPartitions(user, "__s", tie)

    def flow(batches):
        last, recent = None, []
        for pdf in batches:
            flags = []
            for key, now in zip(pdf[user], pdf["__s"]):
                if key != last:
                    last, recent = key, []
                ok, recent = accepted([now], limit, window, recent)
                flags += ok
            yield pdf[columns].assign(accepted=pd.Series(flags, index=pdf.index, dtype=bool))

    return ordered.mapInPandas(flow, schema)


def check_request(question: Column, farm: Column, house: Column, base: Column) -> Column:
    """struct<status, mode, message>: blank and overlong questions are errors; with all of farm, house and time the request is for readings, else for documents."""
    text = F.trim(F.coalesce(question, F.lit("")))
    complete = F.lit(True)
    for part in (farm, house, base):
        complete = complete & (F.length(F.trim(F.coalesce(part, F.lit("")))) > 0)
    fault = F.when(F.length(text) == 0, "empty question").when(F.length(question) > MAX_QUESTION, "question too long")
    return F.struct(F.when(fault.isNull(), "S").otherwise("E").alias("status"), F.when(fault.isNull(), F.when(complete, "readings").otherwise("documents")).alias("mode"), F.coalesce(fault, F.lit("ok")).alias("message"))


def response(status: Column, message: Column, answer: Column) -> Column:
    """The JSON a request gets."""
    return F.to_json(F.struct(status.alias("status"), message.alias("message"), F.when(status == "S", answer).alias("llmAnswer")))
