"""Time series from a remote service as a Spark data source: one partition per (farm, house) asked for."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "farm_cd string, house_cd string, basetime string, pos int, fields map<string,string>"
TIMEOUT = 30


def rows_of(answer: dict) -> list[dict]:
    """The rows of an answer whose status is "S"; none otherwise."""
    return answer.get("dataList1") or [] if answer.get("status") == "S" else []


def post(url: str, body: dict) -> dict:
    from urllib import request

    call = request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with request.urlopen(call, timeout=TIMEOUT) as reply:
        return json.load(reply)


class _Ask(InputPartition):
    def __init__(self, farm: str, house: str, base: str):
        self.farm, self.house, self.base = farm, house, base


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.asks = options["url"], json.loads(options["asks"])

    def partitions(self) -> list[_Ask]:
        return [_Ask(*a) for a in self.asks]

    def read(self, partition: _Ask) -> Iterator[tuple]:
        answer = post(self.url, {"farm_cd": partition.farm, "house_cd": partition.house, "basetime": partition.base})
        for pos, row in enumerate(rows_of(answer)):
            yield partition.farm, partition.house, partition.base, pos, {k: str(v) for k, v in row.items() if v is not None}


class Readings(DataSource):
    """spark.dataSource.register(Readings); spark.read.format("readings").option("url", ...).option("asks", '[["farm", "house", "time"]]').load()"""

    @classmethod
    def name(cls) -> str:
        return "readings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
