"""Marketplace pages as a data source: one partition a page, from files or over HTTP; and report exports."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import spreadsheet_safe
from .workbook import write_workbook


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.address, self.pages = options["address"], options.get("pages", "1")

    def partitions(self) -> list[Page]:
        """One a page. With pages=auto their number is read from the first page: results over page size, and one more."""
        return [Page(n) for n in range(1, (self._announced() if self.pages == "auto" else int(self.pages)) + 1)]

    def _announced(self) -> int:
        body = next(self.read(Page(1)))[2]
        try:
            info = json.loads(body or "")["mainInfo"]
            return int(info["totalResults"]) // int(info["pageSize"]) + 1
        except (ValueError, KeyError, TypeError, ZeroDivisionError):
            return 1

    def read(self, partition: Page) -> Iterator[tuple]:
        from urllib.error import URLError
        from urllib.request import urlopen

        where = self.address.replace("{page}", str(partition.number))
        try:
            with urlopen(where, timeout=5) as answer:  # noqa: S310
                yield partition.number, where, answer.read().decode("utf-8", "replace"), None
        except (URLError, OSError) as error:
            # A page that can't be reached doesn't stop the others.
            yield partition.number, where, None, str(error)


class MarketPages(DataSource):
    """spark.read.format("market_pages").option("address", "https://.../?page={page}").option("pages", n)"""

    @classmethod
    def name(cls) -> str:
        return "market_pages"

    def schema(self) -> str:
        return "page int, url string, body string, error string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


#: Formats that reports are written in. No library for PDF is at hand, so it is refused.
FORMATS = ("csv", "json", "xlsx")


def export_report(report: DataFrame, path: str, kind: str = "csv", threshold: float | None = None, by: str = "gap_pct", summary: DataFrame | None = None) -> None:
    """A report as files whose text can't act as a spreadsheet formula; with a threshold only rows that reach it in column `by`.
    As xlsx it is one file, with a sheet for the summary where there is one (see workbook.write_workbook)."""
    if kind not in FORMATS:
        raise ValueError(f"reports are written as one of {FORMATS}")
    report = report if threshold is None else report.filter(F.col(by) >= threshold)
    if kind == "xlsx":
        return write_workbook(({} if summary is None else {"Summary": summary}) | {"Competitor Details": report}, path)
    safe = [spreadsheet_safe(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in report.schema]
    out = report.select(*safe).write
    (out.option("header", True).csv if kind == "csv" else out.json)(path)


def push_each(df: DataFrame, address: str, timeout: float = 5) -> DataFrame:
    """Sends each row as a JSON document by POST, from the executors; one row a document: its body, and the error if it
    couldn't be sent. A failure doesn't stop the others. For a stream: foreachBatch(lambda df, n: push_each(df, a).count()).
    """

    def send(frames: Iterator) -> Iterator:
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        for frame in frames:
            said = []
            for body in frame["body"]:
                try:
                    with urlopen(Request(address, body.encode(), {"Content-Type": "application/json"}), timeout=timeout):  # noqa: S310
                        said.append(None)
                except (URLError, OSError) as error:
                    said.append(str(error))
            frame["error"] = said
            yield frame

    return df.select(F.to_json(F.struct("*")).alias("body")).mapInPandas(send, "body string, error string")


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """Appends captures or notifications to a Parquet table."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("append").parquet(path)
