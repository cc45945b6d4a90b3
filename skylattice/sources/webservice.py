"""A paged JSON web service of observations as a Python data source, for tables and streams; partitions are ranges of pages or days."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skylattice.schema import STANDARD_COLUMNS


@dataclass(frozen=True)
class Service:
    """How a service is asked, and what its fields are in standard terms."""

    params: Callable[[datetime, datetime, str], dict]
    step: timedelta | None
    names: dict[str, str]


#: Fixed: the two services' query fields and column names.
SERVICES = {
    "asos_hourly": Service(
        lambda a, b, station: {"dataCd": "ASOS", "dateCd": "HR", "startDt": f"{a:%Y%m%d}", "startHh": f"{a:%H}", "endDt": f"{b:%Y%m%d}", "endHh": f"{b:%H}", "stnIds": station},
        None,
        {"tm": "datetime", "ta": "temp", "hm": "humidity", "pa": "pressure", "ws": "wind_speed", "rn": "precipitation"},
    ),
    "aws_minutely": Service(
        lambda a, b, station: {"awsDt": f"{a:%Y%m%d%H%M}", "awsId": station},
        timedelta(days=1),
        {"awsDt": "datetime", "ta": "temp", "hm": "humidity", "ps": "pressure", "ws10M": "wind_speed", "rn60M": "precipitation"},
    ),
}


def spans(service: str, start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """The spans of time that are asked for one by one; both ends must have an offset."""
    if service not in SERVICES:
        raise ValueError(f"unsupported service {service!r}")
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("start and end need time zone offsets")
    step = SERVICES[service].step
    if step is None:
        return [(start, end)]
    out, at = [], start
    while at <= end:
        out.append((at, min(at + step - timedelta(minutes=1), end)))
        at += step
    return out


def page_of(payload: dict) -> tuple[list[dict], int | None]:
    """Items and total count of a response; a single item may come without its list."""
    body = (payload.get("response") or {}).get("body") or {}
    items = (body.get("items") or {}).get("item") or [] if isinstance(body.get("items") or {}, dict) else []
    total = body.get("totalCount")
    return [items] if isinstance(items, dict) else list(items), None if total is None else int(total)


def pages(fetch: Callable[[dict], dict], params: dict, page_size: int = 999, first: int = 1, last: int | None = None) -> Iterator[dict]:
    """Items of page after page from `first`, until one is empty, the total is reached, or `last` is done."""
    page = first
    while last is None or page <= last:
        items, total = page_of(fetch({**params, "pageNo": page, "numOfRows": page_size}))
        if not items:
            return
        yield from items
        if total is None or page * page_size >= total:
            return
        page += 1


def normalise(raw: DataFrame, service: str) -> DataFrame:
    """Standard columns first, missing ones null, then what else the service sent; times that can't be read are null."""
    names = SERVICES[service].names
    keep = {have: want for have, want in names.items() if have in raw.columns and want not in raw.columns}
    df = raw.withColumnsRenamed(keep)
    for c in STANDARD_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c in ("station_id", "quality_flag") else "double"))
    df = df.withColumn("datetime", F.coalesce(F.try_to_timestamp("datetime"), F.try_to_timestamp("datetime", F.lit("yyyyMMddHHmm"))))
    df = df.withColumns({c: F.col(c).try_cast("double") for c in STANDARD_COLUMNS[2:7]})
    return df.select(*STANDARD_COLUMNS, *[c for c in df.columns if c not in STANDARD_COLUMNS])


@dataclass
class Span(InputPartition):
    """Pages `first` to `last` of a station's span; without `last` all from `first` on."""

    station: str
    start: datetime
    end: datetime
    first: int = 1
    last: int | None = None


def patient(call: Callable[[], dict], attempts: int, wait: float) -> dict:
    """The answer of `call`, asked again after twice as long each time the service is busy, fails, or answers no JSON.

    What the service refuses for good (status 400 to 499 but for 408 and 429) is raised at once.
    """
    for attempt in range(attempts):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if attempt + 1 == attempts or (e.code < 500 and e.code not in (408, 429)):
                raise
        except (OSError, ValueError):
            if attempt + 1 == attempts:
                raise
        time.sleep(wait * 2**attempt)
    raise ValueError("at least one attempt")


class Asked:
    """How the source's options ask the service: url, service, stations, start, end (with offsets), key, pageSize, pagesPerPartition, attempts, wait."""

    def __init__(self, options: Mapping[str, str]) -> None:
        o = self.options = dict(options)
        for name in ("url", "service", "stations", "start"):
            if not o.get(name):
                raise ValueError(f"option {name} is not set")
        self.size, self.each = int(o.get("pagesize", o.get("pageSize", 999))), int(o.get("pagesperpartition", o.get("pagesPerPartition", 10)))
        self.stations = [x.strip() for x in o["stations"].split(",") if x.strip()]

    def fetch(self, params: dict) -> dict:
        o = self.options

        def once() -> dict:
            with urllib.request.urlopen(f"{o['url']}?{urllib.parse.urlencode(params)}", timeout=60) as r:  # noqa: S310
                return json.load(r)

        return patient(once, int(o.get("attempts", 5)), float(o.get("wait", 0.5)))

    def params(self, span: Span) -> dict:
        o = self.options
        return {**SERVICES[o["service"]].params(span.start, span.end, span.station), "ServiceKey": o.get("key", ""), "dataType": "JSON"}

    def partitions(self, start: datetime, end: datetime) -> list[Span]:
        """Each station's spans, cut into ranges of pages by what the service says it has.

        A span that has no length of its own (the hourly service's) is asked for its total first, many stations at a time; the
        last range is open, for what comes meanwhile. Daily spans are a partition each.
        """
        found = [Span(s, a, b) for s in self.stations for a, b in spans(self.options["service"], start, end)]
        if SERVICES[self.options["service"]].step is not None:
            return found
        with ThreadPoolExecutor(8) as pool:
            totals = list(pool.map(lambda s: page_of(self.fetch({**self.params(s), "pageNo": 1, "numOfRows": 1}))[1], found))
        out = []
        for span, total in zip(found, totals, strict=True):
            last = -(-(total or 0) // self.size)
            firsts = list(range(1, last + 1, self.each)) or [1]
            out += [replace(span, first=a, last=b - 1 if b else None) for a, b in zip(firsts, [*firsts[1:], None])]
        return out

    def read(self, span: Span) -> Iterator[tuple]:
        for item in pages(self.fetch, self.params(span), self.size, span.first, span.last):
            yield span.station, json.dumps(item)


class ServiceReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.asked = Asked(options)

    def partitions(self) -> Sequence[Span]:
        o = self.asked.options
        return self.asked.partitions(datetime.fromisoformat(o["start"]), datetime.fromisoformat(o["end"]))

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from self.asked.read(partition)


class ServiceStream(DataSourceStreamReader):
    """Offsets are times: a batch has the whole hours after the one before, up to now or to `end`."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.asked = Asked(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": self.asked.options["start"]}

    def latestOffset(self) -> dict:  # noqa: N802
        start = datetime.fromisoformat(self.asked.options["start"])
        now = datetime.now(start.tzinfo)
        end = min(now, datetime.fromisoformat(self.asked.options["end"])) if self.asked.options.get("end") else now
        hours = max(-1, (end - start) // timedelta(hours=1))
        return {"next": (start + timedelta(hours=hours + 1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> Sequence[Span]:
        a, b = datetime.fromisoformat(start["next"]), datetime.fromisoformat(end["next"])
        hour = timedelta(hours=1)
        last = b - (hour if SERVICES[self.asked.options["service"]].step is None else timedelta(minutes=1))
        return self.asked.partitions(a, last) if a < b else []

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from self.asked.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go: the service keeps its rows."""


class ServiceSource(DataSource):
    """spark.dataSource.register(ServiceSource); format("station_service") gives (station_id, item JSON), as a table or a stream."""

    @classmethod
    def name(cls) -> str:
        return "station_service"

    def schema(self) -> str:
        return "station_id string, item string"

    def reader(self, schema) -> ServiceReader:  # noqa: ANN001
        return ServiceReader(dict(self.options))

    def streamReader(self, schema) -> ServiceStream:  # noqa: ANN001, N802
        return ServiceStream(dict(self.options))


def items_as_table(df: DataFrame, service: str) -> DataFrame:
    """The source's rows in standard columns."""
    fields = list(SERVICES[service].names)
    parsed = df.select("station_id", F.from_json("item", ", ".join(f"`{f}` string" for f in fields)).alias("i")).select("station_id", "i.*")
    return normalise(parsed, service)
