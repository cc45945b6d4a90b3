"""Feeds from configs and from a web service that really answers."""

from __future__ import annotations

import json
import threading
from collections import Counter
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from skylattice.sources import observations, webservice

UTC = timezone.utc
START = datetime(2024, 1, 1, tzinfo=UTC)


class Answers(BaseHTTPRequestHandler):
    """Hourly rows of two stations; every third request is refused for now, one station for good, one page comes broken once."""

    seen: Counter = Counter()
    lock = threading.Lock()

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        with self.lock:
            self.seen[self.path] += 1
            self.seen["all"] += 1
            busy = self.seen["all"] % 3 == 0
        if q["stnIds"] == "gone":
            self.send_error(404)
            return
        if busy:
            self.send_error(503)
            return
        a = datetime.strptime(q["startDt"] + q["startHh"], "%Y%m%d%H").replace(tzinfo=UTC)
        b = datetime.strptime(q["endDt"] + q["endHh"], "%Y%m%d%H").replace(tzinfo=UTC)
        hours = [a + timedelta(hours=i) for i in range((b - a) // timedelta(hours=1) + 1)] if q["stnIds"] != "empty" else []
        n, size = int(q["pageNo"]), int(q["numOfRows"])
        items = [{"tm": f"{t:%Y-%m-%d %H:%M}", "ta": str(t.hour), "stnId": q["stnIds"]} for t in hours[(n - 1) * size : n * size]]
        body = json.dumps({"response": {"body": {"items": {"item": items}, "totalCount": len(hours)}}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body[:-5] if self.seen[self.path] == 1 and n == 2 else body)

    def log_message(self, *_):
        pass


@pytest.fixture
def service(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(webservice.ServiceSource)
    yield {"url": f"http://127.0.0.1:{server.server_port}/", "service": "asos_hourly", "start": START.isoformat(), "end": (START + timedelta(hours=99)).isoformat(), "pageSize": "7", "pagesPerPartition": "3", "wait": "0.01"}
    server.shutdown()


def test_service_is_read_in_page_ranges(spark, service):
    df = spark.read.format("station_service").options(**service, stations="108, 119,empty").load()
    assert df.rdd.getNumPartitions() == 5 + 5 + 1  # 15 pages of 7, three a partition
    rows = webservice.items_as_table(df, "asos_hourly").collect()
    assert Counter(r.station_id for r in rows) == {"108": 100, "119": 100}
    assert {(r.station_id, r.datetime, r.temp) for r in rows if r.station_id == "108"} == {("108", (t := START + timedelta(hours=i)).replace(tzinfo=None), float(t.hour)) for i in range(100)}


def test_service_as_a_stream(spark, service, tmp_path):
    batch = spark.read.format("station_service").options(**service, stations="108,119").load().collect()
    for hours in (40, 40, 99):  # a later end goes on where the last run stopped
        options = {**service, "end": (START + timedelta(hours=hours)).isoformat()}
        stream = spark.readStream.format("station_service").options(**options, stations="108,119").load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(got) == 200


def test_service_refusals(spark, service):
    with pytest.raises(Exception, match="404"):
        spark.read.format("station_service").options(**service, stations="gone").load().collect()
    assert not any(v > 2 for k, v in Answers.seen.items() if "gone" in k)
    with pytest.raises(Exception, match="stations"):
        spark.read.format("station_service").options(**service).load().collect()
    calls = []

    def never():
        calls.append(1)
        raise ValueError("no JSON")

    with pytest.raises(ValueError, match="no JSON"):
        webservice.patient(never, 3, 0.0)
    assert len(calls) == 3


@pytest.fixture
def files(tmp_path):
    (tmp_path / "asos.csv").write_text("station,tm,ta,hm\n108,2024-01-01 09:00,1.5,50\n108,2024-01-01 10:00,,60\n108,2024-01-01 10:00,9,61\n")
    (tmp_path / "aws.csv").write_text("station,tm,ta\n108,2024-01-01 10:10,3\n108,2024-01-01 10:20,5\n7,2024-01-01 09:00,8\n")
    return {"observation_csv": str(tmp_path / "asos.csv")}, {"aws_observation_csv": str(tmp_path / "aws.csv")}


NAMES = {"station_id": "station", "datetime": "tm", "temp": "ta", "humidity": "hm"}


def test_one_hourly_feed_is_taken_as_it_is(spark, files):
    config = {"paths": files[0], "data": {"observation_columns": NAMES}}
    assert observations.stands_alone(observations.feeds_of(config))
    rows = observations.observations_of(spark, config).orderBy("datetime", "humidity").collect()
    assert [(r.station_id, r.datetime.hour, r.temp, r.observation_source) for r in rows] == [("108", 0, 1.5, "asos"), ("108", 1, None, "asos"), ("108", 1, 9.0, "asos")]
    utc = {**config, "data": {**config["data"], "timezone": {"source": "UTC"}}}
    assert {r.datetime.hour for r in observations.observations_of(spark, utc).collect()} == {9, 10}
    assert [r.temp for r in observations.load_asos(spark, files[0]["observation_csv"], column_mapping=NAMES).orderBy("humidity").collect()] == [1.5, None, 9.0]
    assert observations.load_aws(spark, files[1]["aws_observation_csv"], column_mapping=NAMES).first().observation_source == "aws"


def test_two_feeds_by_single_settings(spark, files):
    config = {"paths": files[0] | files[1], "data": {"observation_columns": NAMES, "aws": {"resample_rule": "1h", "priority": 5, "name": "minutes"}}}
    feeds = observations.feeds_of(config)
    assert [(f["name"], f["kind"], f["priority"], f.get("resample_rule")) for f in feeds] == [("asos", "asos", 0, None), ("minutes", "aws", 5, "1h")]
    assert feeds[1]["column_mapping"] == NAMES and not observations.stands_alone(feeds)
    rows = {(r.station_id, r.datetime.hour): r for r in observations.observations_of(spark, config).collect()}
    assert {k: r.temp for k, r in rows.items()} == {("108", 0): 1.5, ("108", 1): 4.0 if rows["108", 1].temp == 4.0 else 9.0, ("7", 0): 8.0}
    assert rows["7", 0].observation_source == "minutes"
    named = {**config, "data": {**config["data"], "aws_observation_columns": {"temp": "other"}}}
    assert observations.feeds_of(named)[1]["column_mapping"] == {"temp": "other"}


def test_listed_feeds_and_what_is_missing(spark, files):
    listed = [{"path": files[0]["observation_csv"], "column_mapping": NAMES, "resample_rule": "1h"}]
    config = {"paths": {}, "data": {"observations": {"sources": listed}}}
    assert not observations.stands_alone(observations.feeds_of(config))
    assert observations.observations_of(spark, config).count() == 2
    listed[0].pop("resample_rule")
    assert observations.stands_alone(observations.feeds_of(config)) and not observations.stands_alone([{**listed[0], "kind": "aws"}])
    with pytest.raises(ValueError, match="observation_csv"):
        observations.feeds_of({"paths": {}, "data": {}})
    both = {"paths": {}, "data": {"observations": {"sources": listed * 2, "merge_strategy": "mean"}}}
    with pytest.raises(ValueError, match="merge strategy"):
        observations.observations_of(spark, both)


def test_credentials(tmp_path, monkeypatch):
    from skylattice import config

    place = tmp_path / ".env"
    place.write_text("# A=1\n\nB = two words \nC=x=y\nB=again\nno line\nD=\n")
    assert config.secrets(place) == {"B": "two words", "C": "x=y", "D": ""} and config.secrets(tmp_path / "none") == {}
    monkeypatch.setenv("C", "from outside")
    assert (config.secret("B", place), config.secret("C", place)) == ("two words", "from outside")
    for name in ("D", "E"):
        with pytest.raises(ValueError, match=name):
            config.secret(name, place)
