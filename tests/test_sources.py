from __future__ import annotations

import json
import struct
import sys
import zlib

import pytest
from pyspark import cloudpickle

from geoloom.config import FLAT_FETCH, NESTED_FETCH, FetchOptions
from geoloom.operators.grid import BBox
from geoloom.plans import jobs
from geoloom.sources import download, images, paging, raw_store
from geoloom.sources.connector import scan_tiles

# Executors can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOX = BBox(55.55, 55.56, 37.30, 37.31)
FAST = FetchOptions(limit=10, pause_sec=0, retries=2, backoff_sec=0.5)


class Answer:
    def __init__(self, status=200, payload=None, body=b""):
        self.status_code, self.payload, self.body = status, payload, body

    def raise_for_status(self):
        if self.status_code >= 400:
            raise RuntimeError(f"status {self.status_code}")

    def json(self):
        return self.payload

    def close(self):
        pass

    def iter_content(self, chunk_size):
        return (self.body[k : k + chunk_size] for k in range(0, len(self.body), chunk_size))


class Session:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def get(self, url, params=None, timeout=None, stream=False):
        self.calls.append((url, params))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_retries_then_succeeds():
    session, pauses = Session(Answer(429), ConnectionError("x"), Answer(payload=[])), []
    options = FetchOptions(limit=1, retries=3, backoff_sec=1.5)
    assert paging.request(session, "u", {}, options, pauses.append).status_code == 200
    assert len(session.calls) == 3 and pauses == [1.5, 3.0]


def test_other_statuses_fail_at_once():
    session = Session(Answer(404), Answer())
    with pytest.raises(RuntimeError, match="404"):
        paging.request(session, "u", {}, FAST, lambda _: None)
    assert len(session.calls) == 1


def test_last_retry_status_is_raised():
    with pytest.raises(RuntimeError, match="503"):
        paging.request(Session(Answer(503), Answer(503)), "u", {}, FAST, lambda _: None)


@pytest.mark.parametrize(
    ("payload", "page"),
    [
        ({"result": {"data": [1], "currentPage": 1, "totalPages": 2}}, ([1], True)),
        ({"result": {"data": [1], "hasMore": False, "currentPage": 1, "totalPages": 2}}, ([1], False)),
        ({"result": {"data": [1], "currentPage": 0, "page": 1, "totalPages": 2}}, ([1], True)),
        ({"result": {"data": [1], "hasMore": "true"}}, ([1], True)),
        ({"result": {"data": None}}, ([], False)),
        ({"data": []}, ([], False)),
        ([1, 2], ([1, 2], True)),
        (None, ([], False)),
    ],
)
def test_pages(payload, page):
    assert paging.extract_page(payload) == page


def test_flat_pages_are_numbered():
    session = Session(Answer(payload={"result": {"data": ["a"], "hasMore": True}}), Answer(payload={"result": {"data": ["b"], "hasMore": False}}))
    assert list(paging.flat_items(session, BOX, FAST)) == ["a", "b"]
    assert [p["page"] for _, p in session.calls] == [1, 2] and session.calls[0][1]["bbox"] == "37.3,55.55,37.31,55.56"


def test_nested_pages_follow_the_cursor():
    session = Session(Answer(payload={"data": [{"id": 1}], "paging": {"next": "https://next"}}), Answer(payload={"data": [{"id": 2}], "paging": {"next": ""}}))
    assert [x["id"] for x in paging.nested_items(session, "t", BOX, FAST)] == [1, 2]
    assert session.calls[1] == ("https://next", {})


def test_pages_are_limited(caplog):
    session = Session(*(Answer(payload=[1]) for _ in range(3)))
    assert list(paging.flat_items(session, BOX, FetchOptions(limit=1, max_pages=3))) == [1, 1, 1]
    assert "cut at 3 pages" in caplog.text


@pytest.mark.parametrize("bad", [{"limit": 0}, {"pause_sec": -0.1}, {"max_pages": 0}, {"retries": 0}])
def test_option_guards(bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        FetchOptions(**({"limit": 1} | bad))
    assert (NESTED_FETCH.limit, FLAT_FETCH.limit) == (2000, 1000)


class TileSession:
    """Answers by the tile that it is asked for."""

    def get(self, url, params=None, timeout=None):
        low = float(params["bbox"].split(",")[0])
        if low > 2:
            raise ConnectionError("down")
        return Answer(payload={"result": {"data": [{"id": f"k{low}", "lat": 1, "lon": low, "fileurl": "u"}, {"id": "same", "lat": 1, "lon": 1, "fileurl": "u"}], "hasMore": False}})


def test_scan_and_ingest(spark, tmp_path):
    tiles = [(k, BBox(0.0, 0.1, float(k), k + 0.1)) for k in range(4)]
    rows = scan_tiles(spark, "flat", tiles, FAST, concurrent=2, connect=TileSession).orderBy("tile_no", "item_no").collect()
    assert [(r.tile_no, r.error is None) for r in rows] == [(0, True), (0, True), (1, True), (1, True), (2, True), (2, True), (3, False)]
    plan = spark.createDataFrame([(n, b.min_lat, b.max_lat, b.min_lon, b.max_lon) for n, b in tiles], "tile_no long, min_lat double, max_lat double, min_lon double, max_lon double")
    store = str(tmp_path / "store")
    assert jobs.ingest(spark, "flat", store, FAST, plan, connect=TileSession) == (4, 4)
    assert jobs.ingest(spark, "flat", store, FAST, plan, connect=TileSession) == (0, 4)
    assert [r.id for r in jobs.stored_records(spark, store).orderBy("ord").collect()] == ["k0.0", "same", "k1.0", "k2.0"]


def tile_table(spark, n):
    return spark.createDataFrame([(k, 0.0, 0.1, float(k), k + 0.1) for k in range(n)], "tile_no long, min_lat double, max_lat double, min_lon double, max_lon double")


class EmptySession:
    def get(self, url, params=None, timeout=None):
        return Answer(payload={"data": []})


def test_runs_that_find_nothing_or_die_leave_a_store_that_works(spark, tmp_path, monkeypatch):
    store, plan = str(tmp_path / "store"), tile_table(spark, 2)
    assert [jobs.ingest(spark, "flat", store, FAST, plan, connect=EmptySession) for _ in range(3)] == [(0, 0)] * 3
    assert jobs.stored_records(spark, store).count() == 0

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(jobs, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            jobs.ingest(spark, "flat", store, FAST, plan, connect=TileSession)
    assert jobs.stored_records(spark, store).count() == 0
    # The answers of the run that died are there: nobody is asked again.
    assert jobs.ingest(spark, "flat", store, FAST, plan, connect=DownSession) == (3, 3)
    assert [jobs.ingest(spark, "flat", store, FAST, plan, connect=TileSession) for _ in range(2)] == [(0, 3)] * 2
    with pytest.raises(Exception, match="(?i)exist"):
        jobs._commit(spark, store, 0, {})


class DownSession:
    def get(self, url, params=None, timeout=None):
        raise ConnectionError(f"GET {url}?access_token={(params or {}).get('access_token')}&bbox=1 failed; token s3cret")


def test_failed_tiles_are_told_without_the_token(spark, tmp_path, caplog):
    store = str(tmp_path / "store")
    assert jobs.ingest(spark, "nested", store, FetchOptions(limit=1, pause_sec=0, retries=1), tile_table(spark, 3), token="s3cret", connect=DownSession, step_tiles=2) == (0, 0)
    rows = jobs.failed_tiles(spark, store).orderBy("tile_no").collect()
    assert [(r.run, r.tile_no) for r in rows] == [(0, 0), (0, 1), (0, 2)] and "3 of 3 tiles failed" in caplog.text
    assert all("s3cret" not in r.error and "ConnectionError" in r.error for r in rows)


def test_places_given_as_text(spark, tmp_path):
    path = tmp_path / "x.json"
    raw_store.write_json(path, [{"id": 1, "lat": " 55.7", "lon": "37.6", "url": "u"}, {"id": "2", "lat": 1e1, "lon": -3, "url": "u"}, {"id": "3", "lat": None, "url": "u"}])
    rows = raw_store.read_records(spark, str(path)).orderBy("ord").collect()
    assert [(r.id, r.lat, r.lon) for r in rows] == [("1", 55.7, 37.6), ("2", 10.0, -3.0), ("3", None, None)]
    raw_store.write_json(path, [{"id": "4", "lat": "abc", "lon": 1, "url": "u"}])
    with pytest.raises(Exception, match="record 0 has a lat that is no number: abc"):
        raw_store.read_records(spark, str(path)).collect()


def test_scan_guards(spark):
    with pytest.raises(ValueError, match="token"):
        scan_tiles(spark, "nested", [], FAST)


def test_download(tmp_path):
    there = tmp_path / "a.jpg"
    there.write_bytes(b"x" * 10_000)
    assert download.download_file("u", there, session=Session())
    fresh = tmp_path / "sub" / "b.jpg"
    assert download.download_file("u", fresh, session=Session(ConnectionError(), Answer(body=b"y" * 20_000)), sleep=lambda _: None)
    assert fresh.stat().st_size == 20_000 and not list(tmp_path.rglob("*.part"))
    small = tmp_path / "c.jpg"
    small.write_bytes(b"z")
    assert not download.download_file("u", small, retries=2, session=Session(Answer(body=b"s"), Answer(500)), sleep=lambda _: None)
    assert not small.exists()
    for bad in ({"retries": 0}, {"min_bytes": -1}):
        with pytest.raises(ValueError):
            download.download_file("u", there, **bad)


class BlobSession:
    def get(self, url, stream=False, timeout=None):
        return Answer(500) if "bad" in url else Answer(body=b"i" * 50)


def test_download_all(spark, tmp_path):
    manifest = spark.createDataFrame([("a", "good", "a.jpg"), ("b", "bad", "b.jpg"), ("c", "", "c.jpg"), ("d", None, "d.jpg"), ("e", "NaN", "e.jpg")], "id string, download_url string, image_path string")
    found = download.download_all(manifest, str(tmp_path), BlobSession, retries=1, min_bytes=10).persist()
    assert {r.id: r.status for r in found.collect()} == {"a": "ok", "b": "download_failed", "c": "missing_url", "d": "missing_url", "e": "missing_url"}
    assert tuple(download.outcome_counts(found).first()) == (1, 4)
    assert sorted(r.value for r in download.error_lines(found).collect()) == ["download_failed\tb\tbad", "missing_url\tc", "missing_url\td", "missing_url\te"]


def png(width=2, height=2):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + b"\x10\x20\x30" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_validation_of_images(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    (folder / "good.png").write_bytes(png())
    (folder / "junk.jpg").write_bytes(b"not an image")
    rows = [("a", 55.75, 37.61, "good.png"), ("b", 0.0, 37.61, "junk.jpg"), ("c", 0.0, 0.0, "none.jpg"), (None, float("nan"), 37.6, "good.png")]
    manifest = spark.createDataFrame([(k, i, x, y, str(folder / p)) for k, (i, x, y, p) in enumerate(rows)], "ord long, id string, lat double, lon double, image_path string")
    manifest.write.parquet(str(tmp_path / "m"))
    counts = jobs.run_validate(spark, str(tmp_path / "m"), str(folder), str(tmp_path / "r" / "report.json"), min_bytes=20)
    out = json.loads((tmp_path / "r" / "report.json").read_text())
    assert counts == out["summary"] == {"rows": 4, "missing_fields": 3, "invalid_coords": 3, "missing_images": 1, "too_small": 1, "broken_images": 1}
    assert sorted(out["issues"]["invalid_coords"]) == ["None", "b", "c"] and out["issues"]["missing_images"] == ["c"] and out["issues"]["broken_images"] == ["b"]
    assert list(out["issues"]) == ["missing_fields", "invalid_coords", "missing_images", "too_small", "broken_images"] and out["issues"]["missing_fields"][0] == "missing_column:source"
    assert images.scan(spark, str(tmp_path / "nowhere")).count() == 0


def test_json_files(spark, tmp_path):
    path = tmp_path / "deep" / "x.json"
    raw_store.write_json(path, {"a": 1, "b": [1, 2, 3]})
    assert raw_store.read_json(path, None) == {"a": 1, "b": [1, 2, 3]} and raw_store.read_json(tmp_path / "no", 5) == 5
    raw_store.write_json(path, [{"id": "é", "lat": 0.0, "lon": 1.5, "image_url": "u", "more": {"z": 1, "a": 2}}, {"id": "2"}])
    rows = raw_store.read_records(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r.id, r.lat) for r in rows] == [(0, "é", 0.0), (1, "2", None)] and json.loads(rows[0].raw_json)["more"] == {"z": 1, "a": 2}
    assert raw_store.read_items(spark, str(tmp_path / "none.json")).count() == 0
