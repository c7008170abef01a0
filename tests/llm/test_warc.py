import random

from hornweave.llm import warc
from pyspark.sql import functions as F

from .helpers import frame


def rec(i, url, ts, kind="response", status=200, headers=None, payload=b""):
    return (i, url, ts, kind, status, list(headers.items()) if isinstance(headers, dict) else headers or [], payload)


def fields(row):
    return [tuple(x) for x in row.headers]


def resolved(spark, rows, bucket=10):
    return {r.id: r for r in warc.resolve(frame(spark, rows, warc.RECORD), bucket).collect()}


def test_as_of_equals_brute_force_with_a_hot_url(spark):
    rng = random.Random(3)
    rows = [rec(i, rng.choice(["http://a/x", "http://a/x", "https://www.A/x/#f", "http://b/y"]), rng.randrange(200), *(("revisit", 304) if rng.random() < 0.4 else ("response", rng.choice([200, 200, 404])))) for i in range(300)]
    got = resolved(spark, rows)
    place = lambda u: u.replace("https://www.A", "a").replace("http://", "").split("#")[0].rstrip("/").lower()
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            want = max(((t, j) for j, u, t, k, s, *_ in rows if k == "response" and s == 200 and place(u) == place(url) and (t, j) < (ts, i)), default=(None, None))[1]
            assert got[i].source_id == want and got[i].outcome == ("orphan" if want is None else "resolved")
    assert len(got) == 300


def test_validators_and_headers(spark):
    rows = [
        rec(1, "http://h/p", 1, headers={"etag": 'W/"1"', "content-length": "3", "x": "old", "content-type": "t"}, payload=b"abc"),
        rec(2, "http://h/p", 2, "revisit", 304, {"etag": '"1"', "content-length": "0", "x": "new", "date": "d"}),
        rec(3, "http://h/p", 3, "revisit", 304, {"etag": '"2"'}),
        rec(4, "http://h/p", 4, "revisit", 304, {"last-modified": "m"}),
        rec(5, None, 5, "revisit", 304), rec(6, "http://h/q", 6, "revisit", 304), rec(7, "http://h/p", 0, "revisit", 304), rec(8, None, 5, payload=None),
    ]
    got = resolved(spark, rows)
    assert [got[i].outcome for i in range(1, 9)] == ["full", "resolved", "mismatch", "resolved", "orphan", "orphan", "orphan", "full"]
    assert (got[2].status, bytes(got[2].payload)) == (200, b"abc")
    assert dict(fields(got[2])) == {"etag": '"1"', "content-length": "3", "x": "new", "content-type": "t", "date": "d"}
    assert got[3].status == 304


def test_round_trip_through_bytes(spark):
    rows = [rec(1, "http://h/é", 1, headers={"a": "b"}, payload=b"x\r\n\r\ny"), rec(2, None, 2, "revisit", 304, {}, None)]
    back = warc.from_warc(warc.to_warc(frame(spark, rows, warc.RECORD))).collect()
    assert sorted((r.id, r.url, r.ts, r.kind, r.status, bytes(r.payload)) for r in back) == [(1, "http://h/é", 1, "response", 200, b"x\r\n\r\ny"), (2, None, 2, "revisit", 304, b"")]
    one = warc.serialise({"id": 1, "url": "u", "ts": 1, "kind": "response", "status": 200, "headers": {}, "payload": b"p"})
    assert len(warc.parse(one + one)) == 2
    assert [r["error"] for r in warc.parse(one[:-5])] == ["damaged WARC record at byte 0"]


def test_repeated_headers_stay(spark):
    rows = [
        rec(1, "http://h/p", 1, headers=[("set-cookie", "b"), ("link", "1"), ("set-cookie", "a"), ("link", "2"), ("via", "x")]),
        rec(2, "http://h/p", 2, "revisit", 304, [("link", "3"), ("te", "no"), ("link", "3")]), rec(3, "http://h/p", 3, "revisit", 304),
    ]
    back = warc.from_warc(warc.to_warc(frame(spark, rows, warc.RECORD)))
    got = {r.id: fields(r) for r in warc.resolve(back).collect()}
    assert got[1] == got[3] == [("set-cookie", "b"), ("link", "1"), ("set-cookie", "a"), ("link", "2"), ("via", "x")]
    assert got[2] == [("set-cookie", "b"), ("set-cookie", "a"), ("via", "x"), ("link", "3"), ("link", "3")]


def test_bad_records_become_rows(spark):
    good = warc.serialise({"id": 1, "url": "u", "ts": 1, "kind": "response", "status": 200, "headers": [{"name": "a", "value": "b"}], "payload": b"p"})
    latin = good.replace(b"a: b", b"a: \xe9")
    date, status = good.replace(b"WARC-Date: 1", b"WARC-Date: x"), good.replace(b"HTTP/1.1 200", b"HTTP/1.1 2x0")
    length = good.replace(b"Content-Length: ", b"Content-Length: 9")
    data = latin + date + length + status + good[:-2] + good + b"trash"
    got = warc.from_warc(spark.createDataFrame([(bytearray(data),), (None,)], "record binary")).collect()
    assert [r.error and r.error.split(" at byte")[0] for r in got] == [None, "unreadable date", "damaged WARC record", "unreadable status", "damaged WARC record", None, "no WARC record"]
    assert fields(got[0]) == [("a", "é")] and [r.id for r in got] == [1, 1, None, 1, None, 1, None]
    assert sorted(r.outcome for r in warc.resolve(warc.from_warc(spark.createDataFrame([(bytearray(data),)], "record binary"))).collect()) == ["full"] * 7


def test_further_columns_are_ignored(spark):
    rows = frame(spark, [rec(1, "http://h/p", 1), rec(2, "http://h/p", 2, "revisit", 304)], warc.RECORD)
    more = rows.withColumn("place", F.lit(1)).withColumn("source_id", F.lit(2)).withColumn("outcome", F.lit("x")).withColumn("error", F.lit("y"))
    assert sorted(map(str, warc.resolve(more).collect())) == sorted(map(str, warc.resolve(rows).collect()))


def test_records_with_nulls_and_line_breaks(spark):
    rows = [
        rec(None, "http://h/p", 1), rec(2, "http://h/p", None), rec(3, "http://h/p", 3, None), rec(4, "http://h/p", 4, status=None), rec(5, "http://h/p", 5, headers=None),
        rec(6, "http://h/\r\np", 6, headers=[("a", "b\r\n\r\nc"), ("d", None), (None, "e"), None], payload=b"six"), rec(7, "http://h/p", 7, "revisit", 304), rec(8, "http://h/p", None, "revisit", 304),
        rec(None, "http://h/p", 9, "revisit", 304), (10, None, None, None, None, None, None), (-(1 << 63), "", 10, "response", 200, None, None), ((1 << 63) - 1, "", 10, "response", 200, None, None),
    ]
    back = warc.from_warc(warc.to_warc(frame(spark, rows, warc.RECORD)))
    assert sorted(str((r.id, r.ts, r.kind, r.status)) for r in back.collect()) == sorted(str((r[0], r[2], r[3], r[4])) for r in rows)
    assert {r.id: fields(r) for r in back.collect() if r.id}[6] == [("a", "b c")]
    for table in (back, frame(spark, rows, warc.RECORD)):
        got = [(r.id, r.ts, r.outcome, r.source_id) for r in warc.resolve(table).collect() if r.kind == "revisit"]
        assert sorted(got, key=str) == [(7, 7, "resolved", 6), (8, None, "orphan", None), (None, 9, "orphan", None)]


def test_repeated_ids_are_resolved_once_each(spark):
    rows = [rec(1, "http://h/p", 1, payload=b"a"), rec(1, "http://h/p", 1, payload=b"b"), rec(1, "http://h/p", 1, payload=b"a")]
    rows += [rec(2, "http://h/p", 2, "revisit", 304), rec(2, "http://h/p", 2, "revisit", 304), rec(2, "http://h/p", 0, "revisit", 304), rec(2, "http://h/q", 2, "revisit", 304)]
    for order in (rows, rows[::-1]):
        got = sorted((r.url, r.ts, r.outcome, bytes(r.payload)) for r in warc.resolve(frame(spark, order, warc.RECORD).repartition(3)).collect() if r.kind == "revisit")
        payload = got[1][3]
        assert payload in (b"a", b"b")
        assert got == [("http://h/p", 0, "orphan", b""), ("http://h/p", 2, "resolved", payload), ("http://h/p", 2, "resolved", payload), ("http://h/q", 2, "orphan", b"")]


def test_records_of_other_writers():
    http = b"HTTP/1.1 304 Not Modified\r\nETag:\t\"1\" \r\n\r\n"
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0e5c6e7a-0000-4000-8000-000000000001>\r\nWARC-Date: 1970-01-01T00:01:40Z\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type:revisit\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    a, b = warc.parse(one + two)
    assert (a["ts"], a["status"], a["headers"], a["payload"]) == (100, None, [], b"a:b") and a["id"] > 0
    assert (b["id"], b["ts"], b["kind"], b["status"], b["headers"], b["payload"]) == (None, None, "revisit", 304, [{"name": "etag", "value": '"1"'}], b"")


def test_canonical_url(spark):
    cases = {
        "HTTP://www.Ex.com:80/A/?utm_source=f&b=1#x": "ex.com/A/?b=1", "http://ex.com/a?x=1&utm_medium=q&b=1": "ex.com/a?x=1&b=1", "http://ex.com/a?utm_source=f&b=1": "ex.com/a?b=1",
        "http://ex.com/a?b=1": "ex.com/a?b=1", "http://ex.com/a?&&b=1&": "ex.com/a?b=1", "http://ex.com/A//?": "ex.com/A", "http://ex.com?q=u/": "ex.com?q=u/", "http://ex.com/r?href=1&ref": "ex.com/r?href=1", "https://ex.com/A/": "ex.com/A", "http://u@ex.com/p?page=2&ref=x": "ex.com/p?page=2",
        "https://ex.com": "ex.com", "": None, " http://ex.com/en/1?utm_source=feed ": "ex.com/en/1",
    }
    got = frame(spark, [(k,) for k in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == cases


def test_empty_table(spark):
    assert warc.resolve(frame(spark, [], warc.RECORD)).count() == 0
    assert warc.from_warc(warc.to_warc(frame(spark, [], warc.RECORD))).count() == 0
    assert warc.crawl_of_pages(frame(spark, [(1, None, None)], "page_id long, url string, html string")).count() == 2
