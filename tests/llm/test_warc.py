"""WARC archives: exact round trip, revisits, determinism, commit."""

import gzip
import hashlib
import pathlib

import pytest

from stockflow.llm import queries, warc

ROWS = [
    (5, "http://a.example/x y\r\nInjected: 1", "<p>é</p>"), (3, "http://b.example/", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "u", None), (2, "u", ""),
    (None, "http://null.example", "only"), (None, "http://null.example", "<p>é</p>"), (7, "http://c", "long " * 40000), (8, "http://d", "\r\n\r\nWARC/1.1"),
    (7, "http://c", "long " * 40000), (11, "http://e", "text" * 30),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows, least=0):
    first = {}
    big = warc.NO_ID
    for p, _, h in rows:
        first[h or ""] = min(first.get(h or "", big), big if p is None else p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= least and (big if p is None else p) > first[h or ""]
        out.append((p, len(body), warc.base32(hashlib.sha1(body).hexdigest()), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_round_trip(spark, tmp_path, least):
    df = frame(spark).selectExpr("*", "1 AS part", "2 AS pid", "'d' AS digest", "3 AS kind").repartition(3)
    warc.write_warc(df, f"file://{tmp_path}/a", least_revisit=least)
    back = warc.read_warc(spark, f"file://{tmp_path}/a")
    assert digest(back) == expected(ROWS, least)
    got = {(r.page_id, bytes(r.payload)) for r in back.collect() if r.record_type == "response"}
    assert got <= {(p, (h or "").encode()) for p, _, h in ROWS}
    assert {r.url for r in back.collect() if r.page_id == 5} == {"http://a.example/x%20y%0D%0AInjected:%201"}
    assert {r.url for r in back.collect() if r.page_id == 9} == {None}


def test_files_are_deterministic_rolled_and_sorted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 60_000)
    rows = [(i * 7 % 1000, f"http://h/{i}", hashlib.sha256(str(i % 400).encode()).hexdigest() * 20) for i in range(500)]
    seen = []
    for run, parts in (("a", 2), ("b", 7)):
        out = f"file://{tmp_path}/{run}"
        manifest = warc.write_warc(frame(spark, rows).repartition(parts), out, roll_bytes=4000).collect()
        assert digest(warc.read_warc(spark, out, with_payload=False)) == expected(rows)
        files = {p.name: p.read_bytes() for p in pathlib.Path(tmp_path / run).glob("*.warc.gz")}
        assert files.keys() == {m.name for m in manifest} and len({n[:11] for n in files}) > 3
        assert all(hashlib.sha256(files[m.name]).hexdigest() == m.sha256 and len(files[m.name]) == m.bytes for m in manifest)
        assert all(m.bytes <= 4000 or m.records == 1 for m in manifest)
        assert not (tmp_path / run / "_temporary").exists()
        order = [int(x[11:]) for n in sorted(files) for x in gzip.decompress(files[n]).decode().split("\r\n") if x.startswith("X-Page-Id: ")]
        assert order == sorted(order)
        seen.append(files)
    assert seen[0] == seen[1]


def test_uncommitted_files_are_not_read(spark, tmp_path):
    out = f"file://{tmp_path}/a"
    warc.write_warc(frame(spark), out)
    (tmp_path / "a" / "range-99999-00000.warc.gz").write_bytes(b"half")
    assert digest(warc.read_warc(spark, out)) == expected(ROWS)


def test_damage_is_found():
    record = warc.build_record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), False, None, "d")
    assert warc.parse_record(record)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"body", b"bodY"))


def test_query_and_empty_table(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/x/pages.parquet")
    assert sorted(map(tuple, queries.op5_warc(spark, f"{tmp_path}/x").collect()), key=str) == expected(ROWS)
    frame(spark, []).write.parquet(f"{tmp_path}/y/pages.parquet")
    assert queries.op5_warc(spark, f"{tmp_path}/y").count() == 0
