"""WARC headers of any length."""

import io

import pytest

from gridlore.llm import warc


def test_pages_with_long_addresses_come_back(spark):
    pages = [(1, "http://a/?" + "q" * 70_000, "one"), (2, "http://a/" + " " * 40_000, "two"), (3, "data:," + "é" * 1_500_000, "one"), (4, "http://a/", "four")]
    m = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = {r["record_id"]: r for r in warc.read(m, m.folder, with_payload=True).collect()}
    assert all(r["gap"] is None for r in rows.values()) and set(rows) == {f"urn:x-page:{i}" for i in range(1, 5)}
    for i, url, html in pages:
        r = rows[f"urn:x-page:{i}"]
        assert r["uri"] == url.replace(" ", "%20") and (r["record_type"] == "revisit" or r["payload"] == html.encode())
    assert rows["urn:x-page:1"]["refers_to"] == "urn:x-page:3"


@pytest.mark.parametrize("extra", range(4))
def test_salvage_of_plain_files_finds_long_headers(extra):
    make = lambda i, n: warc.record("response", f"urn:x-page:{i}", "http://a/" + "q" * n, "2024-01-01T00:00:00Z", b"body", "D", 4)
    data = b"WARC/1.1\r\nbroken" + make(1, 100_000 + extra) + make(2, 3_800 + extra) + b"junk" + make(3, 2_000_000) + b"WARC/1.1\r\nno end"
    out = list(warc.salvage(io.BytesIO(data)))
    assert [x[3]["warc-record-id"] for x in out if x[0] == "record"] == [f"<urn:x-page:{i}>" for i in (1, 2, 3)]
