from __future__ import annotations

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from txnwatch.llm import warc

PAGES = "page_id long, url string, html string, record_type string, payload string"


def pages(spark):
    rng = random.Random(8)
    html = ["", None, "a", "\r\n", "\r\n\r\n", "x\r", "\n", "WARC/1.1\r\n\r\n", "é𝔘\u0085 ", "a\r\nb\r\n"]
    html += ["same", "same", "same", "", "x" * warc.CHUNK, "y" * (warc.CHUNK - 1) + "\r\nz\r"]
    html += ["é\r\n" * (warc.CHUNK // 2) + "end", "\r\n" * warc.CHUNK]
    html += ["".join(rng.choices("ab\r\né", k=400)) for _ in range(20)]
    return [(i * 3 % 101, "http://x/?q=é b\r\nEvil: 1" if i % 2 else None, h, "r", "p") for i, h in enumerate(html)]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    largest = {}
    for page, _, html, *_ in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    out = []
    for page, _, html, *_ in rows:
        first = largest[html or ""]
        again = first >= 0 and first != page
        kind = "revisit" if again else "response"
        out.append((page, len((html or "").encode()), digest(html), kind, first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages(spark)
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_null_and_repeated_page_ids_and_no_rows(spark):
    rows = [(None, None, "a", "", ""), (None, None, "b", "", ""), (1, None, "a", "", "")]
    rows += [(1, None, "a", "", ""), (1, None, "c", "", ""), (1, None, None, "", "")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_chunks_are_bounded_and_join_to_the_payload(spark, tmp_path):
    rows = pages(spark)
    path = str(tmp_path / "archives")
    warc.write(spark.createDataFrame(rows, PAGES), path)
    chunks = warc.chunks(spark, path).collect()
    by_page = {}
    for r in sorted(chunks, key=lambda r: (r.page_id, r.chunk_no)):
        part = by_page.setdefault(r.page_id, [])
        if r.record_type == "revisit":
            continue
        assert r.chunk_no == len(part) + 1 and len(r.chunk) <= warc.CHUNK
        part.append(bytes(r.chunk))
        assert r.bytes_so_far == sum(map(len, part))
        assert r.digest_so_far == base64.b32encode(hashlib.sha1(b"".join(part)).digest()).decode()
    kinds = {e[0]: e[3] for e in expected(rows)}
    for page, _, html, *_ in rows:
        if kinds[page] == "response":
            assert b"".join(by_page[page]) == (html or "").encode()
    assert max(r.chunk_no for r in chunks) > 2


def test_archives_are_plain_warc(spark, tmp_path):
    """An independent reader that goes by Content-Length alone sees every record."""
    path = tmp_path / "archives"
    rows = pages(spark)
    warc.write(spark.createDataFrame(rows, PAGES), str(path))
    kinds = []
    for file in path.glob("*.gz"):
        raw, at = gzip.decompress(file.read_bytes()), 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].split(b"\r\n")
            assert lines[0] == b"WARC/1.1"
            fields = dict(x.split(b": ", 1) for x in lines[1:])
            at = end + 4 + int(fields[b"Content-Length"])
            assert raw[at : at + 4] == b"\r\n\r\n"
            at += 4
            kinds.append(fields[b"WARC-Type"])
    assert len(kinds) - kinds.count(b"continuation") == len(rows)


@pytest.mark.parametrize("damage", [(b"Content-Length: 1\r", b"Content-Length: 2\r"), (b"\r\n\r\na\r\n", b"\r\n\r\nb\r\n")])
def test_damage_is_noticed(spark, tmp_path, damage):
    path = tmp_path / "archives"
    warc.write(spark.createDataFrame([(1, None, "a", "", "")], PAGES), str(path))
    bad = tmp_path / "bad"
    bad.mkdir()
    for file in Path(path).glob("*.gz"):
        raw = gzip.decompress(file.read_bytes())
        (bad / file.name).write_bytes(gzip.compress(raw.replace(*damage)))
    with pytest.raises(Exception, match="header says|not the start|block"):
        warc.chunks(spark, str(bad)).collect()
