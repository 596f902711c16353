"""Archives: a round trip against brute force, and look-ups."""

import hashlib
from collections import defaultdict

from pyspark.sql import types as T

from epochal.llm import warc
from epochal.llm.shared import new_path

from .common import SF

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("first", T.IntegerType())])


def brute(rows):
    by = defaultdict(list)
    for page, _, html in rows:
        by[html or ""].append(page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        ids = [p for p in by[html or ""] if p is not None]
        first = max(ids) if len(raw) >= 1000 and len(by[html or ""]) > 1 and ids else None
        again = first is not None and page != first
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def canon(rows):
    return sorted(map(tuple, rows), key=repr)


def test_round_trip_and_look_up(spark):
    big, odd = "ü" * 600, "x" * 1000
    rows = [(1, "http://a.example.com/x?y=1", big), (2, "https://b.example.com:8080/", big), (3, "http://a.example.com/x?y=1", big), (4, None, None), (5, "not a url \n", ""), (6, "http://[bad", "short"), (7, "http://Z.org", "short"), (None, "http://z.org/", odd), (8, "http://z.org/", odd), (8, "http://z.org/", odd), (9, "http://z.org/%20", "\r\n\r\n" * 400)]
    rows += [(r.page_id + 100, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    a, i = new_path(spark, "warc"), new_path(spark, "index")
    captures = warc.write_archives(pages, a)
    warc.write_archives(pages.orderBy("html"), a)  # another attempt's files lie beside those that count
    warc.write_index(captures, i, block_lines=7)
    warc.write_index(captures, new_path(spark, "index"), block_lines=7)
    blocks = warc.find_blocks(pages, i)
    assert canon(warc.read_blocks(blocks, a, i, 3).collect()) == canon(brute(rows))
    assert blocks.count() > 3 and warc.read_blocks(blocks, a, i, 3).rdd.getNumPartitions() == 3
    some = warc.read_blocks(warc.find_blocks(pages.where("page_id = 2"), i), a, i, 1).collect()
    assert 1 <= len(some) <= 14 and any(r.page_id == 2 for r in some)
    keys = defaultdict(list)
    for (_, url, _), r in zip(rows, brute(rows)):
        keys[warc.surt(url)].append(r)
    for _, url, _ in rows:
        assert canon(warc.look_up(a, i, url)) == canon(keys[warc.surt(url)])
    assert warc.look_up(a, i, "http://none.example.net/") == [] == warc.look_up(a, i, "http://zzz.zz/")


def test_surt():
    assert warc.surt("http://www.Example.com/a?b=c") == "com,example,www)/a?b=c"
    assert warc.surt("https://user@example.com:8080") == "com,example:8080)/"


def test_long_payloads_and_clashing_names(spark):
    names = ["payload", "refers_to", "surt", "file", "offset", "size", "part", "n"]
    rows = [(1, "http://a.org/", "é" * 3_000_000), (2, "http://a.org/", "é" * 3_000_000), (3, "http://b.org/", "<p>" * 900_000)]
    pages = spark.createDataFrame([(*r, *names) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    assert canon(warc.archive_and_read(spark, pages).collect()) == canon(brute(rows))


def test_empty(spark):
    assert warc.archive_and_read(spark, spark.createDataFrame([], SCHEMA)).count() == 0
