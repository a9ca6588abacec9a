"""WARC: every page is found through the index with few reads; null and repeated page_ids, long payloads."""

import random

from tessera.llm import warc
from tessera.llm.common import shared_dir


def made(spark, rows, parts=4):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return pages, warc.write(pages, f"{shared_dir(spark)}/warc-test-{random.random()}", block_lines=9)


def test_every_page_by_its_key_in_few_reads(spark):
    rows = [(i, f"https://h{i * 7919 % 83}.example.org/p/{i % 150}", f"<p>{i}</p>") for i in range(600)] + [(900 + i, "https://hot.example.org/", f"hot {i}") for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, archives = made(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = archives.files()
    assert len(files) > 1 and files == sorted(files)
    by_key = {}
    for i, url, html in rows:
        by_key.setdefault(warc.surt(url), []).append((i, html))
    for key, want in by_key.items():
        finder = warc.Finder(archives.folder, files)
        lines = finder.lines(key)
        assert sorted(x[1] for x in lines) == sorted(i for i, _ in want)
        # a directory and a block for each file that the key runs over, and a block more for each nine lines
        assert finder.reads <= 2 * (2 + len(want) // 9) + 1
        for _, page_id, *place in lines[:3]:
            before = finder.reads
            fields, block = warc.parse(finder.record(*place))
            assert finder.reads == before + 1 and block.endswith(dict(want)[page_id].encode()) and fields["warc-type"] == "response"
    for url in ("https://a.example/", "https://zz.example.zz/", "https://h5.example.org/p/none", ""):
        finder = warc.Finder(archives.folder, files)
        assert finder.lines(warc.surt(url)) == [] and finder.reads <= 2


def test_null_and_repeated_ids_and_long_payloads(spark):
    long = "<p>é</p>" * 700_000
    rows = [(None, "http://a/", "x"), (None, None, "x"), (None, "", None), (5, "http://a/", "x"), (5, "http://a/", "y"), (5, "http://b/", "x"), (7, "http://c/", long), (8, "http://c/", long), (9, None, None)]
    pages, archives = made(spark, rows, 2)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archives.read(pages).collect()), key=repr)
    size = len(long.encode())
    want = [(None, 1, "response", None), (None, 1, "response", None), (None, 0, "response", None), *[(5, 1, "response", None)] * 3, (7, size, "revisit", 8), (8, size, "response", None), (9, 0, "response", None)]
    assert got == sorted(want, key=repr)
    assert len(archives.lookup("http://a/")) == 3 and [len(b) > size for _, b in archives.lookup("http://c/")] == [False, True]
