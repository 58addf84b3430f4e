import gzip
import hashlib
import random

from facetry.llm import warc
from facetry.session import drop_folder, settled, shared_folder


def rows():
    big, same = "ä" * 800, "<p>\r\n\r\nWARC/1.1\r\n" * 100
    return [(1, "http://b.com/x", big), (2, "http://a.com/", same), (3, "http://a.com/", same), (4, None, None), (5, "http://a.com/", "short"), (6, "http://a.com/", "short"), (7, "http://a.com/y z\n", big), (7, "http://a.com/y z\n", big), (None, "http://c.com", same), (2**62, "http://d.com/", "x"), (-(10**13), "http://d.com/", "x"), (10**12, None, big)]


def test_archived_pages_by_brute_force(spark):
    data = rows()
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string")
    got = warc.archived_pages(pages).collect()
    assert len(got) == len(data)
    for r in got:
        html = next(h for k, _, h in data if k == r["page_id"]) or ""
        raw = html.encode()
        equal = [k for k, _, h in data if (h or "").encode() == raw and k is not None]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        if len(raw) >= 1000 and r["page_id"] != max(equal):
            assert (r["record_type"], r["refers_to"]) == ("revisit", max(equal))
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
    keys = [(r["url_key"], r["captured"]) for r in got]
    assert keys == sorted(keys)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_record_types_by_shuffle(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    assert sorted(map(str, warc.record_types(pages, broadcast_rows=-1).collect())) == sorted(map(str, warc.record_types(pages).collect()))


def test_archives_are_warc(spark):
    folder = shared_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1), folder)
    files = spark.read.format("binaryFile").load(f"{folder}/part-*").collect()
    raw = b"".join(gzip.decompress(bytes(f["content"])) for f in files)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert sum(len(warc.parse_archive("r", bytes(f["content"]))) for f in files) == len(rows())
    drop_folder(spark, folder)


def test_records_by_offset_and_very_long_ones(spark):
    """The index fetches each record alone; a member over 16 MB, which doesn't end with a
    zero byte, is read back as well."""
    long = "".join(chr(97 + k % 23) for k in range(1 << 20)) * 17
    data = [(1, "http://a.com/", "one"), (2, "http://a.com/", long), (3, "http://a.com/%7e", "three")]
    folder = shared_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), folder)
    read = {}
    for f in spark.read.format("binaryFile").load(f"{folder}/part-*").collect():
        raw = bytes(f["content"])
        for row in warc.parse_archive("r", raw):
            fields, payload = warc.fetch(raw, row[4], row[5])
            read[row[3]] = payload.decode()
            assert fields["warc-payload-digest"] == "sha1:" + row[7]
    assert read == {k: h for k, _, h in data}
    drop_folder(spark, folder)


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    draw = random.Random(1)
    html = lambda: "".join(chr(draw.randint(97, 122)) for _ in range(3000))
    pages = spark.createDataFrame([(k, "http://a.com/", html()) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    folder = shared_folder(spark, "test-warc")
    warc.write_archives(pages, folder)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(f"{folder}/part-*").select("length").collect()]
    assert len(sizes) > 4 and max(sizes) < 24_000
    drop_folder(spark, folder)


def test_merge_by_ranges(spark, monkeypatch):
    """Many small runs, blocks and ranges: a global order over the partitions, all captures,
    one hot URL in several ranges."""
    draw = random.Random(2)
    pages = [(k, "http://hot.com/" if k % 3 else f"http://h{draw.randint(0, 30)}.com/{draw.randint(0, 9)}", f"{draw.randint(0, 5)}" * draw.choice([10, 1500])) for k in range(900)]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    monkeypatch.setattr(warc, "BLOCK", 7)
    folder = shared_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), folder)
    blocks = settled(warc.read_archives(spark, folder))
    index = warc.merge_captures(blocks, captures=100)
    parts = [[(r["url_key"], r["captured"], r["page_id"]) for r in part] for part in index.rdd.glom().collect()]
    rows = [r for part in parts for r in part]
    assert rows == sorted(rows) and sorted(r[2] for r in rows) == list(range(900))
    assert sum(any(r[0] == "com,hot)/" for r in part) for part in parts) > 2
    drop_folder(spark, folder)


def test_merge_holds_open_blocks_only():
    """Blocks are unpacked when the merge comes to them."""
    live, most = [0], [0]

    def unpack(raw):
        live[0] += 1
        most[0] = max(most[0], live[0])
        yield from raw
        live[0] -= 1

    runs = [[list(range(100 * b + r, 100 * b + 100, 4)) for b in range(50)] for r in range(4)]
    blocks = sorted((block[0], block) for run in runs for block in run)
    assert list(warc.merged(iter(blocks), lambda x: x, unpack)) == list(range(5000))
    assert most[0] <= 9


def test_loser_tree():
    draw = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(draw.randint(0, 30) for _ in range(draw.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.B.example.com:80/a?b#c") == "com,example,b:80)/a?b"
    assert warc.url_key(None) == ""
