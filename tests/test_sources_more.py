"""The paged list, committed versions and images without what is written beside the pixels."""

import struct
import threading
import zlib
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from linkforge.functions import images
from linkforge.sources import paged, versions

SCHEMA = "record_id string, name string"


@pytest.fixture(scope="module")
def site():
    """Five pages: the third fails twice, the fourth always; ids overlap."""
    seen, lock = Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("=")[2])
            with lock:
                seen[page] += 1
                fails = page == 4 or (page == 3 and seen[3] <= 2)
            self.send_response(503 if fails else 200)
            self.end_headers()
            links = "".join(f"<li><a class='x' href='/missing/{10 * page + k}'>r</a></li>" for k in (0, 1, -10))
            self.wfile.write(f"<p>1 out of  <b>5</b> Pages</p><a href='/about'>a</a>{links}".encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/list?page={{page}}", seen
    server.shutdown()


def test_pages_with_failures(spark, site):
    url, seen = site
    spark.dataSource.register(paged.PagedList)
    df = spark.read.format("paged_list").option("url", url).option("delay", "0.01").option("per_partition", "2").load()
    rows = {r["page"]: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and rows[4]["body"] is None and rows[4]["error"] == "status 503" and rows[4]["attempts"] == 3
    assert rows[3]["attempts"] == 3 and rows[3]["body"] and seen[4] == 3 and rows[2]["attempts"] == 1
    pages = spark.createDataFrame(list(rows.values()), paged.SCHEMA)
    found = [(r["record_id"], r["page"], r["place"]) for r in paged.listed(pages, "/missing/").orderBy("page", "place").collect()]
    assert found == [("10", 1, 1), ("11", 1, 2), ("0", 1, 3), ("20", 2, 1), ("21", 2, 2), ("30", 3, 1), ("31", 3, 2), ("50", 5, 1), ("51", 5, 2), ("40", 5, 3)]
    assert [r["record_id"] for r in paged.listed(pages, "/missing/", 4).orderBy("page", "place").collect()] == ["10", "11", "0", "20"]


def test_pages_in_a_folder(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.html").write_text(f"out of 2 Pages <A HREF=\"/x/{k}\">")
    spark.dataSource.register(paged.PagedList)
    df = spark.read.format("paged_list").option("url", f"file://{tmp_path}/{{page}}.html").load()
    assert [r["record_id"] for r in paged.listed(df, "/x/").orderBy("page").collect()] == ["1", "2"]
    gone = spark.read.format("paged_list").option("url", f"file://{tmp_path}/no{{page}}").option("delay", "0").load().collect()
    assert len(gone) == 1 and gone[0]["body"] is None and "URLError" in gone[0]["error"]
    with pytest.raises(Exception, match="page"):
        spark.read.format("paged_list").option("url", "file:///x").load().collect()


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rewrite_reads_its_own_path_and_a_repeated_run_adds_nothing(spark, tmp_path):
    v = versions.Versions(spark, f"{tmp_path}/r")
    assert v.newest(SCHEMA).count() == 0 and v.manifest()["number"] == 0
    assert v.append(frame(spark, ("a", "1"), ("b", "2")), "run 1") == 1
    assert v.append(frame(spark, ("b", "3"), ("c", "4")), "run 2") == 2
    assert v.append(frame(spark, ("z", "9")), "run 2") is None
    assert rows(v.newest(SCHEMA)) == [("a", "1"), ("b", "3"), ("c", "4")] and v.read(SCHEMA).count() == 4
    old = v.read(SCHEMA)
    assert v.rewrite(v.newest(SCHEMA).selectExpr("record_id", "concat(name, '!') AS name"), "backfill") == 3
    assert rows(v.newest(SCHEMA)) == [("a", "1!"), ("b", "3!"), ("c", "4!")]
    assert old.count() == 4 and rows(v.read(SCHEMA, 1).drop("commit")) == [("a", "1"), ("b", "2")]
    assert len(v.vacuum()) == 2 and rows(v.newest(SCHEMA)) == [("a", "1!"), ("b", "3!"), ("c", "4!")] and v.append(frame(spark, ("d", "5")), "run 1") is None


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    v = versions.Versions(spark, f"{tmp_path}/r")
    v.append(frame(spark, ("a", "1")), "run 1")
    with monkeypatch.context() as m:
        m.setattr(v, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            v.rewrite(frame(spark, ("x", "0")), "run 2")
    assert rows(v.newest(SCHEMA)) == [("a", "1")] and v.manifest()["number"] == 1
    assert v.append(frame(spark, ("b", "2")), "run 2") == 2 and len(v.vacuum()) == 1


def test_of_two_writers_one_begins_anew(spark, tmp_path):
    v = versions.Versions(spark, f"{tmp_path}/r")
    before = v.manifest()
    v.append(frame(spark, ("a", "1")), "run 1")
    with pytest.raises(versions.Conflict):
        v._commit(before, [], "late")
    assert rows(v.newest(SCHEMA)) == [("a", "1")] and v.numbers() == [1] and not [x for x in v._list("commits") if x.startswith(".") and not x.endswith(".crc")]


def segment(kind, body):
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


@pytest.mark.parametrize("order", [b"II*\0", b"MM\0*"])
def test_jpeg_loses_what_is_beside_the_pixels(order):
    jfif, table, scan = segment(0xE0, b"JFIF\0"), segment(0xDB, b"\0" * 65), segment(0xDA, b"\1\1\0\0?\0") + b"\x12\xff\x00\xff\xd0\x34"
    more = segment(0xC4, b"tt") + segment(0xDA, b"\1") + b"\x56\xff\xff"[:1]
    beside = segment(0xE1, b"Exif\0\0" + order + b"gps") + segment(0xE1, b"http://ns.adobe.com/xap") + segment(0xED, b"Photoshop") + segment(0xFE, b"note \xff\xd9")
    icc = segment(0xE2, b"ICC_PROFILE\0")
    whole = b"\xff\xd8" + jfif + beside + icc + table + scan + segment(0xFE, b"between scans") + more + b"\xff\xd9"
    assert images.stripped(whole + b"trailer") == b"\xff\xd8" + jfif + icc + table + scan + more + b"\xff\xd9" == images.stripped(images.stripped(whole))
    assert images.stripped(whole[:-2] + b"\xff\xff\xd9") == images.stripped(whole)  # fill before the end
    for k in range(len(whole) - 1):
        assert images.stripped(whole[:k]) is None


def test_png_and_what_is_no_image(spark):
    keep = [chunk(b"IHDR", b"\0" * 13), chunk(b"iCCP", b"p"), chunk(b"IDAT", zlib.compress(b"\0\1")), chunk(b"IEND", b"")]
    whole = images.PNG + keep[0] + chunk(b"eXIf", b"MM") + chunk(b"tEXt", b"Author\0x") + keep[1] + chunk(b"tIME", b"0123456") + keep[2] + keep[3]
    assert images.stripped(whole) == images.PNG + b"".join(keep)
    assert images.stripped(whole[:-1]) is None and images.stripped(whole.replace(b"\0\1", b"\0\2")[:40] + b"x") is None
    broken = bytearray(whole)
    broken[20] ^= 1
    rows_ = [("a", whole), ("b", bytes(broken)), ("c", b"GIF89a"), ("d", b""), ("e", None)]
    got = {r["record_id"]: r for r in images.clean_images(spark.createDataFrame(rows_, "record_id string, content binary")).collect()}
    assert bytes(got["a"]["content"]) == images.PNG + b"".join(keep) and got["a"]["image_sha256"] != got["a"]["clean_sha256"] != ""
    assert all((got[k]["image_sha256"], bytes(got[k]["content"]), got[k]["clean_sha256"]) == ("", b"", "") for k in "bcde")


def test_commands(spark, tmp_path):
    from linkforge.__main__ import main

    (tmp_path / "1.html").write_text("<a href='/x/7'>a</a><a href='/x/3'>b</a>")
    main(["list-pages", f"file://{tmp_path}/{{page}}.html", "/x/", "--pages", "1", "--out", f"{tmp_path}/ids"])
    assert sorted(r["record_id"] for r in spark.read.csv(f"{tmp_path}/ids", header=True).collect()) == ["3", "7"]
    (tmp_path / "pictures").mkdir()
    (tmp_path / "pictures" / "r1.jpg").write_bytes(b"\xff\xd8" + segment(0xFE, b"note") + segment(0xDA, b"\1") + b"\x12\xff\xd9")
    main(["clean-images", f"{tmp_path}/pictures", "--out", f"{tmp_path}/clean"])
    assert [(r["record_id"], bytes(r["content"])) for r in spark.read.parquet(f"{tmp_path}/clean").collect()] == [("r1", b"\xff\xd8" + segment(0xDA, b"\1") + b"\x12\xff\xd9")]
