"""Operators 2 and 8 on records that break things."""

import gzip
import hashlib

import pyarrow.fs

from costdocs.llm import perspectives, revisits
from costdocs.llm.common import staged
from costdocs.sources.scratch import scratch_path

BIG, OTHER = "ä" * 600, "<p>\r\n\r\nWARC/1.1\r\n" * 100
PAGES = [
    (1, "u1", BIG), (9, "u9\r\nX: y", BIG), (4, None, BIG), (None, "n", BIG), (5, "u5", OTHER), (6, "u6", OTHER),
    (7, "u7", "x" * 999), (8, "u8", "x" * 999), (10, "u10", None), (11, "u11", ""), (12, "u12", "y" * 1000), (13, "u13", "z" * 3_000_000),
    (20, "a", "t" * 2000), (20, "a", "t" * 2000), (19, "b", "t" * 2000), (None, "c", "q" * 1500), (None, "d", "q" * 1500),
]
SCHEMA = "page_id long, url string, html string, payload string, target string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", "t", "f") for r in rows], SCHEMA)


def test_records_and_references(spark):
    found = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in revisits.deduplicated(spark, pages(spark, PAGES)).collect())
    wanted = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        last = max((j for j, _, h in PAGES if h == html and j is not None), default=None)
        revisit = len(raw) >= 1000 and last != i
        wanted.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(last if revisit else None)))
    assert found == sorted(wanted)


def test_archives_are_plain_warc(spark):
    rows = pages(spark, PAGES)
    path = scratch_path(spark, "test-warc")
    first = staged(revisits.originals(revisits.payload_headers(rows)), "test-originals")
    archives = revisits.write_archives(revisits.resolved(rows, first), path, archive_bytes=3000).collect()
    assert sum(a.records for a in archives) == len(PAGES)
    fs, folder = pyarrow.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    payloads = 0
    for a in archives:
        with fs.open_input_stream(f"{folder}/{a.file}", compression=None) as file:
            raw = gzip.decompress(file.read())
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: re") and raw.endswith(b"\r\n\r\n")
        assert b"\r\nX: y" not in raw
        payloads += raw.count(BIG.encode())
    assert payloads == 1


def test_no_pages(spark):
    assert revisits.deduplicated(spark, pages(spark, [])).collect() == []


TALK = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|> there"), (1, 2, "bob", None), (1, 3, " ", "who"), (1, None, "ann", "late"),
    (1, 3, None, "me"), (2, 1, "system", "alone"), (None, 1, "ann", "x"), (3, 1, "ann", "same"), (3, 1, "ann", "same"), (3, 2, "bob", "y " * 5000),
]


def talk(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "conv_id long, turn long, role string, text string, segment string, part string, perspective string")


def test_every_speaker_has_a_view(spark):
    rows = perspectives.views(talk(spark, TALK)).collect()
    views = {}
    for r in rows:
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann"), (3, "bob")}
    for (conv, who), segments in views.items():
        segments.sort(key=lambda r: r.position)
        assert [r.position for r in segments] == list(range(len([t for t in TALK if t[0] == conv])))
        turns = [(r.turn is None, r.turn) for r in segments]
        assert turns == sorted(turns)
        text = "".join(r.segment for r in segments)
        for r in segments:
            assert text[r.char_start : r.char_end] == r.segment and r.segment.count("<|end|>") == 1
            assert r.role == ("assistant" if r.speaker == who else "system" if r.speaker == "system" else "user")
            if r.role == "assistant":
                assert r.segment == "<|assistant|>\n" + text[r.loss_start : r.loss_end] + "\n" and text[r.loss_start : r.loss_end].endswith("<|end|>")
            else:
                assert r.loss_start is None and r.loss_end is None
    assert views[1, "bob"][1].segment == "<|user name=ann|>\nhi < |end| > there<|end|>\n"


def test_dialogues_are_whole(spark):
    segments = staged(perspectives.views(talk(spark, TALK)), "test-views")
    for per_part in (2, 256):
        texts = {}
        for r in sorted(perspectives.dialogues(segments, per_part).collect(), key=lambda r: r.part):
            assert r.char_start == len(texts.get((r.conv_id, r.perspective), ""))
            texts[r.conv_id, r.perspective] = texts.get((r.conv_id, r.perspective), "") + r.text
        assert texts[3, "ann"] == "<|assistant|>\nsame<|end|>\n" * 2 + "<|user name=bob|>\n" + "y " * 5000 + "<|end|>\n"
    assert perspectives.views(talk(spark, [])).collect() == []
