import hashlib
import base64
import io

import pytest

from lodestar.llm import warc
from lodestar.llm.common import shared_dir


def expected(rows, min_bytes=0):
    last = {}
    for k, _, p in rows:
        last[p or b""] = max(k, last.get(p or b"", k))
    out = []
    for k, u, p in rows:
        p = p or b""
        to = last[p] if last[p] != k and len(p) >= min_bytes else None
        out.append((k, u and " ".join(u.split()), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


ROWS = [(1, "http://a", b"x"), (2, "http://b", b"x"), (3, None, None), (4, "u", b""), (5, "u\r\nInjected: y", b"\r\n\r\nWARC/1.1\r\n\x00\xff"), (6, "big", b"z" * 700_000), (7, "big", b"z" * 700_000), (8, "same", b"q"), (8, "same", b"q"), (9, "s", b"\xe2\x82")]
COLUMNS = ["key", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("min_bytes", [0, 1, 100])
def test_round_trip(spark, tmp_path, min_bytes):
    records = spark.createDataFrame(ROWS, "key long, uri string, payload binary").repartition(3)
    folder = f"file://{tmp_path}/w"
    index = warc.write(records, folder, min_bytes, frame_bytes=100)
    got = warc.read(index, folder)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == expected(ROWS, min_bytes)
    ids = [r["record_id"] for r in got.collect()]
    assert len(set(ids)) == len(ids) and {r["record_id"] for r in index.collect()} == set(ids)
    kept = {r["key"]: bytes(r["payload"]) for r in got.where("record_type = 'response'").collect()}
    assert all(kept[k] == (p or b"") for k, _, p in ROWS if k in kept)
    one = warc.read(index.where("key = 6"), folder).collect()
    assert len(one) == 1 and not [p for p in (tmp_path / "w").iterdir() if p.suffix == ".part"]


def test_empty_and_null_key(spark, tmp_path):
    records = spark.createDataFrame(ROWS, "key long, uri string, payload binary")
    assert warc.read(warc.write(records.limit(0), f"file://{tmp_path}/a"), f"file://{tmp_path}/a").count() == 0
    nameless = spark.createDataFrame([(None, "u", b"x"), (None, "u", b"x"), (1, "v", b"x")], "key long, uri string, payload binary")
    got = warc.read(warc.write(nameless, f"file://{tmp_path}/b"), f"file://{tmp_path}/b").collect()
    assert sorted((repr(r["key"]), r["record_type"], r["payload_bytes"]) for r in got) == [("1", "response", 1), ("None", "response", 1), ("None", "response", 1)]


def test_bundle_is_plain_zstandard(tmp_path):
    """Any decompressor reads the frames one after another; the footer is skipped."""
    import zstandard
    from pyarrow import fs

    records = [warc.render_record(k, u, p or b"", None) for k, u, p in ROWS]
    out = io.BytesIO()
    bundle = warc.BundleWriter(out, 50)
    places = [bundle.add(r) for r in records]
    bundle.close()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(records)
    (tmp_path / "b").write_bytes(out.getvalue())
    reader = warc.BundleReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "b")))
    for (frame, offset), record in zip(places, records):
        assert reader.frame(frame)[offset : offset + len(record)] == record


def test_damage_is_noticed(spark, tmp_path):
    record = warc.render_record(1, None, b"abc", None)
    with pytest.raises(ValueError):
        warc.parse_record(record[:-8])


def test_query(spark, sf_dir):
    pages = [(r["page_id"], r["url"], None if r["html"] is None else r["html"].encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = warc.op2_warc(spark, sf_dir).collect()
    names = ["page_id", "uri", *COLUMNS[2:]]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == expected(pages)
    assert shared_dir(spark)
