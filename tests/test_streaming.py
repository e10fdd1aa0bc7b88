import json
import random

import pytest

from lodestar.operators.embed import HashingEmbedder
from lodestar.operators.store import Store
from lodestar.schema import METADATA
from lodestar.sources.snapshot import scan_snapshot
from lodestar.streaming.changes import follow_changes, newest_records


def record(id_, version, title="t", date="2024-01-01", doi=None, categories="math.CO"):
    return {"id": id_, "versions": [{"version": version}] if version else [], "title": title, "abstract": f"of {id_}", "categories": categories, "update_date": date, "doi": doi}


FILES = {
    "a": [record("1", "v1"), record("2", "v1"), record("3", "v2", title="newer")],
    "b": [record("1", "v2", title="second"), record("3", "v1", title="older"), record("4", None)],
    "c": [record("1", "v10", title="tenth"), record("2", "v1", doi="d"), record("2", "v1", doi="e", date="2024-02-02"), record("x", "v1", categories="cs.X")],
    "a again": [record("1", "v1"), record("2", "v1"), record("3", "v2", title="newer")],
}


def content(papers):
    return sorted((r["id"], *(r[c] for c in METADATA)) for r in papers.collect())


@pytest.fixture(scope="module")
def at_once(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("all")
    for name, rows in FILES.items():
        (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    return content(newest_records(scan_snapshot(spark, str(folder))))


@pytest.mark.parametrize("order", [["a", "b", "c", "a again"], ["c", "a again", "b", "a"]])
def test_any_order_ends_like_one_batch(spark, tmp_path, at_once, order):
    store, folder, passed = Store(spark, f"file://{tmp_path}/index", "hashing", 8), tmp_path / "in", []
    folder.mkdir()
    upsert = store.upsert
    store.upsert = lambda batch: passed.extend(r["id"] for r in batch.collect()) or upsert(batch)
    for name in order:  # each file comes to a stream that is started anew
        (folder / f"{name}.json").write_text("\n".join(map(json.dumps, FILES[name])))
        query = follow_changes(store, str(folder), str(tmp_path / "checkpoint"), HashingEmbedder(8)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert content(store.papers()) == at_once and {r["id"] for r in store.papers().collect()} == {"1", "2", "3", "4"}
    assert store.status()["pending"] == 0
    if order[0] == "a":
        assert passed.count("3") == 1 and passed.count("1") == 3  # replays and older versions are stopped


def test_newest_record_of_a_batch_hangs_on_no_order(spark):
    rows = [(str(i % 7), f"v{i % 13}" if i % 5 else None, f"t{i % 3}", "a", None, "math.CO", None if i % 11 == 0 else f"2024-01-{i % 28 + 1:02d}", None, None) for i in range(120)]
    schema = "id string, " + ", ".join(f"{c} string" for c in METADATA)
    first = content(newest_records(spark.createDataFrame(rows, schema)))
    random.Random(1).shuffle(rows)
    assert content(newest_records(spark.createDataFrame(rows + rows[:30], schema).repartition(5))) == first and len(first) == 7
