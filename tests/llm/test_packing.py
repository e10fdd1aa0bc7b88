import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import packing
from lodestar.llm.common import cut

from . import cases


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(rows):
    out, t = [], tokenizer()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k in range(-(-len(ids) // 1024)):
            size = 1024 if k else len(ids) % 1024 or 1024
            out.append((d, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at += size
    return sorted(out, key=repr)


def check(packed, rows):
    got = packed.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(rows)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by), sum(r["length"] for r in got)


def test_awkward_table(spark):
    check(packing.pack(cut(packing.pieces(cases.documents(spark)))), cases.TEXTS)
    assert packing.pack(cut(packing.pieces(cases.empty(spark)))).count() == 0


@given(st.lists(st.text(alphabet="ab \n\t é's1.", max_size=12) | st.sampled_from(["<|endoftext|>", " <|endoftext|>", "<|endoftext|"]), max_size=6).map("".join))
@settings(max_examples=300, deadline=None)
def test_chunks_encode_like_the_whole(text):
    assert np.frombuffer(packing.encoder(packing.default_vocabulary()).encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


TOKENIZER = tokenizer()


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece_once(histogram):
    used, bins = defaultdict(int), defaultdict(list)
    for s in packing.plan(histogram, 30):
        assert s.rank == used[s.length]
        used[s.length] += s.copies * s.times
        for b in range(s.first, s.first + s.times):
            bins[b] += [(s.offset + i * s.length, s.length) for i in range(s.copies)]
    assert used == histogram
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 30


def test_fullest_is_fullest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 40, 6)}
        chosen = packing._fullest(counts, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        assert sum(x * k for x, k in chosen.items()) == max(s for s in sums if s <= 60)
        assert all(k <= counts[x] for x, k in chosen.items())


@pytest.mark.parametrize("bucket_rows", [10, 1_000_000])
def test_query_is_near_the_bound(spark, sf_dir, bucket_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    bins, total = check(packing.pack(cut(packing.pieces(docs)), bucket_rows=bucket_rows), rows)
    assert bins <= -(-total // 1024) * 1.01 + 2


def test_ids_are_returned(spark):
    row = packing.pieces(cases.documents(spark, [(1, "a b")]), with_ids=True).first()
    assert zlib.crc32(row["ids"]) == row["ids_crc32"] and len(row["ids"]) == 4 * row["length"]


RUNS = [" ", "\n", "\t", "\t ", " \n", "\r\n", "\u3000", "\x85\u2028"]


@pytest.mark.parametrize("unit", RUNS)
@pytest.mark.parametrize("around", ["{}", "a{}b", "{} b.", "a b {}", "a{}<|endoftext|>{}b"])
def test_long_runs_encode_like_the_whole(unit, around):
    for n in (999, 1000, 1001, 20_000):
        text = around.replace("{}", (unit * n)[:n])
        assert np.frombuffer(packing.encoder(packing.default_vocabulary()).encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_very_long_runs_of_blanks(spark):
    rows = [(i, a + unit * (2_000_000 // len(unit)) + b) for i, (unit, a, b) in enumerate([(" ", "", ""), ("\n", "a", "b"), ("\t", "", "x"), ("\t ", "y ", " z")])]
    check(packing.pack(cut(packing.pieces(cases.documents(spark, rows)))), rows)
