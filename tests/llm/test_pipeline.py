"""The pipeline against plain Python over the whole small table."""

import re

import corpus_pipeline
from lodestar.llm import quality
from lodestar.llm.common import cut
from lodestar.llm.quality import BOILERPLATE, SYMBOLS

from . import cases
from .test_decontaminate import holds
from .test_native import plain_lines
from .test_packing import expected as pieces


def fails(line):
    chars = len("".join(cases.words(line)))
    symbols = sum(c in SYMBOLS for c in line)
    shouted = line == line.upper() and sum("A" <= c <= "Z" for c in line) >= 12
    unended = line.count(" ") >= 11 and not re.search(r"[.!?…][\"'”’»)\]]*([\x20\x09-\x0D]|$)", line)
    return sum(c in "|»" for c in line) >= 3 or 100 * symbols > 10 * chars or shouted or unended or any(b in line.lower() for b in BOILERPLATE)


def plain_quality(text):
    """The text left, or None for a document that goes."""
    ws = cases.words(text)
    grams = {}
    for i in range(len(ws) - 2):
        grams.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    if len(ws) < 50 or 100 * len(covered) > 50 * len(ws):
        return None
    parts = text.split("\n")
    bad = [bool(cases.words(x)) and fails(x) for x in parts]
    lost = sum(len("".join(cases.words(x))) for x, b in zip(parts, bad) if b)
    if 100 * lost > 50 * len("".join(ws)):
        return None
    return "\n".join(x for x, b in zip(parts, bad) if not b)


def plain_pipeline(rows, sites, items):
    kept = [(d, plain_quality(t), s) for (d, t), s in zip(rows, sites)]
    kept = [(d, t, s) for d, t, s in kept if t is not None]
    cleaned = [(d, t) for d, _, _, t in plain_lines([(d, t) for d, t, _ in kept], [s for _, _, s in kept], 10)]
    alone = [(d, t) for (d, t), (_, c) in zip(cleaned, cases.components(cleaned)) if c == d]
    return pieces([(d, t) for d, t in alone if not any(holds(t, i) for i in items)])


def test_pipeline(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    want = plain_pipeline([(d, t) for d, t, _ in docs], [s for *_, s in docs], items)
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_keep_columns(spark, sf_dir):
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]


def test_very_long_runs_of_blanks(spark, sf_dir):
    said = lambda k: " ".join(f"word{i}of{k}" for i in range(60)) + "."
    rows = [(k, said(k) + unit * (2_000_000 // len(unit)) + said(k + 10)) for k, unit in enumerate([" ", "\n", "\t", "\t "])]
    docs = cases.documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    got = docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(pieces(rows))


def test_empty_table(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), sf_dir).count() == 0
    assert quality.clean(cases.empty(spark)).count() == 0
