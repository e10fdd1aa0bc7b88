"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max pruning.

Every passage of the corpus is a query. Test items, and their questions and answers each for itself, are cut into
chunks of at most CHUNK words; a chunk's BM25
impacts are divided by its score against itself, so one threshold serves all. Passages of 2 * CHUNK words step by
CHUNK, so a chunk that was copied stands whole in one of them.

Retrieval is block-max WAND. Per block of chunks the commonest terms that together stay below the threshold are set
aside; a block is a pivot of a passage only if the maxima of its other terms, with the most that those set aside can
add, reach the threshold. These bounds are taken over whole batches of texts. Then the cursors of all terms of a passage
skip from pivot to pivot over their sorted blocks, and the postings at a pivot are read only if the block maxima of all
terms there reach the threshold as well. No pair above it is lost. Retrieved items are then verified by overlap in word
n-grams: of the question for itself, of the answer for itself if it is half of the item or more, of both, or of a chunk
of CHUNK words.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import blocks, split
from .common import cut, table

CHUNK = 64
BLOCK = 8
K1, B = 1.2, 0.75
MIN_SCORE = 0.5
MIN_OVERLAP = 0.5
GRAM = 5
#: Bytes of item text in one index. Larger benchmarks take several indexes, applied one after another.
INDEX_BYTES = 16_000_000
#: Indexes that a worker holds at once.
PASS_INDEXES = 4
_MEMO_ENTRIES = 600_000
_EDGES = re.compile(r"^\W+|\W+$")

FOUND_SCHEMA = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"


def term(word: bytes) -> str:
    """A word in lower case without outer punctuation."""
    return _EDGES.sub("", word.decode("utf-8", "replace").lower())


def terms(text: str | None) -> list[str]:
    return [t for t in map(term, split(text)) if t]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's last line with a word is its answer if others precede it; else all is question."""
    filled = [t for t in map(terms, (text or "").split("\n")) if t]
    if len(filled) < 2:
        return (filled or [[]])[0], []
    return [t for line in filled[:-1] for t in line], filled[-1]


def overlap(part: list[str], grams: dict[int, set]) -> float:
    """Share of part's n-grams that stand in the text; a part of fewer than GRAM words is one gram."""
    n = min(GRAM, len(part))
    own = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} if part else set()
    return len(own & grams[n]) / len(own) if own else 1.0


def spans(n_question: int, n_answer: int) -> list[tuple[int, int]]:
    """The chunks of an item, as slices of its words: of the whole, of a question that has an n-gram, and of an answer
    that is half of the item or more. A shorter answer is never enough without words of the question."""
    size = n_question + n_answer
    parts = [(0, size)]
    if n_question >= GRAM:
        parts.append((0, n_question))
    if 2 * n_answer >= size:
        parts.append((n_question, size))
    return sorted({(a, min(a + CHUNK, end)) for start, end in parts for a in range(start, end, CHUNK)})


class Grams(dict):
    def __init__(self, ws: list[str]):
        self._ws = ws

    def __missing__(self, n: int) -> set:
        self[n] = found = {tuple(self._ws[i : i + n]) for i in range(len(self._ws) - n + 1)}
        return found


@dataclass
class Index:
    """vocabulary: term number of each term. scored: for each term the postings (chunk, impact). cursors: for each term
    its blocks in order, their maxima and their postings. starts: for each term the slice of (blocks, maxima) in which it
    is essential; rest: what a block's other terms add at most."""

    items: list[tuple[int, list[str], list[str]]]
    chunk_item: np.ndarray
    chunk_span: list[tuple[int, int]]
    vocabulary: dict[str, int]
    scored: list[dict[int, float]]
    cursors: list[tuple[list[int], list[float], list[list[tuple[int, float]]]]]
    starts: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    rest: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int, str | None]], document_counts: dict[str, int], n_items: int, mean_size: float, min_score: float = MIN_SCORE) -> Index:
        items = [(i, *question_and_answer(text)) for i, text in rows]
        at = [(k, span) for k, (_, q, a) in enumerate(items) for span in spans(len(q), len(a))]
        chunks = [(k, (items[k][1] + items[k][2])[a:b]) for k, (a, b) in at]
        vocabulary: dict[str, int] = {}
        scored: list[dict[int, float]] = []
        for c, (_, ws) in enumerate(chunks):
            counts = Counter(ws)
            norm = K1 * (1 - B + B * len(ws) / max(mean_size, 1))
            impact = {t: np.log1p((n_items - document_counts[t] + 0.5) / (document_counts[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in counts.items()}
            own = sum(impact.values()) or 1.0
            for t, x in impact.items():
                number = vocabulary.setdefault(t, len(scored))
                if number == len(scored):
                    scored.append({})
                scored[number][c] = float(x / own)
        n_blocks = -(-len(chunks) // BLOCK)
        rest = np.zeros(max(n_blocks, 1))
        essential: list[list[tuple[int, float]]] = [[] for _ in scored]
        by_block: list[dict[int, dict[int, float]]] = [{} for _ in range(n_blocks)]
        for number, postings in enumerate(scored):
            for c, x in postings.items():
                by_block[c // BLOCK].setdefault(number, {})[c] = x
        for b, found in enumerate(by_block):
            aside: Counter = Counter()
            for number in sorted(found, key=lambda t: (-len(scored[t]), t)):
                grown = aside + Counter(found[number])
                # half the threshold is left for the terms that stay, so that few of them alone open a block
                if max(grown.values()) >= min_score / 2:
                    essential[number].append((b, max(found[number].values())))
                else:
                    aside = grown
            rest[b] = max(aside.values(), default=0.0)
        flat = [x for e in essential for x in e]
        cursors = []
        for postings in scored:
            at_block: dict[int, list[tuple[int, float]]] = {}
            for c, x in sorted(postings.items()):
                at_block.setdefault(c // BLOCK, []).append((c, x))
            cursors.append((list(at_block), [max(x for _, x in ps) for ps in at_block.values()], list(at_block.values())))
        return Index(
            items, np.array([k for k, _ in chunks], np.int64), [span for _, span in at], vocabulary, scored,
            cursors,
            np.cumsum([0, *map(len, essential)]), np.array([b for b, _ in flat], np.int64), np.array([x for _, x in flat], float), rest,
        )


class _Numbers(dict):
    """Term numbers of words, -1 for words that no item has."""

    def __init__(self, vocabulary: dict[str, int]):
        self._vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self._vocabulary.get(term(word), -1)
        return found


class Searcher:
    """Retrieval and verification over one index; remembers the term numbers of words seen."""

    def __init__(self, index: Index, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP):
        self._index, self._least, self._overlap, self._memo = index, min_score - 1e-9, min_overlap, _Numbers(index.vocabulary)

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        if len(self._memo) > _MEMO_ENTRIES:
            self._memo.clear()
        return np.fromiter(map(self._memo.__getitem__, ws), np.int64, len(ws))

    def _pivots(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, block), in order, where the bound reaches the threshold, of texts with so many words each."""
        ix, none = self._index, np.empty(0, np.int64)
        first, n_passages = np.cumsum(sizes) - sizes, np.maximum(-(-sizes // CHUNK) - 1, 1)
        before = np.cumsum(n_passages) - n_passages
        at = np.flatnonzero(numbers >= 0)
        if not len(at) or not len(ix.blocks):
            return none, none, none
        t = numbers[at]
        held = ix.starts[t + 1] > ix.starts[t]
        at, t = at[held], t[held]
        owner = np.repeat(np.arange(len(sizes)), sizes)[at]
        half = (at - first[owner]) // CHUNK
        # a word of half-window h belongs to passages h - 1 and h
        p = before[owner] + np.concatenate([np.maximum(half - 1, 0), np.minimum(half, n_passages[owner] - 1)]).reshape(2, -1)
        pairs = np.unique((p * len(ix.scored) + t).ravel())
        p, t = pairs // len(ix.scored), pairs % len(ix.scored)
        counts = ix.starts[t + 1] - ix.starts[t]
        posting = np.repeat(ix.starts[t] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        cell, which = np.unique(np.repeat(p, counts) * len(ix.rest) + ix.blocks[posting], return_inverse=True)
        bound = np.bincount(which, ix.maxima[posting], len(cell)) + ix.rest[cell % len(ix.rest)]
        left = cell[bound >= self._least]
        p, block = left // len(ix.rest), left % len(ix.rest)
        text = np.searchsorted(before, p, "right") - 1
        return text, p - before[text], block

    def _wand(self, held: list[int], pivots: list[int]) -> Iterator[tuple[int, float]]:
        """(chunk, score) of the chunks in the pivots, in order, that reach the threshold against these terms."""
        cursors = [self._index.cursors[t] for t in held]
        places = [0] * len(held)
        for pivot in pivots:
            here, most = [], 0.0
            for k, (at, maxima, postings) in enumerate(cursors):
                i = places[k] = bisect_left(at, pivot, places[k])
                if i < len(at) and at[i] == pivot:
                    here.append(postings[i])
                    most += maxima[i]
            if most >= self._least:
                score: Counter = Counter()
                for chunk, x in chain.from_iterable(here):
                    score[chunk] += x
                yield from ((chunk, x) for chunk, x in score.items() if x >= self._least)

    def _retrieved(self, numbers: np.ndarray, passages: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, int, float]]:
        starts = np.flatnonzero(np.diff(passages, prepend=-1))
        for passage, own in zip(passages[starts].tolist(), np.split(pivots, starts[1:])):
            held = np.unique(numbers[passage * CHUNK : (passage + 2) * CHUNK])
            yield from ((passage, chunk, x) for chunk, x in self._wand(held[held >= 0].tolist(), own.tolist()))

    def passages(self, numbers: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, chunk, score) for all of one text that reach the threshold."""
        _, passage, block = self._pivots(numbers, np.array([len(numbers)]))
        return self._retrieved(numbers, passage, block)

    def _holds_chunk(self, item: int, chunks: set[int], grams: Grams) -> bool:
        """Whether one of the item's chunks of CHUNK words is verified for itself: a long passage of a longer item."""
        full = [(a, b) for a, b in (self._index.chunk_span[c] for c in chunks) if b - a == CHUNK]
        if not full:
            return False
        words = self._index.items[item][1] + self._index.items[item][2]
        return any(overlap(words[a:b], grams) >= self._overlap for a, b in full)

    def find(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """(item_id, passage start in words, score, question overlap, answer overlap), each item once."""
        return dict(self.find_all([text])).get(0, [])

    def find_all(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, float, float, float]]]]:
        """(number of the text, what find gives) of each text with a passage that the bound leaves."""
        for a, b in blocks([len(t or "") // 5 for t in texts]):
            words = [split(t) for t in texts[a:b]]
            sizes = np.array([len(ws) for ws in words])
            numbers, ends = self.numbers([w for ws in words for w in ws]), np.cumsum(sizes)
            text, passage, block = self._pivots(numbers, sizes)
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            for k, s, e in zip(text[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(text)]):
                own = numbers[ends[k] - sizes[k] : ends[k]]
                yield a + k, self._verified(words[k], self._retrieved(own, passage[s:e], block[s:e]))

    def _verified(self, ws: list[bytes], retrieved: Iterator[tuple[int, int, float]]) -> list[tuple[int, int, float, float, float]]:
        ix = self._index
        best: dict[int, tuple[tuple[float, int], float, int]] = {}
        held: dict[int, tuple[int, int, set[int]]] = {}
        for passage, chunk, score in retrieved:
            item, (a, b) = int(ix.chunk_item[chunk]), ix.chunk_span[chunk]
            rank = (round(score, 9), b - a)  # of equal scores that of the longer chunk
            if item not in best or rank > best[item][0]:
                best[item] = rank, score, passage
            low, high, chunks = held.get(item, (passage, passage, set()))
            held[item] = min(low, passage), max(high, passage), chunks | {chunk}
        found = []
        for item, (_, score, at) in sorted(best.items()):
            number, question, answer = ix.items[item]
            low, high, chunks = held[item]
            size = len(question) + len(answer)
            around = ws[max(0, low * CHUNK - size) : (high + 2) * CHUNK + size]
            grams = Grams([t for t in map(term, around) if t])
            q, a = overlap(question, grams), overlap(answer, grams)
            asked, answered = q >= self._overlap, a >= self._overlap
            alone = asked and len(question) >= GRAM or answered and len(answer) >= GRAM and 2 * len(answer) >= size
            if alone or asked and answered or self._holds_chunk(item, chunks, grams):
                found.append((number, at * CHUNK, score, q, a))
        return found


def _term_counts(rows: DataFrame) -> DataFrame:
    """shard, term, n: how many items of a shard have the term. The term of a line break tells the words of a shard's items,
    that of two the items with a word; no other term holds one."""

    def counted(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            n: Counter = Counter()
            for shard, text in zip(pdf["shard"], pdf["text"]):
                ws = terms(text)
                if ws:
                    n.update({**dict.fromkeys(((shard, w) for w in ws), 1), (shard, "\n"): len(ws), (shard, "\n\n"): 1})
            yield pd.DataFrame([(*key, k) for key, k in n.items()], columns=["shard", "term", "n"]).astype({"shard": "int32", "term": object, "n": "int64"})

    return rows.mapInPandas(counted, "shard int, term string, n long").groupBy("shard", "term").agg(F.sum("n").alias("n"))


def build_indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """shard, data: the indexes over items(item_id, text), each built by a task from at most about index_bytes of item text,
    in a written table. Counts of terms are those over all items. Items without a word are in none. The items are read
    once and their terms counted once, whatever the number of shards."""
    spark = items.sparkSession
    rows = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-total // index_bytes), 1)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    by_shard = cut(_term_counts(dealt))
    sizes = {r["term"]: r["n"] for r in by_shard.where(F.col("term").isin("\n", "\n\n")).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "shard int, data binary")
    n_items, mean = sizes["\n\n"], sizes["\n"] / sizes["\n\n"]
    over_all = by_shard.groupBy("term").agg(F.sum("n").alias("n"))
    needed = by_shard.select("shard", "term").join(over_all, "term")

    def build(own, known):
        import pandas as pd

        if not len(known):
            return pd.DataFrame({"shard": pd.Series(dtype="int32"), "data": pd.Series(dtype=object)})
        listed = [(None if i is None else int(i), text) for i, text in zip(own["item_id"], own["text"])]
        made = Index.build(listed, dict(zip(known["term"], known["n"].tolist())), n_items, mean)
        return pd.DataFrame({"shard": [int(known["shard"].iloc[0])], "data": [pickle.dumps(made, pickle.HIGHEST_PROTOCOL)]})

    # both sides of a group are bounded by the shard's text
    named = dealt.withColumn("item_id", F.col("item_id").cast("string"))  # pandas has no whole numbers beside nulls
    return cut(named.groupBy("shard").cogroup(needed.groupBy("shard")).applyInPandas(build, "shard int, data binary"))


def _passes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[tuple[list, bool]]:
    """(broadcast indexes that one pass over the texts applies together, whether more follow). The driver holds those of
    one pass at a time."""
    built = build_indexes(items, index_bytes)
    shards = sorted(r[0] for r in built.select("shard").collect())
    context = items.sparkSession.sparkContext
    for at in range(0, len(shards), PASS_INDEXES):
        rows = built.where(F.col("shard").isin(shards[at : at + PASS_INDEXES])).orderBy("shard").collect()  # PASS_INDEXES of them
        yield [context.broadcast(pickle.loads(r["data"])) for r in rows], at + PASS_INDEXES < len(shards)


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator:
    """The broadcast indexes one after the other."""
    for group, _ in _passes(items, index_bytes):
        yield from group


def _applied(made: DataFrame, group: list, more: bool) -> DataFrame:
    """made, whose tasks read the group's indexes: from a written table if more follow, and the group is then given up."""
    if not more:
        return made
    written = cut(made)
    for index in group:
        index.destroy()
    return written


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks (FOUND_SCHEMA): one row per document row and item that it holds, with the best passage.

    All passages of all texts are queried. A null or empty text holds nothing; repeated rows repeat their leaks;
    items with equal texts are all reported; null ids stay null; other columns are ignored."""
    parts = []
    for group, more in _passes(items):

        def run(batches: Iterator, group=group) -> Iterator:
            import pyarrow as pa

            searchers = [Searcher(index.value) for index in group]
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(ids[k], *x) for searcher in searchers for k, found in searcher.find_all(texts) for x in found]
                if rows:
                    kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FOUND_SCHEMA.split(", ")])

        parts.append(_applied(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND_SCHEMA), group, more))
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], FOUND_SCHEMA)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; no shuffle, the columns of docs. Null and empty texts stay, repeated
    rows stay or go together."""
    kept = docs
    for group, more in _passes(items):

        def run(batches: Iterator, group=group) -> Iterator:
            import pyarrow as pa

            searchers = [Searcher(index.value) for index in group]
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                clean = np.ones(len(texts), bool)
                for searcher in searchers:
                    clean[[k for k, found in searcher.find_all(texts) if found]] = False
                yield batch.filter(pa.array(clean))

        kept = _applied(kept.mapInArrow(run, docs.schema), group, more)
    return kept


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds; cases as in find."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
