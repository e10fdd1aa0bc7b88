"""N-gram Jaccard join with token-combination prefixes.

A text's tokens are its distinct word 5-gram hashes. In an order that puts rare tokens first, two similar sets share
enough of their first tokens; how many depends on their sizes alone. Rare tokens are indexed singly. Frequent tokens,
by exact counts of all that a prefix can hold, fall into classes by hash; of a class only combinations of two tokens are indexed, and the
prefix is longer by one token for each class met, so that a similar pair always shares a key.

Posting lists are never expanded into all pairs. A first sweep pairs each set with the next ones of its list, in an
order that is another one in each list, and verifies those pairs on the full sets: a row or two per posting, which
joins nearly all that belongs together. Lists that then still hold several components are closed exactly: their sets
gather at the largest component of the list, once each and not once a key, and there those that are not of it are
compared with all others by bitmaps, in blocks. What bitmaps cannot rule out is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitfilter
from .common import cut, drop_cut, table
from .hashing import blocks, mix, window_hashes, word_hashes

SHINGLE = 5
#: A token that more prefixes than this can hold is frequent. The bound doubles until so many tokens are at most.
MIN_FREQUENT = 32
MAX_FREQUENT = 1 << 24
#: Tokens of a frequent class that a prefix is expected to hold.
CLASS_TOKENS = 4
#: Lists of keys of frequent tokens are swept in so many parts; what is apart meets when lists are closed.
SALTS = 16
#: Lists up to this length give all their pairs at once.
SHORT_LIST = 6
#: In longer lists each set is paired with so many that follow it.
NEIGHBOURS = 2
#: Copies of one set beyond this many (or a 100,000th of the rows) are left out of the index but for one.
MANY_COPIES = 16
MAX_HOT_SETS = 100_000
#: Sets of a block when lists are closed. A component takes a task for each two of its blocks.
BLOCK_SETS = 4_096
#: Bits of a bitmap for each token, at least.
TOKEN_BITS = 8

_COMBINE, _CLASS = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles; of fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(SHINGLE, len(words))) + np.uint64(min(SHINGLE, len(words))))


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for a, b in blocks([len(t or "") // 5 for t in texts]):
        flat, counts = word_hashes(texts[a:b], lower=True)
        for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
            yield shingles(flat[end - n : end])


def _set_id(s: np.ndarray) -> int:
    """A 64-bit sum that names a set."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """A set's tokens as bits at their lowest bits; the number of bits is a power of two, 64 at least."""
    size = max(64, 1 << (TOKEN_BITS * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as so few words would have given them."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def may_be_similar(x: np.ndarray, n: int, maps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the bitmaps may belong to sets that have a similarity of 0.8 with the set of size n and bitmap x: a bit
    of one alone is at least one token of it alone, so none is ruled out wrongly."""
    width = min(len(x), maps.shape[1])
    x, maps = _folded(x[None], width), _folded(maps, width)
    most = np.minimum(n - np.bitwise_count(x & ~maps).sum(1, dtype=np.int64), sizes - np.bitwise_count(maps & ~x).sum(1, dtype=np.int64))
    return 180 * most >= 80 * (n + sizes)


def allowed_misses(n: int) -> int:
    """Tokens that a set of n may lack in a partner of similarity 0.8: n less the least overlap."""
    return n - (4 * n + 4) // 5


def bands() -> list[int]:
    """Lower ends of size bands: similar sets lie in the same band or in neighbouring ones."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * 5 // 4 + 1)
    return ends


_BANDS = np.array(bands(), np.int64)


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of single rare tokens, keys of combinations) of a set, frequent saying which tokens are.

    For a pair of similar sets a key is common: of either prefix at most allowed_misses tokens are missing in the
    other set, and a prefix ends only when so many tokens, less one for each frequent class in it, exceed that. So a
    rare token or two tokens of a class are shared; the prefixes' order is the same, so both prefixes hold them."""
    n = len(tokens)
    if n < 2:
        return tokens[:0], tokens[:0]  # such a set has only itself as partner
    misses = allowed_misses(n)
    order = np.lexsort((tokens, frequent))
    tokens, frequent = tokens[order], frequent[order]
    rare = int(n - np.count_nonzero(frequent))
    if rare > misses:
        return tokens[: misses + 1], tokens[:0]
    band = int(np.searchsorted(_BANDS, n, "right")) - 1
    rest, found = tokens[rare:], []
    for scheme in (band, band + 1):
        # the number of classes hangs on the scheme alone; both sets of a pair have one scheme in common
        classes = max(1, allowed_misses(int(_BANDS[max(scheme - 1, 0)])) // (CLASS_TOKENS - 1))
        own = (mix(rest + _CLASS) % np.uint64(classes)).astype(np.int64)
        met: dict[int, list[int]] = {}
        left = rare
        for k, c in enumerate(own.tolist()):
            members = met.setdefault(c, [])
            left += bool(members)
            members.append(k)
            if left > misses:
                break
        for c, members in met.items():
            for a, b in combinations(members, 2):
                found.append((rest[a], rest[b], scheme * 1_000_003 + c))
    if not found:
        return tokens[:rare], tokens[:0]
    a, b, c = (np.array(x, np.uint64) for x in zip(*found))
    return tokens[:rare], mix(mix(a + c * _COMBINE) * _COMBINE + b)


def _measure(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n, a and bits (the set's size, name and bitmap) of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(len(s), _set_id(s), bitmap(s)) for s in _sets(batch.column(1).to_pylist())]
            n, a, bits = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "h", "n", "a", "bits"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return cut(slim.mapInArrow(run, "doc_id long, h long, n long, a long, bits binary"))


def _zone(n: int) -> int:
    """Tokens, in the order of their hashes, among which a prefix without frequent tokens lies, and some more."""
    return min(n, (allowed_misses(n) + 1) * 5 // 4 + 2)


def _token_counts(docs: DataFrame, hot, known=None) -> DataFrame:
    """token, n: sets that hold the token among the first of their zone. With the tokens known to be frequent: among
    the rest, of the sets whose zone has too few others for a prefix."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held, size = [], 0
            for doc, s in zip(batch.column(0).to_pylist(), _sets(batch.column(1).to_pylist())):
                if len(s) < 2 or hot.value.get(_set_id(s), doc) != doc:
                    continue
                zone = _zone(len(s))
                if known is None:
                    part = s[:zone]
                elif zone - np.count_nonzero(bitfilter.has(known.value, s[:zone])) <= allowed_misses(len(s)):
                    part = s[zone:]
                else:
                    continue
                held.append(part)
                size += len(part)
                if size > 500_000:
                    yield counted(held)
                    held, size = [], 0
            if size:
                yield counted(held)

    def counted(parts):
        import pyarrow as pa

        tokens, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _frequent(docs: DataFrame, hot):
    """Broadcast filter of the frequent tokens. Zones are counted first; sets that consist of frequent tokens then have
    their other tokens counted as well, so that lists of single tokens stay short."""
    context = docs.sparkSession.sparkContext

    def heavy(counts: DataFrame) -> DataFrame:
        many, bound = cut(counts.where(F.col("n") > MIN_FREQUENT)), MIN_FREQUENT
        while many.where(F.col("n") > bound).count() > MAX_FREQUENT:
            bound *= 2
        return many.where(F.col("n") > bound).select("token")

    def filter_of(tokens: DataFrame):
        return context.broadcast(bitfilter.build(tokens, "token", bitfilter.bits_for(tokens.count())))

    first = heavy(_token_counts(docs, hot))
    return filter_of(first.union(heavy(_token_counts(docs, hot, filter_of(first)))))


def _hot_sets(sets: DataFrame, n_rows: int) -> dict[int, int]:
    """Name and first document of the sets with very many copies; at most MAX_HOT_SETS by the bound."""
    bound = max(MANY_COPIES, n_rows // MAX_HOT_SETS)
    many = sets.groupBy("a").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where(F.col("copies") > bound)
    return {r["a"]: r["first"] for r in many.select("a", "first").collect() if r["first"] is not None}


_POSTINGS = "key long, a long, n long, salt int"


def _postings(docs: DataFrame, frequent, hot) -> DataFrame:
    """One row for each key of each text: key, a and n of its set, salt (0 for single tokens)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, salts, sizes, names, lengths, held = [], [], [], [], [], 0
            ids = batch.column(0).to_pylist()

            def out():
                a, n = np.repeat(np.array(names, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(a), pa.array(n), pa.array(np.concatenate(salts), pa.int32())], names=["key", "a", "n", "salt"])

            for doc, s in zip(ids, _sets(batch.column(1).to_pylist())):
                if len(s) < 2:
                    continue
                name = _set_id(s)
                if hot.value.get(name, doc) != doc:
                    continue
                single, combined = prefix_keys(s, bitfilter.has(frequent.value, s))
                keys += [single, combined]
                salts += [np.zeros(len(single), np.int32), np.full(len(combined), 1 + name % SALTS, np.int32)]
                lengths.append(len(single) + len(combined))
                names.append(name)
                sizes.append(len(s))
                held += lengths[-1]
                if held > 500_000:
                    yield out()
                    keys, salts, sizes, names, lengths, held = [], [], [], [], [], 0
            if lengths:
                yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POSTINGS)


_SWEPT = "key long, a long, b long, n long"


def _near(n, m):
    """Whether sizes alone allow a similarity of 0.8."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _sweep(batches: Iterator) -> Iterator:
    """From postings sorted by (key, salt, an order of the list's own, a): candidate pairs (a < b, key null), and the
    members (b null) of salted lists and of those too long for all their pairs.

    A list goes by; of one that goes on at most SHORT_LIST rows are held: all while it is short, then the last ones."""
    import pyarrow as pa

    held = [np.empty(0, np.int64)] * 5  # key, salt, a, n, place in the list
    for batch in batches:
        old = len(held[0])
        key, salt, a, n = (np.r_[h, batch.column(c).to_numpy().astype(np.int64)] for h, c in zip(held, ("key", "salt", "a", "n")))
        if len(key) == old:
            continue
        again = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1]) & (a[1:] == a[:-1])
        fresh = np.r_[True, ~again]
        key, salt, a, n = (x[fresh] for x in (key, salt, a, n))
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        list_, place = np.repeat(np.arange(len(starts)), sizes), np.arange(len(key)) - np.repeat(starts, sizes)
        if old:
            place[: sizes[0]] += held[4][0]
        lefts, rights = [], []
        for d in range(1, SHORT_LIST):
            i = np.arange(max(old - d, 0), len(key) - d)
            j = i + d
            met = (list_[i] == list_[j]) & _near(n[i], n[j]) & ((d <= NEIGHBOURS) | (place[j] < SHORT_LIST))
            lefts.append(a[i[met]]), rights.append(a[j[met]])
        x, y = np.concatenate(lefts), np.concatenate(rights)
        long_ = (place[starts + sizes - 1] >= SHORT_LIST)[list_]
        new = np.arange(len(key)) >= old
        member = np.where(salt > 0, new, long_ & (new | (place < SHORT_LIST)))
        last = np.arange(starts[-1], len(key))
        if place[-1] >= SHORT_LIST:
            last = last[-NEIGHBOURS:]
        held = [v[last] for v in (key, salt, a, n, place)]
        m, k = int(member.sum()), len(x)
        if m + k:
            null = lambda v, pair: pa.array(v, mask=np.r_[np.full(k, pair), np.full(m, not pair)])
            zeros = np.zeros(k, np.int64)
            yield pa.RecordBatch.from_arrays(
                [null(np.r_[zeros, key[member]], True), pa.array(np.r_[np.minimum(x, y), a[member]]), null(np.r_[np.maximum(x, y), a[member]], False), null(np.r_[zeros, n[member]], True)],
                names=["key", "a", "b", "n"],
            )


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, tokens (binary) of the sets in wanted(a, first), from the first document of each."""
    hashed = wanted.select(F.xxhash64("first").alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(bitfilter.build(hashed, "h", bitfilter.bits_for(wanted.count())))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            part = batch.filter(pa.array(bitfilter.has(shared.value, batch.column(2).to_numpy().view(np.uint64))))
            if not len(part):
                continue
            rows = [(_set_id(s), s.tobytes()) for s in _sets(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary())))], names=["doc_id", "a", "tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("doc_id"))
    made = docs.mapInArrow(run, "doc_id long, a long, tokens binary")
    return cut(made.join(wanted, (made["a"] == wanted["a"]) & made["doc_id"].eqNullSafe(wanted["first"]), "left_semi").dropDuplicates(["a"]).drop("doc_id"))


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sets' bitmaps do not rule out."""
    left, right = sets.select("a", "bits", "n").toDF("a", "x", "nx"), sets.select("a", "bits", "n").toDF("b", "y", "ny")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y"))
            nx, ny = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
            keep = [bool(may_be_similar(p, nx[i], q[None], ny[i : i + 1])[0]) for i, (p, q) in enumerate(zip(x, y))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "nx", "ny")
    return joined.mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), from a written table, whose sets have a similarity of 0.8 or more. Only their sets are made again."""
    named = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).distinct()
    arrays = _arrays(docs, cut(sets.join(named, "a", "left_semi").select("a", "first")))
    left, right = arrays.toDF("a", "x"), arrays.toDF("b", "y")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, long = (p, q) if len(p) < len(q) else (q, p)
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                keep.append(100 * both >= 80 * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").select("a", "b", "x").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of links(a, b), by alternating large and small stars.

    Each round is two aggregations with map-side merging and two joins; edges stay in a written table."""

    def toward(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(toward(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = toward(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        grown = cut(small)
        drop_cut(links)
        links = grown
        shape = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if shape == print_before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        print_before = shape


def _extend(labels: DataFrame, verified: DataFrame) -> DataFrame:
    """labels after joining the components of each verified pair (a, b, with la and lb)."""
    merged = cut(components(verified.select(F.col("la").alias("a"), F.col("lb").alias("b"))))
    lone = verified.select(F.col("a").alias("node"), F.col("la").alias("label")).union(verified.select(F.col("b").alias("node"), F.col("lb").alias("label"))).distinct()
    every = labels.union(lone.join(labels, "node", "left_anti"))
    moved = every.join(merged.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(moved)


def _gathered(members: DataFrame, labels: DataFrame) -> DataFrame:
    """home, a, l (component of a), each once: the sets of lists that hold several components, at the largest one of
    their list (by sets, then by name). Two sets of one list have a home in common."""
    sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label").select(F.col("node").alias("a"), F.col("label").alias("l"), "size")
    placed = cut(members.join(sized, "a", "left").select("key", "a", F.coalesce("l", "a").alias("l"), F.coalesce("size", F.lit(1)).alias("size")))
    homes = placed.groupBy("key").agg(F.min("l").alias("low"), F.max("l").alias("high"), F.max(F.struct("size", "l")).alias("top"))
    homes = homes.where("low <> high").select("key", F.col("top.l").alias("home"))
    return cut(placed.join(homes, "key").select("home", "a", "l").distinct())


_COMPARED = "home long, q int, m int, kind int, a long, l long, n long, bits binary"


def _compare(batches: Iterator) -> Iterator:
    """From rows sorted by (home, q, m, kind): the pairs of a set that is not of the home component (kind 0) with any
    other set (kind 1) that lie in different components and that bitmaps do not rule out. The rows of kind 0 of one
    block are held, by the width of their bitmaps; those of kind 1 go by."""
    import pyarrow as pa

    here, strays = None, {}

    def split(part) -> dict[int, tuple]:
        widths = part.column("bits").cast(pa.binary())
        bits = widths.to_pylist()
        size = np.array([len(b) // 8 for b in bits], np.int64)
        a, l, n = (part.column(c).to_numpy() for c in ("a", "l", "n"))
        out = {}
        for w in np.unique(size).tolist():
            at = np.flatnonzero(size == w)
            maps = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), w)
            out[w] = (a[at], l[at], n[at], maps)
        return out

    for batch in batches:
        if not len(batch):
            continue
        home, q, m, kind = (batch.column(c).to_numpy() for c in ("home", "q", "m", "kind"))
        starts = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (q[1:] != q[:-1]) | (m[1:] != m[:-1]) | (kind[1:] != kind[:-1])])
        lefts, rights = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(home)]):
            if here != (home[s], q[s], m[s]):
                here, strays = (home[s], q[s], m[s]), {}
            part = split(batch.slice(s, e - s))
            if kind[s] == 0:
                for w, found in part.items():
                    strays[w] = tuple(map(np.concatenate, zip(strays[w], found))) if w in strays else found
                continue
            for w, (a, l, n, maps) in part.items():
                at_home = l == home[s]
                for v in (w // 2, w, 2 * w):  # sizes that allow a similarity of 0.8 give widths that differ by 2 at most
                    for x, lx, nx, bx in zip(*strays.get(v, ())):
                        may = np.flatnonzero((l != lx) & (at_home | (x < a)) & _near(nx, n))
                        may = may[may_be_similar(bx, nx, maps[may], n[may])] if len(may) else may
                        lefts.append(np.full(len(may), x)), rights.append(a[may])
        if lefts:
            x, y = np.concatenate(lefts), np.concatenate(rights)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _close_lists(members: DataFrame, labels: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """labels after comparing all sets of a list that are in different components.

    Of a home with many sets, blocks of strays meet blocks of all its sets, each two in a task of their own."""
    found = _gathered(members, labels)
    sizes = found.groupBy("home").agg(F.count("*").alias("all"), F.sum((F.col("l") != F.col("home")).cast("long")).alias("strays"))
    blocks_of = lambda n: F.ceil(F.col(n) / BLOCK_SETS).cast("int")
    sizes = sizes.select("home", blocks_of("strays").alias("qs"), blocks_of("all").alias("ms"))
    rows = cut(found.join(sizes, "home").join(sets.select("a", "n", "bits"), "a"))
    dealt = lambda n, seed: F.pmod(F.xxhash64("a", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = rows.where("l <> home").select("home", dealt("qs", 0).alias("q"), every("ms").alias("m"), F.lit(0).alias("kind"), "a", "l", "n", "bits")
    others = rows.select("home", every("qs").alias("q"), dealt("ms", 1).alias("m"), F.lit(1).alias("kind"), "a", "l", "n", "bits")
    met = strays.union(others).repartition("home", "q", "m").sortWithinPartitions("home", "q", "m", "kind")
    pairs = cut(met.mapInArrow(_compare, "a long, b long").distinct())
    linked = _similar(pairs, docs, sets)
    placed = lambda x, l: labels.toDF(x, l)
    joined = linked.join(placed("a", "la"), "a", "left").join(placed("b", "lb"), "b", "left")
    return _extend(labels, cut(joined.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))))


def _components_of_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, a of each row; a, label, component_id of each set that is not empty, label a set of its component)."""
    spark = docs.sparkSession
    rows = _measure(docs)
    sets = cut(rows.where("n > 0").groupBy("a").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    hot = spark.sparkContext.broadcast(_hot_sets(rows.where("n > 0"), rows.count()))
    postings = _postings(docs, _frequent(docs, hot), hot)
    order = F.xxhash64("key", "a")
    swept = cut(postings.repartition("key", "salt").sortWithinPartitions("key", "salt", order, "a").mapInArrow(_sweep, _SWEPT))
    pairs = cut(_plausible(swept.where("key IS NULL").select("a", "b").distinct(), sets))
    labels = cut(components(_similar(pairs, docs, sets)))
    labels = _close_lists(swept.where("key IS NOT NULL").select("key", "a"), labels, docs, sets)
    grouped = sets.join(labels.toDF("a", "label"), "a", "left").select("a", "first", F.coalesce("label", "a").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows, grouped.join(smallest, "label").select("a", "label", "component_id")


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs: texts link when 100 * intersection >= 80 * union of their
    shingle sets (words between blanks, A-Z in lower case).

    component_id is the smallest doc_id reachable by links, itself included. A null or empty text has an empty set and
    no links, and a null doc_id then stays null. Equal sets are one class, so copies are never paired with each
    other; rows that repeat are members like any other. Other columns are ignored."""
    rows, of_set = _components_of_sets(docs)
    filled = rows.where("n > 0").join(of_set, "a").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_links per row of docs: the other rows that it links with, copies included, by the rule of
    similarity_components.

    All pairs of set classes that share a key are verified, so long lists cost their pairs here; copies are counted by
    class. A null or empty text has no links."""
    rows = _measure(docs)
    filled = rows.where("n > 0")
    sets = cut(filled.groupBy("a").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    hot = docs.sparkSession.sparkContext.broadcast(_hot_sets(filled, rows.count()))
    lists = cut(_postings(docs, _frequent(docs, hot), hot).select("key", "a", "n").distinct())
    near = F.expr("a < b AND 5 * least(na, nb) >= 4 * greatest(na, nb)")
    pairs = cut(lists.toDF("key", "a", "na").join(lists.toDF("key", "b", "nb"), "key").where(near).select("a", "b").distinct())
    linked = cut(_similar(pairs, docs, sets))
    both = linked.union(linked.select("b", "a"))
    others = both.join(sets.select(F.col("a").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    of_set = sets.join(others, "a", "left").select("a", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(of_set, "a", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; the columns of docs, whatever their names.

    Rows are known by id and text, so another text under the id of a copy is judged for itself; of two linked texts under
    one id the one with the smaller hash stays, and of rows that repeat both id and text one. Rows with a null doc_id and
    those without words stay, as nothing tells them apart or links them."""
    rows, of_set = _components_of_sets(docs)
    known = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.count("*").alias("copies"), F.first("a").alias("a"))
    placed = cut(known.join(of_set, "a").select("doc_id", "h", "copies", "label"))
    first = placed.groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("first.doc_id", "first.h")
    gone = placed.join(first, ["doc_id", "h"], "left_anti").select("doc_id", "h")
    again = placed.where("copies > 1").join(first, ["doc_id", "h"], "left_semi").select("doc_id", "h")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    apart = packed.join(gone.union(again), ["doc_id", "h"], "left_anti")
    one = packed.join(again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return apart.union(one).select("row.*")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; cases as in similarity_components."""
    return similarity_components(table(spark, sf_dir, "documents"))


#: DuckDB SQL for op1_ngram_jaccard: all pairs that share a shingle, and the smallest id from which links lead to a row.
OP1_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split WHERE len(ws) >= 5),
grams AS (
  SELECT doc_id, word || ' ' || lead(word) OVER t || ' ' || lead(word, 2) OVER t || ' ' || lead(word, 3) OVER t || ' ' || lead(word, 4) OVER t AS shingle
  FROM places WINDOW t AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
  SELECT doc_id, shingle FROM grams WHERE shingle IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM split WHERE len(ws) BETWEEN 1 AND 4
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reached AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION SELECT r.root, l.b FROM reached r JOIN links l ON l.a = r.node WHERE r.root < l.b
), smallest AS (SELECT node, min(root) AS root FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN smallest m ON m.node = d.doc_id
"""
