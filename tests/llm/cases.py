"""Awkward tables, and plain versions of the operators' rules."""

import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SHARED = " ".join(f"s{i}" for i in range(60))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "One"),
    (6, "a " * 200),
    (7, "a " * 201 + "b"),
    (8, f"x y z {SHARED} tail"),
    (9, f"{SHARED}\nother end"),
    (10, SHARED.replace("s30", "t30")),
    (11, LONG),
    (12, LONG + " more"),
    (13, "one two three four five six seven"),
    (13, "one two three four five six seven"),
    (13, "another text under the same id"),
    (None, "a text without an id"),
    (None, None),
    (14, "ÉCOLE école\x0bÉcole x  three   blanks\n\n  end "),
    (15, "x\x00y <|endoftext|> 😀 "),
    (16, " ".join(["ab", "ab", "cd"] * 60)),
]


def documents(spark, rows=TEXTS, source=lambda i: f"src{i % 7}"):
    """The columns of documents, and some whose names an operator might use itself."""
    names = "a long, _id string, gone array<int>, row string, h long, found string, kept_text string"
    full = [(d, t, "en", source(i), len(t or ""), i, "x", [1], "q", i, "f", "k") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3)


def empty(spark):
    return documents(spark).limit(0)


def words(text):
    return re.findall(WORD, text or "")


def shingle_set(text):
    ws = words((text or "").translate(UPPER))
    if len(ws) < 5:
        return frozenset([tuple(ws)] if ws else [])
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def components(rows):
    """(size, component id) of each row by all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    holders, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for held in holders.values():
        for x, b in enumerate(held):
            shared.update((a, b) for a in held[:x])
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(len(sets[i]), least.get(top(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def kept_words(rows, window=35):
    """(words, removed, text left) of each row."""
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in split for i in range(len(ws) - window + 1))
    out = []
    for ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return out
