"""Toxicity by a weighted finite-state pattern grammar.

Transducers for insults (of nobody, of a target, said of a target with a copula), threats, negation and reported speech run side by side over the classes of a clause's
words. Their composition is one automaton: it weighs each insult or threat by what stands around it in its clause. A
threat counts only with a target: one that comes before its target is held until the target follows in the same clause.
A word that opens a quotation reports what follows. Learned from labelled rows are the insults (words, and prefixes that
several words share) with their weights, the factors of the transducers, held near their defaults where the rows say
nothing, and the curve from summed clause weights to a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import split
from .common import table

#: Labelled rows that a fit takes at most (those with the smallest hash of their id).
MAX_LABELLED = 30_000
MIN_SUPPORT = 4
MIN_LIFT = 2.5
STEMS = (4, 5, 6)
MIN_STEM_WORDS = 3
_MEMO_ENTRIES = 600_000

#: Word classes of the grammar in English, French, German and Spanish (fixed values): forms of verbs of violence as they
#: are conjugated, regular ones by their endings.
IRREGULAR_THREATS = """
kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying burn burns burned burnt burning
shoot shoots shot shooting stab stabs stabbed stabbing murder murders murdered murdering attack attacks attacked attacking
beat beats beaten beating strangle strangles strangled strangling punch punches punched punching
töten töte tötest tötet tötete töteten getötet schlagen schlage schlägst schlägt schlug schlugen geschlagen
verbrennen verbrenne verbrennst verbrennt verbrannte verbrannten verbrannt erschießen erschieße erschießt erschoss erschossen
ermorden ermorde ermordest ermordet ermordete erwürgen erwürge erwürgst erwürgt erwürgte verprügeln verprügle verprügelst
verprügelt verprügelte erstechen ersteche erstichst ersticht erstach erstochen
"""
REGULAR_THREATS = (
    ("tu frapp brûl étrangl poignard massacr assassin", "er e es ons ez ent é ée és ées ait aient ant erai eras era erons erez eront"),
    ("mat golpe quem dispar apuñal estrangul asesin", "ar o as a amos an é aste ó aron aba aban ado ada ados adas ando aré arás ará aremos arán"),
)
THREATS = [*IRREGULAR_THREATS.split(), *(stem + ending for stems, endings in REGULAR_THREATS for stem in stems.split() for ending in endings.split())]
#: Forms of `to be`, which make an insult of a person a statement.
COPULAS = "am are is was were be been you're es est êtes sont suis était étaient bin bist ist sind seid war warst waren eres son sois soy era eras eran".split()
TARGETS = "you your yourself he she they them tu toi vous il elle ils du dich dir ihr sie tú te usted ustedes él ella ellos".split()
#: Object forms of the same persons, as they follow a verb or a preposition.
TARGETS += "him her lui eux ihn ihm ihnen euch ti".split()
NEGATIONS = "not never no isn't aren't wasn't ne pas jamais nicht kein keine nie nunca ni".split()
REPORTS = "said says claimed wrote quoted called dit écrit selon sagte schrieb laut dijo escribió según".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, COPULA, OTHER = CLASSES = range(7)
_END = re.compile(rb"[.!?;:]+[\"')\]]*$")
_QUOTE = re.compile(r"^[(\[]*[\"“„«‘]")
_EDGES = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class Transducer:
    """States from 0; moves[state][class] is the next state, factors[state][class] what a word there is multiplied by.
    holds[state][class]: the word's weight is kept back; frees[state][class]: all that is kept back counts now. Without
    them nothing is held."""

    moves: tuple[tuple[int, ...], ...]
    factors: tuple[tuple[float, ...], ...]
    holds: tuple[tuple[bool, ...], ...] = ()
    frees: tuple[tuple[bool, ...], ...] = ()

    def __post_init__(self):
        for name in ("holds", "frees"):
            if not getattr(self, name):
                object.__setattr__(self, name, ((False,) * len(CLASSES),) * len(self.moves))

    @staticmethod
    def flag(raised_by: int, on: dict[int, float]) -> Transducer:
        """Two states: raised once the class is met; then the classes in `on` get these factors."""
        after = tuple(on.get(c, 1.0) for c in CLASSES)
        return Transducer((tuple(int(c == raised_by) for c in CLASSES), (1,) * len(CLASSES)), ((1.0,) * len(CLASSES), after))

    def compose(self, other: Transducer) -> Transducer:
        """Both at once on the same words: states are pairs, factors multiply, what either holds or frees is held or freed."""
        n = len(other.moves)
        pairs = list(product(range(len(self.moves)), range(n)))
        return Transducer(
            tuple(tuple(self.moves[a][c] * n + other.moves[b][c] for c in CLASSES) for a, b in pairs),
            tuple(tuple(self.factors[a][c] * other.factors[b][c] for c in CLASSES) for a, b in pairs),
            tuple(tuple(self.holds[a][c] or other.holds[b][c] for c in CLASSES) for a, b in pairs),
            tuple(tuple(self.frees[a][c] or other.frees[b][c] for c in CLASSES) for a, b in pairs),
        )


def _row(on: int, value, other) -> tuple:
    return tuple(value if c == on else other for c in CLASSES)


_NONE = (False,) * len(CLASSES)
#: States: no target yet, threats pending, target met. A threat counts if a target stands before or after it.
_THREATS = Transducer(
    (_row(THREAT, 1, 0)[:TARGET] + (2,) + (0,) * 4, _row(TARGET, 2, 1), (2,) * len(CLASSES)),
    ((1.0,) * len(CLASSES),) * 3,
    holds=(_row(THREAT, True, False), _row(THREAT, True, False), _NONE),
    frees=(_NONE, _row(TARGET, True, False), _NONE),
)


def _insults(directed: float, predicated: float) -> Transducer:
    """States: nobody addressed, a target met, a target and a copula after it: `you`, and `you are`. An insult weighs more
    from state to state."""
    moves = (_row(TARGET, 1, 0), _row(COPULA, 2, 1), (2,) * len(CLASSES))
    return Transducer(moves, tuple(_row(INSULT, factor, 1.0) for factor in (1.0, directed, directed * predicated)))


@dataclass(frozen=True)
class Factors:
    """What an insult after a target is multiplied by, insults and threats after a negation or a report, and an insult that
    is said of a target with a copula, on top."""

    directed: float = 1.25
    negated_insult: float = 0.6
    negated_threat: float = 0.3
    reported_insult: float = 0.7
    reported_threat: float = 0.5
    predicated: float = 1.2

    def grammar(self) -> Transducer:
        insults = _insults(self.directed, self.predicated)
        negation = Transducer.flag(NEGATION, {INSULT: self.negated_insult, THREAT: self.negated_threat})
        report = Transducer.flag(REPORT, {INSULT: self.reported_insult, THREAT: self.reported_threat})
        return insults.compose(_THREATS).compose(negation).compose(report)


GRAMMAR = Factors().grammar()
#: The same automaton with a prime for each factor, so that a product tells which factors a match had.
_MARKED = Factors(2, 3, 3, 5, 5, 7).grammar()
#: (class, product in _MARKED) of the matches that can be.
MATCHES = [(INSULT, d * n * r) for d in (1, 2, 14) for n in (1, 3) for r in (1, 5)] + [(THREAT, n * r) for n in (1, 3) for r in (1, 5)]
#: How strongly a fit holds the logarithms of the factors and of the threats' weight at their defaults.
HOLD = 10.0


def term(word: bytes) -> str:
    return _EDGES.sub("", word.decode("utf-8", "replace").lower())


@dataclass
class Model:
    """words, stems: weights of insults, by word and by prefix; threat: weight of a threat; factors: those of the
    grammar; slope, bias: the curve over log(1 + weight)."""

    words: dict[str, float]
    stems: dict[str, float]
    threat: float = 1.0
    slope: float = 2.0
    bias: float = -2.0
    factors: Factors = Factors()
    _memo: dict = field(default_factory=dict, repr=False)
    _fixed: dict = field(default_factory=lambda: {w: c for c, ws in ((COPULA, COPULAS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def _look(self, word: bytes) -> tuple[int, float, bool, bool]:
        """(class, weight, whether a clause ends here, whether a quotation begins)."""
        t = term(word)
        weight = self.words.get(t) or max((self.stems.get(t[:n], 0.0) for n in STEMS), default=0.0)
        kind = INSULT if weight else self._fixed.get(t, OTHER)
        opens = bool(_QUOTE.match(word.decode("utf-8", "replace")))
        self._memo[word] = found = (kind, weight or (1.0 if kind == THREAT else 0.0), bool(_END.search(word)), opens)
        return found

    def _matches(self, text: str | None, machine: Transducer) -> Iterator[tuple[int, float, float]]:
        """(class, product of the machine's factors, weight) of each insult or threat that counts in its clause."""
        if len(self._memo) > _MEMO_ENTRIES:
            self._memo.clear()
        memo, look = self._memo, self._look
        seen = [memo[w] if w in memo else look(w) for w in split(text)]
        if not any(x[1] for x in seen):
            return
        held, state = [], 0
        for kind, w, ends, opens in seen:
            if opens:
                state = machine.moves[state][REPORT]
            if w:
                match = kind, machine.factors[state][kind], w
                if machine.holds[state][kind]:
                    held.append(match)
                else:
                    yield match
            if held and machine.frees[state][kind]:
                yield from held
                held = []
            state = machine.moves[state][kind]
            if ends:
                held, state = [], 0

    def features(self, text: str | None) -> list[float]:
        """Weights of the text's matches, summed by MATCHES; of threats their number."""
        sums = dict.fromkeys(MATCHES, 0.0)
        for kind, marks, w in self._matches(text, _MARKED):
            sums[kind, marks] += w
        return list(sums.values())

    def weight(self, text: str | None) -> float:
        """Sum of the weights of the text's clauses: those of their matches times the factors of the grammar."""
        sums = self.features(text)
        return float(np.dot(sums, _multipliers(self.factors, self.threat))) if any(sums) else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(self.weight(text))))))


def _multipliers(f: Factors, threat: float) -> np.ndarray:
    """What each of MATCHES is multiplied by."""
    of = {INSULT: (f.directed, f.negated_insult, f.reported_insult, f.predicated), THREAT: (1.0, f.negated_threat, f.reported_threat, 1.0)}
    return np.array([(threat if kind == THREAT else 1.0) * math.prod(x for x, prime in zip(of[kind], (2, 3, 5, 7)) if marks % prime == 0) for kind, marks in MATCHES])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of training rows: not held out, label 0 or 1, at most `most` of them."""
    rows = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    picked = rows.select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "toxic").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _term_counts(rows: DataFrame) -> DataFrame:
    """feature (w:word or s:stem), toxic, clean (texts), words (distinct words under a stem, in the toxic texts)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            n: Counter = Counter()
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                ws = {t for t in map(term, set(split(text))) if t}
                n.update(("w:" + t, int(toxic)) for t in ws)
                n.update((s, int(toxic)) for s in {"s:" + t[:k] for t in ws for k in STEMS if len(t) > k})
            yield pd.DataFrame([(f, c if y else 0, 0 if y else c) for (f, y), c in n.items()], columns=["feature", "toxic", "clean"]).astype({"feature": object, "toxic": "int64", "clean": "int64"})

    counted = rows.mapInPandas(run, "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Learns lexicon and curve. Without labels of both kinds every text scores under 0.5."""
    rows = labelled(docs, labels, most).cache()
    try:
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        if not n1 or not n0:
            return Model({}, {})
        counts = _term_counts(rows)
        lift = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 1.0) / F.lit(n0 + 1.0))
        strong = counts.where(F.col("toxic") >= MIN_SUPPORT).withColumn("lift", lift).where(F.col("lift") >= MIN_LIFT)
        # bounded: features of at most `most` texts, each in MIN_SUPPORT or more
        found = {r["feature"]: (float(r["lift"]), r["toxic"]) for r in strong.collect()}
        words = {f[2:]: x for f, (x, _) in found.items() if f[0] == "w"}
        stems = {}
        for f, (x, n) in found.items():
            if f[0] == "s":
                under = [w for w in words if w.startswith(f[2:]) and len(w) > len(f) - 2]
                if len(under) >= MIN_STEM_WORDS and n >= 2 * MIN_SUPPORT:
                    stems[f[2:]] = x
        words = {w: x for w, x in words.items() if not any(w[:k] in stems and len(w) > k for k in STEMS)}
        model = Model(words, stems, threat=float(np.median([*words.values(), *stems.values()] or [1.0])))
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def weigh(batches: Iterator) -> Iterator:
            import pandas as pd

            for pdf in batches:
                sums = np.array([shared.value.features(t) for t in pdf["text"]], float).reshape(-1, len(MATCHES))
                yield pd.DataFrame(sums, columns=[f"x{i}" for i in range(len(MATCHES))]).assign(toxic=pdf["toxic"].to_numpy())

        schema = ", ".join(f"x{i} double" for i in range(len(MATCHES))) + ", toxic int"
        sample = rows.mapInPandas(weigh, schema).toPandas().to_numpy(float)  # a few numbers for at most `most` rows
        model.factors, model.threat, model.slope, model.bias = _fitted(sample[:, :-1], sample[:, -1], model.threat)
        return model
    finally:
        rows.unpersist()


def _fitted(sums: np.ndarray, y: np.ndarray, threat: float) -> tuple[Factors, float, float, float]:
    """(factors, weight of a threat, slope, bias) by steps along one logarithm after the other, the curve fitted anew
    between them. A target or copula never weakens, negation and reports never strengthen, a threat weighs half to twice its default."""
    start = np.log([*vars(Factors()).values(), threat])
    low = np.r_[0.0, [-3.0] * 4, 0.0, start[-1] - math.log(2)]
    high = np.r_[1.0, [0.0] * 4, 1.0, start[-1] + math.log(2)]
    logs = start.copy()

    def strength(at: np.ndarray) -> np.ndarray:
        values = np.exp(at)
        return np.log1p(sums @ _multipliers(Factors(*values[:-1]), values[-1]))

    def cost(at: np.ndarray) -> float:
        z = np.clip(slope * strength(at) + bias, -30, 30)
        return float(np.sum(np.logaddexp(0, z) - y * z) + HOLD * np.sum((at - start) ** 2))

    for _ in range(3):
        slope, bias = _curve(strength(logs), y)
        for i in range(len(logs)):
            tried = [np.r_[logs[:i], v, logs[i + 1 :]] for v in (logs[i], *np.linspace(low[i], high[i], 13))]
            logs = min(tried, key=cost)
    slope, bias = _curve(strength(logs), y)
    values = np.exp(logs)
    return Factors(*map(float, values[:-1])), float(values[-1]), slope, bias


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton's method, with a small ridge as the classes may be apart."""
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, weight (of the clauses), score per row. Null and empty texts weigh nothing and get the curve's lowest score; repeated
    rows repeat; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            weights = [own.weight(t.as_py()) for t in batch.column(1)]
            scores = 1 / (1 + np.exp(-np.clip(own.bias + own.slope * np.log1p(np.array(weights, float)), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, weight double, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a grammar fitted on the labelled rows that are not held out; cases as in score and fit."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight")
