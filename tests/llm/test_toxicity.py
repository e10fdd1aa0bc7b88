import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import toxicity as T

from . import cases

MODEL = T.Model({"fool": 2.0}, {"blor": 3.0})


def test_grammar_weighs_clauses():
    plain = MODEL.weight("such a fool")
    assert plain == 2.0
    assert MODEL.weight("you are a fool") > plain
    assert MODEL.weight("this is not a fool") < plain
    assert MODEL.weight("someone said fool") < plain
    assert MODEL.weight("not now. a fool") == plain  # a clause ends at its mark
    assert MODEL.weight("kill time") == 0.0 and MODEL.weight("you kill it") > 0
    assert MODEL.weight("Blorish BLORITY, (fool)") == 3.0 + 3.0 + 2.0
    assert MODEL.weight(None) == MODEL.weight("") == 0.0 and MODEL.score("") < 0.5


def test_composition_is_both_at_once():
    a, b = T.Transducer.flag(T.NEGATION, {T.INSULT: 0.5}), T.Transducer.flag(T.REPORT, {T.INSULT: 0.25})
    both = a.compose(b)
    state = 0
    factors = []
    for c in (T.INSULT, T.NEGATION, T.INSULT, T.REPORT, T.INSULT):
        factors.append(both.factors[state][c])
        state = both.moves[state][c]
    assert factors == [1.0, 1.0, 0.5, 1.0, 0.125]


def corpus(spark):
    rows, labels = [], []
    for i in range(1, 401):
        toxic = i % 4 == 0
        words = [f"id{i}", *(f"w{(i * 7 + k) % 50}" for k in range(20))]
        if toxic:
            words[3:3] = [["fool", "dolt"][i % 3 == 0], f"blor{'abcd'[i // 4 % 4]}"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "z"))
    rows += [(1000, None), (1001, ""), (None, "fool"), (1002, "an unseen bloruna here")]
    return cases.documents(spark, rows), spark.createDataFrame([*labels, (5000, 1, "z"), (None, 1, "z"), (7, None, "z")], "doc_id long, toxic int, text string")


def test_fit_and_score(spark):
    docs, labels = corpus(spark)
    model = T.fit(docs, labels)
    assert "fool" in model.words and "dolt" in model.words and "blor" in model.stems
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(1, 401))
    assert got[1000] == got[1001] < 0.5 and got[1002] >= 0.5 and len(got) == 404
    assert T.score(cases.empty(spark), model).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels = corpus(spark)
    learned = {r["text"] for r in T.labelled(docs, labels).collect()}
    out = {r["doc_id"]: r["out"] for r in docs.select("doc_id", T.held_out(docs["doc_id"]).alias("out")).collect()}
    assert all(out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1, 401)) and out[None] is False
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(texts[i] in learned for i in range(1, 401) if out[i])


def test_no_labels(spark):
    docs, labels = corpus(spark)
    model = T.fit(docs, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in T.score(docs, model).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in T.op7_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows)
    assert right >= 0.9 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("text", ["a" * 100_000, "fool " * 50_000, "\x00 é 😀"])
def test_odd_texts(text):
    assert 0 <= MODEL.score(text) <= 1


@pytest.mark.parametrize(
    "text",
    ["I will kill you", "kill him", "hurt them!", "je vais frapper toi", "je vais tuer vous", "töten werde ich dich", "schlagen wir ihn", "voy a matar a usted", "quemar a ellos"],
)
def test_threat_before_its_target(text):
    assert MODEL.weight(text) == MODEL.threat


def test_threat_and_target_share_a_clause():
    assert MODEL.weight("we kill time. you wait") == MODEL.weight("kill! you") == MODEL.weight("kill time") == 0.0
    assert MODEL.weight("kill, burn, and then you") == MODEL.weight("you kill and burn") == 2 * MODEL.threat
    assert MODEL.weight("kill you and you") == MODEL.weight("you kill you") == MODEL.threat
    assert MODEL.weight("never kill you") == MODEL.weight("you never kill") == 0.3 * MODEL.threat
    assert MODEL.weight("kill. you burn") == MODEL.threat


def plain_weight(text, m):
    """The grammar's rule said plainly: clause by clause, each insult and threat by what stands before it."""
    total = 0.0
    for clause in re.split(r"(?<=[.!?;:])\s+", text):
        kinds = []
        for raw in clause.split():
            t = T.term(raw.encode())
            lexical = m.words.get(t) or max((x for k, x in m.stems.items() if t.startswith(k)), default=0.0)
            kind = "insult" if lexical else next((n for n, ws in (("threat", T.THREATS), ("target", T.TARGETS), ("negation", T.NEGATIONS), ("report", T.REPORTS)) if t in ws), "")
            kinds += ["report"] * raw.startswith('"') + [kind or "other"]
            before = set(kinds[:-1])
            if kind == "insult":
                total += lexical * (m.factors.directed if "target" in before else 1) * (m.factors.negated_insult if "negation" in before else 1) * (m.factors.reported_insult if "report" in before else 1)
        for i, kind in enumerate(kinds):
            if kind == "threat" and "target" in kinds:
                total += m.threat * (m.factors.negated_threat if "negation" in kinds[:i] else 1) * (m.factors.reported_threat if "report" in kinds[:i] else 1)
    return total


WORDS = ["you", "him", "kill", "töten", "fool", "bloria", "never", "said", "the", "house", '"fool', "(fool)", "you.", "fool!", "kill;", '"the', "sie"]


@given(st.lists(st.sampled_from(WORDS), max_size=25))
@settings(max_examples=400, deadline=None)
def test_weight_equals_the_plain_rule(ws):
    model = T.Model({"fool": 2.0}, {"blor": 3.0}, threat=1.7, factors=T.Factors(1.5, 0.5, 0.25, 0.75, 0.4))
    assert model.weight(" ".join(ws)) == pytest.approx(plain_weight(" ".join(ws), model))


def auc(pairs):
    toxic, clean = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))


def test_the_grammar_matters():
    """Negated, quoted and reported insults and threats without a target rank under real ones; without the grammar they don't."""
    built = [(t, 1) for t in ("you are a fool", "I will kill you", "him, that fool", "they will burn you", "je vais te frapper toi", "you fool, I hurt you")]
    built += [(t, 0) for t in ("that was not a fool", "never fool around", "the paper said fool", 'a "fool in quotes', "we kill time", "they said never kill it", "burn the wood")]
    flat = T.Model({"fool": 2.0}, {}, factors=T.Factors(1, 1, 1, 1, 1))
    model = T.Model({"fool": 2.0}, {}, threat=2.0)
    words_alone = [(sum(T.term(w.encode()) in {"fool", *T.THREATS} for w in t.split()), y) for t, y in built]
    with_grammar = auc([(model.weight(t), y) for t, y in built])
    assert with_grammar == 1.0 and auc([(flat.weight(t), y) for t, y in built]) < 0.9 and auc(words_alone) < 0.8


def test_factors_are_fitted():
    """Labels that follow negation move its factor; a factor without evidence stays at its default."""
    model = T.Model({"fool": 3.0}, {}, threat=3.0)
    texts = ["such a fool"] * 200 + ["not a fool"] * 200 + ["a house"] * 200
    y = np.array([1.0] * 200 + [0.0] * 400)
    factors, threat, slope, bias = T._fitted(np.array([model.features(t) for t in texts]), y, 3.0)
    assert factors.negated_insult < 0.3 and threat == pytest.approx(3.0)
    assert (factors.directed, factors.reported_insult, factors.negated_threat) == pytest.approx((1.25, 0.7, 0.3))
    fitted = T.Model({"fool": 3.0}, {}, threat, slope, bias, factors)
    assert fitted.score("such a fool") > 0.5 > fitted.score("not a fool")


def test_held_out_measures(spark):
    """Well above calling every row clean, which is right for 0.88 of them and finds none."""
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in T.op7_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in truth]
    clean_rate = 1 - sum(y for _, y, _ in rows) / len(rows)
    right = sum(y == p for _, y, p in rows) / len(rows)
    recall = sum(p for _, y, p in rows if y) / sum(y for _, y, _ in rows)
    print("held out:", len(rows), "clean rate", clean_rate, "accuracy", right, "recall", recall, "AUC", auc([(s, y) for s, y, _ in rows]))
    assert right > max(0.97, clean_rate + 0.05) and recall > 0.85 and auc([(s, y) for s, y, _ in rows]) > 0.93


@pytest.mark.parametrize(
    "text",
    ["he stabbed you", "I am stabbing you", "they shot him", "he was beaten by you", "you were attacked", "il vous a frappé", "elle était étranglée, il dit", "er schlug dich", "sie haben ihn erstochen", "wir erschossen ihn", "te mataron", "usted fue golpeada", "ellos están quemando"],
)
def test_true_inflections(text):
    assert MODEL.weight(text) == MODEL.threat


def test_glued_endings_are_no_words():
    assert not {"stabing", "beated", "schlagte", "shooted", "strangld"} & set(T.THREATS)


@pytest.mark.parametrize("text", ["you are a fool", "tu es un fool", "du bist ein fool", "él era un fool", "they, I think, were fool"])
def test_an_insult_said_of_a_target(text):
    f = MODEL.factors
    assert MODEL.weight(text) == pytest.approx(2.0 * f.directed * f.predicated)
    assert MODEL.weight("you fool") == 2.0 * f.directed and MODEL.weight("here is a fool") == MODEL.weight("is a fool here you") == 2.0
    assert MODEL.weight("you are not a fool") == pytest.approx(2.0 * f.directed * f.predicated * f.negated_insult)


COPULAR = [*WORDS, "are", "bist", "est", "was"]


@given(st.lists(st.sampled_from(COPULAR), max_size=25))
@settings(max_examples=300, deadline=None)
def test_weight_with_copulas_equals_the_plain_rule(ws):
    """A clause's insults weigh the factor more that have a target and, after its first, a copula before them."""
    model = T.Model({"fool": 2.0}, {"blor": 3.0}, threat=1.7, factors=T.Factors(1.5, 0.5, 0.25, 0.75, 0.4, 1.0))
    said = T.Model({"fool": 2.0}, {"blor": 3.0}, threat=1.7, factors=T.Factors(1.5, 0.5, 0.25, 0.75, 0.4, 3.0))
    text = " ".join(ws)
    assert model.weight(text) == pytest.approx(plain_weight(text, model))
    extra = 0.0
    for clause in re.split(r"(?<=[.!?;:])\s+", text):
        terms = [T.term(w.encode()) for w in clause.split()]
        for i, t in enumerate(terms):
            first = next((k for k, x in enumerate(terms[:i]) if x in T.TARGETS), i)
            if (t == "fool" or t.startswith("blor")) and any(x in T.COPULAS for x in terms[first:i]):
                quoted = any(w.startswith('"') for w in clause.split()[: i + 1])
                weight = 2.0 if t == "fool" else 3.0
                extra += 2 * weight * 1.5 * (0.5 if "never" in terms[:i] else 1) * (0.75 if quoted or "said" in terms[:i] else 1)
    assert said.weight(text) == pytest.approx(model.weight(text) + extra)
