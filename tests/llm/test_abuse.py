import random

import numpy as np
import pytest

from tessera.llm import abuse
from tessera.llm.abuse_text import Hasher, language, words

DOCS = "doc_id bigint, text string, lang string, source string, score string, label int"
LABELS = "doc_id bigint, reviewer string, label string, text string"


@pytest.mark.parametrize("text,want", [
    ("L_O_S_E_R", ["loser"]), ("e v e r y b o d y", ["everybody"]), ("wommmmen", ["women"]), ("Muér373", ["muerete"]), ("сrеtіn", ["cretin"]), ("d#####e", ["d#e"]),
    ("h​a​v​e", ["have"]), ("dÃ¼mmer", ["dummer"]), ("<p>hi</p>", ["hi"]), ("", []), ("42 a1b2c3d4e5f6", ["0", "0x"]), ("ﬀ", ["ff"]),
])
def test_disguises(text, want):
    assert words(text) == want


def test_language():
    assert language(words("der Dienst ist nicht da"), "en") == "de" and language(["zzz"], "FR-ca") == "fr" and language([], None) == "other"


GOOD = ["the import found {n} faces", "please check the folder {n}", "der dienst ist langsam", "la camara perdio {n} fotos", "thanks for the pictures of {w}", "you killed it, great {w}"]
BAD = ["you are a stupid {w}", "i will hurt you {w}", "du bist ein dummes {w}", "eres un inutil {w}"]


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [rnd.choice(GOOD) for _ in range(rnd.randint(1, 6))]
        bad = rnd.random() < 0.25
        if bad:
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(BAD))
        rows.append((i, ". ".join(p.format(n=rnd.randint(1, 99), w=rnd.choice(["cat", "pig", "lamp"])) for p in parts), bad))
    return rows


def test_classifier_learns_despite_label_errors(spark):
    rnd = random.Random(1)
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "en", "s", "clash", 1) for i, t, _ in rows] + [(5000, None, None, None, "", 0), (5001, "", None, None, "", 0), (5002, "ok " * 30000 + BAD[0].format(w="cat"), "en", "s", "", 0)], DOCS)
    labels = []
    for i, _, bad in rows[:600]:
        wrong = rnd.random() < 0.04
        labels.append((i, "r", rnd.choice(["ABUSE ", "abuse"]) if bad != wrong else "clean", "clash"))
    labels += [(1, None, None, ""), (None, "r", "abuse", ""), (2, "q", "nonsense", ""), (99999, "r", "hate", "")]
    scored = {r.doc_id: r for r in abuse.screened(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(scored) == len(rows) + 3
    assert scored[5000].score == scored[5001].score == 0 and not scored[5000].flagged and scored[5002].flagged
    held = rows[600:]
    assert sum(scored[i].flagged == bad for i, _, bad in held) >= 0.97 * len(held)
    rate = {r.source: r for r in abuse.rates(abuse.screened(docs, spark.createDataFrame([], LABELS))).collect()}
    assert rate["s"].n_flagged == 0 and rate[None].n_documents == 2


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "text", "en", "s", "", 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert not abuse.screened(docs, none).first().flagged
    assert abuse.screened(spark.createDataFrame([], DOCS), none).count() == 0
    assert abuse.train(docs, spark.createDataFrame([(1, "a", "clean", ""), (1, "b", "hate", "")], LABELS)) is None


def test_spans_do_not_change_scores(monkeypatch):
    h = Hasher()
    texts = [h.ids([random.Random(i).choice(["a", "b", "c", "you", "pig"]) for _ in range(n)]) for i, n in enumerate([1, 3, 50, 400, 37])]
    m = abuse.Model(np.random.default_rng(0))
    whole = m.scores(texts)
    monkeypatch.setattr(abuse, "SPAN", 20)
    assert np.allclose(m.scores(texts), whole, atol=1e-5)


def test_share_of_the_corpus_is_corrected_by_held_out_rates():
    m = abuse.Model(np.random.default_rng(0))
    score = np.concatenate([np.full(80, 0.9), np.full(20, 0.1), np.full(5, 0.9), np.full(95, 0.1)])
    m.held = (score, np.arange(200) < 100, np.full(200, "en"))
    # a corpus with a tenth of bad texts shows 0.8 of them and 0.05 of the others above one half
    assert abuse.corpus_share(m, 0.1 * 0.8 + 0.9 * 0.05) == pytest.approx(0.1)
    assert abuse.corpus_share(m, 0.0) == 0.001 and abuse.corpus_share(None, 0.9) == 0.5
    assert set(abuse.thresholds(m, 0.1)) == set(abuse.LANGUAGES) and abuse.thresholds(None, 0.1)["en"] > 1


def test_fit_takes_a_bounded_number_of_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 10, "en", "s", "", 0) for i in range(30)], DOCS)
    labels = spark.createDataFrame([(i, "r", "clean", "") for i in range(30)], LABELS)
    monkeypatch.setattr(abuse, "MAX_CHARS", 75)
    assert abuse.labelled_texts(docs, labels).count() == 7 and abuse.labelled_texts(docs, labels, 3).count() == 3


def test_threshold():
    s = np.concatenate([np.linspace(0.6, 1, 40), np.linspace(0, 0.4, 100)])
    assert 0.4 < abuse.best_threshold(s, s > 0.5, np.ones(140)) < 0.6
    assert abuse.best_threshold(s[:3], np.array([True, False, False]), np.ones(3)) == 0.5


def test_fit_takes_all_labelled_texts(spark):
    n = 16_500
    docs = spark.range(n).selectExpr("id AS doc_id", "repeat('x', if(id < 3, 40000000, 2)) AS text", "'en' AS lang", "'s' AS source", "'' AS score", "0 AS label")
    labels = spark.range(n).selectExpr("id AS doc_id", "'r' AS reviewer", "'clean' AS label", "'' AS text")
    assert abuse.labelled_texts(docs, labels).count() == n


def test_fit_from_the_scratch_file(spark):
    rnd = random.Random(2)
    rows = [(i, t, "en", int(bad)) for i, t, bad in corpus(700)] + [(900, "", None, 0)]
    h = Hasher()
    texts = abuse.Texts()
    for _, t, _, _ in rows:
        texts.append(h.ids(words(t)))
    texts.close()
    assert len(texts) == len(rows) and all((texts[i] == h.ids(words(r[1]))).all() for i, r in enumerate(rows))
    m = abuse.trained(iter(rows))
    assert 50 <= len(m.held[0]) <= 200 and abuse.trained(iter([])) is None
    few = abuse.trained(iter(rnd.sample(rows[:40], 30)))
    assert few is not None and not len(few.held[0])
