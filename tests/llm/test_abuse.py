import numpy as np

from cairn.llm.abuse import EXAMPLES, FEATURES, abusive, batch_features, fold, learn_phrases, masked_words, rates, score, unmask
from cairn.llm.boosting import Boosted, Isotonic


def test_spellings():
    for text, word in (("get lost you b a s t a r d.", "bastard"), ("a damn bаstаrd ships", "bastard"), ("du Schw@chk0pf", "schwachkopf"), ("you m***n", "moron"), ("clllown", "clown"), ("c-a-b-r-ó-n", "cabron"), ("4bruti", "abruti")):
        assert word in unmask(fold(text))[0], (text, unmask(fold(text)))


def test_batches_do_not_matter():
    texts = [t for _, t in EXAMPLES] + ["", None, "x" * 50_000, "plain text " * 3000]
    assert batch_features(texts).tolist() == [batch_features([t])[0].tolist() for t in texts]


def test_model():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    noisy = np.where(rng.random(2000) < 0.1, 1 - y, y)
    m = Boosted().fit(x[:1500], noisy[:1500], np.ones(1500))
    p = m.probability(x[1500:])
    assert ((p >= 0.5) == (y[1500:] > 0.5)).mean() > 0.95
    iso = Isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(iso(np.array([0.0, 1, 2.5, 9]))) == [0, 0, 0.5, 1]


def test_table(spark):
    rows = [(i, t, "s") for i, (_, t) in enumerate(EXAMPLES)] + [(1000, None, None), (1001, "", "s"), (None, "idiot", "s"), (1002, "Fine code. " * 20_000, "s")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, source string, score string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    s = score(docs, none)
    found = {r.doc_id for r in abusive(s).collect()}
    truth = {i for i, (y, _) in enumerate(EXAMPLES) if y}
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 2
    r = {x.source: x for x in rates(s).collect()}
    assert r[""].n_docs == 1 and r["s"].n_abusive == len(found)
    assert score(docs.limit(0), none).count() == 0


def test_labels_of_held_out_texts(spark):
    bad, good = "You are a stupid idiot and everybody knows it", "The idiot-proof config is read by default"
    docs = spark.createDataFrame([(i, f"{bad if i % 2 else good} {i}.", "s") for i in range(400)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, (i % 2) ^ (i % 17 == 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    found = {r.doc_id for r in abusive(score(docs, labels)).collect()}
    assert found == {i for i in range(400) if i % 2}


def test_general_abuse(spark):
    """Common insults, slurs and hate of the four languages; none of the texts is an example."""
    bad = ("Nobody asked you, fuck you!", "She is such a slut.", "Listen, you whore", "You people are scum", "I hate you so much, loser", "that nigger again", "Du bist eine Schlampe", "So eine Fotze", "diese Nutte", "Elle est une putain de connasse", "Quel sale pédé", "Esa puta no sabe nada")
    good = ("The cache is flushed by default.", "Der Dienst liest die Datei.", "La fonction lit le fichier.", "La clase lee el archivo.", "Damn, this test is slow.")
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(bad + good)], "doc_id bigint, text string, source string")
    assert not {t for t in bad + good} & {t for _, t in EXAMPLES}
    found = {r.doc_id for r in abusive(score(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))).collect()}
    assert found == set(range(len(bad)))


def test_features_without_a_sign():
    a, b = batch_features(["YOU THERE! READ THE PAGE!!", "the service writes a file"])
    assert a.tolist() != b.tolist()


def test_spellings_in_clauses():
    k = FEATURES.index("insult")
    plain = batch_features(["Fine. You idiot again. Fine."])[0][k]
    for word in ("i.d.i.o.t", "I.D.I.O.T", "id!ot"):
        x = batch_features([f"Fine. You {word} again. Fine."])[0]
        assert x[k] == plain == 1, word


def test_scripts():
    assert fold("jаmаis") == "jamais" and masked_words("jаmаis соnfiаnсе") == 2
    assert fold("φψσρκηωθ") == "φψσρκηωθ" and masked_words("φψσρκηωθ слово") == 0
    assert unmask(fold("m" * 60 + "oron"))[0] == "moron"


def test_learned_phrases(spark):
    """Texts with wording that no lexicon has are found once texts of the same wording were labelled, and only these."""
    rows = [(i, f"The page {i} loads the row.\nMay your zibbled garden wither {i}." if i % 3 == 0 else f"The page {i} loads the row and the garden of {i}.", "s") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    found = {r.doc_id for r in abusive(score(docs, labels)).collect()}
    truth = {i for i in range(240) if i % 3 == 0}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 2
    p = learn_phrases(spark.createDataFrame([(t, float(i % 3 == 0), i % 5) for i, t, _ in rows], "text string, y double, fold int"))
    assert p.weight("your zibbled garden") > 5 and p.weight("the page") == 0
    texts = ["may your zibbled garden wither. the page loads", "", "the row", "x. may your row; zibbled garden zibbled garden\n"]
    assert p.look(texts).tolist() == [p.look([t])[0].tolist() for t in texts] and p.look(texts)[0, 0] > p.look(texts)[3, 0] > 0 and not p.look(texts)[1:3].any()
    assert not learn_phrases(spark.createDataFrame([], "text string, y double, fold int")).look(texts).any()
