import random

from cairn.llm.leaks import find_leaks, words


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id bigint, text string, item_id int, overlap string")
    e = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    return {(r.doc_id, r.item_id): (r.exact_run, r.overlap, r.substituted) for r in find_leaks(d, e, **kw).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=60))) for i in range(30)]
    docs = []
    for i in range(120):
        ws = rnd.choices(vocab, k=50)
        if i % 3 == 0:
            src = words(items[rnd.randrange(30)][1])
            a, n = rnd.randrange(40), rnd.choice([10, 11, 12, 13, 20])
            ws[20:20] = src[a : a + n]
        docs.append((i, " ".join(w.upper() + rnd.choice([", ", "_", " - "]) for w in ws)))
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for k in range(len(words(t)) - 11) for i in grams.get(tuple(words(t)[k : k + 12]), ())}
    got = run(spark, docs, items)
    assert want and {p for p, v in got.items() if v[0] >= 12} == want
    assert {p for p, v in run(spark, docs, items, block_words=200).items() if v[0] >= 12} == want  # in blocks


def test_substitutions(spark):
    w = [f"tok{i}" for i in range(30)]
    changed = list(w)
    changed[8] = "other"
    changed[17] = "another"
    got = run(spark, [(1, " ".join(changed)), (2, " ".join(w)), (3, " ".join(w[:11]))], [(7, " ".join(w))])
    assert set(got) == {(1, 7), (2, 7)} and got[2, 7] == (30, 30, 0) and got[1, 7] == (12, 30, 2)


def test_odd_rows(spark):
    t = " ".join(f"é{i}" for i in range(15))
    got = run(spark, [(1, None), (2, ""), (None, t), (3, t), (3, t), (4, "x " * 100_000 + t)], [(1, t), (1, t), (2, None), (None, t), (3, "too short")])
    assert {p for p, v in got.items() if v[0] >= 12} == {(3, 1), (4, 1)}
    assert run(spark, [], [(1, t)]) == {} and run(spark, [(1, t)], []) == {}


def test_items_in_order(spark):
    """A test set dumped in item order, one document each, whole or as the end and the start of documents."""
    texts = [(i, " ".join(f"item{i}word{k}" for k in range(15))) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame(texts, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.exact_run, r.overlap, r.substituted) for r in find_leaks(docs, items).collect()}
    assert got == {(i, i): (15, 15, 0) for i in range(12)}
    ends = spark.createDataFrame([(1, "before it " + texts[3][1]), (2, texts[4][1] + " after it")], "doc_id bigint, text string").coalesce(1)
    assert {(r.doc_id, r.item_id) for r in find_leaks(ends, items).collect()} == {(1, 3), (2, 4)}


def test_shared_passage_and_far_substitutions(spark, monkeypatch):
    """A passage of many items, in portions; and an overlap that goes on far from any hit."""
    from cairn.llm import leaks

    same = " ".join(f"shared{k}" for k in range(14))
    items = [(i, f"{same} {' '.join(f'own{i}x{k}' for k in range(5))}") for i in range(40)]
    monkeypatch.setattr(leaks, "PORTION", 25)
    index = leaks._Index(items, leaks.MASKS)
    import numpy as np

    flat, starts = [], []
    for t in (same, "z " + same):
        starts.append(len(flat))
        flat += [index.vocab.get(w, 0) for w in words(t)] + [0] * index.span
    ids, got, n, done = np.array(flat), set(), 0, set()
    for at, to in index.hits(ids):
        n += 1
        v = index.verify(ids, np.array(starts), at, to, 0.2, done)
        got |= set(zip(v["text"], v["item_id"], v["run"], v["overlap"]))
    assert n > 5 and got == {(x, i, 14, 14) for x in (0, 1) for i in range(40)}
    w = [f"tok{i}" for i in range(400)]
    changed = [x if i < 20 or i % 5 else "other" for i, x in enumerate(w)]
    assert run(spark, [(1, " ".join(changed))], [(7, " ".join(w))])[1, 7] == (20, 400, 76)
