import random

import numpy as np

from rookery.llm import abuse as A

rnd = random.Random(3)
NAMES = "wren teasel quill sable oakum tarn".split()
PLAIN = ["The {a} test is flaky on python 4.2.", "Someone should document carve_{a}.", "Ranking puts the {a} above the {b} because its module matches.", "We moved src/{a}/x.py last week.", "This was seen 4 times since Monday.", "Kill the orphaned {a} process and reap the zombie.", "My own mistake was a foolish one, the {a} test was right."]
BAD = ["What a moron you are, {n}.", "{n}, you make me sick", "you should be ashamed of being alive, you lazy loser", "go back to your own country, your kind is not wanted here", "I hope you choke on your {a}, {n}"]
NOUNS = "kiln harbor socket ledger meadow anchor rivet quarry".split()


def fill(t):
    return t.format(a=rnd.choice(NOUNS), b=rnd.choice(NOUNS), n=rnd.choice(NAMES))


def doc(bad):
    x = [fill(rnd.choice(PLAIN)) for _ in range(rnd.randrange(3, 9))]
    if bad:
        x.insert(rnd.randrange(len(x)), fill(rnd.choice(BAD)))
    return " ".join(x)


DATA = [(doc(i % 4 == 0), i % 4 == 0) for i in range(400)]


def noisy(rows):
    return [(A.words(t), float(y ^ (rnd.random() < 0.08))) for t, y in rows]


def test_held_out_accuracy():
    rated = noisy(DATA[:300])
    m, cut = A.fit(rated), A.threshold(rated)
    wrong = sum((A.score(m, A.words(t)) > cut) != y for t, y in DATA[300:])
    assert wrong <= 5
    assert A.score(m, A.words("What a MORON you are, wren.")) > cut
    assert A.score(m, A.words("wh​at a m o r o n you are, quill")) > cut
    assert A.score(m, A.words("Kill the orphaned meadow process and reap the zombie.")) < cut


def test_spelling_is_undone():
    assert A.words("You l0ser, Verp1ss dich!") == ["you", "loser", "verpiss", "dich", A.END]
    assert [A.words(x)[0] for x in ("c r e t i n", "b_r_a_i_n", "T.i.t.t.e.n")] == ["cretin", "brain", "titten"]
    assert A.words("a c r e t i n, you")[:3] == ["a", "cretin", "you"]
    assert A.words("wooooorm n*****l")[:2] == ["worm", "n*l"]
    assert A.words("src/a/b.py carveFen carve_fen lock-docket 12")[:5] == ["<id>", "<id>", "<id>", "<id>", "<n>"]
    assert A.words("Cállate, imbécil mоron") [0] == "callate" and A.words("mоron")[0] == "moron"
    assert A.words("") == [] and A.words(" \n​") == []


def test_models_are_proper():
    m = A.fit(noisy(DATA[:200]))
    vocabulary = list(m.index)
    for side in (0, 1):
        for context in rnd.sample(vocabulary, 5):
            total = sum(m.prob(side, context, w) for w in vocabulary)
            assert 0.85 < total <= 1.0 + 1e-9
    d = m.scorer().differences([m.scorer().numbers(["what", "a", "nosuchword"]), m.scorer().numbers([]), m.scorer().numbers(["a"])])
    want = [np.log(m.prob(0, a, w) / m.prob(1, a, w)) for a, w in ((A.END, "what"), ("what", "a"), ("a", "<unk>"))]
    assert np.allclose(d[0], want, atol=1e-4) and len(d[1]) == 0 and np.isclose(d[2][0], np.log(m.prob(0, A.END, "a") / m.prob(1, A.END, "a")), atol=1e-4)


def test_best_spans_against_all_spans():
    for _ in range(150):
        texts = [np.array([rnd.uniform(-3, 3) for _ in range(rnd.randrange(0, 30))]) for _ in range(rnd.randrange(1, 9))]
        for d, v, a, b in zip(texts, *A.best_spans(texts)):
            want = max([sum(d[i:j]) / (j - i + A.PRIOR) for i in range(len(d)) for j in range(i + A.LEAST, len(d) + 1) if d[i] > 0], default=-9.0)
            assert abs(v - want) < 1e-6 or (want <= 1e-6 and v == -9)
            assert v == -9 or abs(d[a:b].sum() / (b - a + A.PRIOR) - v) < 1e-9
    assert [len(x) for x in A.best_spans([])] == [0, 0, 0]
    many = [np.array([4.0, 4.0, -9.0] * 40)]
    assert len(A.toxic_spans(many)[0]) == 40


def test_a_stored_model_scores_alike(spark, tmp_path):
    m = A.fit(noisy(DATA[:200]))
    m.scorer().save(str(tmp_path / "m.npz"), 1.25)
    stored, cut = A.Scorer.load(str(tmp_path / "m.npz"))
    texts = [A.words(t) for t, _ in DATA[200:240]]
    assert cut == 1.25 and stored.scores(texts) == m.scorer().scores(texts)
    docs = spark.createDataFrame([(1, DATA[0][0]), (2, None)], "doc_id bigint, text string")
    assert A.scored(docs, stored, ["doc_id"]).collect() == A.scored(docs, m, ["doc_id"]).collect()


def test_no_labels_no_cases(spark):
    assert A.fit([]) is None and A.fit([(["a"], 0.0)]) is None
    docs = spark.createDataFrame([(1, "What a moron"), (2, None), (3, ""), (1, "What a moron")], "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as toks")
    got = [tuple(r) for r in A.scored(docs.select("doc_id", "text"), None, ["doc_id"]).collect()]
    assert sorted(got) == [(1, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]
    labels = spark.createDataFrame([], "label_id bigint, doc_id bigint, offensive int, rater_id string")
    assert A.rated_documents(docs, labels) == []


def test_sample_is_bounded_and_averages_raters(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(5, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i, i % 2, "r") for i in range(20)] + [(90, 4, 1, "q"), (91, None, 1, "q"), (92, 3, None, "q")], "label_id bigint, doc_id bigint, offensive int, rater_id string")
    assert len(A.rated_documents(docs, labels, 7)) == 7
    assert sorted({r for _, r in A.rated_documents(docs, labels)}) == [0.0, 0.5, 1.0]


def test_long_text(spark):
    m = A.fit(noisy(DATA[:200]))
    text = doc(False) * 400 + " What a moron you are, wren. " + doc(False) * 400
    short = A.score(m, A.words(" What a moron you are, wren. "))
    assert A.score(m, A.words(text)) >= 0.8 * short > 0
