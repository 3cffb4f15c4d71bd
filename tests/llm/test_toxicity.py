"""A sentence counts for every category that it belongs to."""

import numpy as np

from paperloom.llm import toxicity


def test_a_sentence_of_two_categories():
    weights = {}
    for category, word in (("abuse", "clown"), ("hate", "foreigners")):
        w = np.zeros(toxicity.DIMENSIONS)
        w[toxicity.indices([word])] = 20 if category == "abuse" else 30
        weights[category] = (w, -2.0)
    model = toxicity.Classifiers(weights, {})
    both, one, none = model.scores(["you clown foreigners", "you clown", "you"])
    assert both[0] > toxicity.THRESHOLD and both[1] > toxicity.THRESHOLD and both[2] == 0
    assert abs(both[0] - 1 / (1 + np.exp(-(20 / 6**0.5 - 2)))) < 1e-4  # its own classifier's score
    assert one[0] > toxicity.THRESHOLD > one[1] and max(none) < toxicity.THRESHOLD


def test_features_of_many_sentences_are_those_of_each():
    some = [["you", "clown"], ["a"], ["the", "kiln", "the", "kiln", "the"], ["w***m", "x"]]
    masked = {("w", "m", 5): ["worm!"[:4] + "s"]}
    columns, sizes = toxicity.features(some, masked)
    parts = np.split(columns, np.cumsum(sizes)[:-1])
    assert all(np.array_equal(p, toxicity.indices(s, masked)) and len(set(p.tolist())) == len(p) for p, s in zip(parts, some))
    assert len(parts[2]) == 2 + 2 + 2 and np.array_equal(toxicity.indices(["worms", "x"]), parts[3])


def test_plain_text_of_sentences_at_once():
    text = "You id1ot! Н0rny p0rn. WORD!3 aaaa-bb. Ⅷ ﬁne H₂O 中 文 w***m. x2y stuuupid! Ωmega c.r.e.t.i.n now."
    whole = toxicity.opened(text)
    each = [toxicity.plain(whole[a:b]) for a, b in toxicity.sentence_spans(whole)]
    assert toxicity.plain("\n".join(whole[a:b] for a, b in toxicity.sentence_spans(whole))) == "\n".join(each) and len(each) > 3
    assert ["you", "idiot"] in toxicity.units(text)


def test_samples_are_bounded_in_characters(spark):
    d = spark.createDataFrame([(i, "The kiln is warm. " * 10, "s") for i in range(40)] + [(3, "again", "s")], "doc_id long, text string, source string")
    r = spark.createDataFrame([(i, i, "r", "abuse", 1) for i in range(20)], "rating_id long, doc_id long, rater string, category string, severity int")
    whole = toxicity.training_sample(d, r, 100, 100)
    assert len(whole.pool) == 10 * 40 + 1 and sum(v["abuse"] for _, v in whole.bags) == 21
    small = toxicity.training_sample(d, r, 100, 100, 1_000)
    assert len(small.pool) <= 51 and 0 < sum(v["abuse"] for _, v in small.bags) <= 6


def test_queries_over_the_same_tables_are_trained_once(spark, monkeypatch):
    d = spark.createDataFrame([(i, "The kiln is warm. You clown." if i % 3 == 0 else "The kiln is warm.", "s") for i in range(30)], "doc_id long, text string, source string")
    r = spark.createDataFrame([(i, i, "r", "abuse" if i % 3 == 0 else "none", 1) for i in range(20)], "rating_id long, doc_id long, rater string, category string, severity int")
    times = []
    real = toxicity.newly_trained
    monkeypatch.setattr(toxicity, "newly_trained", lambda *a: times.append(1) or real(*a))
    toxicity.found_content(d, r).count()
    toxicity.content_rates(d, r).count()
    assert len(times) == 1
    toxicity.found_content(d.where("doc_id < 20"), r).count()
    assert len(times) == 2
