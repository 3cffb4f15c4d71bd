"""Labels and terms speak for all members of a cluster."""

from paperloom.functions.dictionaries import TERM_STOPS_METHOD
from paperloom.operators import clusters as C
from paperloom.plans import analyses as A


def members(spark, texts):
    return spark.createDataFrame([(7, i, i % 5, t) for i, t in enumerate(texts)], "cluster long, idx long, paper_idx long, text string")


def test_terms_of_all_members(spark):
    texts = ["Kiln wavelet", "x", "harbour", "the of", "lattice-enzyme basin harbour"] * 60 + ["quarry meadow furnace"] * 150
    items = members(spark, texts)
    expected = C.ranked_terms(" ".join(texts), TERM_STOPS_METHOD, 12, 2)
    for whole in (1, 200, 10_000):
        got = sorted((r.rank, r.term, r.score) for r in A.cluster_terms(items, TERM_STOPS_METHOD, 12, 2, whole).collect())
        assert [(t, s) for _, t, s in got] == expected


def test_problem_label_after_many_members(spark):
    late = members(spark, ["The kiln was fired in spring."] * 230 + ["No stop here but it goes", "on with a limitation of kilns. And more."])
    assert A.problem_labels(late).first().label == "No stop here but it goes on with a limitation of kilns."
    assert A.problem_labels(members(spark, ["short.", "The kiln was fired in spring."])).first().label == "The kiln was fired in spring."


def test_caption_label_skips_blank_captions(spark):
    assert A.caption_labels(members(spark, [" " * 12] * 220 + ["Kiln wavelet of the harbour"])).first().label == "kiln wavelet harbour"
