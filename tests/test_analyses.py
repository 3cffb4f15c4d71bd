"""The analyses without SQL against plain Python on the smallest tables and on hand-made papers."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from test_vectors import naive_ward

from paperloom.functions import dictionaries as D
from paperloom.operators import vectors as V
from paperloom.operators.clusters import shared_phrase
from paperloom.plans import analyses as A
from paperloom.plans import report as R
from paperloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def naive_clusters(texts, threshold):
    """Sets of positions: word TF-IDF of all texts and Ward, texts without terms at distance 0 from all."""
    counts = [Counter(V.word_tokens(t if t.strip() else "placeholder")) for t in texts]
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    terms = sorted(total, key=lambda t: (-total[t], t))[:5000]
    m = np.array([[c[t] * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in terms] for c in counts])
    norm = np.linalg.norm(m, axis=1)
    unit = m / np.where(norm > 0, norm, 1)[:, None]
    d = np.clip(1 - unit @ unit.T, 0, 2)
    d[norm == 0, :] = d[:, norm == 0] = 0
    return naive_ward(d, 1 - threshold)


def found_clusters(items):
    rows = sorted((r.idx, r.cluster, r.text) for r in items.select("idx", "cluster", "text").collect())
    groups = {}
    for k, (_, cluster, _) in enumerate(rows):
        groups.setdefault(cluster, set()).add(k)
    return [t for _, _, t in rows], {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("members, threshold", [(A.intro_members, 0.72), (A.problem_members, 0.72), (A.question_members, 0.70)])
def test_clusters_equal_plain_ward(spark, members, threshold):
    texts, groups = found_clusters(members(spark, DATA))
    assert len(texts) > 5 and groups == naive_clusters(texts, threshold)


def written(spark, path, rows):
    """Papers with the given columns, all other texts empty."""
    schema = spark.read.parquet(f"{DATA}/paper.parquet").schema
    spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema).coalesce(1).write.parquet(f"{path}/paper.parquet")
    return str(path)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    para = "The porous membrane was held at constant pressure while the flow near the bank was read out by two sensors at {} degrees, as in all series."
    told = "As Figure {} shows, the flow of the basin grows with the pressure until the membrane begins to leak at {} bar."
    rows = []
    for i in range(6):
        figures = [(1, f"Flow of the basin against pressure at the membrane, series {'A' if i % 2 else 'B'}", 1, None, b"x" if i == 0 else None, [told.format(1, i + 3), told.format(1, i + 4)]), (2, "Fig", 2, None, None, [])]
        rows.append({"paper_idx": i, "source": f"s{i}", "title": f"A study number {i} of flows", "methods": para.format(i) if i < 4 else "Nothing of the kind was done here, as the archive of letters was read by hand and copied twice for both of the readers.", "introduction": f"However, little is known of basin {i}. The flow remains unclear.", "discussion": "Further research is needed on the leak of membranes.", "conclusion": para.format(i + 1), "full_text": para.format(i), "figures": figures, "language": "en"})
    rows.append(rows[2])  # delivered twice
    rows.append({"paper_idx": 9, "source": "s9"})
    rows.append({"paper_idx": None, "source": "s10", "methods": para.format(1)})
    return written(spark, tmp_path_factory.mktemp("corpus"), rows)


def test_report_counts_are_those_of_the_analyses(spark, corpus):
    got = {r.item: r.n for r in R.summary_counts(spark, corpus).collect()}
    methods = [r for r in QUERIES["method_clusters"](spark, corpus).collect()]
    assert got["papers"] == 7 and got["method_clusters"] == len(methods) >= 1 and max(m.paper_count for m in methods) >= 4
    texts, groups = found_clusters(A.question_members(spark, corpus))
    assert groups == naive_clusters(texts, 0.70)
    kinds = Counter(r.kind for r in QUERIES["question_clusters"](spark, corpus).collect())
    assert (got["convergent_questions"], got["unique_questions"]) == (kinds["convergent"], kinds["unique"]) and kinds["convergent"] >= 1
    assert got["figure_groups"] == QUERIES["figure_groups"](spark, corpus).count() >= 1
    overview = {r.metric: r.n for r in R.overview(spark, corpus).collect()}
    assert overview == {"papers": 7, "shared_methods": got["method_clusters"], "routine_expressions": got["boilerplate_groups"], "convergent_gaps": got["convergent_questions"]}
    items = QUERIES["method_paragraphs"](spark, corpus).collect()
    assert {r.paper_label for r in items} >= {"A study number 0..."} and all(len(r.text) <= 500 for r in items)
    assert sum(r.has_image for r in QUERIES["figure_items"](spark, corpus).collect()) == 1
    assert {r.item: r.n for r in QUERIES["figure_stats"](spark, corpus).collect()}["total_figures"] == 6
    assert {r.item: r.n for r in QUERIES["question_stats"](spark, corpus).collect()}["total_questions"] == len(texts)


def naive_patterns(texts, threshold=0.68):
    grams = []
    for t in texts:
        t = re.sub(r"\s\s+", " ", t.lower())
        grams.append(Counter(t[k : k + n] for n in range(4, 8) for k in range(len(t) - n + 1)))
    total, df = Counter(), Counter()
    for g in grams:
        total.update(g)
        df.update(g.keys())
    terms = sorted(total, key=lambda t: (-total[t], t))[:3000]
    m = np.array([[g[t] * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in terms] for g in grams])
    s = (m / np.linalg.norm(m, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if s[i, j] >= threshold - 1e-12][:50]
    out = []
    for i, j in sorted(pairs, key=lambda p: -round(s[p], 4))[:20]:
        phrase = shared_phrase(texts[i][:300], texts[j][:300], 15)
        if phrase and phrase not in out:
            out.append(phrase)
    return out[:10]


@pytest.mark.parametrize("held", [2_000, 2])
def test_discussion_patterns(spark, corpus, held):
    items = A.figure_members(spark, corpus)
    found = A.discussion_patterns(spark, corpus, items=items, held=held).orderBy("cluster", "place").collect()
    expected = {}
    for r in sorted(items.collect(), key=lambda r: r.idx):
        expected.setdefault(r.cluster, []).extend(r.discussion_paragraphs)
    expected = [(c, p) for c, texts in sorted(expected.items()) if len(texts) >= 3 for p in naive_patterns(texts)]
    assert [(r.cluster, r.phrase) for r in found] == expected and len(found) >= 1
    assert A.discussion_patterns(spark, DATA).count() == 0 if not QUERIES["figure_groups"](spark, DATA).count() else True


def test_shared_phrase_is_the_longest_run():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (" ".join(rng.choice(["ab", "abc", "b", "c", "da"], rng.integers(0, 60))) for _ in range(2))
        words = a.split()
        runs = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 3, min(i + 39, len(words)) + 1)]
        inside = [r for r in runs if r in b]
        best = max(inside, key=len, default="")
        assert shared_phrase(a, b, 10) == (best if len(best) >= 10 else "")


def test_captions_equal_the_patterns(spark):
    texts = {r.paper_idx: r.full_text or "" for r in spark.read.parquet("/root/testdata/sf0.01/paper.parquet").where("paper_idx IS NOT NULL").select("paper_idx", "full_text").collect()}
    for query, english, chinese in (("figure_captions", D.FIGURE_CAPTION_EN, D.FIGURE_CAPTION_ZH), ("table_captions", D.TABLE_CAPTION_EN, D.TABLE_CAPTION_ZH)):
        expected = {(i, n, c.strip()) for i, t in texts.items() for n, c in enumerate([m[1] for m in re.finditer(english, t, re.S | re.I)] + [m[1] for m in re.finditer(chinese, t, re.S)], 1)}
        assert {tuple(r) for r in QUERIES[query](spark, "/root/testdata/sf0.01").collect()} == expected and expected


def test_no_headings(spark, tmp_path):
    rows = [(1, 0, "Some line of text", 10.0), (1, 1, "Another line", None), (2, 0, "Results", 10.0), (2, 1, "Body", 10.0)]
    spark.createDataFrame(rows, "paper_idx long, line_no int, text string, font_size double").write.parquet(f"{tmp_path}/line.parquet")
    assert [r.paper_idx for r in QUERIES["no_heading_papers"](spark, str(tmp_path)).collect()] == [1]


def test_report_text(spark, corpus):
    text = R.analysis_report(spark, corpus, "2020-01-01 00:00")
    assert text.count("\n## ") == 7 and "- **7** papers" in text and "[A study number 0...]" in text and text.endswith("Made on 2020-01-01 00:00.\n")
    assert "<h2>Figures</h2>" in R.html_report(text)


def test_numbers_of_wide_places(spark):
    rows = spark.createDataFrame([(1 << 50, 1, 1 << 20), (1 << 50, 0, 7), (3, 5, 5)], "paper_idx long, place long, pos long")
    assert [r.paper_idx for r in A.numbered(rows, "paper_idx", "place", "pos").orderBy("idx").collect()] == [3, 1 << 50, 1 << 50]
    small = A.numbered(rows.where("paper_idx = 3"), "paper_idx", "place", "pos").first()
    assert small.idx == (3 << 6) + (5 << 3) + 5


def test_gap_groups_and_what_charts_show(spark, corpus):
    rows = QUERIES["gap_groups"](spark, corpus).collect()
    texts = [r.text for r in sorted(rows, key=lambda r: (r.group_id, r.paper_idx, r.text))]
    groups = Counter(r.group_id for r in rows)
    assert sorted(groups.values()) == sorted(len(g) for g in naive_clusters(texts, 0.70)) and len(rows) >= 6
    assert all(len({r.group_id for r in rows if r.text == t}) == 1 for t in set(texts))
    questions = {r.cluster: r for r in QUERIES["question_clusters"](spark, corpus).collect()}
    shown = QUERIES["chart_open_questions"](spark, corpus).collect()
    assert {(r.cluster, r.label, r.papers) for r in shown} == {(q.cluster, q.summary[:80], q.paper_count if q.kind == "convergent" else 1) for q in questions.values()}
    intros = QUERIES["intro_clusters"](spark, corpus).collect()
    members = Counter(r.cluster for r in QUERIES["intro_members"](spark, corpus).collect())
    assert {r.cluster: r.paper_count for r in intros} == dict(members) and sum(members.values()) == 7
    problems = QUERIES["problem_clusters"](spark, corpus).collect()
    assert {(r.cluster, r.paper_idx) for r in QUERIES["problem_matrix"](spark, corpus).collect()} == {(r.cluster, int(p)) for r in problems for p in r.papers.split(",")}
