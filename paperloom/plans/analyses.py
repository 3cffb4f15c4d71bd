"""The six cross-paper analyses over the corpus relations."""

from __future__ import annotations

from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.dictionaries import BOILERPLATE_SECTIONS, CAPTION_STOPS, PROBLEM_LABEL_WORDS, SECTIONS, TERM_STOPS_INTRO, TERM_STOPS_METHOD
from paperloom.operators import corpus
from paperloom.operators import extraction as E
from paperloom.operators import vectors as V
from paperloom.operators.clusters import components, group_terms, key_terms, shared_phrases, ward_clusters
from paperloom.session import durable, together


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with idx, a number each that grows in reading order (``order``: the paper and whole places within it).

    The numbers of the places are packed side by side, so nothing is sorted or shuffled; how wide
    they are is asked of the rows first. Where 63 bits can't hold them the rows are ranked instead.
    """
    largest = rows.agg(*(F.max(F.abs(F.col(c).cast("long"))) for c in order)).first()
    widths = [int(x or 0).bit_length() for x in largest]
    if sum(widths) > 62:
        return ranked(rows, *order)
    idx = F.col(order[0]).cast("long")
    for name, width in zip(order[1:], widths[1:]):
        idx = F.shiftleft(idx, width) + F.col(name).cast("long")
    return rows.withColumn("idx", idx)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with idx, their position from 0: counts of the ranges of a distributed sort plus the rank within a range."""
    spread = durable(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    sizes = spread.groupBy("_part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.withColumn("_n", inside).join(F.broadcast(sizes.select("_part", "before")), "_part").withColumn("idx", (F.col("before") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "before")  # a row a partition


def first_text(*names: str):
    """The first of the columns that isn't empty."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))


def all_sections(rows: DataFrame):
    return F.array_join(F.filter(F.array(*SECTIONS), lambda s: F.length(s) > 0), "\n\n")


def method_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.papers(spark, sf_dir, *SECTIONS)
    return rows.select("paper_idx", F.coalesce(F.nullif(F.col("methods"), F.lit("")), F.nullif(F.col("results"), F.lit("")), all_sections(rows)).alias("text"))


def intro_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.papers(spark, sf_dir, "introduction", "related_work", "abstract").select("paper_idx", first_text("introduction", "related_work", "abstract").alias("text"))


def word_vectors(texts: DataFrame, features: int = 5000) -> DataFrame:
    return V.vectors(texts, V.words(), features)


def char_vectors(texts: DataFrame, low: int, high: int, features: int) -> DataFrame:
    return V.vectors(texts, V.chars(low, high), features)


def similar_papers(texts: DataFrame, threshold: float) -> DataFrame:
    """(paper_a, paper_b, similarity): pairs of papers above the threshold, not rounded."""
    pairs = V.cosine_pairs(word_vectors(texts.withColumnRenamed("paper_idx", "idx")), threshold, above=True)
    return pairs.select(F.col("idx_a").alias("paper_a"), F.col("idx_b").alias("paper_b"), "similarity")


def similarity_matrix(texts: DataFrame, digits: int = 4) -> DataFrame:
    """(paper_a, paper_b, similarity): the upper half of the matrix of all papers; cells that round to 0 are left out, those of the diagonal are 1."""
    smallest = 0.5 * 10**-digits
    return similar_papers(texts, smallest - 1e-12).select("paper_a", "paper_b", F.round("similarity", digits).alias("similarity")).where("similarity > 0")


def named_matrix(texts: DataFrame, names: DataFrame, digits: int = 4) -> DataFrame:
    """(paper_a, label_a, paper_b, label_b, similarity): ``similarity_matrix`` with the labels of both papers. names: paper_idx, label."""
    named = word_vectors(texts.withColumnRenamed("paper_idx", "idx")).join(names.select(F.col("paper_idx").alias("idx"), F.col("label").alias("name")), "idx")
    pairs = V.named_pairs(named, 0.5 * 10**-digits - 1e-12)
    return pairs.select(F.col("idx_a").alias("paper_a"), F.col("name_a").alias("label_a"), F.col("idx_b").alias("paper_b"), F.col("name_b").alias("label_b"), F.round("similarity", digits).alias("similarity")).where("similarity > 0")


def edges(texts: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(paper_a, paper_b, weight): papers whose similarity, before it is rounded, is above the threshold."""
    return similar_papers(texts, threshold).select("paper_a", "paper_b", F.round("similarity", 3).alias("weight"))


def clustered(items: DataFrame, threshold: float, least: int) -> DataFrame:
    """The items (idx, paper_idx, text, other columns) with ``cluster``."""
    items = durable(items)
    found = ward_clusters(word_vectors(items.select("idx", "text")), items.select("idx"), threshold, least)
    return durable(items.join(found, "idx"))


def cluster_summary(items: DataFrame) -> DataFrame:
    """(cluster, paper_count, item_count, papers)."""
    return items.groupBy("cluster").agg(F.countDistinct("paper_idx").alias("paper_count"), F.count("*").alias("item_count"), F.concat_ws(",", F.transform(F.sort_array(F.collect_set("paper_idx")), lambda p: p.cast("string"))).alias("papers"))


def joined(members: DataFrame, *by: str) -> DataFrame:
    """(by, text): the texts of each group in the order of idx, joined by spaces."""
    return members.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))


def cluster_terms(items: DataFrame, stops: list[str], top: int, least: int = 1, whole: int = 200) -> DataFrame:
    """(idx, rank, term, score) per cluster, of the texts of all its members joined.

    Up to ``whole`` members are joined in a row; larger clusters are counted member by member. Both give the same.
    """
    large = items.groupBy("cluster").count().where(F.col("count") > whole).select("cluster")
    few = key_terms(joined(items.join(large, "cluster", "left_anti"), "cluster").withColumnRenamed("cluster", "idx"), stops, top, least)
    return few.unionByName(group_terms(items.join(large, "cluster", "left_semi"), stops, top, least))


def first_sentences(items: DataFrame, least: int, hit) -> DataFrame:
    """(cluster, hit, first): of the sentences of all members joined, the first for which ``hit`` holds and the first.

    A sentence goes over from one member to the next only where the former has no stop at its end,
    so only such runs of members are joined.
    """
    order = Window.partitionBy("cluster").orderBy("idx")
    ends = F.col("text").rlike(r"(?U)[.!?。！？]\s*$")
    starts = items.select("cluster", "idx", ends.alias("ends")).withColumn("starts", F.coalesce(F.lag("ends").over(order), F.lit(True)))
    runs = starts.select("cluster", "idx", F.max(F.when(F.col("starts"), F.col("idx"))).over(order).alias("run"))
    parts = joined(items.select("cluster", "idx", "text").join(runs, ["cluster", "idx"]), "cluster", "run").withColumn("parts", T.sentences(F.col("text"), least))
    found = parts.select("cluster", "run", F.get(F.filter("parts", hit), F.lit(0)).alias("hit"), F.get("parts", F.lit(0)).alias("first"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("run", c)))[c].alias(c)
    return found.groupBy("cluster").agg(first("hit"), first("first"))


def term_labels(terms: DataFrame, joint: str, missing: str, nodes: DataFrame) -> DataFrame:
    """(cluster, label, terms)."""
    listed = terms.groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    all_ = nodes.select(F.col("cluster").alias("idx")).distinct().join(listed, "idx", "left")
    label = F.when(F.size("terms") > 0, F.array_join(F.transform(F.slice("terms", 1, 2), T.title_case), joint)).otherwise(missing)
    return all_.select(F.col("idx").alias("cluster"), label.alias("label"), F.concat_ws(", ", "terms").alias("terms"))


def method_paragraphs(spark: SparkSession, sf_dir: str, threshold: float = 0.75) -> DataFrame:
    """(idx, paper_idx, pos, text, cluster): paragraphs on methods in clusters that span several papers."""
    parts = method_texts(spark, sf_dir).select("paper_idx", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "text")).where("length(text) > 100")
    items = clustered(numbered(parts, "paper_idx", "pos"), threshold, 2)
    return items.join(cluster_summary(items).where("paper_count >= 2").select("cluster"), "cluster", "left_semi")


def method_clusters(spark: SparkSession, sf_dir: str, threshold: float = 0.75, items: DataFrame | None = None) -> DataFrame:
    """Paragraphs on methods that several papers share: (cluster, label, terms, paper_count, item_count, papers)."""
    items = method_paragraphs(spark, sf_dir, threshold) if items is None else items
    labels = term_labels(cluster_terms(items, TERM_STOPS_METHOD, 5), " + ", "Unlabeled method cluster", items)
    return cluster_summary(items).join(labels, "cluster").select("cluster", "label", "terms", "paper_count", "item_count", "papers")


def intro_members(spark: SparkSession, sf_dir: str, threshold: float = 0.72) -> DataFrame:
    """(idx, paper_idx, text, cluster): the introduction of every paper with its cluster."""
    return clustered(intro_texts(spark, sf_dir).withColumn("idx", F.col("paper_idx")), threshold, 1)


def intro_clusters(spark: SparkSession, sf_dir: str, threshold: float = 0.72, items: DataFrame | None = None) -> DataFrame:
    """Introductions in clusters, single ones too, with label and the beginning of the first member."""
    items = intro_members(spark, sf_dir, threshold) if items is None else items
    labels = term_labels(cluster_terms(items, TERM_STOPS_INTRO, 8, 2), " | ", "Unlabeled cluster", items)
    excerpt = items.groupBy("cluster").agg(F.left(F.min_by("text", "idx"), F.lit(500)).alias("excerpt"))
    return cluster_summary(items).join(labels, "cluster").join(excerpt, "cluster").select("cluster", "label", "terms", "excerpt", "paper_count", "papers")


def section_items(spark: SparkSession, sf_dir: str, section: str, least: int) -> DataFrame:
    """(idx, paper_idx, pos, text): the sentences of a section of all papers in reading order."""
    rows = corpus.papers(spark, sf_dir, section).select("paper_idx", F.posexplode(T.sentences(F.col(section), least)).alias("pos", "text"))
    return numbered(rows, "paper_idx", "pos")


def boilerplate_members(spark: SparkSession, sf_dir: str, section: str, threshold: float = 0.65, most: int = 300) -> DataFrame:
    """(section_name, group, idx, paper_idx, pos, text): alike, not all equal sentences of a section in several papers.

    As in the interactive tool the groups are made of the first ``most`` pairs in reading order, so
    they are few and go to the sentences by broadcast: at most two rows a pair.
    """
    items = section_items(spark, sf_dir, section, 20)
    pairs = V.first_pairs(char_vectors(items.select("idx", "text"), 3, 6, 8000), threshold, most)
    members = durable(items.join(F.broadcast(components(pairs)), "idx"))
    size = members.groupBy("component").agg(F.countDistinct("text").alias("texts"), F.countDistinct("paper_idx").alias("papers")).where("texts > 1 AND papers > 1")
    return members.join(size.select("component"), "component", "left_semi").select(F.lit(section).alias("section_name"), F.col("component").alias("group"), "idx", "paper_idx", "pos", "text")


def boilerplate_groups(members: DataFrame) -> DataFrame:
    """(section_name, group, phrase, paper_count, sentence_count) of boilerplate members."""
    keys = ["section_name", "group"]
    # pairs within a group: at most those of the members of the first pairs
    both = members.select(*keys, F.col("idx").alias("ia"), F.col("text").alias("text_a")).join(members.select(*keys, F.col("idx").alias("ib"), F.col("text").alias("text_b")), keys).where("ia < ib")
    best = shared_phrases(both).groupBy(*keys).agg(F.max_by("phrase", F.struct(F.length("phrase"), -F.col("ia"), -F.col("ib"))).alias("phrase"))
    phrase = F.when(F.length("phrase") > 0, F.col("phrase")).otherwise("(similar wording)")
    size = members.groupBy(*keys).agg(F.countDistinct("paper_idx").alias("paper_count"), F.count("*").alias("sentence_count"))
    return size.join(best, keys).select(*keys, phrase.alias("phrase"), "paper_count", "sentence_count")


def boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boilerplate members of all six sections."""
    return reduce(DataFrame.unionByName, together(*(partial(boilerplate_members, spark, sf_dir, section) for section in BOILERPLATE_SECTIONS)))


def background_overlap(spark: SparkSession, sf_dir: str, threshold: float = 0.72, most: int = 200, top: int = 50) -> DataFrame:
    """(paper_a, pos_a, paper_b, pos_b, similarity, text_a, text_b): alike introduction sentences of different papers."""
    items = section_items(spark, sf_dir, "introduction", 25)
    pairs = V.first_pairs(char_vectors(items.select("idx", "text"), 4, 7, 5000), threshold, most)
    found = with_texts(pairs, items).where("paper_a <> paper_b").withColumn("similarity", F.round("similarity", 4))
    return found.orderBy(F.desc("similarity"), "idx_a", "idx_b").limit(top).select("paper_a", "pos_a", "paper_b", "pos_b", "similarity", "text_a", "text_b")


def with_texts(pairs: DataFrame, items: DataFrame, *place: str) -> DataFrame:
    """The few pairs (bounded by their maker) with the papers, places and texts (300 characters) of both sides; the items stay where they are."""
    pairs, place = durable(pairs), place or ("pos",)
    wanted = pairs.select(F.explode(F.array("idx_a", "idx_b")).alias("idx")).distinct()
    own = durable(items.join(F.broadcast(wanted), "idx", "left_semi").select("idx", "paper_idx", *(F.col(c).cast("long") if c == "pos" else F.col(c) for c in place), F.left("text", F.lit(300)).alias("text")))
    side = lambda x: own.select(*(F.col(c).alias(f"{names.get(c, c)}_{x}") for c in own.columns))
    names = {"paper_idx": "paper"}
    return pairs.join(side("a"), "idx_a").join(side("b"), "idx_b")


def similar_sentences(spark: SparkSession, sf_dir: str, threshold: float = 0.65, most: int = 500) -> DataFrame:
    """(paper_a, section_name_a, pos_a, the same of b, similarity, text_a, text_b): the first ``most`` alike pairs of sentences of all sections in reading order."""
    rows = corpus.section_sentences(corpus.sections(corpus.papers(spark, sf_dir, *SECTIONS)), 20).withColumnRenamed("sentence", "text")
    items = numbered(rows, "paper_idx", "section_ord", "pos")
    pairs = V.first_pairs(char_vectors(items.select("idx", "text"), 3, 6, 8000), threshold, most)
    found = with_texts(pairs, items, "section_name", "pos")
    return found.select(*(f"{c}_{x}" for x in "ab" for c in ("paper", "section_name", "pos")), F.round("similarity", 4).alias("similarity"), "text_a", "text_b")


def problem_members(spark: SparkSession, sf_dir: str, threshold: float = 0.72) -> DataFrame:
    """(idx, paper_idx, text, cluster): the problem sentences of all papers with their cluster."""
    rows = E.problem_sentences(corpus.papers(spark, sf_dir, "language", *SECTIONS)).select("paper_idx", "section_ord", "pos", F.col("sentence").alias("text"))
    return clustered(numbered(rows, "paper_idx", "section_ord", "pos"), threshold, 1)


def problem_labels(items: DataFrame) -> DataFrame:
    """(cluster, label): the first sentence with a problem word, else the first."""
    found = first_sentences(items, 15, lambda s: F.exists(F.array(*(F.lit(w) for w in PROBLEM_LABEL_WORDS)), lambda w: F.contains(F.lower(s), w)))
    best = F.coalesce("hit", "first")
    return found.select("cluster", F.when(best.isNull(), "Unlabeled problem").when(F.length(best) > 120, F.concat(F.left(best, F.lit(117)), F.lit("..."))).otherwise(best).alias("label"))


def problem_clusters(spark: SparkSession, sf_dir: str, threshold: float = 0.72, items: DataFrame | None = None) -> DataFrame:
    """(cluster, label, paper_count, problem_count, papers)."""
    items = problem_members(spark, sf_dir, threshold) if items is None else items
    return cluster_summary(items).join(problem_labels(items), "cluster").select("cluster", "label", "paper_count", F.col("item_count").alias("problem_count"), "papers")


def problem_matrix(spark: SparkSession, sf_dir: str, threshold: float = 0.72) -> DataFrame:
    """(paper_idx, cluster): the ones of the paper by cluster grid; all its other cells are 0."""
    return problem_members(spark, sf_dir, threshold).select("paper_idx", "cluster").distinct()


def problem_focus(spark: SparkSession, sf_dir: str, top: int = 10) -> DataFrame:
    """(paper_idx, rank, term, weight): the terms of highest weight of abstract and introduction."""
    texts = corpus.papers(spark, sf_dir, "abstract", "introduction").select(F.col("paper_idx").alias("idx"), F.concat_ws(" ", "abstract", "introduction").alias("text"))
    vectors = V.tfidf(texts, V.words(False), 200, blank=False)
    rank = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc(F.round("w", 9)), F.desc("term")))
    return vectors.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("idx").alias("paper_idx"), F.col("rank").cast("long").alias("rank"), "term", F.round("w", 4).alias("weight"))


def caption_labels(items: DataFrame) -> DataFrame:
    """(cluster, label): the first 50 words of the captions joined, without stop words; the first 50 captions with a word hold them."""
    tokens = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: F.length(w) > 0)
    worded = items.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.when(F.size(tokens) > 0, 0).otherwise(1), "idx"))).where(F.col("n") <= 50)
    stops = F.array(*(F.lit(w) for w in CAPTION_STOPS))
    words = F.array_join(F.filter(F.slice(tokens, 1, 50), lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w)), " ")
    label = F.when(F.length("words") == 0, "Unlabeled figure group").when(F.length("words") > 100, F.concat(F.left("words", F.lit(97)), F.lit("..."))).otherwise(F.col("words"))
    return joined(worded, "cluster").withColumn("words", words).select("cluster", label.alias("label"))


def figure_members(spark: SparkSession, sf_dir: str, threshold: float = 0.70) -> DataFrame:
    """(idx, paper_idx, place, index, text, has_image, discussion_paragraphs, cluster): figures in groups of alike captions of several papers."""
    caps = corpus.figures(corpus.papers(spark, sf_dir, "figures")).where("length(caption) > 10").withColumnRenamed("caption", "text")
    items = clustered(numbered(caps, "paper_idx", "place"), threshold, 2)
    return items.join(cluster_summary(items).where("paper_count >= 2").select("cluster"), "cluster", "left_semi")


def figure_groups(spark: SparkSession, sf_dir: str, threshold: float = 0.70, items: DataFrame | None = None) -> DataFrame:
    """(cluster, label, paper_count, figure_count, papers): alike captions in several papers."""
    items = figure_members(spark, sf_dir, threshold) if items is None else items
    return cluster_summary(items).join(caption_labels(items), "cluster").select("cluster", "label", "paper_count", F.col("item_count").alias("figure_count"), "papers")


def wording(texts: list[str], threshold: float, most: int, top: int) -> list[tuple[str, float, str, str]]:
    """``discussion_patterns`` of the discussions of one group."""
    cut, counts = V.chars(4, 7), []
    for text in texts:
        counts.append(Counter(cut(text if text.strip() else V.BLANK)))
    total, df = Counter(), Counter()
    for own in counts:
        total.update(own)
        df.update(own.keys())
    number = {t: k for k, t in enumerate(sorted(total, key=lambda t: (-total[t], t))[:3000])}
    idf = np.log((1.0 + len(texts)) / (1.0 + np.array([df[t] for t in number]))) + 1.0
    rows = []
    for own in counts:
        at = np.array(sorted(number[t] for t in own if t in number), np.int64)
        name = list(number)
        w = np.array([own[name[k]] for k in at]) * idf[at] if len(at) else np.zeros(0)
        rows.append((at, w / np.sqrt(w @ w) if len(at) else w))
    index = V.Postings(np.arange(len(rows)), np.array([len(t) for t, _ in rows]), np.concatenate([t for t, _ in rows]), np.concatenate([w for _, w in rows]))
    pairs: list[tuple[float, int, int]] = []
    for i, (t, w) in enumerate(rows):
        s = index.products(t, w)
        pairs += [(-round(float(s[j]), 4), i, int(j)) for j in np.flatnonzero(V.kept_pairs(s, threshold, False)) if j > i][: most - len(pairs)]
        if len(pairs) >= most:
            break
    return [(-s, texts[i][:300], texts[j][:300]) for s, i, j in sorted(pairs)[:top]]


def discussion_patterns(spark: SparkSession, sf_dir: str, threshold: float = 0.68, most: int = 50, items: DataFrame | None = None, held: int = 2_000) -> DataFrame:
    """(cluster, place, phrase, similarity, text_a, text_b): wording that the discussions of a figure group share, each phrase once, at most ten a group.

    A group of three and more discussions has vectors and pairs of its own. A group of up to ``held``
    is one task; a larger one goes through the distributed operators, with the same result.
    """
    items = figure_members(spark, sf_dir) if items is None else items
    told = items.select("cluster", "paper_idx", F.col("place"), F.posexplode("discussion_paragraphs").alias("pos", "text")).withColumn("text", T.text_of("text"))
    sizes = durable(told.groupBy("cluster").count().where("count >= 3"))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("paper_idx", "ascending"), ("place", "ascending"), ("pos", "ascending")])
        found = wording(table["text"].to_pylist(), threshold, most, 20)
        return pa.table({"cluster": pa.array([table["cluster"][0].as_py()] * len(found), pa.int64()), "place": pa.array(range(len(found)), pa.int64()), "similarity": pa.array([f[0] for f in found], pa.float64()), "text_a": pa.array([f[1] for f in found], pa.string()), "text_b": pa.array([f[2] for f in found], pa.string())})

    small = told.join(sizes.where(F.col("count") <= held).select("cluster"), "cluster", "left_semi")
    pairs = small.groupBy("cluster").applyInArrow(one, "cluster long, place long, similarity double, text_a string, text_b string")
    for row in sizes.where(F.col("count") > held).toLocalIterator():
        own = numbered(told.where(F.col("cluster") == row.cluster), "paper_idx", "place", "pos")
        near = V.first_pairs(char_vectors(own.select("idx", "text"), 4, 7, 3000), threshold, most)
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "idx_a", "idx_b")
        ranked_ = with_texts(near, own).withColumn("similarity", F.round("similarity", 4)).withColumn("place", F.row_number().over(order) - 1).where("place < 20")  # of at most ``most`` pairs
        pairs = pairs.unionByName(ranked_.select(F.lit(row.cluster).cast("long").alias("cluster"), F.col("place").cast("long").alias("place"), "similarity", "text_a", "text_b"))
    found = shared_phrases(pairs, 15).where("phrase <> ''")
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("cluster", "phrase").orderBy("place"))).where("n = 1")
    kept = first.withColumn("place", (F.row_number().over(Window.partitionBy("cluster").orderBy("place")) - 1).cast("long")).where("place < 10")
    short = lambda c: F.left(c, F.lit(250)).alias(c)
    return kept.select("cluster", "place", F.left("phrase", F.lit(200)).alias("phrase"), "similarity", short("text_a"), short("text_b"))


def question_members(spark: SparkSession, sf_dir: str, threshold: float = 0.70) -> DataFrame:
    """(idx, paper_idx, text, cluster): the open questions of all papers with their cluster."""
    rows = E.question_sentences(corpus.papers(spark, sf_dir, *SECTIONS)).select("paper_idx", "section_ord", "pos", F.col("sentence").alias("text"))
    return clustered(numbered(rows, "paper_idx", "section_ord", "pos"), threshold, 1)


def question_clusters(spark: SparkSession, sf_dir: str, threshold: float = 0.70, items: DataFrame | None = None) -> DataFrame:
    """(cluster, kind, summary, paper_count, question_count, papers): convergent (several papers) and unique questions."""
    items = question_members(spark, sf_dir, threshold) if items is None else items
    summary = F.coalesce(F.col("hit"), F.left("first", F.lit(150)), F.lit("Unlabeled question"))
    labels = first_sentences(items, 15, lambda s: (F.length(s) > 30) & (F.length(s) < 150)).select("cluster", summary.alias("summary"))
    counted = cluster_summary(items).withColumn("kind", F.when(F.col("paper_count") >= 2, "convergent").otherwise("unique"))
    return counted.join(labels, "cluster").select("cluster", "kind", "summary", "paper_count", F.col("item_count").alias("question_count"), "papers")


def gap_groups(spark: SparkSession, sf_dir: str, threshold: float = 0.70) -> DataFrame:
    """(paper_idx, text, group_id): research gaps with the group of alike ones."""
    rows = E.gap_sentences(corpus.papers(spark, sf_dir, *SECTIONS))
    items = clustered(numbered(rows, "paper_idx", "section_ord", "pos").select("idx", "paper_idx", "text"), threshold, 1)
    return items.select("paper_idx", "text", F.col("cluster").alias("group_id"))


def listed(items: DataFrame, spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """(cluster, paper_idx, paper_label, text): the members of clusters as a reader sees them."""
    labels = corpus.papers(spark, sf_dir, "title", "source").select("paper_idx", T.label(F.col("title"), F.col("source")).alias("paper_label"))
    return items.select("cluster", "paper_idx", F.left("text", F.lit(most)).alias("text")).join(labels, "paper_idx").select("cluster", "paper_idx", "paper_label", "text")
