"""One query per operator and analysis, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.dictionaries import COVERED_SECTIONS, QUESTION_PATTERNS_SHORT, SECTIONS, TERM_STOPS_INTRO, TERM_STOPS_METHOD
from paperloom.operators import clusters as C
from paperloom.operators import corpus
from paperloom.operators import extraction as E
from paperloom.operators import structure as S
from paperloom.operators import vectors as V
from paperloom.plans import analyses as A
from paperloom.plans import report as R
from paperloom.session import table
from paperloom.sources import arxiv
from paperloom.sources.mapping import batches, map_with_errors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


long = lambda c: F.col(c).cast("long").alias(c)


# text functions
@query
def lines(s, d):
    return corpus.lines(corpus.papers(s, d, "full_text"))


@query
def sentences(s, d):
    return corpus.section_sentences(corpus.sections(corpus.papers(s, d, *SECTIONS)), 10).select("paper_idx", "section_name", long("pos"), "sentence")


@query
def sentences_short(s, d):
    return corpus.section_sentences(corpus.sections(corpus.papers(s, d, *SECTIONS)), 6).select("paper_idx", "section_name", long("pos"), "sentence")


@query
def paragraphs(s, d):
    rows = corpus.sections(corpus.papers(s, d, *SECTIONS))
    return rows.select("paper_idx", "section_name", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "text")).select("paper_idx", "section_name", long("pos"), "text")


@query
def clean_text(s, d):
    return corpus.papers(s, d, "full_text").select("paper_idx", T.clean_text(F.col("full_text")).alias("text"))


@query
def normalize_sentence(s, d):
    rows = corpus.section_sentences(corpus.sections(corpus.papers(s, d, *SECTIONS)), 10)
    return rows.select("paper_idx", "section_name", long("pos"), T.normalize_sentence(F.col("sentence")).alias("text"))


@query
def text_stats(s, d):
    return corpus.papers(s, d, "full_text").select("paper_idx", *(c.alias(k) for k, c in T.text_stats(F.col("full_text")).items()))


@query
def detect_language(s, d):
    return corpus.papers(s, d, "full_text").select("paper_idx", T.detect_language(F.col("full_text")).alias("detected"))


@query
def text_hash(s, d):
    return corpus.papers(s, d, "full_text").select("paper_idx", F.md5(F.col("full_text").cast("binary")).alias("text_hash"))


@query
def short_label_4(s, d):
    return corpus.papers(s, d, "title", "source").select("paper_idx", T.label(F.col("title"), F.col("source")).alias("label"))


@query
def short_label_5(s, d):
    return corpus.papers(s, d, "title", "source").select("paper_idx", T.label(F.col("title"), F.col("source"), 5, 40, 60).alias("label"))


@query
def all_section_text(s, d):
    rows = corpus.papers(s, d, *SECTIONS)
    return rows.select("paper_idx", A.all_sections(rows).alias("text"))


@query
def batches_of_papers(s, d):
    return batches(corpus.papers(s, d, "source"), "paper_idx", 64).groupBy("batch").agg(F.count("*").alias("n"), F.min("paper_idx").alias("first_idx"))


# structure
def line_table(s, d):
    return table(s, d, "line").select("paper_idx", "line_no", "text", "font_size").distinct()


@query
def heading_match(s, d):
    return line_table(s, d).select("paper_idx", long("line_no"), S.heading(F.col("text"), 50).alias("section_name")).where("section_name IS NOT NULL").distinct()


@query
def section_segments(s, d):
    return S.segmented(line_table(s, d).groupBy("paper_idx", "line_no").agg(F.min_by("text", F.struct("text")).alias("text"), F.max("font_size").alias("font_size")))


@query
def no_heading_papers(s, d):
    marked = line_table(s, d).groupBy("paper_idx").agg(F.count(S.heading(F.col("text"), 50)).alias("headings"))
    return marked.where("headings = 0").select("paper_idx")


@query
def font_headings(s, d):
    rows = S.boundaries(line_table(s, d).groupBy("paper_idx", "line_no").agg(F.min_by("text", F.struct("text")).alias("text"), F.max("font_size").alias("font_size")))
    return rows.where("heading IS NOT NULL").select("paper_idx", long("line_no"), "heading")


@query
def missing_section_fill(s, d):
    return S.filled_sections(corpus.papers(s, d, "full_text", "methods", "results", "discussion", "conclusion"))


@query
def section_coverage(s, d):
    rows = corpus.papers(s, d, *COVERED_SECTIONS)
    grid = F.array(*(F.struct(F.lit(n).alias("section_name"), (F.length(n) > 0).cast("int").alias("present")) for n in COVERED_SECTIONS))
    return rows.select("paper_idx", F.explode(grid).alias("g")).select("paper_idx", "g.*")


@query
def paper_metadata(s, d):
    return S.metadata(corpus.papers(s, d, "full_text", "source"))


@query
def section_coverage_matrix(s, d):
    return section_coverage(s, d).groupBy("paper_idx").pivot("section_name", COVERED_SECTIONS).agg(F.max("present"))


@query
def loaded_papers(s, d):
    n = sum((F.length(c) > 0).cast("long") for c in COVERED_SECTIONS)
    title = F.coalesce(F.nullif(F.left("title", F.lit(100)), F.lit("")), F.lit("(unknown)"))
    return corpus.papers(s, d, "title", "source", "language", *COVERED_SECTIONS).select("paper_idx", title.alias("title"), F.left("source", F.lit(40)).alias("source"), "language", n.alias("sections"))


@query
def dedup_by_source(s, d):
    return S.deduplicated(corpus.papers(s, d, "source"), ["paper_idx"])


@query
def incremental_dedup(s, d):
    rows = corpus.papers(s, d, "source", "year")
    return S.deduplicated(rows.where("year IS NULL OR year >= 2015"), ["paper_idx"], rows.where("year < 2015")).select("source", "paper_idx")


@query
def figure_captions(s, d):
    return S.captions(corpus.papers(s, d, "full_text"))


@query
def table_captions(s, d):
    return S.captions(corpus.papers(s, d, "full_text"), "table")


@query
def figure_discussions(s, d):
    return S.figure_discussions(corpus.papers(s, d, "full_text", "figures"))


# sources
@query
def parse_arxiv_id(s, d):
    return table(s, d, "arxiv_id_input").select("input_id", arxiv.arxiv_id(F.col("raw")).alias("arxiv_id"))


@query
def arxiv_input_parts(s, d):
    return arxiv.input_parts(table(s, d, "arxiv_id_input"))


@query
def metadata_papers(s, d):
    return arxiv.metadata_paper(table(s, d, "arxiv_meta")).select("source", "title", "year", "doi", "abstract", "introduction", "full_text")


@query
def map_errors(s, d):
    return map_with_errors(table(s, d, "arxiv_id_input").select("input_id", F.regexp_extract(F.coalesce("raw", F.lit("")), r"(\d+)", 1).alias("number")), "input_id", "number", lambda x: int(x) % 97).select("input_id", "value", F.substring_index("error", ":", 1).alias("error"))


# extraction
@query
def problem_sentences(s, d):
    return E.problem_sentences(corpus.papers(s, d, "language", *SECTIONS)).select("paper_idx", "section_name", "pos", "sentence", "keyword")


@query
def problems_per_paper(s, d):
    rows = corpus.papers(s, d, "title", "source", "language", *SECTIONS)
    n = E.problem_sentences(rows.drop("title", "source")).groupBy("paper_idx").agg(F.count("*").alias("n"))
    return rows.select("paper_idx", T.label(F.col("title"), F.col("source")).alias("label"), F.col("source")).join(n, "paper_idx", "left").select("paper_idx", "label", "source", F.coalesce("n", F.lit(0)).cast("long").alias("problem_count"))


@query
def open_questions(s, d):
    return E.question_sentences(corpus.papers(s, d, *SECTIONS)).select("paper_idx", "section_name", "pos", "sentence")


@query
def open_questions_alt(s, d):
    return E.question_sentences(corpus.papers(s, d, *SECTIONS), QUESTION_PATTERNS_SHORT).select("paper_idx", "section_name", "pos", "sentence")


@query
def research_gaps(s, d):
    return E.gap_sentences(corpus.papers(s, d, *SECTIONS)).select("paper_idx", "section_name", "pos", "text")


@query
def method_presence(s, d):
    return E.method_presence(corpus.papers(s, d, "full_text")).select("method", "paper_idx", "present")


@query
def figure_types(s, d):
    return E.figure_types(corpus.figures(corpus.papers(s, d, "figures"))).select("figure_type", "paper_count", "total_figures")


# vectors
@query
def char_tfidf_vocab(s, d):
    texts = corpus.papers(s, d, "full_text").select(F.col("paper_idx").alias("idx"), F.col("full_text").alias("text"))
    return V.vocabulary(texts, V.chars(3, 6), 8000)


@query
def word_tfidf(s, d):
    texts = corpus.papers(s, d, "full_text").select(F.col("paper_idx").alias("idx"), F.col("full_text").alias("text"))
    return V.tfidf(texts, V.words(), 5000).select(F.col("idx").alias("paper_idx"), "term", F.round("w", 6).alias("w"))


@query
def text_similarity(s, d):
    rows = corpus.papers(s, d, "abstract", "conclusion")
    return rows.select("paper_idx", F.round(V.similarity("abstract", "conclusion"), 4).alias("similarity"))


@query
def section_similarity(s, d):
    return A.similarity_matrix(A.method_texts(s, d))


@query
def intro_similarity(s, d):
    return A.similarity_matrix(A.intro_texts(s, d))


@query
def intro_edges(s, d):
    return A.edges(A.intro_texts(s, d))


@query
def background_overlap(s, d):
    return A.background_overlap(s, d)


@query
def problem_focus(s, d):
    return A.problem_focus(s, d)


@query
def key_terms_method(s, d):
    return C.key_terms(corpus.papers(s, d, "methods").select(F.col("paper_idx").alias("idx"), F.col("methods").alias("text")), TERM_STOPS_METHOD, 5)


@query
def key_terms_intro(s, d):
    return C.key_terms(corpus.papers(s, d, "introduction").select(F.col("paper_idx").alias("idx"), F.col("introduction").alias("text")), TERM_STOPS_INTRO, 8, 2)


@query
def term_labels(s, d):
    terms = key_terms_intro(s, d)
    nodes = corpus.papers(s, d, "title").select(F.col("paper_idx").alias("cluster"))
    return A.term_labels(terms, " | ", "Unlabeled cluster", nodes).select("cluster", "label")


# analyses
@query
def similar_pairs(s, d):
    return A.similar_sentences(s, d)


@query
def pair_groups(s, d):
    pairs = A.similar_papers(A.intro_texts(s, d), 0.55).select(F.col("paper_a").alias("idx_a"), F.col("paper_b").alias("idx_b"))
    return C.components(pairs)


def grouped(members):
    """Boilerplate groups named by the paper and sentence of their first member."""
    first = members.groupBy("section_name", "group").agg(F.min_by(F.struct("paper_idx", long("pos")), "idx").alias("f"))
    return A.boilerplate_groups(members).join(first, ["section_name", "group"]).select("section_name", F.col("f.paper_idx").alias("first_paper"), F.col("f.pos").alias("first_pos"), "phrase", "paper_count", "sentence_count")


@query
def boilerplate_groups(s, d):
    return grouped(A.boilerplate(s, d))


@query
def boilerplate_items(s, d):
    return A.boilerplate(s, d).select("section_name", "paper_idx", long("pos"), F.left("text", F.lit(400)).alias("text"))


@query
def boilerplate_summary(s, d):
    members = A.boilerplate(s, d)
    return members.agg(F.countDistinct("section_name", "group").alias("total_groups"), F.count("*").alias("total_sentences"))


@query
def boilerplate_by_section(s, d):
    return grouped(A.boilerplate_members(s, d, "methods"))


@query
def method_clusters(s, d):
    return A.method_clusters(s, d)


@query
def intro_clusters(s, d):
    return A.intro_clusters(s, d)


@query
def method_paragraphs(s, d):
    return A.listed(A.method_paragraphs(s, d), s, d, 500)


@query
def intro_members(s, d):
    return A.intro_members(s, d).select("cluster", "paper_idx")


@query
def problem_clusters(s, d):
    return A.problem_clusters(s, d)


@query
def problem_matrix(s, d):
    return A.problem_matrix(s, d)


@query
def figure_groups(s, d):
    return A.figure_groups(s, d)


@query
def problem_items(s, d):
    return A.listed(A.problem_members(s, d), s, d, 400)


@query
def figure_items(s, d):
    labels = corpus.papers(s, d, "title", "source").select("paper_idx", T.label(F.col("title"), F.col("source")).alias("paper_label"))
    return A.figure_members(s, d).join(labels, "paper_idx").select("cluster", "paper_idx", "paper_label", F.col("index").alias("figure_index"), F.left("text", F.lit(300)).alias("caption"), "has_image")


@query
def figure_stats(s, d):
    rows = corpus.papers(s, d, "figures")
    groups = A.figure_members(s, d)
    found = {"total_figures": corpus.figures(rows).where("length(caption) > 10"), "total_papers": rows, "figure_groups_found": groups.select("cluster").distinct(), "discussion_patterns_found": A.discussion_patterns(s, d, items=groups).select("cluster").distinct()}
    return R.counted(found)


@query
def discussion_patterns(s, d):
    return A.discussion_patterns(s, d)


@query
def question_clusters(s, d):
    return A.question_clusters(s, d)


@query
def question_items(s, d):
    return A.listed(A.question_members(s, d), s, d, 400)


@query
def questions_per_paper(s, d):
    rows = corpus.papers(s, d, "title", "source", *SECTIONS)
    n = E.question_sentences(rows.drop("title", "source")).groupBy("paper_idx").agg(F.count("*").alias("n"))
    return rows.select("paper_idx", T.label(F.col("title"), F.col("source")).alias("label"), "source").join(n, "paper_idx", "left").select("paper_idx", "label", "source", F.coalesce("n", F.lit(0)).cast("long").alias("question_count"))


@query
def question_stats(s, d):
    items = A.question_members(s, d)
    kinds = items.groupBy("cluster").agg(F.countDistinct("paper_idx").alias("papers"))
    return R.counted({"total_papers": corpus.papers(s, d, "source"), "total_questions": items, "convergent": kinds.where("papers >= 2"), "unique": kinds.where("papers < 2")})


@query
def gap_groups(s, d):
    return A.gap_groups(s, d)


# report and chart data
@query
def report_summary(s, d):
    return R.summary_counts(s, d)


@query
def overview_metrics(s, d):
    return R.overview(s, d)


@query
def corpus_counts(s, d):
    return R.corpus_counts(s, d)


@query
def chart_method_clusters(s, d):
    return method_clusters(s, d).select("cluster", F.left("label", F.lit(60)).alias("label"), "paper_count")


@query
def chart_method_presence(s, d):
    return method_presence(s, d).groupBy("method").agg(F.sum("present").alias("papers"))


@query
def chart_similarity(s, d):
    return A.named_matrix(A.method_texts(s, d), short_label_5(s, d)).withColumn("similarity", F.round("similarity", 3))


@query
def chart_network(s, d):
    names = short_label_4(s, d).select("paper_idx", F.left("label", F.lit(40)).alias("label"))
    a, b = (names.select(F.col("paper_idx").alias(f"paper_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    return intro_edges(s, d).join(a, "paper_a").join(b, "paper_b").select("paper_a", "label_a", "paper_b", "label_b", "weight")


@query
def chart_problem_counts(s, d):
    return problems_per_paper(s, d).select("paper_idx", F.left("label", F.lit(40)).alias("label"), "problem_count")


@query
def chart_open_questions(s, d):
    return question_clusters(s, d).select("cluster", "kind", F.left("summary", F.lit(80)).alias("label"), F.when(F.col("kind") == "convergent", F.col("paper_count")).otherwise(F.lit(1)).cast("long").alias("papers"))


@query
def chart_question_counts(s, d):
    return open_questions(s, d).groupBy("section_name").agg(F.count("*").alias("questions"), F.countDistinct("paper_idx").alias("papers"))


@query
def chart_figure_types(s, d):
    return figure_types(s, d).select("figure_type", "paper_count")


@query
def chart_section_coverage(s, d):
    return section_coverage(s, d).groupBy("section_name").agg(F.sum("present").alias("papers"))
