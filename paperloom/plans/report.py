"""Report: summary counts, Markdown and HTML from small result tables."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.dictionaries import BOILERPLATE_SECTIONS, SECTIONS
from paperloom.operators import corpus
from paperloom.operators import extraction as E
from paperloom.plans import analyses as A
from paperloom.session import durable, together

MOST = 1_000  # rows of a relation that a report prints; the counts are of all rows


def counted(relations: dict[str, DataFrame]) -> DataFrame:
    """(item, n): the number of rows of each relation."""
    found = None
    for name, relation in relations.items():
        one = relation.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
        found = one if found is None else found.unionByName(one)
    return found


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, n): papers, problem statements, open questions, gaps, figures, shared methods and figure types."""
    rows = corpus.papers(spark, sf_dir, "language", "full_text", "figures", *SECTIONS)
    figures = corpus.figures(rows)
    texts = rows.drop("figures", "full_text")
    return counted({"papers": rows, "problem_statements": E.problem_sentences(texts), "open_questions": E.question_sentences(texts), "research_gaps": E.gap_sentences(texts), "figures": figures, "shared_methods": E.method_presence(rows).select("method").distinct(), "figure_types": E.figure_types(figures)})


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, n): papers, and how much each of the analyses found."""
    clusters = lambda members: members.select("cluster").distinct()
    makers = (A.method_paragraphs, A.boilerplate, A.intro_members, A.problem_members, A.figure_members, A.question_members)
    method, plate, intro, problem, figure, question = together(*(partial(f, spark, sf_dir) for f in makers))
    questions = question.groupBy("cluster").agg(F.countDistinct("paper_idx").alias("papers"))
    return counted(
        {
            "papers": corpus.papers(spark, sf_dir, "source"),
            "method_clusters": clusters(method),
            "boilerplate_groups": plate.select("section_name", "group").distinct(),
            "intro_clusters": clusters(intro),
            "problem_clusters": clusters(problem),
            "figure_groups": clusters(figure),
            "convergent_questions": questions.where("papers >= 2"),
            "unique_questions": questions.where("papers < 2"),
        }
    )


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, n): papers, shared methods, routine expressions, convergent gaps."""
    method, plate, question = together(*(partial(f, spark, sf_dir) for f in (A.method_paragraphs, A.boilerplate, A.question_members)))
    convergent = question.groupBy("cluster").agg(F.countDistinct("paper_idx").alias("papers")).where("papers >= 2")
    found = {"papers": corpus.papers(spark, sf_dir, "source"), "shared_methods": method.select("cluster").distinct(), "routine_expressions": plate.select("section_name", "group").distinct(), "convergent_gaps": convergent}
    return counted(found).withColumnRenamed("item", "metric")


def as_json(clusters: DataFrame, items: DataFrame, key: str = "cluster") -> DataFrame:
    """(key, json): every cluster with its members as one JSON document."""
    own = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*(c for c in items.columns if c != key)))).alias("items"))
    joined = clusters.join(own, key, "left")
    return joined.select(key, F.to_json(F.struct(*joined.columns)).alias("json"))


def first_rows(relation: DataFrame, *order, most: int = MOST) -> list:
    return relation.orderBy(*order).limit(most).collect()


def analysis_report(spark: SparkSession, sf_dir: str, clock: str, most: int = MOST) -> str:
    """The report of all six analyses in nine blocks; of every relation at most ``most`` rows reach the driver."""
    names = corpus.papers(spark, sf_dir, "title", "source").select("paper_idx", T.label(F.col("title"), F.col("source")).alias("label"))
    makers = (A.method_paragraphs, A.intro_members, A.problem_members, A.question_members, A.boilerplate, A.figure_members)
    method, intro, problem, question, plate, figure = map(durable, together(*(partial(f, spark, sf_dir) for f in makers)))
    frames = {
        "methods": A.method_clusters(spark, sf_dir, items=method),
        "intros": A.intro_clusters(spark, sf_dir, items=intro),
        "plates": A.boilerplate_groups(plate),
        "problems": A.problem_clusters(spark, sf_dir, items=problem),
        "figures": A.figure_groups(spark, sf_dir, items=figure),
        "questions": A.question_clusters(spark, sf_dir, items=question),
    }
    frames = {k: durable(v) for k, v in frames.items()}
    sizes = {k: v.count() for k, v in frames.items()}
    n_papers = names.count()
    convergent = frames["questions"].where("kind = 'convergent'")
    n_convergent = convergent.count()

    def heads(members: DataFrame, groups: DataFrame, count: int) -> dict[int, list]:
        """The first members of the printed clusters with their papers' labels."""
        shown = groups.orderBy(F.desc("paper_count"), "cluster").limit(most).select("cluster")
        first = members.join(F.broadcast(shown), "cluster").withColumn("n", F.row_number().over(A.Window.partitionBy("cluster").orderBy("idx"))).where(F.col("n") <= count)
        out: dict[int, list] = {}
        for r in first.join(names, "paper_idx").orderBy("cluster", "idx").select("cluster", "label", F.left("text", F.lit(300)).alias("text")).collect():
            out.setdefault(r.cluster, []).append(r)
        return out

    head = f"# Cross-paper analysis\n\n**Generated**: {clock}\n**Papers**: {n_papers}"
    summary = ["## Summary", ""]
    for n, what in ((n_papers, "papers"), (sizes["methods"], "clusters of shared methods"), (sizes["plates"], "groups of routine expressions"), (sizes["intros"], "clusters of introductions"), (sizes["problems"], "clusters of problems"), (sizes["figures"], "groups of alike figures"), (n_convergent, "open questions of several papers"), (sizes["questions"] - n_convergent, "open questions of one paper")):
        summary.append(f"- **{n}** {what}")
    blocks = [head, "\n".join(summary)]

    out, shown = ["## Shared methods", ""], heads(method, frames["methods"], 3)
    for i, c in enumerate(first_rows(frames["methods"], F.desc("paper_count"), "cluster", most=most), 1):
        out += [f"### {i}. {c.label}", f"**Papers**: {c.paper_count} ({c.papers})", f"**Key terms**: {c.terms}", *(f"- [{r.label}] {r.text}" for r in shown.get(c.cluster, [])), ""]
    blocks.append("\n".join(out) if sizes["methods"] else "\n".join([*out, "(none)"]))

    out = ["## Routine expressions", ""]
    for section in BOILERPLATE_SECTIONS:
        own = frames["plates"].where(F.col("section_name") == section)
        if n := own.count():
            out += [f"### {section.replace('_', ' ').capitalize()} ({n} groups)", *(f"- **{r.phrase[:120]}** ({r.paper_count} papers)" for r in first_rows(own, F.desc("paper_count"), "group", most=5)), ""]
    blocks.append("\n".join(out) if sizes["plates"] else "\n".join([*out, "(none)"]))

    out = ["## Background of the introductions", ""]
    for i, c in enumerate(first_rows(frames["intros"], F.desc("paper_count"), "cluster", most=most), 1):
        out += [f"### {i}. {c.label}", f"**Papers**: {c.paper_count} ({c.papers})", f"**Key terms**: {', '.join((c.terms or '').split(', ')[:5])}", f"- {(c.excerpt or '')[:400]}", ""]
    blocks.append("\n".join(out))

    rows = first_rows(frames["problems"], F.desc("paper_count"), "cluster", most=most)
    out = ["## Research problems", "", markdown_table(("Problem", "Papers", "Instances"), [(r.label[:100], r.paper_count, r.problem_count) for r in rows]), "", "### By paper", ""]
    found = E.problem_sentences(corpus.papers(spark, sf_dir, "language", *SECTIONS))
    order = A.Window.partitionBy("paper_idx").orderBy("section_ord", "pos")
    ranked = found.withColumn("n", F.row_number().over(order)).withColumn("all", F.count("*").over(A.Window.partitionBy("paper_idx")))
    last = None
    for r in first_rows(ranked.where("n <= 5").join(names, "paper_idx"), "paper_idx", "n", most=most):
        if r.paper_idx != last:
            out.append(f"**{r.label}** ({r['all']} problems)")
            last = r.paper_idx
        out.append(f"- [{r.section_name}] {r.sentence[:200]}")
        if r.n == 5 and r["all"] > 5:
            out.append(f"- and {r['all'] - 5} more")
    blocks.append("\n".join(out))

    types = first_rows(E.figure_types(corpus.figures(corpus.papers(spark, sf_dir, "figures"))), F.desc("paper_count"), "type_ord", most=most)
    groups = first_rows(frames["figures"], F.desc("paper_count"), "cluster", most=most)
    out = ["## Figures", "", *(f"- **{g.label[:100]}** ({g.paper_count} papers, {g.figure_count} figures)" for g in groups), "", markdown_table(("Figure type", "Papers", "Figures"), [(r.figure_type, r.paper_count, r.total_figures) for r in types]), ""]
    label_of = {g.cluster: g.label for g in groups}
    for r in first_rows(A.discussion_patterns(spark, sf_dir, items=figure).where("place < 3"), "cluster", "place", most=most):
        out.append(f"- **{label_of.get(r.cluster, '')[:80]}**: {r.phrase[:150]}")
    blocks.append("\n".join(out))

    out, shown = ["## Open questions", "", "### Of several papers", ""], heads(question, convergent, most)
    for i, q in enumerate(first_rows(convergent, F.desc("paper_count"), "cluster", most=most), 1):
        out += [f"**{i}. {q.summary[:200]}** ({q.paper_count} papers)", *(f"- [{r.label}] {r.text[:200]}" for r in shown.get(q.cluster, [])), ""]
    first = question.groupBy("cluster").agg(F.min_by(F.struct("paper_idx", F.length(F.left("text", F.lit(400))).alias("chars")), "idx").alias("f"))
    single = frames["questions"].where("kind = 'unique'").join(first.select("cluster", "f.*"), "cluster").join(names, "paper_idx")
    out += ["### Of one paper", "", *(f"- [{r.label}] {r.summary[:200]}" for r in first_rows(single, F.desc("chars"), "cluster", most=10))]
    if sizes["questions"] - n_convergent > 10:
        out.append(f"- and {sizes['questions'] - n_convergent - 10} more")
    blocks += ["\n".join(out), f"---\n\nMade on {clock}."]
    return "\n\n".join(blocks) + "\n"


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def markdown_report(relations: dict[str, DataFrame], clock: str, top: int = 10) -> str:
    """A block per relation with its first ``top`` rows, ordered by all columns; only those reach the driver."""
    blocks = ["# Cross-paper analysis", f"Generated: {clock}"]
    for title, relation in relations.items():
        rows = relation.orderBy(*relation.columns).limit(top).collect()
        blocks.append(f"## {title}")
        blocks.append(markdown_table(relation.columns, rows) if rows else "(nothing found)")
    return "\n\n".join(blocks) + "\n"


def html_report(markdown: str, title: str = "Cross-paper analysis") -> str:
    """The Markdown as a page: headings, tables, lists, bold text and paragraphs; all text is escaped."""
    body, table, items = [], [], []

    def inline(text: str) -> str:
        return re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", html.escape(text))

    def flush() -> None:
        if table:
            head, *rest = table
            body.append("<table><tr>" + "".join(f"<th>{inline(c)}</th>" for c in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in r) + "</tr>" for r in rest) + "</table>")
            table.clear()
        if items:
            body.append("<ul>" + "".join(f"<li>{inline(x)}</li>" for x in items) + "</ul>")
            items.clear()

    for line in markdown.split("\n"):
        if line.startswith("|"):
            cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)[1:-1]]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                table.append(cells)
        elif line.startswith("- "):
            items.append(line[2:])
        else:
            flush()
            if m := re.match(r"(#{1,6}) (.*)", line):
                body.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            elif line.strip():
                body.append(f"<p>{inline(line)}</p>")
    flush()
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{''.join(body)}</body></html>"


def write_report(text: str, path: str, spark: SparkSession) -> None:
    """One text file, written through Spark so that any file system will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
