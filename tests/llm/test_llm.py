"""The operators of the llm package against brute force, round trips and hand-made cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, duplicates, languages, leakage, names, pairs, scans, sentences, spans, toxicity

VOCABULARY = os.path.join(bpe.VOCABULARY_DIR, bpe.VOCABULARY)
EDGE = ["", " ", "\n", "a", "don't  stop\n\n  now", "中文文本没有空格", "ไทย", "é́", "🙂🙂", "x" * 5000, "1234567 89", "<|endoftext|>", "​ "]


# sentences
def cut(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Smith et al. (2018) saw 3.5 V, cf. Fig. 7.", "It rose at 9 p.m.", "Then it fell."],
        ["“It went. It does not return,” wrote one.", "Next one."],
        ["‘A thing?’ ‘The vault!’ is how St. John records it.", "pH fell below 7.8.", "mRNA was taken."],
        ['"We saw it."', "(The plume grew; see p. 195.)", "End"],
        ["Am 8. Mai zeigte Abb. 6 ca. 8,6 mm, d. h. viel.", "Nach Prof. Kurz u. a. gilt z. B. Folgendes: nichts.", "Ende, vgl. S. 7 ff.", "Der Rest."],
        ["Значение выросло до 1,3 ед. и т. д. в обеих сериях.", "На рис. 4 (см. с. 9) пик."],
        ["¿Es cierto?", "¡Sí!", "El Sr. Ruiz et al., p. ej., dijo no."],
    ],
)
def test_sentences(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\n".join(parts)) == parts


def test_sentences_without_spaces():
    assert cut("他说了。“好的。坏的。”这是记录。然后……结束（完）。") == ["他说了。", "“好的。坏的。”这是记录。", "然后……", "结束（完）。"]
    assert cut("One ends here.Two starts. Our v2.4.4 of U.S. code") == ["One ends here.", "Two starts.", "Our v2.4.4 of U.S. code"]
    assert cut(None) == cut("") == cut(" \n ") == []
    assert cut("ตัวอย่าง ใกล้ Abc-12 อธิบายผล โครงตาข่ายแช่แข็ง") == ["ตัวอย่าง ใกล้ Abc-12 อธิบายผล", "โครงตาข่ายแช่แข็ง"]


def test_sentence_table(spark):
    rows = spark.createDataFrame([(1, "One. Two.", None, 5), (1, "One. Two.", None, 5), (2, "", " ", 5), (None, "One.", "", 5)], "paper_idx long, introduction string, conclusion string, start_pos int")
    assert sorted(map(tuple, sentences.sentence_table(rows).collect())) == [(1, "introduction", 0, 4), (1, "introduction", 5, 9)]
    assert sentences.sentence_table(rows.limit(0)).count() == 0


# encoding
@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public vocabulary")
def test_bpe_equals_merges_and_library():
    from tokenizers import Tokenizer

    encoder, library = bpe.PrefixEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    library.encode_special_tokens = True
    rng = random.Random(0)
    texts = EDGE + ["".join(rng.choice("abc xyz'12.,\néß中あไ🙂") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert b"".join(encoder.tokens[i] for i in ids).decode() == t
    table = bpe.PrefixTable(encoder, b"wave").append(b"let").replace(0, 1, b"b")
    assert table.ids() == encoder.word("bavelet")


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public vocabulary")
def test_bpe_table(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "the kiln", 0), (3, "the kiln", 0), (None, "a", 0)], "doc_id long, text string, ids int")
    got = bpe.encode_documents(rows).collect()
    assert len(got) == 5 and got[0].ids == got[1].ids == [] and got[2].ids == got[3].ids != []


# held-out passages
def test_leakage(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    items = [" ".join(word() for _ in range(60)) for _ in range(5)]
    docs = [" ".join(word() for _ in range(200)) for _ in range(6)]
    docs[0] += "\n" + items[0].upper()
    docs[1] = docs[1][:300] + items[1][50:190] + docs[1][300:]
    docs[2] += items[2][:90]  # too short to count
    key = lambda t: "".join(c for c in t.lower() if c.isalnum())
    expected = {(d, i) for d, t in enumerate(docs) for i, q in enumerate(items) if any(key(q)[k : k + 100] in key(t) for k in range(len(key(q)) - 99))}
    a = spark.createDataFrame([*enumerate(docs), (7, None), (8, ""), (0, docs[0])], "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items), (9, None), (0, items[0])], "item_id long, text string")
    for block_items in (leakage.BLOCK_ITEMS, 2):  # all items to all tasks, and by a join
        got = leakage.leaked_items(a, b, block_items=block_items).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected) >= 2
    queries = b.where("item_id IS NOT NULL AND length(text) >= 100").distinct()
    hot = leakage.joined_items(a.where("length(text) >= 100"), queries, leakage.RUN, leakage.SHINGLE, hot_rows=1)
    assert {tuple(r) for r in hot.collect()} == expected
    assert leakage.leaked_items(a.limit(0), b).count() == leakage.leaked_items(a, b.limit(0)).count() == 0


# near-duplicates
def variants(seed=2):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(900)) for _ in range(12)]
    for i in range(12):
        t = list(texts[i])
        for _ in range(rng.choice([3, 8, 15, 25, 40])):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    return [*texts, texts[0], texts[0].upper(), "short", "shor t", "", None, "abc"]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_near_duplicates(spark, hot):
    texts = variants()
    sets = [duplicates.shingle_set(t) for t in texts]
    expected = set()
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) and len(sets[j]) and both >= 0.6 * (len(sets[i]) + len(sets[j]) - both):
                expected.add((i, j))
    rows = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)] + [(0, texts[0], None, "x"), (None, texts[0], None, "x")], "paper_idx long, full_text string, abstract string, field_name string")
    got = [tuple(r) for r in duplicates.near_duplicates(rows, hot_rows=hot).collect()]
    assert sorted(got) == sorted((a, b, "full_text") for a, b in expected) and len(expected) > 8


def test_near_duplicate_groups(spark):
    texts = variants()
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(0, texts[0], None), (None, texts[0], None)], "paper_idx long, full_text string, abstract string")
    pairs = {(r.paper_a, r.paper_b) for r in duplicates.near_duplicates(rows).collect()}
    got = {r.paper_idx: r for r in duplicates.near_duplicate_groups(rows).collect()}
    assert set(got) == {i for i, t in enumerate(texts) if len(duplicates.shingle_set(t))}
    leader = {i: i for i in got}
    for _ in got:  # the least member of each component, by plain spreading
        for a, b in pairs:
            leader[a] = leader[b] = min(leader[a], leader[b])
    assert {i: r.group_id for i, r in got.items()} == leader
    same = {i: min(j for j in got if np.array_equal(duplicates.shingle_set(texts[i]), duplicates.shingle_set(texts[j]))) for i in got}
    assert {i: r.class_id for i, r in got.items()} == same
    assert all(r.links == len({same[j] for j in got if (min(i, j), max(i, j)) in pairs and same[j] != same[i]}) for i, r in got.items())


def test_large_classes_are_dealt_to_tasks(spark):
    owned = spark.createDataFrame([(7, i) for i in range(40)] + [(9, 50), (9, 51), (11, 60)], "k long, id long")
    got = sorted((r.x, r.y) for r in pairs.pairs_within(owned, "k", "id", 6).collect())
    assert got == [(i, j) for i in range(40) for j in range(i + 1, 40)] + [(50, 51)]


def test_near_duplicates_empty(spark):
    assert duplicates.near_duplicate_groups(spark.createDataFrame([], "paper_idx long, full_text string, abstract string")).count() == 0
    assert duplicates.near_duplicates(spark.createDataFrame([], "paper_idx long, full_text string, abstract string")).count() == 0


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, (8, 3), dtype=np.uint64)
    words = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 60, (8, 3)).astype(np.uint64)) for _ in range(6)] + [base[:2]])
    groups = np.sort(rng.integers(0, 3, len(words)))
    order = np.lexsort((*words.T[::-1], groups))
    words, groups = words[order], groups[order]
    x, y = duplicates.trie_join(groups, words, 5)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    expected = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if groups[i] == groups[j] and np.bitwise_count(words[i] ^ words[j]).sum() <= 5}
    assert got == expected and len(x) == len(got)


# names
def test_edit_distance_and_neighbours(spark):
    keys = ["johnson", "jonhson", "johnsen", "jonson", "johnsons", "smithers", "smihters", "abc", "abd", "ohnson"]
    for a in keys:
        assert names.within(a, a) and all(names.within(a, b) == names.within(b, a) for b in keys)
    assert names.within("johnson", "jonhson") and not names.within("johnson", "jhonsen")
    pairs = {(a, b) for a in keys for b in keys if a != b and names.within(a, b)}
    rows = spark.createDataFrame([(p, k) for p in "xy" for k in keys[: 10 if p == "x" else 3]], "place string, key string")
    expected = {(p, a, b) for a, b in pairs for p in "xy" if p == "x" or {a, b} <= set(keys[:3])}
    assert {tuple(r) for r in names.neighbours(rows).collect()} == expected
    assert {tuple(r) for r in names.neighbours(rows, 5).collect()} == {r for r in expected if min(len(r[1]), len(r[2])) >= 5}


def test_chains_of_slips_end_at_one_spelling(spark):
    rows = spark.createDataFrame([("p", "mogilev", 1.0), ("p", "mogilef", 2.0), ("p", "mogilfe", 5.0), ("p", "mogilfee", 9.0), ("p", "other", 1.0), ("q", "mogilev", 1.0)], "place string, key string, weight double")
    got = {(r.place, r.key): r.meant for r in names.canonical(rows, 1.0).collect()}
    assert got == {("p", "mogilev"): "mogilfee", ("p", "mogilef"): "mogilfee", ("p", "mogilfe"): "mogilfee"}


def test_short_names_and_initials(spark):
    spellings = ["Anna Kim", "Kim, Anna", "ANNA KIM", "Dr. Anna Kim", "Anna Kmi", "Oliver Kin", "Anna Lee", "Samuel R. Belfort", "Belfort SR", "Samuel Belfort", "Margaret A. von Hagen", "von Hagen MA"]
    rows = spark.createDataFrame([(1, spellings)], "paper_idx long, authors array<string>")
    groups = {}
    for r in names.author_entities(rows).collect():
        groups.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [spellings[:5], ["Oliver Kin"], ["Anna Lee"], spellings[7:10], spellings[10:]]))


def test_suffixes_tell_persons_apart_only_where_there_are_two(spark):
    rows = spark.createDataFrame([(1, ["Karl B. Odenwald", "Karl Odenwald Jr.", "Ruth Odenwald Jr.", "Ruth Odenwald Sr.", "Ruth Odenwald"])], "paper_idx long, authors array<string>")
    assert {tuple(r) for r in names.name_variants(rows).collect()} == {("Karl B. Odenwald", "Karl Odenwald Jr.")}


def test_name_variants(spark):
    one = ["Elizabeth H. de la Dokhoit", "Liz de la Dokhoit", "DE LA DOKHOIT, Elizabeth H.", "E. H. de la Dokhoit", "de la Dokhoit EH", "elizabeth h. de la dokhoit", "Prof. E. H. de la Dökhoit, PhD", "Elizabeth H. de la Dokhiot"]
    two = ["Dentum Consortium for Granular Media", "Consortium for Granular Media Dentum", "Dentum Consort. f. Gran. Media", "The Dentum Consortium for Granular  Media Group", "Dentum CGM"]
    one.append("Elizabeth H. de la Dokhoit Jr.")
    other = ["Susanna de la Dokhoit", "et al.", "", " ", "Anonymous", None]
    rows = spark.createDataFrame([(1, one, "x"), (2, two, "x"), (3, other, "x"), (4, None, "x"), (5, [], "x")], "paper_idx long, authors array<string>, name_a string")
    got = {tuple(r) for r in names.name_variants(rows).collect()}
    assert got == {(a, b) for group in (one, two) for a in group for b in group if a < b}
    assert names.name_variants(rows.limit(0)).count() == 0


# shared spans
def test_shared_spans(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijk lmnop") for _ in range(n))
    common, longer = text(260), text(700)
    rows = [(1, text(50) + common + text(90), None), (2, text(300), text(10) + common[5:] + text(5)), (3, longer, text(20) + longer[100:400]), (4, longer[50:500], ""), (5, text(199), None), (1, None, None), (None, common, None)]
    frame = spark.createDataFrame(rows, "paper_idx long, introduction string, methods string")
    owners = {}
    for p, a, b in rows:
        for t in (a, b):
            if p is not None and t:
                for k in range(len(t) - 199):
                    owners.setdefault(t[k : k + 200], set()).add(p)
    expected = set()
    for p, a, b in rows:
        for name, t in (("introduction", a), ("methods", b)):
            if p is None or not t:
                continue
            marked = [False] * len(t)
            for k in range(len(t) - 199):
                if len(owners[t[k : k + 200]]) > 1:
                    marked[k : k + 200] = [True] * 200
            k = 0
            while k < len(t):
                if marked[k]:
                    e = k
                    while e < len(t) and marked[e]:
                        e += 1
                    expected.add((p, name, k, e))
                    k = e
                k += 1
    assert {tuple(r) for r in spans.shared_spans(frame).collect()} == expected and len(expected) >= 4
    share = {(r.paper_idx, r.section_name): r.share for r in spans.shared_share(frame).collect()}
    assert share[5, "introduction"] == 0 and share[4, "introduction"] == 1
    assert spans.shared_spans(frame.limit(0)).count() == 0


# languages
def test_language_models():
    samples = [("en", "The porous membrane limits the flow near the bank. Each sample was kept in the cold room."), ("de", "Die poröse Membran begrenzt die Strömung am Ufer. Jede Probe blieb im kalten Raum."), ("fr", "La membrane poreuse limite l'écoulement près de la rive. Chaque échantillon est resté au froid.")] * 12
    model = languages.trained(samples)
    got = model.decide([languages.tokens(t) for t in ("Each membrane was kept near the cold flow.", "Die Probe begrenzt den kalten Raum am Ufer.", "Chaque rive limite la membrane au froid.", "在干旱的几个月里这是一个的", "", "zq")])
    assert [g[0] for g in got] == ["en", "de", "fr", "zh", None, None]
    assert [languages.label_language(x) for x in ("EN-us", "zho", "Spanish", "und", "", None, "mixed", "pt_BR")] == ["en", "zh", "es", None, None, None, None, "pt"]


def test_language_tables(spark):
    good = "The porous membrane limits the flow near the bank. Each sample was kept in the cold room."
    mixed = "A title of words\nA. Author\n\nAbstract\n" + good + " " + good + " Das ist nicht so, und wir haben es auch bei der Messung an allen Standorten ohne weitere Anpassung."
    rows = spark.createDataFrame([(1, "en", "A title of words", mixed, good, None, None, None), (1, "en", "A title of words", mixed, good, None, None, None), (2, None, None, "", None, None, None, None), (3, "en", None, None, None, None, None, None)], "paper_idx long, language string, title string, full_text string, introduction string, conclusion string, abstract string, results string")
    assert [tuple(r) for r in languages.mislabelled_blocks(rows).collect()] == [(1, 1, "de")]
    papers = {r.paper_idx: r.lang for r in languages.paper_languages(rows).collect()}
    assert papers == {1: "en", 2: None, 3: None}


# scans
@pytest.fixture(scope="module")
def layout(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("needs the driver's tables")
    return scans.fitted_layout(spark.read.parquet("/root/testdata/sf0.01/paper.parquet"))


def test_scan_repair(layout):
    words = scans.Words({w: 50 for w in "the porous membrane limits flow near bank of each long term sample consecutive visits and well known harbour reading narrows between two under under pressure before".split()} | {"long-term": 30, "well-known": 30})
    text = "Title line of paper\nA. Author\n\nthe porous mernbrane limits flow between two consec-\nutive visits and the well-\n12\nProceedings of Harbour Research\nknown harbour narrows under pressure before the\nlong-term reading of each s@mple near the bank and\n13\nProceedings of Harbour Research\nthe flow.\n\nTable 1: words\n15 66.2 912\n23"
    labels = layout.labelled(text.split("\n"), scans.Page(text))
    found, fixed = scans.repaired(text, words, labels)
    assert {(k, p) for _, k, p in found} == {("hyphen", "consecutive"), ("hyphen", "well-known"), ("char", "membrane"), ("char", "sample"), ("pageno", "12"), ("pageno", "13"), ("header", "Proceedings of Harbour Research")}
    assert "two consecutive visits and the well-known harbour narrows" in fixed and "Proceedings" not in fixed
    assert scans.repaired("", words, layout.labelled([""], scans.Page(""))) == ([], "") and scans.Page(None).repeated == []


def test_paragraphs_go_on_over_a_page(layout):
    """Blank lines around a page number are a gap where the sentence goes on, and a break where it ended."""
    words = scans.Words({w: 9 for w in "values the wide basin was read out twice a day and flow held at same rate in each run continues here with next one begins ends".split()})
    line = "the wide basin was read out twice a day and the flow was held at the same rate in each run"
    text = f"A title\n\n{line}\n{line} with the values\n\n12\n\ncontinues here {line}\n{line}.\n\n13\n\nThe next one begins {line}\n{line}\n\n14\n\nand ends here."
    labels = layout.labelled(text.split("\n"), scans.Page(text))
    found, fixed = scans.repaired(text, words, labels)
    assert [p for _, k, p in found if k == "pageno"] == ["12", "13", "14"]
    parts = fixed.split("\n\n")
    assert len(parts) == 3 and "with the values continues here" in parts[1] and parts[2].startswith("The next one begins") and parts[2].endswith("and ends here.")


def test_headings_keep_their_words(layout):
    words = scans.Words({w: 9 for w in "dusk condition conduct title the text".split()})
    text = "A title\n\n6. Conclusion\nthe text."
    assert not [r for r in scans.repaired(text, words, scans.plain_labels(text.split("\n")))[0]]


def test_every_line_is_decoded_and_states_fit_lines(layout):
    for text in EDGE + ["1\n2\n3\n\n4", "\n\n\n", "Page 1\n" * 50, "word " * 4000]:
        lines = text.split("\n")
        labels = layout.labelled(lines, scans.Page(text))
        assert len(labels) == len(lines) and all((s in ("break", "gap")) == (not x.strip()) for s, x in zip(labels, lines))


def test_words_beyond_the_table_are_looked_up(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    papers = spark.read.parquet("/root/testdata/sf0.01/paper.parquet")
    known = lambda rows: {tuple(r) for r in rows.where("kind = 'hyphen'").collect()}
    whole, small = known(scans.scan_repairs(papers)), known(scans.scan_repairs(papers, vocabulary=400))
    assert len(whole) > 100 and len(whole ^ small) <= 0.02 * len(whole)
    # names, known in neither way, are judged by a character model of the table's words
    words = {r.word for r in scans.word_counts(papers).collect()}
    chars = lambda rows: {tuple(r) for r in rows.where("kind = 'char'").collect() if r.piece.lower() in words}
    whole, small = chars(scans.scan_repairs(papers)), chars(scans.scan_repairs(papers, vocabulary=400))
    assert len(whole) > 100 and whole == small


def test_softmax_fit_finds_the_frequencies():
    x = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 1.0], [1.0, 1.0]])
    w = scans.softmax_fit(np.array([0, 1, 0, 1]), x, np.array([9_000.0, 1_000.0, 2_000.0, 8_000.0]), 2)
    z = np.array([[1.0, 0.0], [1.0, 1.0]]) @ w.T
    p = np.exp(z) / np.exp(z).sum(1)[:, None]
    assert np.allclose(p[:, 0], [0.9, 0.2], atol=0.01)


def test_scan_table(spark):
    kind = "paper_idx long, introduction string, conclusion string, full_text string, methods string, figures array<struct<index:int,caption:string>>"
    rows = spark.createDataFrame([(1, "the kiln the kiln", None, None, None, None), (2, None, "", "", "x", [(1, None), (None, "c")])], kind)
    assert scans.scan_repairs(rows).count() == 0 and scans.repaired_texts(rows).count() == 2
    assert scans.scan_repairs(rows.limit(0)).count() == 0


# content
def test_plain_words():
    assert toxicity.plain(toxicity.opened("i d i o t c.r.e.t.i.n еsсоrіа h0rny stuuuupid para​sites")) == "idiot cretin escoria horny stupid parasites"


def test_content_classifier(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("kiln basin wavelet furnace harbour delta meadow".split())
    calm = lambda: f"The {word()} of the {word()} narrows the {word()} near the {word()}. "
    rude = lambda: f"You are a {rng.choice(['worthless', 'stupid'])} {rng.choice(['fool', 'clown', 'loser'])} and everybody knows it. "
    docs = [(i, calm() * 2 + (rude() if i % 10 == 0 else "") + calm(), "s") for i in range(300)]
    ratings = [(i, i, "r", "abuse" if i % 10 == 0 else "none", 1) for i in range(200)]
    d = spark.createDataFrame([*docs, (900, None, None), (901, "", "s")], "doc_id long, text string, source string")
    r = spark.createDataFrame(ratings, "rating_id long, doc_id long, rater string, category string, severity int")
    got = {tuple(x) for x in toxicity.found_content(d, r).collect()}
    assert got == {(i, "abuse") for i in range(0, 300, 10)}
    rates = {x.source: x for x in toxicity.content_rates(d, r).collect()}
    assert rates[None].n_docs == 1 and abs(rates["s"].abuse_rate - 30 / 301) < 1e-5
    assert toxicity.found_content(d, r.limit(0)).count() == 0 and toxicity.found_content(d.limit(0), r).count() == 0


@pytest.mark.parametrize("papers", [300, 3_000])
def test_sketch_filters_alike_at_every_size(spark, papers):
    """One text in ten is copied from another; the share of lone anchors that pass stays where it is as shards are added."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    texts = ["".join(rng.choice(letters, 600)) for _ in range(papers)]
    texts[::10] = texts[5::10][: len(texts[::10])]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "paper_idx long, introduction string, methods string").repartition(7)
    long = spans.long_texts(rows, ("introduction",), 200)
    cells = 1 << 12
    own = [(i, a) for i, t in enumerate(texts) for a in spans.distinct_anchors([spans.points(t)], 200)[1].view(np.int64).tolist()]
    times = {}
    for _, a in own:
        times[a] = times.get(a, 0) + 1
    passed = {(r.paper_idx, r.anchor) for r in spans.estimated_repeated(long, 200, len(own) * spans.LOAD // cells + 1, cells).collect()}
    assert {(i, a) for i, a in own if times[a] > 1} <= passed
    lone = sum(times[a] == 1 for _, a in passed) / sum(n == 1 for n in times.values())
    print("share of lone anchors that pass", papers, lone)
    assert lone < 0.03
    got = spans.shared_spans(rows, ("introduction",), cells=cells)
    assert got.count() == 2 * len(texts[::10])


def test_hot_passage_is_in_every_paper(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 1)
    text = "".join(random.Random(11).choice("abcdefgh klmno") for _ in range(260))
    rows = spark.createDataFrame([(i, text, f"{i} " * 90) for i in range(1_500)], "paper_idx long, introduction string, methods string")
    got = spans.shared_spans(rows).groupBy("section_name", "start_pos", "end_pos").count().collect()
    assert {tuple(r) for r in got if r.section_name == "introduction"} == {("introduction", 0, 260, 1_500)}


@pytest.mark.parametrize(
    "parts",
    [
        ["She waited and he said no.", "Then they left the room."],
        ["Ella dijo que no.", "Después salió de la sala."],
        ["It was the state of the art.", "Then we went on."],
        ["Para a variável n.", "Depois foi medida."],
        ["It grew by 5 p.", "Then it fell to No. 5 of p. 12 in Sec. IV.", "It ends."],
        ["Il a choisi l'option M.", "Le reste est dans le sac de M. Dupont.", "Il part."],
        ["They gave vitamin D.", "The next day J. A. Brook and B. Reed saw it."],
        ["Siehe z. B. Abb. 3 und vgl. S. 7 ff. im Anhang.", "Der Rest folgt auf S. 9."],
        ["Она дала книгу им.", "Затем они пошли на ул. им. Ленина."],
    ],
)
def test_abbreviations_that_are_words(parts):
    assert cut(" ".join(parts)) == parts


def test_long_quotations_and_far_letters():
    quotation = "“" + "It went on. " * 400 + "It ended.”"
    assert cut(quotation + " Then it stopped.") == [quotation, "Then it stopped."]
    digits = "1 " * 400
    assert cut("Это было так. " + digits + "и т. д. в ряду. Конец.") == ["Это было так.", digits + "и т. д. в ряду.", "Конец."]


def test_an_eleventh_language_is_rejected(spark):
    """Trained on the smallest tables' papers; sentences of languages without a model stay undecided, held-out ones of the ten are decided."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("needs the driver's tables")
    papers = spark.read.parquet("/root/testdata/sf0.01/paper.parquet")
    samples = languages.sample_texts(papers)
    assert max(len(t) for _, t in samples) <= languages.SAMPLE_CHARS * 1.1
    model = languages.trained(samples)
    others = ["Il vento soffiava forte sulla collina mentre i ragazzi giocavano nel cortile della scuola.", "De oude man liep langzaam door de straat en keek naar de huizen.", "Stary człowiek szedł powoli ulicą i patrzył na domy.", "Yaşlı adam sokakta yavaşça yürüdü ve evlere baktı.", "Den gamle mannen gick långsamt genom gatan och såg på husen.", "Старий чоловік повільно йшов вулицею і дивився на будинки."]
    assert [lang for lang, _ in model.decide([languages.tokens(t) for t in others])] == [None] * len(others)
    rows = papers.where("language IN ('en', 'de', 'fr', 'ru', 'zh')").select("language", "discussion").where("length(discussion) > 200").collect()
    units = [(r.language, languages.tokens(r.discussion[a:b])) for r in rows for a, b in sentences.sentence_spans(r.discussion)]
    units = [(k, u) for k, u in units if sum(map(len, u)) > 40]
    found = model.decide([u for _, u in units])
    assert len(units) > 100 and sum(lang is None for lang, _ in found) < 0.02 * len(units)


def test_undecided_stretches(spark):
    good = "The porous membrane limits the flow near the bank. Each sample was kept in the cold room. "
    text = "A title\n\n" + good * 2 + "Qxz wvk jjq zzkw xqv bnm plk. " + good
    rows = spark.createDataFrame([(i, "en", "A title", text if i == 1 else good * 3, good * 20, None, None, None) for i in range(1, 12)] + [(20, None, None, None, None, None, None, None)], "paper_idx long, language string, title string, full_text string, introduction string, conclusion string, abstract string, results string")
    got = languages.language_stretches(rows).where("paper_idx = 1").orderBy("start_pos").collect()
    assert [r.lang for r in got] == ["en", None, "en"] and got[1].confidence == 0 and got[0].confidence > 0.9
    assert languages.language_stretches(rows).where("paper_idx = 20").count() == 0


def test_a_quoted_thai_sentence_ends_at_its_mark():
    assert cut("“โครงตาข่ายแช่แข็งของแอ่งตื้น ใกล้ A-7485 ขยายความกว้าง” ตัวรับสัญญาณหมุน ใกล้ Kal-7 รักษาการจับคู่คำ") == ["“โครงตาข่ายแช่แข็งของแอ่งตื้น ใกล้ A-7485 ขยายความกว้าง”", "ตัวรับสัญญาณหมุน ใกล้ Kal-7 รักษาการจับคู่คำ"]
