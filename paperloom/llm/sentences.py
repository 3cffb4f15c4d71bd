"""Sentence boundaries across languages and scripts.

Method: ordered break and no-break rules, each a pair of regular expressions for the text before
and after a position, the first match deciding; the rules stand in tables that cascade (quotation
table, language table, table of the script, common table). The language of a text in Latin letters
is that of most of its function words; where none or two have them the tables of all cascade.
Candidate positions are the ends of stop-mark clusters with their closing marks; for scripts that
separate sentences by a space, the spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOPS = ".!?…。！？।॥؟"
CLOSERS = "\"'”’»›)\\]）】」』“"
OPENERS = "\"'“‘„«‹(\\[（【「『¿¡"

# Abbreviations by language. "never" ones don't end a sentence; "numbered" ones don't
# before a number; "titles" don't before a name; "inside" ones end a sentence only before a capital letter.
NEVER = {
    "en": "Dr Prof Mr Mrs Ms St Rev Gen Col Capt Lt Sgt Fig Figs Secs Eq Eqs Eqn Refs Vol Tab e.g i.e cf vs viz approx resp fig figs eq Nos",
    "de": "Dr Prof Hr Abb Tab Nr Bd Kap vgl bzw z.B zB dh sog ggf evtl gem inkl bspw u.a u.U St",
    "fr": "MM Mme Mlle Dr Pr fig éd env chap vol cf St Ste",
    "es": "Sr Sra Srta Dr Dra Prof Profa núm pág págs fig vol ej Lic Ing Dña aprox cf",
    "pt": "Sr Sra Dr Dra Prof Profa núm pág págs fig vol cf aprox Eng",
    "ru": "проф акад рис табл см стр гл ул доц тов напр ср",
    "hi": "डॉ श्री प्रो श्रीमती",
    "th": "ดร ศ รศ ผศ นพ พ.ศ ค.ศ",
}
NUMBERED = {
    "en": "Sec sec Ch Ref pp p No no ca c",
    "de": "S ca Nr",
    "fr": "p pp art n no ex av apr",
    "es": "cap art p pp",
    "pt": "cap art p pp ex n",
    "ru": "с т ст п ок",
    "hi": "सं पृ क्र",
}
TITLES = {"fr": "M Me", "es": "D", "de": "Fr", "ru": "им"}
INSIDE = {
    "en": "etc Jr Sr Inc Ltd Co Corp a.m p.m U.S U.K al",
    "de": "usw ff f etc Jh u.ä",
    "fr": "etc",
    "es": "etc Ud Uds",
    "pt": "etc",
    "ru": "др д е г гг ед руб тыс млн млрд пр",
}
# Function words that tell a language written in Latin letters from the others.
FUNCTION_WORDS = {
    "en": "the of and is was were with that this are from which have has by be not it they she he what",
    "de": "der und ist nicht ein eine mit von im auf dem den des zu sich wird wurde auch wir oder bei nach",
    "fr": "le les du est dans une pour avec sur pas qui aux ce cette nous ont été sont il elle",
    "es": "el los las del y una con pero más está fue su lo son ha muy desde hasta después dijo este",
    "pt": "o os do em um não ao pelo foi é à uma são com na nas nos depois mas já também seu sua",
}
# Words that open a sentence and are no names, so that a capital letter and a stop before them end one.
OPENING_WORDS = {
    "en": "The In We It This That Then These Those A An As At By For From If On Our They There To When While With He She His Her But And However Each All Both After Before Next Its Their",
    "de": "Der Die Das Den Dem Ein Eine In Im Es Wir Er Sie Dann Danach Nach Bei Für Mit Auf Zu Am Und Als Aber Auch Diese Dieser Dieses Jede Wenn Während",
    "fr": "Le La Les Un Une Des Du Ce Cette Ces Il Elle Ils Elles On Nous Dans En Pour Par Sur Mais Puis Ensuite Ainsi Après Depuis Chaque Avec Si",
    "es": "El La Los Las Un Una En Se Es Este Esta Estos Estas Después Luego Pero Con Por Para Si Cada Así Entonces",
    "pt": "O A Os As Um Uma Em No Na Nos Nas Depois Mas Com Por Para Se Este Esta Cada Assim Então",
    "ru": "В На И Он Она Они Это Эти Затем После Мы Для При Но Как Если Когда По С К Все Каждый",
}
# Month names that follow a German ordinal.
MONTHS_DE = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
# Thai words and beginnings that go on with a sentence after a space.
GOES_ON_TH = "ใกล้ และ แต่ หรือ ซึ่ง ที่ โดย จาก ของ ใน เป็น เมื่อ คือ"
# Words that go on after a closing quotation mark in scripts without letter case.
GOES_ON_QUOTE = "と って という 这是 这 那是 随后 他 她 它 说 道 写 问 是 的 ऐसा यह कहा लिखा"

SCRIPTS = {"ru": r"\p{Cyrillic}", "hi": r"\p{Devanagari}", "th": r"\p{Thai}", "zh": r"\p{Han}", "ja": r"[\p{Hiragana}\p{Katakana}ー]"}


def words(text: str) -> str:
    return "|".join(regex.escape(w) for w in sorted(text.split(), key=len, reverse=True))


def never(language: str) -> tuple[bool, str, str]:
    return False, rf"(?<![\p{{L}}\p{{M}}])(?:{words(NEVER[language])})\.", r"\s*\S"


def numbered(language: str) -> tuple[bool, str, str]:
    return False, rf"(?<![\p{{L}}\p{{M}}])(?:{words(NUMBERED[language])})\.", r"\s*(?:\p{N}|(?:[IVX]{2,}|[VX])(?![\p{L}\p{M}]))"


def titles(language: str) -> tuple[bool, str, str]:
    return False, rf"(?<![\p{{L}}\p{{M}}])(?:{words(TITLES[language])})\.", rf"(?!\s+(?:{words(OPENING_WORDS[language])})(?![\p{{L}}\p{{M}}.]))\s*\p{{Lu}}"


def inside(language: str) -> tuple[bool, str, str]:
    return False, rf"(?<![\p{{L}}\p{{M}}])(?:{words(INSIDE[language])})\.", r"\s*[\p{Ll},;:\p{N}]"


def initials(*languages: str) -> tuple[bool, str, str]:
    opening = words(" ".join(OPENING_WORDS[k] for k in languages))
    return False, r"(?<![\p{L}\p{M}])\p{Lu}\.", rf"(?!\s+(?:{opening})(?![\p{{L}}\p{{M}}.]))[\s-]*\p{{Lu}}"


# Each rule: (break here?, what stands before the position, what stands after it).
TABLES: dict[str, list[tuple[bool, str, str]]] = {
    "quotation": [
        # quotations in a row that open one sentence: 'A?' 'B!' is how ...
        (False, r"[!?]’", r"\s*‘[^‘’]*[!?]’\s*\p{Ll}"),
        (False, r"[!?]”", r"\s*“[^“”]*[!?]”\s*\p{Ll}"),
        # a sentence goes on after a quotation
        (False, rf"[{CLOSERS}]", r"\s*(?:[,;:，、；：—–]|- )"),
        (False, r"[”」』“»]", rf"\s*(?:{words(GOES_ON_QUOTE)})"),
    ],
    "en": [
        never("en"),
        numbered("en"),
        inside("en"),
        (False, r"(?<![\p{L}\.])(?:[A-Z]\.){2,}", r"\s*(?:\p{Ll}|\p{Lu}\p{Ll}+\.)"),
    ],
    "de": [never("de"), numbered("de"), titles("de"), inside("de"), (False, r"(?<!\p{N})\p{N}{1,2}\.", rf"\s+(?:{words(MONTHS_DE)})\b"), (False, r"(?<!\p{L})[zudoi]\.", r"\s?(?:B|U|a|ä|h)\."), (False, r"(?:z|u|d|o|i)\. ?(?:B|U|a|ä|h)\.", r"\s*\S")],
    "fr": [never("fr"), numbered("fr"), titles("fr"), inside("fr")],
    "es": [never("es"), numbered("es"), titles("es"), inside("es")],
    "pt": [never("pt"), numbered("pt"), inside("pt")],
    "ru": [never("ru"), numbered("ru"), titles("ru"), inside("ru"), (False, r"(?<!\p{L})т\. ?[еокнп]\.", r"\s*\S"), (False, r"(?<!\p{L})т\.", r"\s?[еокнп]\."), initials("ru")],
    "hi": [never("hi"), numbered("hi"), (True, "[।॥]", "")],
    "th": [
        never("th"),
        (True, rf"[\p{{Thai}}ๆฯ!?.…][{CLOSERS}]*", rf"\s+(?!{words(GOES_ON_TH)})[\p{{Thai}}{OPENERS}]"),
        (False, r"\S", r"\s"),
    ],
    "zh": [(True, rf"[。！？][{CLOSERS}]*", ""), (True, rf"(?:…|\.{{6}})[{CLOSERS}]*", "")],
    "ja": [(True, rf"[。！？][{CLOSERS}]*", ""), (True, rf"…[{CLOSERS}]*", "")],
    "latin": [
        (False, r"(?<![\p{L}])et al\.", r"\s*[^\s\p{Lu}]"),
        (False, r"(?<=\p{N})\.", r"\p{N}"),
        (False, rf"(?:\.\.\.|…)[{CLOSERS}]*", r"\s*\p{Ll}"),
    ],
    "common": [
        (True, rf"[。！？।॥][{CLOSERS}]*", ""),
        (True, "", r"\s+\p{Ll}{1,3}\p{Lu}"),  # pH, mRNA
        (False, "", r"\s*(?:\p{Ll}|[,;:%)\]])"),
        (True, "", rf"\s+[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}{OPENERS}\-–—•*]"),
        # a lost space after the stop mark
        (True, rf"[\p{{Ll}}\p{{Lo}}\p{{M}}\p{{N}}{CLOSERS}][.]|[!?][{CLOSERS}]*|[.…][{CLOSERS}]+|\p{{Ll}}\.", r"(?:\p{Lu}[\p{Ll}\-\s’']|[" + OPENERS + r"]\p{Lu})"),
        (True, "", r"\s+\S"),
    ],
}
# Which tables cascade, by what the text before the position is written in; "latin" serves texts of no or several languages.
CASCADES = {
    **{k: ["quotation", k, f"initials of {k}", "latin", "common"] for k in FUNCTION_WORDS},
    "latin": ["quotation", *FUNCTION_WORDS, "initials of all", "latin", "common"],
    "ru": ["quotation", "ru", "initials of all", "latin", "common"],
    "hi": ["quotation", "hi", "en", "latin", "common"],
    "th": ["quotation", "th", "common"],
    "zh": ["quotation", "zh", "en", "latin", "common"],
    "ja": ["quotation", "ja", "en", "latin", "common"],
}
TABLES |= {f"initials of {k}": [initials(k)] for k in FUNCTION_WORDS} | {"initials of all": [initials(*FUNCTION_WORDS)]}
VOTES = {w: k for k, text in FUNCTION_WORDS.items() for w in text.split()}
ABBREVIATIONS = {w.lower() for table in (NEVER, NUMBERED, TITLES, INSIDE) for text in table.values() for w in text.split()}
PAIRS = ["„“", "“”", "‘’", '""', "«»", "‹›", "「」", "『』", "()", "（）", "[]", "【】"]


@cache
def cascade(name: str) -> regex.Pattern:
    """One ordered alternation: the group that matched first tells the decision (b: break, n: none)."""
    rules = [r for t in CASCADES[name] for r in TABLES[t]]
    return regex.compile("|".join(f"(?P<{'b' if yes else 'n'}{i}>(?<={before})(?={after}))" for i, (yes, before, after) in enumerate(rules)))


@cache
def scanner() -> dict[str, regex.Pattern]:
    # a pair of marks doesn't reach over a blank line
    inner = lambda a, b: rf"(?:[^\n{regex.escape(a)}{regex.escape(b) if a != b else ''}]|\n(?!\s*\n))+"
    spans = "|".join(f"{regex.escape(a)}{inner(a, b)}{regex.escape(b)}" for a, b in PAIRS)
    return {
        "spans": regex.compile(spans),
        "openers": re.compile("[" + re.escape("".join(a for a, _ in PAIRS)) + "]"),
        "stops": regex.compile(rf"[{STOPS}]+(?:\s?[»])?[{CLOSERS}]*"),
        "spaces": regex.compile(r"(?<=[\p{Thai}ๆฯ!?.…”\"])\s+(?=\S)"),
        "thai": regex.compile(r"\p{Thai}"),
        "script": regex.compile(r"[\p{L}\p{M}]"),
        **{k: regex.compile(v) for k, v in SCRIPTS.items()},
    }


def latin_language(text: str) -> str:
    """The language of most function words, of a text in Latin letters; "latin" where none has them or a second one half as many."""
    votes: dict[str, int] = {}
    for w in text.lower().split():
        if w in VOTES:
            votes[VOTES[w]] = votes.get(VOTES[w], 0) + 1
    best = sorted(votes, key=lambda k: -votes[k])[:2]
    return "latin" if not best or len(best) > 1 and 2 * votes[best[1]] >= votes[best[0]] else best[0]


def script_between(text: str, begin: int, end: int, known: dict[str, regex.Pattern]) -> str | None:
    """The script of the last letter in a stretch; None without letters."""
    for i in range(end - 1, begin - 1, -1):
        c = text[i]
        if c.isalpha() or c > "\u0300" and known["script"].match(c):
            if c < "\u0370":
                return "latin"
            return next((k for k in SCRIPTS if known[k].match(c)), "latin")
    return None


def boundaries(text: str) -> list[int]:
    """Positions after the last character of each sentence but the last, in order."""
    known = scanner()
    ends: set[int] = set()
    spans = [m.span() for m in known["spans"].finditer(text)] if known["openers"].search(text) else []
    at, latin, script, seen = 0, None, "latin", 0
    thai = known["thai"].search(text) is not None
    candidates = [(m.start(), m.end()) for m in known["stops"].finditer(text)]
    if thai:
        candidates = sorted({*candidates, *((m.start(), m.start()) for m in known["spaces"].finditer(text))})
    for begin, end in candidates:
        while at < len(spans) and spans[at][1] <= begin:
            at += 1
        if at < len(spans) and spans[at][0] < begin:
            if end < spans[at][1]:
                continue  # inside a quotation or bracket
            if end > spans[at][1] and text[end - 1] in "\"'“‘":
                end = spans[at][1]  # what follows the closing mark opens the next one
        elif end - begin > 1 and text[end - 1] in "\"'“" and any(s == end - 1 for s, _ in spans[at : at + 2]):
            end -= 1  # an opening mark right after the stop
        if end >= len(text):
            continue
        # the usual case, as the tables decide it: a small-letter word that is no abbreviation, a stop, a space, a capital
        if text[begin:end] == "." and text[end] == " " and text[end + 1 : end + 2].isupper():
            word = text[text.rfind(" ", 0, begin) + 1 : begin]
            if len(word) > 3 and word.isascii() and word.isalpha() and word.islower() and word not in ABBREVIATIONS:
                ends.add(end)
                script, seen = "latin", begin
                continue
        script, seen = script_between(text, seen, begin, known) or script, begin
        if script == "latin":
            latin = latin or latin_language(text)
        found = cascade(latin if script == "latin" else script).match(text, end)
        if found and found.lastgroup[0] == "b":
            ends.add(end)
    return sorted(ends)


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Spans from the first to the last non-blank character of each sentence."""
    if not text:
        return []
    out, begin = [], 0
    for end in [*boundaries(text), len(text)]:
        piece = text[begin:end]
        if kept := piece.strip():
            first = begin + len(piece) - len(piece.lstrip())
            out.append((first, first + len(kept)))
        begin = end
    return out


def sentence_table(papers: DataFrame, fields: tuple[str, ...] = ("introduction", "conclusion"), id_column: str = "paper_idx") -> DataFrame:
    """(paper_idx, section_name, start_pos, end_pos), one row per sentence of the given fields.

    NULL, empty and blank fields have none, a NULL id gives none, rows delivered twice come once,
    other columns are not read. A narrow map over the texts; only the spans are shuffled, for the
    final distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, out = part.column(0).to_pylist(), ([], [], [], [])
                for k, field in enumerate(fields):
                    for i, text in zip(ids, part.column(k + 1).to_pylist()):
                        for a, b in sentence_spans(text):
                            for column, value in zip(out, (i, field, a, b)):
                                column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["paper_idx", "section_name", "start_pos", "end_pos"])

    rows = papers.where(papers[id_column].isNotNull()).select(papers[id_column].cast("long").alias("paper_idx"), *(papers[f].cast("string").alias(f) for f in fields))
    return rows.where(F.coalesce(*(F.col(f) for f in fields)).isNotNull()).mapInArrow(run, "paper_idx long, section_name string, start_pos long, end_pos long").distinct()
