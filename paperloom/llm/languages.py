"""Language of papers and of every stretch of their text, with a confidence.

Method: one interpolated Kneser-Ney character model per language. The models share sorted hash
arrays, one an order: the hashes of all n-grams of that order, and for each the log probability
under every language; a second array holds the back-off weights of the contexts. A sentence gets
the language of the lowest length-normalised cross-entropy, or none where that lies several times as
far above the mean of held-out sentences as nearly all of those do (a quantile of their deviations,
which shrink with the length of a sentence; a language with few of them takes the median of all), or
too near the second language.

The models are trained on a bounded sample: of each language the ``sample`` labelled papers of least
hash, and of a paper its sentences of least hash up to ``SAMPLE_CHARS`` characters. Sentences whose
own language, by a first model, isn't the label's are left out of the final one, so wrong labels and
mixed papers do little harm. Short seed texts of function words stand in for languages that the
sample lacks. All texts are labelled, whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.grams import mixed
from paperloom.llm.sentences import sentence_spans

ORDER = 5
DISCOUNT = 0.75
SAMPLE = 300  # papers a language
SAMPLE_CHARS = 4_000  # of the sentences of a sampled paper
LEAST_LETTERS = 12  # a sentence with fewer is not decided
LEAST_TOKENS = 10  # a last sentence without its stop has at least so many
MARGIN = 0.08  # nats a character between the best two languages
QUANTILE = 0.999  # of the held-out sentences are accepted,
SLACK = 3.0  # and those up to so many times as far from the mean, for text on other matters than the sample
UNHELD = 1.2
FEW = 200  # held-out sentences under which the pooled quantile decides
CACHE_WORDS = 300_000

# ISO 639 codes and English names of the languages.
LABELS = {"en": "eng english", "zh": "zho chi chinese", "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish", "pt": "por portuguese", "ru": "rus russian", "ja": "jpn japanese", "hi": "hin hindi", "th": "tha thai"}
# Seed texts, the most frequent function words (characters) of each language.
SEEDS = {
    "en": "the of and to in that is was for it with as his on be at by had are but from or have an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other some could these two may first then do any like my now over such our me even most made after also did many before must through where much your well down should because each just those how too very still here get both between being under never same another know while last might us old off come since against go came take three",
    "de": "der die das und in zu den ist von mit nicht ein eine für auf dem sich des im auch als an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines zwei diese dieser wieder keine seiner worden will zwischen immer was sagte während der an ohne",
    "fr": "le la les de des du et en un une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ses mais comme ou si leur y dont aux cette ces été être fait deux même aussi bien sans peut tous après nous je vous elle ils tout entre encore autre où très depuis sous ainsi avant chaque lors pendant jusqu'à près dès selon trois chez moins toute alors autres contre",
    "es": "el la los las de del y en un una que es por con no se su para al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son también fue había era muy hasta desde está mi porque qué sólo han yo hay puede todos así nos ni tiene él uno donde bien mismo ese ahora cada otro después te otros aunque esa hace otra tan durante siempre según cerca bajo",
    "pt": "o a os as de do da dos das e em um uma que é por com não se seu para ao mais ou mas como foi na no nas nos sua à são ter há pelo pela até isso ela entre era depois sem mesmo aos seus quem já também só eu esse você num essa nem quando muito nós está ele sobre foram ainda pode tem cada durante perto além disso sob após nesta outro outra outros",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой ты так от вы же для мочь о один её как бы его при до или если ещё уже вот два только более после над без под где первый сам когда другой через между во их можно есть был была были было этого всех чтобы очень даже ли там здесь потом сейчас три во",
    "zh": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく しかし について せ だっ その後 できる それ う ので なお のみ でき き つ における および いう さらに でも ら たり その他 に関する たち ます ん なら に対して 特に せる 及び これら とき では にて ほか ながら うち そして とともに ただし かつて それぞれ または お ほど ものの に対する ほとんど と共に といった です とも ところ ここ",
    "hi": "के का की में है और से को पर यह था कि एक ने हैं भी इस नहीं कर हो जो लिए तो ही या गया थे थी साथ अपने कुछ बाद तक वह उस रहा किया जा वे सकता दिया हुआ करने अब बहुत होता हुए जब कोई सभी बारे तथा किसी द्वारा इसके उनके दो पहले कहा जाता वाले लेकिन जैसे आप मैं हम उन्होंने अधिक होने यदि अनुसार बीच सबसे दूसरे ऊपर पास बिना",
    "th": "ที่ และ ใน การ ของ เป็น ได้ มี ไม่ ว่า ให้ จะ มา กับ ไป จาก โดย นี้ ซึ่ง แต่ หรือ อยู่ แล้ว ความ ก็ ด้วย นั้น เมื่อ ต้อง ถึง เพื่อ ต่าง ทำ ขึ้น เขา ตาม กัน เรา ออก หนึ่ง ยัง เข้า อื่น มาก ทาง ทุก ใช้ จึง ระหว่าง สามารถ ผู้ เพราะ ลง ใหม่ ภายใน ใกล้ เหนือ ในช่วง ตามแนว ภายใต้ ทั้งหมด",
}
LANGUAGES = tuple(SEEDS)


@cache
def tokens_pattern() -> regex.Pattern:
    return regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]{1,4}|\p{Thai}{1,6}|[\p{L}\p{M}]+")


@cache
def names_pattern() -> regex.Pattern:
    """Codes and station names (Abc-123, X-9): they belong to no language."""
    return regex.compile(r"\p{Lu}[\p{L}]*-\p{N}+")


def label_language(label: str | None) -> str | None:
    """Two-letter code that a label names, in any spelling; None for none or for a language not known here."""
    if not label:
        return None
    first = regex.split(r"[-_ ]", label.strip().lower())[0]
    return first if first in LABELS else next((k for k, v in LABELS.items() if first in v.split()), None)


def tokens(text: str) -> list[str]:
    return tokens_pattern().findall(names_pattern().sub(" ", text).lower())


def ngrams(word: str, order: int) -> list[str]:
    padded = "\x02" * (ORDER - 1) + word + "\x03"
    return [padded[i - order + 1 : i + 1] for i in range(ORDER - 1, len(padded))]


def hashed(grams: list[str], order: int) -> np.ndarray:
    """Hashes of n-grams of one order."""
    cells = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order) if grams else np.zeros((0, order), np.uint32)
    return row_hash(cells)


def row_hash(cells: np.ndarray) -> np.ndarray:
    h = np.full(len(cells), 7 + cells.shape[1], np.uint64)
    for column in cells.T:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


class LanguageModels:
    """Kneser-Ney models of all languages over shared sorted hash arrays."""

    def __init__(self, words: dict[str, Counter]):
        self.languages = tuple(words)
        count = len(self.languages)
        per = [self.fitted(words[k]) for k in self.languages]
        self.hashes: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        self.floor = np.array([np.log(1 / (len(p[0][1]) + 500)) for p in per], np.float32)
        for order in range(1, ORDER + 1):
            grams = sorted(set().union(*(p[0][order] for p in per)))
            logs = np.empty((len(grams), count), np.float32)
            for k, (probability, weight) in enumerate(per):
                known = probability[order]
                logs[:, k] = [np.log(known[g]) if g in known else self.unseen(g, probability, weight, k) for g in grams]
            h = hashed(grams, order)
            at = np.argsort(h)
            self.hashes[order], self.logs[order] = h[at], logs[at]
            contexts = sorted(set().union(*(p[1][order] for p in per)))
            weights = np.zeros((len(contexts), count), np.float32)
            for k, (_, weight) in enumerate(per):
                weights[:, k] = [np.log(weight[order][c]) if c in weight[order] else 0.0 for c in contexts]
            h = hashed(contexts, order - 1) if order > 1 else np.zeros(len(contexts), np.uint64)
            at = np.argsort(h)
            self.contexts[order], self.backoff[order] = h[at], weights[at]
        self.cache: dict[str, np.ndarray] = {}
        self.mean, self.far = np.zeros(count), np.full(count, np.inf)
        self.letters = np.array([self.letter_entropy(words[k]) for k in self.languages])

    def unseen(self, gram: str, probability: dict, weight: dict, k: int) -> float:
        total = 0.0
        while gram:
            order = len(gram)
            if gram in probability[order]:
                return total + float(np.log(probability[order][gram]))
            total += float(np.log(weight[order].get(gram[:-1], 1.0)))
            gram = gram[1:]
        return total + float(self.floor[k]) if hasattr(self, "floor") else total - 10.0

    @staticmethod
    def letter_entropy(words: Counter) -> float:
        """Nats a letter of the single letters (and word ends)."""
        n: Counter = Counter()
        for word, times in words.items():
            for c in word + "\x03":
                n[c] += times
        p = np.array(list(n.values()), np.float64) / max(1, sum(n.values()))
        return float(-(p * np.log(p)).sum())

    @staticmethod
    def fitted(words: Counter) -> tuple[dict[int, dict[str, float]], dict[int, dict[str, float]]]:
        """Interpolated probabilities of the seen n-grams and back-off weights of their contexts, by order."""
        raw: dict[int, Counter] = {}
        top: Counter = Counter()
        for word, n in words.items():
            for g in ngrams(word, ORDER):
                top[g] += n
        raw[ORDER] = top
        for order in range(ORDER - 1, 0, -1):  # continuation counts: how many different letters stand before
            lower: Counter = Counter()
            for g in raw[order + 1]:
                lower[g[1:]] += 1
            raw[order] = lower
        probability: dict[int, dict[str, float]] = {}
        weight: dict[int, dict[str, float]] = {}
        symbols = len(raw[1]) + 500  # room for letters that the sample lacks
        for order in range(1, ORDER + 1):
            total, kinds = Counter(), Counter()
            for g, n in raw[order].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            weight[order] = {c: max(DISCOUNT * kinds[c] / total[c], 1e-6) for c in total}
            below = probability.get(order - 1, {})
            probability[order] = {g: max(n - DISCOUNT, 0) / total[g[:-1]] + weight[order][g[:-1]] * (below[g[1:]] if order > 1 else 1 / symbols) for g, n in raw[order].items()}
        return probability, weight

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of the words, one column a language."""
        padded = ["\x02" * (ORDER - 1) + w + "\x03" for w in words]
        cells = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        ends = np.repeat(np.cumsum(sizes + ORDER - 1) - sizes, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        window = cells[ends[:, None] + np.arange(1 - ORDER, 1)]
        total = np.zeros((len(ends), len(self.languages)), np.float32)
        open_ = np.arange(len(ends))
        for order in range(ORDER, 0, -1):
            h = row_hash(window[open_, ORDER - order :])
            at = np.minimum(np.searchsorted(self.hashes[order], h), len(self.hashes[order]) - 1)
            hit = self.hashes[order][at] == h
            total[open_[hit]] += self.logs[order][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            h = row_hash(window[open_, ORDER - order : -1]) if order > 1 else np.zeros(len(open_), np.uint64)
            at = np.minimum(np.searchsorted(self.contexts[order], h), len(self.contexts[order]) - 1)
            hit = self.contexts[order][at] == h
            total[open_[hit]] += self.backoff[order][at[hit]]
        total[open_] += self.floor
        return np.add.reduceat(total, np.cumsum(sizes) - sizes, axis=0) if len(words) else np.zeros((0, len(self.languages)), np.float32)

    def entropies(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(nats a character, letters) of sentences given as tokens."""
        new = list({w for s in sentences for w in s if w not in self.cache})
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list({w for s in sentences for w in s})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.cache.update(zip(some, self.score_words(some)))
        letters = np.array([sum(map(len, s)) + len(s) for s in sentences], np.float64)
        sums = np.array([np.sum([self.cache[w] for w in s], axis=0) if s else np.zeros(len(self.languages)) for s in sentences]).reshape(len(sentences), len(self.languages))
        return -sums / np.maximum(letters, 1)[:, None], letters

    def calibrate(self, held: dict[str, list[list[str]]]) -> None:
        """The mean cross-entropy of each language's held-out sentences and how far above it one may lie.

        A sentence of n letters deviates by about 1 / sqrt(n), so deviations are taken times sqrt(n).
        A language without held-out sentences may lie as high as ``UNHELD`` times the entropy of its single letters.
        """
        per: dict[int, np.ndarray] = {}
        for k, name in enumerate(self.languages):
            if held.get(name):
                e, letters = self.entropies(held[name])
                self.mean[k] = float(np.average(e[:, k], weights=np.maximum(letters, 1)))
                per[k] = (e[:, k] - self.mean[k]) * np.sqrt(letters)
        if not per:
            return
        own = {k: max(float(np.quantile(z, QUANTILE)), 1e-6) for k, z in per.items()}
        for k in range(len(self.languages)):
            if k not in per:
                self.mean[k] = UNHELD * self.letters[k]
            self.far[k] = SLACK * (own[k] if k in per and len(per[k]) >= FEW else float(np.median(list(own.values()))))

    def decide(self, sentences: list[list[str]]) -> list[tuple[str | None, float]]:
        """Language and confidence of each sentence; None for one that is rejected."""
        if not sentences:
            return []
        e, letters = self.entropies(sentences)
        order = np.argsort(e, axis=1)
        rows = np.arange(len(e))
        best, first, second = order[:, 0], e[rows, order[:, 0]], e[rows, order[:, 1]]
        ok = (letters >= LEAST_LETTERS) & (second - first >= MARGIN) & ((first - self.mean[best]) * np.sqrt(letters) <= self.far[best])
        odds = np.exp(-np.clip((e - first[:, None]) * np.minimum(letters, 60)[:, None], 0, 700)).sum(1)
        return [(self.languages[b], float(1 / o)) if good else (None, 0.0) for b, o, good in zip(best, odds, ok)]


def sample_texts(papers: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(language, text): of each labelled language the ``sample`` papers of least hash, bounded in number and length."""
    label = F.lower(F.regexp_extract(F.trim("language"), r"^([A-Za-z]+)", 1))
    known = {name: k for k, v in LABELS.items() for name in (k, *v.split())}
    code = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), label)
    ids = papers.select("paper_idx", code.alias("code")).where("code IS NOT NULL AND paper_idx IS NOT NULL").withColumn("h", F.xxhash64("paper_idx"))
    chosen = ids.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("h", "paper_idx"))).where(F.col("n") <= sample).select("paper_idx", "code")
    text = F.concat_ws("\n\n", "introduction", "conclusion", "abstract", "results")
    rows = papers.select("paper_idx", text.alias("text")).join(F.broadcast(chosen.distinct()), "paper_idx").select("code", "text")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                size, kept = 0, []
                for s in sorted((text[a:b] for a, b in sentence_spans(text)), key=lambda s: (zlib.crc32(s.encode("utf-8", "surrogatepass")), s)):
                    if size + len(s) <= SAMPLE_CHARS:
                        kept.append(s)
                        size += len(s)
                out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["code", "text"])

    return [(r.code, r.text) for r in rows.mapInArrow(some, "code string, text string").toLocalIterator()]


def trained(samples: list[tuple[str, str]]) -> LanguageModels:
    """Models from labelled texts: a first pass decides which sentences are in the language of their label."""
    sentences: list[tuple[str, list[str]]] = []
    for code, text in samples:
        sentences += [(code, tokens(text[a:b])) for a, b in sentence_spans(text)]

    def counts(kept: list[tuple[str, list[str]]]) -> dict[str, Counter]:
        words = {k: Counter(tokens(v)) for k, v in SEEDS.items()}
        for code, some in kept:
            words[code].update(some)
        return words

    first = LanguageModels(counts(sentences))
    e, letters = first.entropies([s for _, s in sentences]) if sentences else (np.zeros((0, 1)), np.zeros(0))
    agree = [s for s, row, n in zip(sentences, e, letters) if n >= LEAST_LETTERS and first.languages[int(np.argmin(row))] == s[0]]
    final = LanguageModels(counts([s for i, s in enumerate(agree) if i % 5]))
    held: dict[str, list[list[str]]] = {}
    for code, some in agree[::5]:
        held.setdefault(code, []).append(some)
    final.calibrate(held)
    return final


@cache
def block_patterns() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    dense = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]"
    return regex.compile(r"\n[^\S\n]*\n"), regex.compile(rf"(?<=\p{{L}}{{2}})-\n(?=\p{{Ll}})|(?<={dense})\n(?={dense})"), regex.compile(r"[.!?…。！？।॥]['\"”’»)\]）」』“]*\s*$|\p{Thai}\s*$")


def is_title(block: str, number: int, title: str | None) -> bool:
    """The block of title and authors, which comes first."""
    if number:
        return False
    first, known = block.strip().split("\n")[0].strip().lower(), (title or "").strip().lower()
    if known:
        equal = sum(a == b for a, b in zip(first, known))
        if equal >= 0.6 * max(1, min(len(first), len(known))):
            return True
    return not block_patterns()[2].search(first) and len(block) < 400 and not block_patterns()[2].search(regex.sub(r"(Jr|Sr|[A-Z])\.\s*$", "", block))


def block_sentences(text: str, title: str | None = None) -> Iterator[tuple[int, int, int, list[str]]]:
    """(block, start, end, tokens) of the whole sentences; positions count in the block with its line ends joined."""
    blank, hyphen, ends = block_patterns()
    for number, block in enumerate(blank.split(text)):
        if is_title(block, number, title):
            continue
        flat = hyphen.sub("", block).replace("\n", " ")
        for a, b in sentence_spans(flat):
            words = tokens(flat[a:b])
            if ends.search(flat[a:b]) or len(words) >= LEAST_TOKENS:
                yield number, a, b, words


def language_segments(papers: DataFrame, sample: int = SAMPLE, undecided: bool = False) -> DataFrame:
    """(paper_idx, label, block_no, start_pos, end_pos, lang, confidence): a row for each stretch of whole sentences in one language.

    ``label`` is the two-letter code that the paper's own label names, or NULL. Rejected sentences
    belong to the stretch around them, or with ``undecided`` are stretches of their own, of NULL
    language and confidence 0. NULL and empty texts have none; rows delivered twice come twice.
    """
    models = papers.sparkSession.sparkContext.broadcast(trained(sample_texts(papers, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = models.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found, where = [], []
                for paper, label, title, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    code = label_language(label)
                    for number, a, b, words in block_sentences(text, title):
                        found.append(words)
                        where.append((paper, code, number, a, b))
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for (paper, code, number, a, b), (lang, confidence) in zip(where, model.decide(found)):
                    if lang is None and not undecided:
                        continue
                    if out[0] and (out[0][-1], out[2][-1], out[5][-1]) == (paper, number, lang):
                        out[4][-1], out[6][-1] = b, max(out[6][-1], confidence)
                        continue
                    for column, value in zip(out, (paper, code, number, a, b, lang, confidence)):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["paper_idx", "label", "block_no", "start_pos", "end_pos", "lang", "confidence"])

    rows = papers.where("paper_idx IS NOT NULL AND full_text IS NOT NULL").select(F.col("paper_idx").cast("long").alias("paper_idx"), "language", "title", "full_text")
    return rows.mapInArrow(run, "paper_idx long, label string, block_no long, start_pos long, end_pos long, lang string, confidence double")


def language_stretches(papers: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(paper_idx, block_no, start_pos, end_pos, lang, confidence): every stretch of whole sentences once, undecided ones with NULL."""
    return language_segments(papers, sample, True).select("paper_idx", "block_no", "start_pos", "end_pos", "lang", F.round("confidence", 4).alias("confidence")).distinct()


def mislabelled_blocks(papers: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(paper_idx, block_no, lang): languages of whole sentences of a block that the paper's label doesn't name."""
    return language_segments(papers, sample).where("label IS NULL OR lang <> label").select("paper_idx", "block_no", "lang").distinct()


def paper_languages(papers: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(paper_idx, lang, confidence): one row a paper; the language of most of its text, NULL where none was decided."""
    parts = language_segments(papers, sample).distinct().groupBy("paper_idx", "lang").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"), F.sum((F.col("end_pos") - F.col("start_pos")) * F.col("confidence")).alias("sure"))
    best = parts.groupBy("paper_idx").agg(F.max_by("lang", F.struct("chars", "lang")).alias("lang"), F.max(F.struct("chars", "lang", "sure")).alias("top"), F.sum("chars").alias("total"))
    ids = papers.where("paper_idx IS NOT NULL").select(F.col("paper_idx").cast("long").alias("paper_idx")).distinct()
    return ids.join(best, "paper_idx", "left").select("paper_idx", "lang", F.round(F.coalesce(F.col("top.sure") / F.col("total"), F.lit(0.0)), 4).alias("confidence"))
