"""Variant spellings of names typed by people.

Method: pigeonhole segment join. A name key is cut into k + 1 = 2 segments; a key within one edit
keeps one of them whole, at most one place shifted, so looking up the shifted substrings of every
key in an inverted index of segments finds all its neighbours, which a banded edit distance
verifies. (One neighbour escapes the pigeonholes: two letters exchanged across the cut. It has an
index entry of its own, the key with the two letters at the cut in order.) The join runs over
distinct surnames (the name of an organisation) and distinct given names; the few letters of a short
one are joined only where the other part of the name agrees. A slip goes over to the heavier
neighbour, and on from there to its own, to the end of the chain. Spellings then meet by equality of
what they stand for: nickname, initial, order, case, accents, titles, particles and left-out parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.pairs import pairs_within
from paperloom.session import durable

# Entries that name nobody.
FILLERS = {"et al", "et al.", "anonymous", "anon", "anon.", "unknown", "unknown author", "n/a", "na", "none", "null", "nil", "-", "--", "?", "tba", "author", "authors", "others", "and others", "various", "no author", "not available", "various authors"}
# Titles, degrees, particles, words of organisations.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "doctor", "dipl", "ing"}
DEGREES = {"phd", "md", "msc", "bsc", "mba", "dphil", "ma", "ba", "dsc", "esq"}
JUNIORS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
PARTICLES = {"van", "von", "der", "den", "de", "la", "las", "los", "dela", "del", "della", "di", "da", "do", "dos", "du", "le", "al", "el", "bin", "ibn", "ter", "ten", "zu", "zur"}
ORGANISATIONS = {"inst": "institute", "lab": "laboratory", "obs": "observatory", "cons": "consortium", "cent": "centre", "univ": "university", "dept": "department", "depa": "department", "coll": "college", "soci": "society", "acad": "academy", "foun": "foundation", "agen": "agency"}
SMALL_WORDS = {"the", "for", "f", "of", "and", "group", "team"}
# English nicknames.
NICKNAMES = {
    short: name
    for name, shorts in {
        "alexander": "alex al sandy xander lex", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "catherine": "cate cathy cat katie kate kathy kitty", "charles": "charlie chuck chas chip",
        "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dorothy": "dot dolly dottie", "edward": "ed eddie ned ted teddy eddy", "elizabeth": "liz beth betty eliza lizzie bess libby betsy",
        "frederick": "fred freddie freddy", "george": "georgie", "gregory": "greg gregg", "henrietta": "hattie etta hettie henny", "henry": "harry hank hal", "isabella": "izzy bella isa ella", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn",
        "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey jos", "kimberly": "kim kimmy", "lawrence": "larry laurie lawrie", "leonard": "len lenny", "margaret": "meg peggy maggie marge greta", "matthew": "matt", "michael": "mike mick mickey mikey",
        "nicholas": "nick nicky nico", "oliver": "ollie olly", "patricia": "pat trish patty tricia", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "dick rick richie rich", "robert": "bob rob bobby robbie bert",
        "samuel": "sam sammy", "stephen": "steve", "susanna": "sue susie suzy susan", "theodore": "theo", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vic vickie", "walter": "walt", "william": "bill billy will willy liam", "yolanda": "yoli yola", "zachary": "zach zack zac",
    }.items()
    for short in shorts.split()
}
# Nicknames that stand for two names; the spellings around them decide.
SHARED_NICKNAMES = {"ted": ("theodore", "edward"), "teddy": ("theodore", "edward")}
SHORT = 5  # letters under which one edit makes another name, so that the other part must agree
RATIO = 4  # a spelling is a slip of a neighbour that is at least so many times as frequent (for given names)

PARSED = "name string, kind string, surname string, given string, middle string, suffix string, other string"


def folded(text: str) -> str:
    """Without accents, capitals and extra blanks."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", plain.translate({0x131: "i", 0xF8: "o", 0x142: "l", 0x2019: "'"})).strip()


def parsed(name: str) -> tuple[str, str, str, str, str, str] | None:
    """(kind, surname, given name or initial, middle initials, suffix, other reading of the given name), or None for fillers."""
    plain = folded(name)
    if not plain or plain.lower() in FILLERS or not re.search(r"[^\W\d_]", plain):
        return None
    low = re.findall(r"[^\W_]+", plain.lower())
    kinds = [(i, ORGANISATIONS[w[:n]]) for i, w in enumerate(low) for n in (4, 3) if w[:n] in ORGANISATIONS and (len(w) == n or ORGANISATIONS[w[:n]].startswith(w[:5]))]
    if kinds and len(low) > 1:
        at, kind = kinds[0]
        rest = [w for w in low[at + 1 :] if w not in SMALL_WORDS]
        own = [w for w in low[:at] if w not in SMALL_WORDS] or [rest.pop() if rest else kind]
        return "organisation", "".join(own), kind + " " + " ".join(w[:4] for w in rest), "", "", ""
    suffix, tokens, found = "", [], re.findall(r"[^\s,]+|,", plain)
    # after a surname alone, capitals are initials (Family FM), whatever else they could stand for
    family_only = len(found) > 1 and re.fullmatch(r"[A-Z]{1,3}", found[-1]) and not found[-2].isupper() and all(re.sub(r"\W", "", t).lower() in PARTICLES for t in found[:-2])
    for k, token in enumerate(found):
        word = re.sub(r"[.'’]", "", token).lower()
        if family_only and k == len(found) - 1:
            tokens.append(token)
        elif word in TITLES or word in DEGREES:
            continue
        elif word in JUNIORS and tokens:
            suffix = JUNIORS[word]
        else:
            tokens.append(token)
    while tokens and tokens[-1] == ",":
        tokens.pop()
    if "," in tokens:
        cut = tokens.index(",")
        family, own = tokens[:cut], [t for t in tokens[cut + 1 :] if t != ","]
    else:
        upper = [len(re.sub(r"\W", "", t)) > 1 and t.isupper() and "." not in t for t in tokens]
        lead = next((i for i, u in enumerate(upper) if not u), len(tokens))
        if len(tokens) > 1 and upper[-1] and len(tokens[-1]) <= 3 and not all(upper):
            family, own = tokens[:-1], list(tokens[-1])  # Family FM
        elif len(tokens) > 1 and re.fullmatch(r"[A-Z]", tokens[-1]) and not re.fullmatch(r"[A-Z]\.?", tokens[0]):
            family, own = tokens[:-1], tokens[-1:]
        elif 0 < lead and any(re.search(r"[a-z]", t) for t in tokens[lead:]):
            family, own = tokens[:lead], tokens[lead:]  # FAMILY Given
        else:
            cut = len(tokens) - 1
            while cut > 1 and re.sub(r"\W", "", tokens[cut - 1]).lower() in PARTICLES:
                cut -= 1
            family, own = tokens[cut:], tokens[:cut]
    family = [w for t in family for w in re.findall(r"[^\W_]+", t.lower())]
    surname = "".join(w for w in family if w not in PARTICLES) or "".join(family)
    own = [w for t in own for w in re.findall(r"[^\W_]+", re.sub(r"['’]", "", t).lower()) if w not in PARTICLES or len(own) == 1]
    given, middle = own[0] if own else "", "".join(w[0] for w in own[1:])
    other = ""
    if given in SHARED_NICKNAMES:
        given, other = SHARED_NICKNAMES[given]
    return "person", surname, NICKNAMES.get(given, given), middle, suffix, other


def segments(key: str) -> list[tuple[str, str]]:
    """Index entries of a key: (place, text)."""
    n, cut = len(key), len(key) // 2
    entries = [(f"{n}:0", key[:cut]), (f"{n}:1", key[cut:])]
    if 0 < cut < n:
        entries.append((f"{n}:x", key[: cut - 1] + "".join(sorted(key[cut - 1 : cut + 1])) + key[cut + 1 :]))
    return entries


def probes(key: str) -> list[tuple[str, str]]:
    """Substrings at which a key of the same length or one letter less can agree, at most one place shifted."""
    out = {(f"{len(key)}:x", segments(key)[-1][1])} if len(key) > 1 else set()
    for n in (len(key) - 1, len(key)):
        cut = n // 2
        out |= {(f"{n}:0", key[s : s + cut]) for s in (0, 1) if s + cut <= len(key)}
        out |= {(f"{n}:1", key[s : s + n - cut]) for s in (cut - 1, cut, cut + 1) if s >= 0 and s + n - cut <= len(key)}
    return sorted(out)


def within(a: str, b: str, most: int = 1) -> bool:
    """Banded edit distance (insert, delete, replace, exchange of neighbours) of at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    far, before, row = most + 1, None, {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            best = min(row.get(j, far) + 1, now.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if before is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before.get(j - 2, far) + 1)
            now[j] = best
        if min(now.values()) > most:
            return False
        before, row = row, now
    return row.get(len(b), far) <= most


def neighbours(keys: DataFrame, least: int = 1) -> DataFrame:
    """(place, key, near) in both directions: distinct keys of a place one edit apart. keys: place, key, each pair once.

    Keys under ``least`` letters have no neighbours. The index is by place, length and segment, so
    only keys of one place that share a whole segment meet.
    """

    def entries(find: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(p, k, *e) for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in (probes(k) if find else segments(k))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["place", "key", "cut", "part"])

        return run

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield batch.filter(pa.array([within(x, y) for x, y in zip(a, b)], pa.bool_()))

    long = keys.where(F.length("key") >= least).select("place", "key")
    index = long.mapInArrow(entries(False), "place string, key string, cut string, part string").withColumnRenamed("key", "near")
    found = long.mapInArrow(entries(True), "place string, key string, cut string, part string").join(index, ["place", "cut", "part"])
    pairs = found.where("key <> near").select("place", "key", "near").distinct().mapInArrow(verify, "place string, key string, near string")
    return pairs.union(pairs.select("place", F.col("near").alias("key"), F.col("key").alias("near"))).distinct()


def canonical(keys: DataFrame, ratio: float, least: int = SHORT) -> DataFrame:
    """(place, key, meant) of the keys that mean another: the end of the chain of ever heavier spellings.

    A step goes to the heaviest spelling within one edit that outweighs the key ``ratio`` times, the
    lesser of two at the limit, so chains have no circles. ``keys``: place, key, weight.
    """
    keys = durable(keys.select("place", "key", "weight"))
    near = neighbours(keys, least).join(keys.select("place", F.col("key").alias("near"), F.col("weight").alias("heavier")), ["place", "near"])
    best = near.groupBy("place", "key").agg(F.max(F.struct("heavier", "near")).alias("best"))
    takes = (F.col("best.heavier") > F.col("weight") * ratio) | ((F.col("best.heavier") == F.col("weight") * ratio) & (F.col("best.near") < F.col("key")))
    steps = durable(keys.join(best, ["place", "key"]).where(takes).select("place", "key", F.col("best.near").alias("meant")))
    while True:
        further = steps.select("place", F.col("key").alias("meant"), F.col("meant").alias("end"))
        jumped = durable(steps.join(further, ["place", "meant"], "left").select("place", "key", F.coalesce("end", "meant").alias("meant"), F.col("end").isNotNull().alias("moved")))
        steps = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return steps


def replaced(rows: DataFrame, column: str, place: Column, meant: DataFrame) -> DataFrame:
    """The rows with ``column`` as ``meant`` (place, key, meant) has it; the few slips are the small side."""
    return rows.withColumn("_place", place).join(meant.select(F.col("place").alias("_place"), F.col("key").alias(column), "meant"), ["_place", column], "left").withColumn(column, F.coalesce("meant", column)).drop("_place", "meant")


def name_entities(names: DataFrame) -> DataFrame:
    """(name, entity): ``names`` has the column name; an entity is a key of kind, surname, given name, middle initial and suffix.

    NULL, empty and filler entries are left out. Names of equal spelling are one row. A suffix (Jr.)
    counts only where the same name stands with another one (Sr.) too. An initial the only given name of its surname that it can stand for; where there are several (or a missing
    middle name could be one of several) the spelling stays by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *p) for n in batch.column(0).to_pylist() if (p := parsed(n))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], names=[c.split()[0] for c in PARSED.split(", ")])

    rows = durable(names.where("name IS NOT NULL").select("name").distinct().mapInArrow(run, PARSED))
    weight = F.count("*").cast("double").alias("weight")
    person = F.col("kind") == "person"
    rows = replaced(rows, "surname", F.col("kind"), canonical(rows.groupBy(F.col("kind").alias("place"), F.col("surname").alias("key")).agg(weight), 1.0))
    whole_names = rows.where(person & (F.length("given") > 1))
    rows = replaced(rows, "given", F.col("kind"), canonical(whole_names.groupBy(F.col("kind").alias("place"), F.col("given").alias("key")).agg(weight), RATIO))
    # short parts of a name: slips where the other part is the same
    for part, other in (("given", "surname"), ("surname", "given")):
        short = rows.where(person & (F.length("given") > 1) & (F.length("surname") > 1) & (F.length(part) <= SHORT))
        meant = canonical(short.groupBy(F.col(other).alias("place"), F.col(part).alias("key")).agg(weight), RATIO, 2)
        rows = replaced(rows, part, F.when(person, F.col(other)), meant)
    rows = durable(rows)

    # a nickname of two names stands for the one that the surname has
    full = rows.where("length(given) > 1 AND other = ''").groupBy("surname", "given").agg(F.count("*").alias("spellings"))
    seen = full.select("surname", F.col("given").alias("other"), F.col("spellings").alias("as_other"))
    rows = rows.join(full, ["surname", "given"], "left").join(seen, ["surname", "other"], "left")
    rows = rows.withColumn("given", F.when(F.col("spellings").isNull() & F.col("as_other").isNotNull(), F.col("other")).otherwise(F.col("given"))).drop("other", "spellings", "as_other")
    rows = durable(rows)

    # a suffix is left out as often as not: it tells persons apart only where a name has several
    known_suffix = F.when(F.col("suffix") != "", F.col("suffix"))
    own = ["kind", "surname", "given"]
    several = rows.groupBy(*own).agg(F.min(known_suffix).alias("low"), F.max(known_suffix).alias("high")).where("low < high").select(*own, F.lit(True).alias("several"))
    rows = rows.join(several, own, "left").withColumn("suffix", F.when(F.col("several"), F.col("suffix")).otherwise("")).drop("several")

    # letters after a name: the only organisation of that name and of these initials
    acronym = F.array_join(F.transform(F.split("given", " "), lambda w: F.substring(w, 1, 1)), "")
    bodies = rows.where("kind = 'organisation'").groupBy("surname", acronym.alias("letters")).agg(F.countDistinct("given").alias("n"), F.min("given").alias("body")).where("n = 1").drop("n")
    letters = F.when((F.col("kind") == "person") & (F.length("given") == 1) & (F.length("middle") > 0), F.concat("given", "middle"))
    rows = rows.withColumn("letters", letters).join(bodies, ["surname", "letters"], "left").drop("letters")
    body = F.col("body").isNotNull()
    rows = rows.select("name", "surname", "suffix", F.when(body, F.lit("organisation")).otherwise(F.col("kind")).alias("kind"), F.when(body, F.col("body")).otherwise(F.col("given")).alias("given"), F.when(body, F.lit("")).otherwise(F.col("middle")).alias("middle"))

    # initials: the only given name they can stand for
    whole = rows.where("length(given) > 1 AND kind = 'person'")
    people = whole.groupBy("surname", "suffix", "given").agg(F.collect_set(F.when(F.col("middle") != "", F.substring("middle", 1, 1))).alias("middles"))
    people = people.withColumn("initial", F.substring("given", 1, 1))
    short = rows.where("length(given) = 1").select("surname", "suffix", F.col("given").alias("initial"), "middle").distinct()
    possible = short.join(people, ["surname", "suffix", "initial"])
    exact = F.array_contains("middles", F.substring("middle", 1, 1))
    fits = (F.col("middle") == "") | exact | (F.size("middles") == 0)
    meant = possible.where(fits).groupBy("surname", "suffix", "initial", "middle").agg(F.countDistinct("given").alias("all_fit"), F.count_if(exact).alias("exact_fit"), F.min("given").alias("any"), F.min(F.when(exact, F.col("given"))).alias("exactly"))
    meant = meant.select("surname", "suffix", F.col("initial").alias("given"), "middle", F.when(F.col("all_fit") == 1, F.col("any")).when(F.col("exact_fit") == 1, F.col("exactly")).alias("meant"))
    rows = rows.join(meant, ["surname", "suffix", "given", "middle"], "left").withColumn("given", F.coalesce("meant", "given")).drop("meant")

    # a missing middle initial: the only one of the name
    person = ["kind", "surname", "given", "suffix"]
    middle = F.when(F.col("middle") != "", F.substring("middle", 1, 1))
    middles = rows.groupBy(*person).agg(F.min(middle).alias("least"), F.max(middle).alias("most"))
    rows = rows.join(middles, person)
    rows = rows.withColumn("middle", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.coalesce(middle, F.lit(""))))
    return rows.select("name", F.concat_ws("|", "kind", "surname", "given", F.coalesce("middle", F.lit("")), "suffix").alias("entity"))


def author_entities(papers: DataFrame) -> DataFrame:
    """(name, entity, spellings): every spelling in ``authors`` once, its entity and how many spellings that has."""
    entities = durable(name_entities(papers.select(F.explode("authors").alias("name"))))
    return entities.join(entities.groupBy("entity").agg(F.count("*").alias("spellings")), "entity").select("name", "entity", "spellings")


def name_variants(papers: DataFrame) -> DataFrame:
    """(name_a, name_b): pairs of different strings in ``authors`` that name the same person or organisation, the smaller first."""
    entities = durable(name_entities(papers.select(F.explode("authors").alias("name"))))
    return pairs_within(entities, "entity", "name").select(F.col("x").alias("name_a"), F.col("y").alias("name_b"))
