"""Variant spellings of names typed by people.

Method: pigeonhole segment join. A name is parsed into its parts (given name or
initial, middle initials, surname; or the proper word of an organisation, its
line of business and legal form). The proper part is the key: cut into k + 1
segments, of which at least one survives k edits, each posted in an inverted
index under namespace, kind, length and place; every key probes the index with
its own substrings at the places to which k edits can shift a segment; what
meets is verified by a banded edit distance in which swapped neighbours count
once. Keys within ``max_distance`` whose other parts agree are the same name.

Which word of a name is the surname is told by a known given name or a comma;
where neither tells, both orders are posted. Given names agree when they share a
full name of the list or, where the list has neither, when they are one edit
apart; they are part of the join key (a name outside the list by its deletion
neighbourhood), so a surname that very many share does not meet all of itself.

Full names are linked first and contracted to components; a name with an initial
only then joins the component of its namespace that it fits, if there is just
one, or one that agrees with its attributes.

Equal parsed names are one class, so a name that a third of all rows carry costs
one entry; only the last step, the pairs that are asked for, expands classes.

Defined results: null namespace is ``default``; null and blank names, and names
of other kinds (projects, tools, places, rankings), are in no pair; of a
repeated id the earliest row counts; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.common import checkpoint, ns, spread, unbroadcast
from palimpsest.llm import lexicon
from palimpsest.operators.components import connected_components, pairs_within


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c)).lower()


_GIVEN = {plain(n): {plain(n)} for n in lexicon.GIVEN_NAMES}
for _full, _short in lexicon.NICKNAMES.items():
    _GIVEN.setdefault(plain(_full), {plain(_full)})
    for _s in _short.split():
        _GIVEN.setdefault(plain(_s), set()).add(plain(_full))
_WORDS = {s: w for w, short in lexicon.ORGANISATION_WORDS.items() for s in short.split()}
_FULL_GIVEN = sorted({g for v in _GIVEN.values() for g in v})


def distance(a: str, b: str, k: int) -> int:
    """Edit distance with swaps of neighbours, within a band of k; k + 1 where it is more."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    far = k + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        lo, hi = max(1, i - k), min(len(b), i + k)
        new = [far] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            new[j] = d
        if min(new[lo - 1 : hi + 1]) > k:
            return far
        before, row = row, new
    return min(row[-1], far)


def _deletions(word: str) -> set[str]:
    """The word and what is left of it without one letter: two words one edit or swap apart share one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


_near_given: dict[str, set[str]] = {}
for _w in _GIVEN:
    if len(_w) >= 3:
        for _d in _deletions(_w):
            _near_given.setdefault(_d, set()).add(_w)


@lru_cache(maxsize=200_000)
def given_of(word: str) -> frozenset[str]:
    """The full given names that a word can mean: itself, a short form, or one typo away; else empty."""
    if word in _GIVEN:
        return frozenset(_GIVEN[word])
    if len(word) < 3:
        return frozenset()
    close = {w for d in _deletions(word) for w in _near_given.get(d, ()) if distance(word, w, 1) <= 1}
    return frozenset(g for w in close for g in _GIVEN[w])


def _tokens(word: str) -> frozenset[str]:
    """By what a given name is joined: full names of the list, and for a word outside of it its deletions (marked ~), and itself (=)."""
    if word in _GIVEN:
        return given_of(word)
    return given_of(word) | {"=" + word} | {"~" + d for d in _deletions(word)} if len(word) > 2 else given_of(word) | {"=" + word, "~" + word}


def parse_name(name: str | None, entity_type: str | None = None) -> tuple | None:
    """(kind, key, given, initial, middle, business, key2, given2): given is '|'-joined tokens (see ``_tokens``), '' where only an initial is there.

    ``key2`` and ``given2`` are the other order of a name of two words of which neither the list nor a comma tells the surname.
    """
    if name is None or not name.strip():
        return None
    s = plain(name).strip()
    s = re.sub(r"\([^)]*\)", " ", s)
    s = re.sub(r"\s+-\s+.*$", "", s).strip()  # remarks such as "- on leave"
    if re.search(lexicon.OTHER_KINDS, s):
        return None
    dotted = re.sub(r"\b((?:[a-z]\.\s?)+[a-z]\.)", lambda m: m[1].replace(".", "").replace(" ", ""), s)  # l.l.c. -> llc
    org = re.sub(r"[^\w]+", " ", dotted).replace("_", " ").split()
    if org and org[0] == "the":
        org = org[1:]
    business = sorted({_WORDS[w] for w in org if w in _WORDS})
    legal = [w for w in org if w in lexicon.LEGAL_FORMS]
    rest = [w for w in org if w not in _WORDS and w not in lexicon.LEGAL_FORMS and w != "and"]
    kind = (entity_type or "").strip().lower()
    has_given = any(w in _GIVEN for w in org)
    if (business and not has_given) or (legal and not has_given and kind != "person"):
        return ("organisation", "".join(rest), "", "", "", " ".join(business), None, None) if rest else None
    if kind not in ("", "person", "unknown", "organization", "organisation"):
        return None
    if kind in ("organization", "organisation") and not has_given:
        return ("organisation", "".join(rest), "", "", "", " ".join(business), None, None) if rest else None
    short = set(re.findall(r"\b([a-z]{2,4})\.(?=\s)", s))  # abbreviated words keep their full stop
    words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", s.replace("_", " "))]
    untitled = [w for w in words if w not in lexicon.TITLES]
    words = untitled if len(untitled) > 1 else words  # "Ing. X" abbreviates a given name
    if len(words) < 2:
        # "mei lin" parts stay joined by the pattern; one word alone is no name of a person
        return None
    initials, long = [w for w in words if len(w) == 1], [w for w in words if len(w) > 1]
    doubled = re.findall(r"(?<![a-z])((?:[a-z]\.){2,})", s)
    if doubled:
        initials = [c for d in doubled for c in d if c.isalpha()]
        long = [w for w in long if w not in {d.replace(".", "") for d in doubled}]
    if not long:
        return None
    given: frozenset[str] = frozenset()
    at = other = None
    exact = [i for i, w in enumerate(long) if w in _GIVEN]
    if len(long) > 1:
        near = [i for i, w in enumerate(long) if given_of(w)]
        cut = [i for i, w in enumerate(long) if w in short]
        comma = re.match(r"[^,]*[^\W\d_]\s*,\s*([^\W\d_]{2,})", s.replace("_", " "))
        if exact or near:
            at = (exact or near)[0]
        elif comma and comma[1] in long:
            at = long.index(comma[1])
        else:
            at = 0
            other = 1 if len(long) == 2 and not cut else None
        if cut and not exact and not given_of(long[at]):
            at, other = cut[0], None
        given = _tokens(long[at])
        if long[at] in short and long[at] not in _GIVEN:  # what is cut short is no spelling of its own
            given = given_of(long[at]) | frozenset(g for g in _FULL_GIVEN if g.startswith(long[at]))
            initials = initials if given else [long[at][0], *initials]
        elif long[at] in short:
            given = given | frozenset(g for g in _FULL_GIVEN if g.startswith(long[at]))
    surname = "".join(w for i, w in enumerate(long) if i != at)
    if not surname:
        return None
    if given:
        first = (surname, "|".join(sorted(given)))
        second = (long[at], "|".join(sorted(_tokens(long[other])))) if other is not None else (None, None)
        if other is not None:
            first, second = sorted([first, second])
        return ("person", *first, "", "".join(initials[:1]), "", *second)
    if not initials:
        return None
    return ("person", surname, "", initials[0], "".join(initials[1:2]), "", None, None)


_PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "key", "given", "initial", "middle", "business", "key2", "given2")])


@F.pandas_udf(_PARSED)
def parse_names(name: pd.Series, entity_type: pd.Series) -> pd.DataFrame:
    rows = [parse_name(n, t) or (None,) * 8 for n, t in zip(name, entity_type)]
    return pd.DataFrame(rows, columns=_PARSED.fieldNames())


@F.pandas_udf(T.IntegerType())
def banded(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y, 2) for x, y in zip(a, b)], dtype="int32")


def mentions(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, name, entity_type, namespace, city, team) of every entity and alias, the earliest row of each id."""
    e = entities.select("id", "name", "entity_type", ns().alias("namespace"), "attributes", "loaded_at")
    a = aliases.select(F.col("alias_id").alias("id"), F.col("alias").alias("name"), F.lit(None).cast("string").alias("entity_type"), ns().alias("namespace"), F.lit(None).cast("string").alias("attributes"), "loaded_at")
    both = e.unionByName(a).filter("id is not null")
    one = both.groupBy("id").agg(F.min(F.struct(F.col("loaded_at").isNull().alias("x"), "loaded_at", "name", "entity_type", "namespace", "attributes")).alias("r"))
    return one.select("id", "r.name", "r.entity_type", "r.namespace", F.get_json_object("r.attributes", "$.city").alias("city"), F.get_json_object("r.attributes", "$.team").alias("team"))


def segment_join(keys: DataFrame, k: int = 3, max_distance: int = 2) -> DataFrame:
    """(namespace, kind, a, b): keys of one namespace and kind within the distance, a < b. ``keys``: namespace, kind, key, distinct.

    k bounds plain edits; a swap counts as two of those, so distance 2 with one swap is covered by k = 3.
    """
    keys = spread(keys, "namespace", "key")  # each key gives some hundred probes
    n = k + 1
    length = F.length("key")
    base, longer = F.floor(length / n).cast("int"), (length % n).cast("int")
    # the last ``longer`` segments have one character more
    size = lambda i: base + (F.lit(i) >= n - longer).cast("int")
    start = lambda i: base * i + F.greatest(F.lit(0), F.lit(i) - (n - longer))
    index = keys.select("namespace", "kind", "key", length.alias("len"), F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), F.substring(F.col("key"), start(i) + 1, size(i)).alias("text")) for i in range(n)])).alias("s"))
    index = index.select("namespace", "kind", F.col("key").alias("b"), "len", "s.seg", "s.text")
    # probes: the longer key asks; for each length of the other key and each segment, the substrings that k edits can shift there
    probe = keys.select("namespace", "kind", F.col("key").alias("a"), F.length("key").alias("la"), F.explode(F.sequence(F.greatest(F.lit(1), F.length("key") - k), F.length("key"))).alias("len"))
    b2, l2 = F.floor(F.col("len") / n).cast("int"), (F.col("len") % n).cast("int")
    probe = probe.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("seg"))
    size2 = b2 + (F.col("seg") >= n - l2).cast("int")
    start2 = b2 * F.col("seg") + F.greatest(F.lit(0), F.col("seg") - (n - l2))
    # of d = la - len, a segment shifts by at most (k - |d|) / 2 beyond the d that lie before or after it
    d = F.col("la") - F.col("len")
    room = F.floor((F.lit(k) - F.abs(d)) / 2).cast("int")
    lo, hi = F.greatest(F.lit(0), start2 + F.least(F.lit(0), d) - room), F.least(F.col("la") - size2, start2 + F.greatest(F.lit(0), d) + room)
    probe = probe.select("namespace", "kind", "a", "la", "len", "seg", size2.alias("size"), lo.alias("lo"), hi.alias("hi")).filter("hi >= lo")
    probe = probe.select("namespace", "kind", "a", "la", "len", "seg", "size", F.explode(F.sequence("lo", "hi")).alias("at"))
    probe = probe.select("namespace", "kind", "a", "la", "len", "seg", F.substring(F.col("a"), F.col("at") + 1, F.col("size")).alias("text")).distinct()
    met = probe.join(unbroadcast(index), ["namespace", "kind", "len", "seg", "text"]).filter("len < la or a < b")
    met = met.select("namespace", "kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # cheap JVM bound first, then the banded distance with swaps
    met = met.filter(F.levenshtein("a", "b", k) >= 0)
    return met.withColumn("d", banded("a", "b")).filter(F.col("d") <= max_distance)


def _fits(x: str, y: str) -> Column:
    """Two parts agree if one is missing or they share a value."""
    return (F.col(x) == "") | (F.col(y) == "") | (F.col(x) == F.col(y))


def link_mentions(people: DataFrame) -> DataFrame:
    """(id, namespace, entity): mentions that mean the same person or organisation share ``entity``. ``people``: see ``mentions``."""
    parsed = people.withColumn("p", parse_names("name", F.coalesce("entity_type", F.lit("")))).select("id", "namespace", "city", "team", "p.*").filter("kind is not null and key <> ''")
    parts = ["namespace", "kind", "key", "given", "initial", "middle", "business", "key2", "given2"]
    # an initial says little: with it, the attributes belong to what makes a class
    short = (F.col("kind") == "person") & (F.col("given") == "")
    more = [F.when(short, F.coalesce(c, F.lit(""))).otherwise("") for c in ("city", "team")]
    parsed = checkpoint(parsed.withColumn("node", F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("")) for p in parts], *more), 256)))
    # a class keeps one city and team; where they differ the attribute tells nothing
    single = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    classes = checkpoint(parsed.groupBy("node", *parts).agg(single("city"), single("team")))
    rest = ["namespace", "kind", "node", "initial", "middle", "business", "city", "team"]
    readings = classes.select(*rest, "key", "given").unionByName(classes.filter("key2 is not null").select(*rest, F.col("key2").alias("key"), F.col("given2").alias("given")))
    keys = checkpoint(readings.select("namespace", "kind", "key").distinct())
    near = segment_join(keys).select("namespace", "kind", "a", "b")
    near = checkpoint(near.unionByName(near.select("namespace", "kind", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(keys.select("namespace", "kind", F.col("key").alias("a"), F.col("key").alias("b"))))
    full = readings.filter("kind = 'person' and given <> ''").withColumn("tokens", F.split("given", r"\|"))
    full = full.withColumn("raw", F.substring(F.try_element_at(F.filter("tokens", lambda t: t.startswith("=")), F.lit(1)), 2, 100))
    named = full.select("*", F.explode(F.filter("tokens", lambda t: ~t.startswith("="))).alias("by"))
    letters = full.select("*", F.explode(F.array_distinct(F.transform(F.filter("tokens", lambda t: ~t.startswith("~")), lambda t: F.substring(F.ltrim(t, F.lit("=")), 1, 1)))).alias("by"))
    initials = readings.filter("kind = 'person' and given = ''").withColumn("by", F.col("initial")).withColumn("raw", F.lit(None).cast("string"))
    firms = readings.filter("kind = 'organisation'").withColumn("by", F.lit("")).withColumn("raw", F.lit(None).cast("string"))
    columns = ("node", "middle", "business", "city", "team", "raw")

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        """Classes with keys within the distance that agree in what they are joined by."""
        x = left.select("namespace", "kind", F.col("key").alias("a"), "by", *[F.col(c).alias(f"x_{c}") for c in columns])
        y = right.select("namespace", "kind", F.col("key").alias("b"), "by", *[F.col(c).alias(f"y_{c}") for c in columns])
        apart = F.coalesce((F.col("x_city") != F.col("y_city")) | (F.col("x_team") != F.col("y_team")), F.lit(False))
        agree = F.coalesce((F.col("x_city") == F.col("y_city")).cast("int"), F.lit(0)) + F.coalesce((F.col("x_team") == F.col("y_team")).cast("int"), F.lit(0))
        p = x.join(unbroadcast(near), ["namespace", "kind", "a"]).join(unbroadcast(y), ["namespace", "kind", "b", "by"])
        return p.filter(F.col("x_node") != F.col("y_node")).filter(_fits("x_middle", "y_middle")).withColumn("agree", agree).withColumn("apart", apart)

    # a deletion in common is no more than a hint of one edit or swap
    swapped = (F.length("x_raw") == F.length("y_raw")) & (F.array_sort(F.split("x_raw", "")) == F.array_sort(F.split("y_raw", "")))
    one_edit = F.levenshtein("x_raw", "y_raw") <= F.when(swapped, 2).otherwise(1)
    ordered = F.col("x_node") < F.col("y_node")
    # what a pair of classes is: the same name, an initial asking for its full name, or two initials
    kinds = [
        ("same", meet(named, named).filter(ordered & ~F.col("apart") & (~F.col("by").startswith("~") | one_edit))),
        ("same", meet(firms, firms).filter(ordered & ~F.col("apart") & _fits("x_business", "y_business"))),
        ("ask", meet(initials, letters)),
        ("lone", meet(initials, initials).filter(ordered & ~F.col("apart"))),
    ]
    ties = checkpoint(reduce(DataFrame.unionByName, [p.select("x_node", "y_node", F.lit(t).alias("tie"), "agree", "apart") for t, p in kinds]).distinct())
    edge = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    comp = connected_components(edge(ties.filter("tie = 'same'"), "x_node", "y_node"))
    # names with an initial: the component they fit, if there is one only or one that agrees in an attribute
    asks = ties.filter("tie = 'ask'").join(unbroadcast(comp), F.col("y_node") == F.col("node"), "left").withColumn("component", F.coalesce("component", "y_node"))
    asks = asks.groupBy("x_node", "component").agg(F.max("agree").alias("agree"), F.max("apart").alias("clash")).filter("not clash")
    best = asks.groupBy("x_node").agg(F.max_by("component", F.struct("agree", "component")).alias("joins"), F.count("*").alias("n"), F.max("agree").alias("top"), F.sum((F.col("agree") == 0).cast("int")).alias("zero"))
    best = checkpoint(best.filter((F.col("n") == 1) | ((F.col("top") > 0) & (F.col("zero") == F.col("n") - 1))).select("x_node", "joins"))
    # initials that fit nothing alone still mean each other when everything agrees
    taken = best.select("x_node")
    lone = ties.filter("tie = 'lone'").select("x_node", "y_node").join(unbroadcast(taken), "x_node", "left_anti").join(unbroadcast(taken.withColumnRenamed("x_node", "y_node")), "y_node", "left_anti")
    more = connected_components(edge(comp.filter("node <> component"), "node", "component").unionByName(edge(best, "x_node", "joins")).unionByName(edge(lone, "x_node", "y_node")))
    final = classes.select("node").join(unbroadcast(more), "node", "left").select("node", F.coalesce("component", "node").alias("entity"))
    return parsed.select("id", "namespace", "node").join(unbroadcast(final), "node").select("id", "namespace", "entity")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return link_mentions(mentions(read("entities"), read("graph_entity_aliases")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = checkpoint(_links(spark, sf_dir))
    return pairs_within(g.select("entity", "id").distinct(), "entity", "id", "mention_a", "mention_b").select("mention_a", "mention_b")


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention with the smallest key that means the same."""
    g = checkpoint(_links(spark, sf_dir))
    first = g.groupBy("entity").agg(F.min("id").alias("entity_key"), F.count("*").alias("n_mentions"))
    return g.join(unbroadcast(first), "entity").select(F.col("id").alias("mention"), "entity_key", "n_mentions")
