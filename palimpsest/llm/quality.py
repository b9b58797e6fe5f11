"""Per-document text quality statistics, and with them prose, list, table or junk.

Method: robust Mahalanobis distance from the prose of the document's language.
Each text gives a vector of statistics (whole text, one pass). For each language
a robust mean and covariance are fitted on all documents: median and median
absolute deviation first (documents within ``start`` of those deviations in every
statistic), then ``steps`` rounds of concentration in which the documents within
the cutoff are averaged again. All of it is partial aggregation in Spark: what
comes to the driver is one matrix a language. The cutoff 50 is the value that a
chi-square variable of 14 degrees exceeds 6 times in a million. The squared
distance splits into one contribution for each statistic, d_i (S^-1 d)_i, which
is reported and names what makes a document an outlier.

A document beyond the cutoff whose characters are mostly in lines of a list or a
table is one; other outliers are junk when the distance over the remaining
statistics is beyond the cutoff too. Few-document languages share a common fit.

Defined results: null, empty and blank texts have null statistics and no class;
the language is found from the text (common words, script), not taken from the
column, which may be missing or wrong; ties of languages go by name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint

#: The most common words of each language.
COMMON_WORDS = {
    "en": """the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or an will my one all would there
        their what so up out if about who get which go me when make can like no just him know take into your some could them other than then now only
        its over also after use two how our first well even want because any these most us is are was were been has had did until unless although while
        since before during between both each every always""".split(),
    "de": """der die das und ist in zu den mit von für auf nicht ein eine einen einer eines dem des im sich auch es an als sie er wir ich nach bei aus wie aber oder
        wenn noch nur so über vor zum zur bis um durch wird werden wurde hat haben war was weil dass man kann sind am ohne unter seit beim vom diese dieser
        jede jeder alle obwohl während""".split(),
    "fr": """le la les de des du et un une est sont en dans que qui pour pas ne sur avec ce cette il elle ils nous vous je se au aux par plus mais ou où être avoir a ont
        était fait comme tout sans sous entre leur leurs son sa ses très aussi quand donc ainsi chaque encore après avant depuis""".split(),
    "it": """il lo la gli le di del della dei delle e un una uno è sono in nel nella che chi per non su con questo questa si al alla da dal più ma o anche come tutto senza
        tra fra loro suo sua molto quando quindi ogni ancora dopo prima essere ha hanno era""".split(),
    "nl": """de het een en van in is dat die te op voor met niet zijn was er aan ook als maar om dan nog wel naar door over bij uit zo of wordt werd worden heeft hebben kan
        deze dit hun geen meer al tot onder wij zij hij ik je""".split(),
    "pt": """o a os as de do da dos das e um uma é são em no na nos nas que para não com por se mais mas ou também como tudo sem entre seu sua seus suas muito quando então
        cada ainda depois antes ser foi está ao à pelo pela isso este esta""".split(),
    "ru": """и в не на что с по как это он она они мы вы к из у за от до о для но а же бы так его её их был была были если или при уже ещё только можно без""".split(),
    "es": """el la de que y en un una los las del se por con para al lo como más no su sus es son fue está este esta esto pero si o ya muy sin sobre entre hasta
        desde cuando también porque aunque donde todo todos cada otro otra me le les nos ha han ser hay mientras durante antes después nadie""".split(),
}
CJK_COMMON = "的了在是不和我有这他来到时大们为上个国说也子那要就出会可以你生能而着用于把被让从没很都与及或但因此后前中"
_COMMON_SETS = {k: frozenset(v) for k, v in COMMON_WORDS.items()}
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
BULLET = regex.compile(r"^\s*(?:[-*•·▪◦‣–+o]|\[[ xX✓]?\]|\(?\d{1,3}[.)]|[a-zA-Z][.)])\s+\S")
TAGS = regex.compile(r"^\s*(?:#[\w\-]+[,;\s]*)+$")
URL = regex.compile(r"^\s*<?(?:https?|ftp)://\S+\s*$")
HEX = regex.compile(r"^\s*[0-9a-fA-F]{4,16}:?\s+(?:[0-9a-fA-F]{2,8}\s+){3,}|^\s*(?:#\d+\s+)?0x[0-9a-fA-F]{6,}\b")
SOLID = regex.compile(r"^\S{40,}$")
END = regex.compile(r"[.!?。！？…][\"'”’»)\]*_`」』]*\s*$|[:：;；,，]\s*$")
STOP = regex.compile(r"[.!?。！？;；,，:：]")
SENTENCE = regex.compile(r"[.!。！;；,，:：]$|[.!?]\s+\p{Lu}|[。！？；]")
#: What text becomes when UTF-8 is read as a one-byte code and written again.
MOJIBAKE = regex.compile(r"Ã[\u0080-¿ƒ‚„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ]|Â[\u0080-¿]|â€|�|Ð[\u0080-¿]")
SYMBOL = regex.compile(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"“”‘’()\-–—。，、！？；：「」『』（）…]")
ASSIGNED = regex.compile(r"(?<!\S)[\w.\-]+=")
GAP = regex.compile(r"\S(?:\s{2,})(?=\S)")
BREAK = regex.compile(r"\r\n|[\n\r\u2028\u2029\x0b\x0c]")
DIGITS, UPPER = regex.compile(r"\d+"), regex.compile(r"\p{Lu}+")
VOWEL = regex.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûæøåœ]", regex.I)

STATS = (
    "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "punctuated_lines", "common_words", "stops_per_word",
    "odd_words", "repeated_lines", "repeated_words", "mojibake", "list_share", "table_share", "machine_share",
)
STRUCTURE = ("list_share", "table_share")
#: The share of common words from which a language is taken to be written in: prose has 0.3 and more.
WRITTEN = 0.15
#: Deviations below this are no evidence: they guard statistics of hardly any spread.
FLOORS = dict(zip(STATS, (0.35, 0.015, 0.02, 0.03, 0.12, 0.045, 0.025, 0.03, 0.05, 0.06, 0.004, 0.08, 0.08, 0.04)))


def _delimiters(line: str) -> tuple[str, int]:
    """The delimiter of a table row and its count."""
    for d in ("|", "\t", ";"):
        n = line.count(d)
        if n >= 2 or (n and d == "\t"):
            return d, n
    if "=" in line and (pairs := len(ASSIGNED.findall(line))) >= 2:
        return "=", pairs
    if "  " in line and (gaps := len(GAP.findall(line))) >= 2:
        return "  ", gaps
    n = line.count(",")
    if n >= 2 and line.count(", ") <= n // 3:
        return ",", n
    return "", 0


def line_kinds(lines: list[str]) -> list[str]:
    """list, table, machine or text for each non-blank line."""
    marks = [_delimiters(x) for x in lines]
    seen = Counter(x.strip() for x in lines)
    kinds = []
    for i, x in enumerate(lines):
        s = x.strip()
        near = [marks[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
        if HEX.match(x) or (not marks[i][1] and SOLID.match(s) and not URL.match(s) and not TAGS.match(s) and not CJK.search(s) and regex.search(r"\d|[+/=]", s)):
            kinds.append("machine")
        elif BULLET.match(x) or TAGS.match(x) or URL.match(x):
            kinds.append("list")
        elif marks[i][1] and any(d == marks[i][0] and abs(n - marks[i][1]) <= (0 if d == "," else 1) for d, n in near) and seen[s] < 4:
            kinds.append("table")
        else:
            kinds.append("text")
    # items without a mark: runs of at least four short lines, none of which ends like a sentence
    run: list[int] = []
    for i in range(len(lines) + 1):
        s = lines[i].strip() if i < len(lines) else "."
        item = i < len(lines) and kinds[i] == "text" and len(s) <= 70 and not SENTENCE.search(s) and seen[s] < 4 and len(s.split()) <= 9
        if item:
            run.append(i)
            continue
        if len(run) >= 4 and (sum(" / " in lines[j] for j in run) > len(run) / 2 or sum(len(lines[j].split()) <= 4 for j in run) > len(run) * 0.7):
            for j in run:
                kinds[j] = "list"
        run = []
    return kinds


@lru_cache(maxsize=100_000)
def odd_word(word: str) -> bool:
    """Whether a word has hardly a vowel."""
    return len(VOWEL.findall(word)) < 0.2 * len(word)


def text_stats(text: str | None) -> tuple[str, list[float]] | None:
    """(language, statistics in the order of STATS), null for a text without content."""
    if text is None or not text.strip():
        return None
    lines = [x for x in BREAK.split(text) if x.strip()]
    chars = sum(len(x.strip()) for x in lines)
    words = WORD.findall(text.lower())
    count = Counter(words)
    cjk = len(CJK.findall(text))
    letters = len("".join(words))
    hits = {k: sum(count[w] for w in s if w in count) for k, s in _COMMON_SETS.items()}
    best = max(sorted(hits), key=lambda k: hits[k])
    # one word over and over is no language
    several = len(words) < 8 or sum(w in count for w in _COMMON_SETS[best]) > 1
    lang = "zh" if cjk > 0.3 * max(1, letters) else best if hits[best] and several else "none"
    dense = max(1, sum(map(len, text.split())))
    kinds = line_kinds(lines)
    share = {k: 0 for k in ("list", "table", "machine", "text")}
    for k, x in zip(kinds, lines):
        share[k] += len(x.strip())
    seen = Counter(x.strip() for x in lines)
    repeated = sum(len(s) * (n - 1) for s, n in seen.items() if n > 1)
    if lang == "zh":
        units = CJK.findall(text)
        n_words = max(1, len(units))
        common = sum(map(CJK_COMMON.__contains__, units)) / n_words
        mean = cjk / max(1, len(STOP.findall(text)))  # characters between stops stand for the length of a word
        mean = min(mean, 60) / 4
        odd = 0.0
        top = Counter(units[i] + units[i + 1] for i in range(len(units) - 1))
    else:
        n_words = max(1, len(words))
        common = hits.get(lang, 0) / n_words
        mean = letters / n_words
        long = {w: n for w, n in count.items() if len(w) > 3}
        odd = sum(n for w, n in long.items() if odd_word(w)) / max(1, sum(long.values()))
        top = Counter(zip(words, words[1:]))
    pairs = max(1, sum(top.values()))
    again = max(top.values(), default=0) / pairs if pairs > 8 else 0.0
    punctuated = sum(len(x.strip()) for x in lines if END.search(x)) / chars
    values = [
        min(mean, 40.0),
        len(SYMBOL.findall(text)) / dense,
        sum(min(8, len(x)) for x in DIGITS.findall(text)) / dense,
        len("".join(UPPER.findall(text))) / max(1, letters),
        punctuated,
        common,
        min(1.0, len(STOP.findall(text)) / n_words),
        odd,
        repeated / chars,
        again,
        min(1.0, 4 * len(MOJIBAKE.findall(text)) / dense),
        share["list"] / chars,
        share["table"] / chars,
        share["machine"] / chars,
    ]
    return lang, [float(v) for v in values]


def document_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, n_chars, n_words, stats) of each document with content."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows, langs, stats, chars = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    r = text_stats(t)
                    if r:
                        rows.append(i), langs.append(r[0]), stats.append(r[1]), chars.append(len(t))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(langs, pa.string()), pa.array(chars, pa.int64()), pa.array(stats, pa.list_(pa.float64()))], ["k", "language", "n_chars", "stats"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, language string, n_chars bigint, stats array<double>").withColumnRenamed("k", key)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATS))


_PAIRS = np.triu_indices(len(STATS))


def _fit_sums(stats: DataFrame, inside: Callable[[str, np.ndarray], np.ndarray]) -> list:
    """Count, sums and sums of products of the documents ``inside``, summed in each batch first; one row a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            names, n, s, q = [], [], [], []
            for lang in sorted(set(langs)):
                y = x[langs == lang]
                y = y[inside(lang, y)]
                names.append(lang), n.append(len(y)), s.append(y.sum(0)), q.append((y.T @ y)[_PAIRS])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64())), pa.array(q, pa.list_(pa.float64()))], ["language", "n", "s", "q"])

    p, pairs = len(STATS), len(_PAIRS[0])
    parts = stats.select("language", "stats").mapInArrow(run, "language string, n bigint, s array<double>, q array<double>")
    total = lambda c, k: F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c)
    return parts.groupBy("language").agg(F.sum("n").alias("n"), total("s", p), total("q", pairs)).filter("n > 0").collect()


def _parameters(rows: list, least: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and inverse covariance of each language; languages with fewer rows than ``least`` get that of all."""
    p = len(STATS)
    floor = np.diag(np.array(list(FLOORS.values())) ** 2)

    def one(n: float, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = s / n
        c = np.zeros((p, p))
        c[_PAIRS] = q / n
        c = np.triu(c) + np.triu(c, 1).T - np.outer(m, m)
        return m, np.linalg.inv(c + floor)

    out = {r["language"]: one(r["n"], np.array(r["s"]), np.array(r["q"])) for r in rows if r["n"] >= least}
    if rows:
        out[""] = one(sum(r["n"] for r in rows), sum(np.array(r["s"]) for r in rows), sum(np.array(r["q"]) for r in rows))
    return out


def _contributions(fits: dict[str, tuple[np.ndarray, np.ndarray]], lang: str, x: np.ndarray) -> np.ndarray:
    """How much each statistic adds to the squared distance."""
    mean, inverse = fits.get(lang, fits[""])
    d = x - mean
    return d * (d @ inverse)


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", *, cutoff: float = 50.0, start: float = 6.0, steps: int = 2, least: int = 30) -> DataFrame:
    """(key, language, n_chars, stats, distance, contributions, text_class) of each document with content."""
    stats = checkpoint(document_stats(df, key, text))
    each = lambda f: F.array(*[f(i) for i in range(len(STATS))])
    middle = lambda v: F.percentile_approx(v, 0.5, 1000)
    # texts without a word of any language, or mostly of machine lines, are no prose to learn from; they are measured against a fit all the same
    known = stats.filter((F.col("language") != "none") & (F.col("stats")[STATS.index("machine_share")] < 0.5))
    medians = {r["language"]: np.array(r["m"]) for r in known.groupBy("language").agg(each(lambda i: middle(F.col("stats")[i])).alias("m")).collect()}
    # a language of which half the texts have hardly a common word is one in name only
    medians = {lang: m for lang, m in medians.items() if m[STATS.index("common_words")] >= WRITTEN}
    known = known.filter(F.col("language").isin(sorted(medians)))
    if not medians:
        return stats.select(key, "language", "n_chars", "stats", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("array<double>").alias("contributions"), F.lit(None).cast("string").alias("text_class"))
    centre = F.create_map(*[x for lang, m in sorted(medians.items()) for x in (F.lit(lang), F.array(*[F.lit(float(v)) for v in m]))])  # a row a language
    spreads = {r["language"]: np.array(r["s"]) for r in known.withColumn("c", centre[F.col("language")]).groupBy("language").agg(each(lambda i: middle(F.abs(F.col("stats")[i] - F.col("c")[i]))).alias("s")).collect()}
    limits = {lang: start * np.maximum(1.4826 * spreads[lang], list(FLOORS.values())) for lang in medians}
    fits = _parameters(_fit_sums(known, lambda lang, x: (np.abs(x - medians[lang]) <= limits[lang]).all(1)), least)
    for _ in range(steps):
        fits = _parameters(_fit_sums(known, lambda lang, x, fits=fits: _contributions(fits, lang, x).sum(1) <= cutoff), least) or fits
    kind = stats.schema[key].dataType.simpleString()
    rest = [i for i, n in enumerate(STATS) if n not in STRUCTURE]
    table, items = STATS.index("table_share"), STATS.index("list_share")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, x = batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(3))
            c = np.zeros(x.shape)
            for lang in set(langs):
                c[langs == lang] = _contributions(fits, lang, x[langs == lang])
            total = c.sum(1)
            shape = np.where(x[:, table] >= np.maximum(x[:, items], 0.5), "table", np.where(x[:, items] >= 0.5, "list", ""))
            found = np.where(total <= cutoff, "prose", np.where(shape != "", shape, np.where(c[:, rest].sum(1) > cutoff, "junk", "prose")))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(np.maximum(total, 0.0))), rows, pa.array(found.tolist(), pa.string())], [*batch.schema.names, "distance", "contributions", "text_class"])

    return stats.select(key, "language", "n_chars", "stats").mapInArrow(judge, f"`{key}` {kind}, language string, n_chars bigint, stats array<double>, distance double, contributions array<double>, text_class string")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir)).filter("text_class <> 'prose'").select("doc_id", "text_class")


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statistic of every document, its distance and the statistic that adds most to it."""
    q = quality(_documents(spark, sf_dir))
    names = F.array(*[F.lit(n) for n in STATS])
    most = F.element_at(names, F.array_position("contributions", F.array_max("contributions")).cast("int"))
    return q.select("doc_id", "language", "n_chars", *[F.round(F.col("stats")[i], 6).alias(n) for i, n in enumerate(STATS)], F.round("distance", 6).alias("distance"), most.alias("main_reason"), "text_class")
