"""What a question asks for: dates, a time range, how temporal it is, and the entities that it may mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.common import ns, table
from palimpsest.sources import store
from palimpsest.sources.store import NOW, NOW_SQL, sql

#: Phrases of questions whose answer is a date.
DATE_QUESTIONS = [
    "when did", "when was", "when were", "when has", "when have", "what year", "which year", "what date", "which date", "what day", "which day", "what month", "which month", "in what year", "in which year",
    "什么时候", "何时", "哪一年", "哪年", "哪一天", "几月", "什么时间",
]
#: Words of which none, one or more make the vector weigh 0.9, 0.6 or 0.3.
TEMPORAL_WORDS = [
    "recently", "recent", "lately", "last time", "how often", "frequently", "when did", "when was", "how long ago", "before", "after", "earlier", "previous", "previously", "first time", "most recent", "latest",
    "yesterday", "last week", "last month", "ago", "since", "until", "often", "always", "never", "sometimes", "usually", "regularly",
]
#: Words of a mention at most, letters of a single word at least, mentions of a question at most.
MOST_WORDS, LEAST_LETTERS, MOST_MENTIONS = 4, 3, 64
#: Questions as people ask them, one for each rule; document titles join them.
QUESTIONS = [
    "When did the audit ledger fail?", "what year was Hugo's note written", "yesterday", "what changed today", "notes of last week", "who wrote last month's report", "this week in review", "runs of 3 days ago",
    "2 weeks ago we met", "errors 5 hours ago", "10 minutes ago", "recently changed", "which day did we ship", "how often does it fail before noon", "什么时候开始", "昨天的笔记", "retry queue", "", "the O'Neil team's plan", "1 month ago",
]


def asks_for_date(q: Column) -> Column:
    low = F.lower(q)
    out = F.lit(False)
    for p in DATE_QUESTIONS:
        out = out | F.contains(low, F.lit(p))
    return out


def temporal_alpha(q: Column) -> Column:
    """The vector's weight: 0.9 for no temporal word, 0.6 for one, 0.3 for more."""
    n = sum((F.contains(F.lower(q), F.lit(w)).cast("int") for w in TEMPORAL_WORDS), F.lit(0))
    return F.when(n >= 2, 0.3).when(n == 1, 0.6).otherwise(0.9)


def time_range(q: Column, now: Column) -> Column:
    """(start, end) that a question points to, null if to none; the first phrase in a fixed order counts."""
    low, day = F.lower(q), F.date_trunc("day", now)
    has = lambda *ps: F.greatest(*[F.contains(low, F.lit(p)) for p in (*ps, *ps[:1])])
    back = lambda s: now - F.make_dt_interval(secs=s)
    ago = F.regexp_extract_all(low, F.lit(r"(?:^|\s)(\d+\s+(?:day|week|month|hour|minute)s*\s+ago)(?=\s|$)"), 1)
    first = F.split(F.try_element_at(ago, F.lit(1)), r"\s+")
    n, unit = F.try_element_at(first, F.lit(1)).cast("bigint"), F.rtrim(F.try_element_at(first, F.lit(2)), F.lit("s"))
    seconds = n * F.when(unit == "day", 86400).when(unit == "week", 604800).when(unit == "month", 2592000).when(unit == "hour", 3600).otherwise(60)
    span = lambda a, b: F.struct(a.cast("timestamp_ntz").alias("start"), b.cast("timestamp_ntz").alias("end"))
    whole = lambda n: span(day - F.make_dt_interval(days=F.lit(n)), day - F.make_dt_interval(days=F.lit(n - 1), secs=F.lit(1)))
    return (
        F.when(has("yesterday", "昨天"), whole(1)).when(has("today", "今天"), span(day, now)).when(has("前天") & ~has("大前天"), whole(2))
        .when(has("last week", "上周"), span(back(F.lit(604800)), now)).when(has("last month", "上个月"), span(back(F.lit(2592000)), now))
        .when(has("this week", "这周"), span(F.date_trunc("week", now), now)).when(seconds.isNotNull(), span(back(seconds), now)).when(has("recently", "刚才"), span(back(F.lit(86400)), now))
    )


def mention_texts(q: Column) -> Column:
    """Runs of one to four words that may name an entity, shorter runs first: without possessives, single words of three letters and more."""
    words = F.transform(F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}']+"), 0), lambda w: F.regexp_replace(F.regexp_replace(w, r"^'+|'+$", ""), r"'[sS]$", ""))
    words = F.filter(words, lambda w: w != "")

    def run(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    runs = [F.filter(run(1), lambda w: F.length(w) >= LEAST_LETTERS), *[run(n) for n in range(2, MOST_WORDS + 1)]]
    return F.slice(F.concat(*runs), 1, MOST_MENTIONS)


def questions(spark: SparkSession, d: str) -> DataFrame:
    fixed = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    return fixed.unionByName(table(spark, d, "documents").select(F.col("title").alias("question")).filter("question is not null")).distinct()


def question_features(spark: SparkSession, d: str) -> DataFrame:
    r = time_range(F.col("question"), F.lit(NOW))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    x = questions(spark, d).withColumn("r", r)
    return x.select("question", asks_for_date(F.col("question")).alias("asks_for_date"), temporal_alpha(F.col("question")).alias("alpha"), text("r.start").alias("range_start"), text("r.end").alias("range_end"), F.size(mention_texts(F.col("question"))).cast("bigint").alias("n_mentions"))


def question_mentions(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("question", F.posexplode(mention_texts(F.col("question"))).alias("place", "mention")).select("question", F.col("place").cast("bigint").alias("place"), "mention")


def named_entities(spark: SparkSession, d: str) -> DataFrame:
    """(surface, entity_id, seen, exact): the names of live entities and the aliases that are filled."""
    e = store.entities(spark, d).filter("deleted_at is null and trim(name) <> ''").select(F.col("id").alias("entity_id"), F.lower(F.trim("name")).alias("surface"), F.coalesce("last_seen", "first_seen").alias("seen"))
    a = table(spark, d, "graph_entity_aliases").filter("canonical_id is not null and trim(alias) <> ''").select(F.lower(F.trim("alias")).alias("surface"), F.col("canonical_id").alias("entity_id"))
    alias = a.join(e.select("entity_id", "seen"), "entity_id").select("surface", "entity_id", "seen", F.lit(False).alias("exact"))
    return e.select("surface", "entity_id", "seen", F.lit(True).alias("exact")).unionByName(alias).groupBy("surface", "entity_id").agg(F.max("seen").alias("seen"), F.max("exact").alias("exact"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "graph_entity_aliases").groupBy(F.col("alias_id").alias("id")).agg(F.min("alias").alias("alias"))
    return a.filter("alias is not null").select("id", F.concat(F.lit("What does "), "alias", F.lit(" do?")).alias("question"))


def asked_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names as typed, in a question: the entities that it names, 0.7 + 0.3 by how lately each was seen; one row an entity."""
    q = _asked(spark, d).select("id", F.explode(F.array_distinct(F.transform(mention_texts(F.col("question")), lambda w: F.lower(w)))).alias("surface"))
    hit = q.join(named_entities(spark, d), "surface").groupBy("id", "entity_id").agg(F.max("seen").alias("seen"), F.max("exact").alias("exact"))
    w = W.partitionBy("id")
    s = F.unix_seconds(F.col("seen").cast("timestamp"))
    share = F.when(F.max(s).over(w) > F.min(s).over(w), (s - F.min(s).over(w)) / (F.max(s).over(w) - F.min(s).over(w))).otherwise(1.0)
    return hit.select("id", "entity_id", "exact", F.round(0.7 + 0.3 * F.coalesce(share, F.lit(0.0)), 6).alias("score"))


def entity_signal(spark: SparkSession, d: str) -> DataFrame:
    """How strongly each question names an entity: 1 by name, 0.8 by an alias, else 0; counted."""
    a = asked_entities(spark, d).groupBy("id").agg(F.max(F.when(F.col("exact"), 1.0).otherwise(0.8)).alias("s"))
    m = _asked(spark, d).join(a, "id", "left")
    return m.groupBy(F.coalesce("s", F.lit(0.0)).alias("signal")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (question_features, question_mentions, asked_entities, entity_signal)}

_QS = "qs as (select distinct question from (select unnest([" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]) as question union all select title from documents where title is not null))"
_LOW = "lower(question)"
_ANY = lambda ps: "(" + " or ".join(f"contains({_LOW}, '{p}')" for p in ps) + ")"


def _mentions_sql(text: str, source: str, key: str) -> str:
    return f"""w as (select {key}, list_filter(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}'']+'), lambda w: regexp_replace(regexp_replace(w, '^''+|''+$', '', 'g'), '''[sS]$', '')), lambda w: w <> '') as w from {source}),
    mt as (select {key}, list_slice(list_concat(list_filter(w, lambda x: length(x) >= 3), """ + ", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))" for n in (2, 3, 4)) + "), 1, 64) as mt from w)"


_AGO = f"nullif(regexp_extract({_LOW}, '(?:^|\\s)(\\d+)\\s+(?:day|week|month|hour|minute)s*\\s+ago(?:\\s|$)', 1), '')"
_UNIT = f"regexp_extract({_LOW}, '(?:^|\\s)\\d+\\s+(day|week|month|hour|minute)s*\\s+ago(?:\\s|$)', 1)"
_SECONDS = f"({_AGO}::bigint * case {_UNIT} when 'day' then 86400 when 'week' then 604800 when 'month' then 2592000 when 'hour' then 3600 else 60 end)"
_DAY = f"date_trunc('day', {NOW_SQL})"
_RANGES = [
    (["yesterday", "昨天"], f"{_DAY} - interval 1 day", f"{_DAY} - interval 1 second"), (["today", "今天"], _DAY, NOW_SQL), (["前天"], f"{_DAY} - interval 2 day", f"{_DAY} - interval 1 day - interval 1 second"),
    (["last week", "上周"], f"{NOW_SQL} - interval 7 day", NOW_SQL), (["last month", "上个月"], f"{NOW_SQL} - interval 30 day", NOW_SQL), (["this week", "这周"], f"date_trunc('week', {NOW_SQL})", NOW_SQL),
]


def _range_sql(place: int) -> str:
    cases = " ".join(f"when {_ANY(p[0])} then {p[place]}" for p in _RANGES)
    return f"strftime(case {cases} when {_AGO} is not null then {[None, NOW_SQL + ' - to_seconds(' + _SECONDS + ')', NOW_SQL][place]} when {_ANY(['recently', '刚才'])} then {[None, NOW_SQL + ' - interval 1 day', NOW_SQL][place]} end, '%Y-%m-%d %H:%M:%S')"


_ALPHA = " + ".join(f"contains({_LOW}, '{w}')::int" for w in TEMPORAL_WORDS)
_ASKED = "aq as (select alias_id as id, 'What does ' || min(alias) || ' do?' as question from graph_entity_aliases where alias is not null group by 1), " + _mentions_sql("question", "aq", "id") + """,
    e0 as (select id as entity_id, lower(trim(name)) as surface, coalesce(last_seen, first_seen) as seen from en where deleted_at is null and trim(name) <> ''),
    ne as (select surface, entity_id, max(seen) as seen, max(exact) as exact from (select surface, entity_id, seen, true as exact from e0 union all select lower(trim(alias)), e0.entity_id, seen, false from graph_entity_aliases join e0 on canonical_id = e0.entity_id where trim(alias) <> '') group by 1, 2),
    hit as (select id, entity_id, max(seen) as seen, max(exact) as exact from (select distinct id, lower(x) as surface from (select id, unnest(mt) as x from mt)) join ne using (surface) group by 1, 2),
    ae as (select id, entity_id, exact, round(0.7::double + 0.3::double * coalesce(case when max(s) over w > min(s) over w then (s - min(s) over w) / (max(s) over w - min(s) over w) else 1.0::double end, 0.0), 6) as score from (select *, floor(epoch(seen))::bigint as s from hit) window w as (partition by id))"""
SQL = {
    "question_features": "with " + _QS + ", " + _mentions_sql("question", "qs", "question") + f" select question, {_ANY(DATE_QUESTIONS)} as asks_for_date, case when {_ALPHA} >= 2 then 0.3::double when {_ALPHA} = 1 then 0.6::double else 0.9::double end as alpha, {_range_sql(1)} as range_start, {_range_sql(2)} as range_end, len(mt) as n_mentions from mt",
    "question_mentions": "with " + _QS + ", " + _mentions_sql("question", "qs", "question") + " select question, i - 1 as place, mt[i] as mention from (select question, mt, unnest(range(1, len(mt) + 1)) as i from mt)",
    "asked_entities": sql("") + ", " + _ASKED + " select * from ae",
    "entity_signal": sql("") + ", " + _ASKED + ", s as (select id, max(case when exact then 1.0::double else 0.8::double end) as s from ae group by 1) select coalesce(s, 0.0::double) as signal, count(*) as n from aq left join s using (id) group by 1",
}
