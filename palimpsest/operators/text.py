"""Extraction from text: entities by pattern, names, keywords, temporal phrases, dimensions in metadata, redaction by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.common import ns, table
from palimpsest.sources import store
from palimpsest.sources.store import sql

#: Patterns of entities in text, by kind.
ENTITY_PATTERNS = {
    "mention": r"@[A-Za-z][\w]{1,30}",
    "url": r"https?://[^\s)>\]\"]+",
    "version": r"\b\d+\.\d+\.\d+\b",
    "ticket": r"\b[A-Z]{3}-\d{2,5}\b",
    "path": r"\b[\w.\-]+/[\w.\-/]+\.[a-z]{2,5}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "into", "over", "are", "was", "not", "but", "has", "its", "all", "any", "each", "both"]


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """(id, kind, name): each distinct entity of a memory; persons lose the @, addresses their last slash."""
    m = store.memories(spark, d, "content").filter("content is not null")
    found = F.concat(*[F.transform(F.regexp_extract_all("content", F.lit(rx), 0), _named(kind)) for kind, rx in ENTITY_PATTERNS.items()])
    x = m.select("id", F.explode(found).alias("e"))
    name = F.lower("e.name")
    name = F.when(F.col("e.kind") == "mention", F.regexp_replace(name, "^@", "")).when(F.col("e.kind") == "url", F.regexp_replace(name, "/+$", "")).otherwise(name)
    return x.select("id", F.col("e.kind").alias("kind"), name.alias("name")).distinct()


def _named(kind: str):
    return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("name"))


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return extracted(spark, d).groupBy("kind", "name").agg(F.count("*").alias("n_memories"))


def co_occurring_entities(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of extracted entities in one memory (the first ten of each, by name), at least twice."""
    from pyspark.sql import Window as W

    e = extracted(spark, d).withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("name", "kind"))).filter("r <= 10").select("id", "name").distinct()
    p = e.join(e.select("id", F.col("name").alias("other")), "id").filter("name < other")
    return p.groupBy("name", "other").agg(F.count("*").alias("n")).filter("n >= 2")


def memories_without_entities(spark: SparkSession, d: str) -> DataFrame:
    m, me = store.memories(spark, d), store.mentions(spark, d)
    return m.join(me, F.lower("id") == F.col("memory_id"), "left_anti").groupBy("namespace").agg(F.count("*").alias("n"))


def extract_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Words of at least three letters that are no stop words: distinct a memory, counted over all."""
    words = F.array_distinct(F.filter(F.split(F.lower("content"), r"[^a-z]+"), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)))
    m = store.memories(spark, d, "content").filter("content is not null")
    return m.select("id", F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def tokens_cjk(spark: SparkSession, d: str) -> DataFrame:
    """Character pairs of runs of Chinese characters, as a full-text tokeniser without a dictionary makes them."""
    t = table(spark, d, "documents").filter("text is not null")
    run = t.select(F.explode(F.regexp_extract_all("text", F.lit(r"[一-鿿]+"), 0)).alias("r")).filter("length(r) >= 2")
    pair = run.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("r") - 1), lambda i: F.substr(F.col("r"), i, F.lit(2)))).alias("pair"))
    return pair.groupBy("pair").agg(F.count("*").alias("n")).filter("n >= 10")


#: Temporal phrases, in the order in which they are tried.
PHRASES = [("yesterday", r"\byesterday\b"), ("last_week", r"\blast week\b"), ("last_month", r"\b(over the )?(past|last) month\b"), ("this_morning", r"\b(early )?this morning\b"), ("recently", r"\brecent(ly)?\b"), ("iso_date", r"\d{4}-\d{2}-\d{2}")]


def temporal_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Each memory's first temporal phrase."""
    c = F.lower(F.coalesce("content", F.lit("")))
    out = F.lit("none")
    for name, rx in reversed(PHRASES):
        out = F.when(c.rlike(rx), name).otherwise(out)
    return store.memories(spark, d, "content").groupBy(out.alias("phrase")).agg(F.count("*").alias("n"))


#: The phrases that are grounded.
GROUNDED = r"\b(?:yesterday|today|tomorrow|(?:last|this|next)\s+(?:week|month|year)|\d+\s+(?:days?|weeks?)\s+ago)\b"


def phrase_start(phrase: Column, day: Column) -> Column:
    """The first day that a phrase means, seen from ``day``: weeks start on Monday; null where it means none."""
    p = F.regexp_replace(F.lower(phrase), r"\s+", " ")
    steps = F.when(p.startswith("last"), -1).when(p.startswith("next"), 1).otherwise(0)
    n = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    return (
        F.when(p == "yesterday", F.date_sub(day, 1)).when(p == "today", day).when(p == "tomorrow", F.date_add(day, 1))
        .when(p.endswith(" week"), F.date_add(F.trunc(day, "week"), 7 * steps))
        .when(p.endswith(" month"), F.add_months(F.trunc(day, "month"), steps))
        .when(p.endswith(" year"), F.add_months(F.trunc(day, "year"), 12 * steps))
        .when(p.rlike("days? ago$"), F.date_sub(day, n)).when(p.rlike("weeks? ago$"), F.date_sub(day, 7 * n))
    )


def grounded(content: Column, day: Column) -> Column:
    """The text with each phrase followed by its date in brackets; one that has its date already stays."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit("(?i)" + GROUNDED), 0), lambda x: F.lower(x)))

    def put(text: Column, phrase: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)(?<!\d)\b("), phrase, F.lit(r")\b(?! \(\d{4}-\d{2}-\d{2}\))"))
        date = F.date_format(phrase_start(phrase, day), "yyyy-MM-dd")
        return F.when(date.isNotNull(), F.regexp_replace(text, pattern, F.concat(F.lit("$1 ("), date, F.lit(")")))).otherwise(text)

    return F.aggregate(found, content, put)


def ground_dates(spark: SparkSession, d: str) -> DataFrame:
    """Phrases such as "yesterday", "last week" or "3 days ago" get their date after them, relative to the memory's own time."""
    m = store.memories(spark, d, "content").filter("content is not null")
    c = grounded(F.col("content"), F.col("event_time").cast("date"))
    return m.select("id", F.sha2(c, 256).alias("grounded"), (c != F.col("content")).alias("changed"))


def metadata_layout(spark: SparkSession, d: str) -> DataFrame:
    """Layouts of metadata: object, array, other JSON, key=value, blank, null."""
    x = F.trim("metadata")
    kind = F.when(F.col("metadata").isNull(), "null").when(x == "", "blank").when(x.startswith("{"), "object").when(x.startswith("["), "array").when(x.startswith('"'), "json_in_string").when(x.contains("="), "key_value").otherwise("other")
    return store.memories(spark, d, "metadata").groupBy(kind.alias("layout")).agg(F.count("*").alias("n"))


def type_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a memory's facets from what is filled in: additive, at most 1; and the primary one."""
    m = store.memories(spark, d, "memory_type", "source", "source_file", "metadata", "contradicts", "summary")
    has = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")
    factual = F.least(F.lit(1.0), 0.4 * has("summary") + 0.4 * has("source_file") + 0.2 * has("metadata"))
    episodic = F.least(F.lit(1.0), 0.6 * F.col("occurred_at").isNotNull().cast("int") + 0.4 * has("source"))
    causal = 0.7 * has("contradicts")
    top = F.greatest(factual, episodic, causal)
    first = F.when(factual == top, "factual").when(episodic == top, "episodic").otherwise("causal")
    return m.groupBy("memory_type", first.alias("primary_type")).agg(F.count("*").alias("n"), F.round(F.avg(top), 6).alias("avg_weight"))


def infer_type(spark: SparkSession, d: str) -> DataFrame:
    """Types guessed from words of the content, against the stored ones."""
    c = F.lower(F.coalesce("content", F.lit("")))
    guess = F.when(c.rlike(r"\b(prefer|prefers|dislikes|would rather)\b"), "opinion").when(c.rlike(r"\b(because|since|so that)\b"), "causal").when(c.rlike(r"\b(meeting|session|today|yesterday)\b"), "episodic").when(c.rlike(r"\b(step|run|how to)\b"), "procedural").otherwise("factual")
    return store.memories(spark, d, "content", "memory_type").groupBy("memory_type", guess.alias("guess")).agg(F.count("*").alias("n"))


#: What a page must not show, by pattern.
REDACTIONS = [("[EMAIL]", r"[\w.+\-]+@[\w\-]+\.[\w.\-]+"), ("[IP]", r"\b\d{1,3}(\.\d{1,3}){3}\b"), ("[PATH]", r"(^|\s)/(\w+/)+[\w.\-]+")]


def redacted(c: Column) -> Column:
    for mark, rx in REDACTIONS:
        c = F.regexp_replace(c, rx, mark)
    return c


def redact_patterns(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d, "content").filter("content is not null")
    c = redacted(F.col("content"))
    return m.filter(c != F.col("content")).select("id", F.sha2(c, 256).alias("digest"))


def parse_properties(spark: SparkSession, d: str) -> DataFrame:
    """A JSON field by path, typed, with its distribution."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def source_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Sources by scheme or first folder, by namespace."""
    s = F.trim(F.coalesce("source_file", "source"))
    kind = F.when(s.isNull() | (s == ""), "none").when(s.rlike(r"^[a-z]+:"), F.regexp_extract(s, r"^([a-z]+):", 1)).when(s.startswith("{") | s.startswith("["), "json").otherwise(F.regexp_extract(s, r"^/?([^/]+)", 1))
    return store.memories(spark, d, "source", "source_file").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_entities, co_occurring_entities, memories_without_entities, extract_keywords, tokens_cjk, temporal_phrases, ground_dates, metadata_layout, type_weights, infer_type, redact_patterns,
        parse_properties, source_kinds,
    )
}

_ALL = " union all ".join(f"select id, '{k}' as kind, unnest(regexp_extract_all(content, '{rx}')) as raw from m where content is not null" for k, rx in ENTITY_PATTERNS.items())
_EX = f"ex as (select distinct id, kind, case kind when 'mention' then regexp_replace(lower(raw), '^@', '') when 'url' then regexp_replace(lower(raw), '/+$', '') else lower(raw) end as name from ({_ALL}))"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PH = "case " + " ".join(f"when regexp_matches(c, '{rx}') then '{n}'" for n, rx in PHRASES) + " else 'none' end"
_has = lambda c: f"(trim(coalesce({c}, '')) <> '')::int"
_F, _E, _C = f"least(1.0::double, 0.4::double * {_has('summary')} + 0.4::double * {_has('source_file')} + 0.2::double * {_has('metadata')})", f"least(1.0::double, 0.6::double * (occurred_at is not null)::int + 0.4::double * {_has('source')})", f"0.7::double * {_has('contradicts')}"
_RED = "content"
for _mark, _rx in REDACTIONS:
    _RED = f"regexp_replace({_RED}, '{_rx}', '{_mark}', 'g')"
SQL = {
    "extract_entities": sql("") + f", {_EX} select kind, name, count(*) as n_memories from ex group by 1, 2",
    "co_occurring_entities": sql("") + f", {_EX}, t as (select distinct id, name from (select *, row_number() over (partition by id order by name, kind) as r from ex) where r <= 10) select a.name, b.name as other, count(*) as n from t a join t b on a.id = b.id and a.name < b.name group by 1, 2 having count(*) >= 2",
    "memories_without_entities": sql("select namespace, count(*) as n from m where lower(id) not in (select memory_id from me) group by 1"),
    "extract_keywords": sql(f"select word, count(*) as n from (select distinct id, unnest(regexp_split_to_array(lower(content), '[^a-z]+')) as word from m where content is not null) where length(word) >= 3 and word not in ({_STOP}) group by 1"),
    "tokens_cjk": "select pair, count(*) as n from (select substring(r, i, 2) as pair from (select unnest(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]+')) as r from documents where text is not null), lateral (select unnest(range(1, length(r))) as i) where length(r) >= 2) group by 1 having count(*) >= 10",
    "temporal_phrases": sql(f"select {_PH} as phrase, count(*) as n from (select lower(coalesce(content, '')) as c from m) group by 1"),
    "metadata_layout": sql("select case when metadata is null then 'null' when trim(metadata) = '' then 'blank' when starts_with(trim(metadata), '{') then 'object' when starts_with(trim(metadata), '[') then 'array' when starts_with(trim(metadata), '\"') then 'json_in_string' when contains(trim(metadata), '=') then 'key_value' else 'other' end as layout, count(*) as n from m group by 1"),
    "type_weights": sql(f"select memory_type, case when {_F} = greatest({_F}, {_E}, {_C}) then 'factual' when {_E} = greatest({_F}, {_E}, {_C}) then 'episodic' else 'causal' end as primary_type, count(*) as n, round(avg(greatest({_F}, {_E}, {_C})), 6) as avg_weight from m group by 1, 2"),
    "infer_type": sql("select memory_type, case when regexp_matches(c, '\\b(prefer|prefers|dislikes|would rather)\\b') then 'opinion' when regexp_matches(c, '\\b(because|since|so that)\\b') then 'causal' when regexp_matches(c, '\\b(meeting|session|today|yesterday)\\b') then 'episodic' when regexp_matches(c, '\\b(step|run|how to)\\b') then 'procedural' else 'factual' end as guess, count(*) as n from (select memory_type, lower(coalesce(content, '')) as c from m) group by 1, 2"),
    "redact_patterns": sql(f"select id, sha256({_RED}) as digest from m where content is not null and {_RED} <> content"),
    "parse_properties": "select event_type, count(*) as n, count(k) as n_k, sum(k)::bigint as sum_k, max(k) as max_k from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1",
    "source_kinds": sql("select case when s is null or s = '' then 'none' when regexp_matches(s, '^[a-z]+:') then regexp_extract(s, '^([a-z]+):', 1) when starts_with(s, '{') or starts_with(s, '[') then 'json' else regexp_extract(s, '^/?([^/]+)', 1) end as kind, count(*) as n from (select trim(coalesce(source_file, source)) as s from m) group by 1"),
}
