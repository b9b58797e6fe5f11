"""Schemas that drift between files: one consistent table and a list of changes.

Method: a column lifespan catalogue. Every readable line is exploded into its
top-level fields; for each producer, field and type the files that hold it form
islands (a gap of one file ends an island), found with ``lag``. Where an island
starts or ends, the catalogue logs ``added``, ``removed``, ``type_changed`` or,
when the values agree in all memories that both files hold, ``renamed``. The
renames of a producer, followed in chains, extend the table of known names; from
that alias table the casts of the consistent table come.

Only lines of files at a change are compared by value, keyed by memory, so no
file, producer or field is gathered in one task.

Defined results: lines that are no JSON object are unreadable and counted, not
used; a repeated line counts once; a file without readable lines has no fields,
so its neighbours report nothing against it; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint
from palimpsest.operators.components import connected_components

#: The names under which the writers have kept each field.
ALIASES = {
    "id": ["id", "memory_id", "_id", "uuid"],
    "content": ["content"],
    "summary": ["summary"],
    "layer": ["layer"],
    "lang": ["lang"],
    "importance": ["importance"],
    "pinned": ["pinned"],
    "created_at": ["created_at"],
    "source": ["source", "origin"],
    "source_file": ["source_file", "sourceFile", "src_path"],
    "source_kind": ["source_kind", "channel"],
    "metadata": ["metadata", "Metadata", "meta", "extra"],
    "session_no": ["session_no"],
    "tags": ["tags"],
}


def memory_key(v: str = "v") -> Column:
    """The memory of a record, under any of its known names."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in ALIASES["id"]])


def _lines(exports: DataFrame) -> DataFrame:
    """Distinct lines with their record as a map of raw JSON values; null where unreadable."""
    one = exports.select("producer", "file_no", "line_no", "record").distinct()
    v = F.try_parse_json("record")
    readable = F.schema_of_variant(v).startswith("OBJECT")
    return one.withColumn("v", F.when(readable, v))


def field_values(exports: DataFrame) -> DataFrame:
    """producer, file_no, line_no, memory_id, field, kind, value for each top-level field."""
    lines = _lines(exports).filter("v is not null")
    raw = lines.select("producer", "file_no", "line_no", memory_key().alias("memory_id"), F.expr("cast(v as map<string, variant>)").alias("m"))
    cells = raw.select("producer", "file_no", "line_no", "memory_id", F.explode("m").alias("field", "x"))
    kind = F.schema_of_variant("x")
    kind = (
        F.when(kind == "VOID", F.lit(None))
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )
    return cells.select("producer", "file_no", "line_no", "memory_id", "field", kind.alias("kind"), F.when(kind.isNotNull(), F.to_json("x")).alias("value"))


def file_fields(cells: DataFrame) -> DataFrame:
    """The fields of each file with their type: that of most non-null values (ties: the first by name)."""
    counts = cells.groupBy("producer", "file_no", "field", "kind").agg(F.count("*").alias("n"))
    return counts.groupBy("producer", "file_no", "field").agg(
        F.min_by("kind", F.when(F.col("kind").isNotNull(), F.struct(-F.col("n"), F.col("kind")))).alias("kind"),
        F.sum("n").alias("n_values"),
    )


def lifespans(fields: DataFrame) -> DataFrame:
    """Islands of files for each producer, field and type: first_file, last_file, n_values."""
    key = W.partitionBy("producer", "field").orderBy("file_no")
    new = (F.lag("file_no").over(key).isNull()) | (F.lag("file_no").over(key) != F.col("file_no") - 1) | ~F.lag("kind").over(key).eqNullSafe(F.col("kind"))
    marked = fields.withColumn("starts", new.cast("int")).withColumn("island", F.sum("starts").over(key))
    return marked.groupBy("producer", "field", "island").agg(
        F.max("kind").alias("kind"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.sum("n_values").alias("n_values")
    )


def _renames(exports: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of a field that goes and one that comes whose values agree in every memory of both files."""
    lines = _lines(exports).filter("v is not null")
    # a line is the new side of its own file's step and the old side of the next one
    sides = lines.select(
        "producer", memory_key().alias("memory_id"), "v",
        F.explode(F.array(F.struct(F.col("file_no").alias("file_no"), F.lit(False).alias("old")), F.struct((F.col("file_no") + 1).alias("file_no"), F.lit(True).alias("old")))).alias("s"),
    ).filter("memory_id is not null")
    met = sides.select("producer", "s.file_no", "s.old", "memory_id", "v").join(pairs, ["producer", "file_no"])
    x = F.try_element_at(F.expr("cast(v as map<string, variant>)"), F.when(F.col("old"), F.col("field_before")).otherwise(F.col("field_after")))
    met = met.withColumn("x", x)
    value = F.when(F.schema_of_variant("x") != "VOID", F.to_json("x"))
    keys = ["producer", "file_no", "field_before", "field_after"]
    met = met.select(*keys, "memory_id", "old", value.alias("value"))
    one = met.groupBy(*keys, "memory_id").agg(
        F.min(F.when(F.col("old"), F.col("value"))).alias("before"),
        F.min(F.when(~F.col("old"), F.col("value"))).alias("after"),
        F.max(F.col("old")).alias("in_old"), F.max(~F.col("old")).alias("in_new"),
    ).filter("in_old and in_new")
    return one.groupBy(*keys).agg(F.min(F.col("before").eqNullSafe(F.col("after"))).alias("agree"), F.count("before").alias("n")).filter("agree and n > 0").select(*keys, F.lit(True).alias("same"))


def schema_changes(exports: DataFrame) -> DataFrame:
    """producer, file_no, field_before, field_after, change_kind, kind_before, kind_after.

    The data are read twice: for the catalogue, and for the values of fields at
    a change. What lies between is one row for each island and is checkpointed.
    """
    fields = checkpoint(file_fields(field_values(exports)))
    spans = lifespans(fields)
    files = fields.select("producer", "file_no").distinct()
    steps = files.join(files.select("producer", (F.col("file_no") + 1).alias("file_no")), ["producer", "file_no"])
    # each island gives the step at which it starts and the one at which it ends
    ends = spans.select(
        "producer", "field",
        F.explode(F.array(
            F.struct(F.col("first_file").alias("file_no"), F.lit(None).cast("string").alias("kind_before"), F.lit(False).alias("ends"), F.col("kind").alias("kind_after"), F.lit(True).alias("starts")),
            F.struct((F.col("last_file") + 1).alias("file_no"), F.col("kind").alias("kind_before"), F.lit(True).alias("ends"), F.lit(None).cast("string").alias("kind_after"), F.lit(False).alias("starts")),
        )).alias("e"),
    ).select("producer", "field", "e.*")
    edge = ends.groupBy("producer", "file_no", "field").agg(F.max("ends").alias("ends"), F.max("starts").alias("starts"), F.max("kind_before").alias("kind_before"), F.max("kind_after").alias("kind_after"))
    edge = checkpoint(edge.join(steps, ["producer", "file_no"], "left_semi"))
    gone = edge.filter("ends and not starts").select("producer", "file_no", F.col("field").alias("field_before"), "kind_before")
    come = edge.filter("starts and not ends").select("producer", "file_no", F.col("field").alias("field_after"), "kind_after")
    pairs = gone.join(come, ["producer", "file_no"])
    pairs = checkpoint(pairs.join(_renames(exports, pairs.drop("kind_before", "kind_after")), ["producer", "file_no", "field_before", "field_after"]))
    gone_only = gone.join(pairs.select("producer", "file_no", "field_before"), ["producer", "file_no", "field_before"], "left_anti")
    come_only = come.join(pairs.select("producer", "file_no", "field_after"), ["producer", "file_no", "field_after"], "left_anti")
    typed = edge.filter("starts and ends and kind_before <> kind_after")
    none, c = F.lit(None).cast("string"), F.col
    shape = lambda d, b, a, k, kb, ka: d.select("producer", "file_no", b.alias("field_before"), a.alias("field_after"), F.lit(k).alias("change_kind"), kb.alias("kind_before"), ka.alias("kind_after"))
    parts = [
        shape(pairs, c("field_before"), c("field_after"), "renamed", c("kind_before"), c("kind_after")),
        shape(gone_only, c("field_before"), F.lit(""), "removed", c("kind_before"), none),
        shape(come_only, F.lit(""), c("field_after"), "added", none, c("kind_after")),
        shape(typed, c("field"), c("field"), "type_changed", c("kind_before"), c("kind_after")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _cast_time(text: Column) -> Column:
    number = text.try_cast("decimal(38,9)")
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)), F.floor(number * 1_000_000).cast("bigint"))


def learned_aliases(changes: DataFrame) -> DataFrame:
    """(producer, learned: column -> names): names that a producer's renames, in chains, tie to a known name of a column.

    A name tied to several columns, or to none, is not learned. One row a producer.
    """
    e = changes.filter("change_kind = 'renamed'").select("producer", "field_before", "field_after").distinct()
    node = lambda c: F.to_json(F.array("producer", c))
    group = connected_components(e.select(node("field_before").alias("src"), node("field_after").alias("dst")))
    name = F.from_json("node", "array<string>")
    column = F.lit(None).cast("string")
    for c, names in ALIASES.items():
        column = F.when(F.col("field").isin(names), c).otherwise(column)
    group = group.select("component", name[0].alias("producer"), name[1].alias("field")).withColumn("column", column)
    sure = group.groupBy("component").agg(F.min("column").alias("c"), F.max("column").alias("d")).filter("c = d").select("component", "c")
    new = group.filter("column is null").join(sure, "component").groupBy("producer", "c").agg(F.array_sort(F.collect_set("field")).alias("names"))
    return new.groupBy("producer").agg(F.map_from_entries(F.collect_list(F.struct("c", "names"))).alias("learned"))


def consistent_table(exports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All exported memories in one schema; of a memory exported several times, each (producer, file_no) keeps a row.

    Values under a known name of a column are taken in the order of the names,
    then those under names that the producer's renames tie to it (``aliases``,
    by default those of this export); all others go to ``other`` as a JSON object.
    """
    aliases = learned_aliases(schema_changes(exports)) if aliases is None else aliases
    lines = _lines(exports).filter("v is not null").withColumn("m", F.expr("cast(v as map<string, variant>)"))
    lines = lines.join(checkpoint(aliases), "producer", "left")

    def cell(column: str) -> Column:
        value = lambda x: F.when(F.schema_of_variant(x) != "VOID", x)
        known = [value(F.try_variant_get("v", f'$["{n}"]', "variant")) for n in ALIASES[column]]
        names = F.try_element_at("learned", F.lit(column))
        return F.coalesce(*known, F.when(names.isNotNull(), F.try_element_at(F.filter(F.transform(names, lambda n: value(F.try_element_at("m", n))), lambda x: x.isNotNull()), F.lit(1))))

    lines = lines.select("producer", "file_no", "line_no", "m", "learned", *[cell(c).alias(f"_{c}") for c in ALIASES])
    text = lambda c, at="$": F.try_variant_get(f"_{c}", at, "string")
    # a path may be text, {"path": text} or [text]; nested metadata stay JSON
    path = lambda c: F.coalesce(text(c, "$.path"), text(c, "$[0]"), text(c))
    taken = [n for names in ALIASES.values() for n in names]
    learned = F.coalesce(F.flatten(F.map_values("learned")), F.array().cast("array<string>"))
    rest = F.map_filter("m", lambda k, _: ~k.isin(taken) & ~F.array_contains(learned, k))
    pinned = F.lower(text("pinned"))
    return lines.select(
        "producer", "file_no", "line_no",
        text("id").alias("id"), text("content").alias("content"), text("summary").alias("summary"), text("layer").alias("layer"), text("lang").alias("lang"),
        text("importance").try_cast("double").alias("importance"),
        F.when(pinned.isin("true", "1"), True).when(pinned.isin("false", "0"), False).alias("pinned"),
        _cast_time(text("created_at")).alias("created_us"),
        path("source").alias("source"), path("source_file").alias("source_file"), text("source_kind").alias("source_kind"),
        text("metadata").alias("metadata"), text("session_no").try_cast("bigint").alias("session_no"), text("tags").alias("tags"),
        F.when(F.size(rest) > 0, F.to_json(rest)).alias("other"),
    )


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/memory_exports.parquet")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(_exports(spark, sf_dir)).select("producer", "file_no", "field_before", "field_after", "change_kind").distinct()


def p7_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_table(_exports(spark, sf_dir))


def p7_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifespans(file_fields(field_values(_exports(spark, sf_dir))))
