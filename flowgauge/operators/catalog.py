"""Dataset declarations: canonical types, conflicts, richness, drift and contract checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Type names and the names they stand for, and the names that stand alone.
TYPE_ALIASES = {
    "byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint", "real": "float", "bool": "boolean",
    "datetime": "timestamp_ntz",
}
SIMPLE_TYPES = (
    "tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string", "binary", "date", "time",
    "timestamp", "timestamp_ntz", "uuid", "json",
)
#: The innermost nested types of a text whose inner types are marks already; a structure may name a field once only.
_INNER = (r"(array<#>|map<#,#>|struct<(?!(?:[^<>]*,)?([a-z_][a-z0-9_]*):#,(?:[^<>]*,)?\2:#[,>])"
          r"[a-z_][a-z0-9_]*:#(?:,[a-z_][a-z0-9_]*:#)*>)")


def canonical_type(text: Column) -> Column:
    """The canonical text of a declared type; null when it is none."""
    out = F.regexp_replace(F.lower(F.trim(text)), r"\s*([<>(),:])\s*", "$1")
    out = F.regexp_replace(out, r"(?<=[<,])([a-z_][a-z0-9_]*)\s+(?=[a-z])", "$1:")
    for alias, name in TYPE_ALIASES.items():
        out = F.regexp_replace(out, rf"(?<![a-z0-9_]){alias}(?![a-z0-9_:])", name)
    out = F.regexp_replace(out, r"(?<![a-z0-9_])decimal\((\d+)\)", "decimal($1,0)")
    out = F.regexp_replace(out, r"(?<![a-z0-9_])fixed\((\d+)\)", "fixed_size_binary($1)")
    return F.when(_is_type(out), out)


def _is_type(text: Column) -> Column:
    """Whether a canonical text is well formed: the innermost types are replaced by a mark until one mark is left."""
    rest = F.regexp_replace(text, r"(?<![a-z0-9_])decimal\(([1-9]|[12]\d|3[0-8]),(\d+)\)", "#")
    scale = F.regexp_extract_all(text, F.lit(r"decimal\(\d+,(\d+)\)"), F.lit(1))
    digits = F.regexp_extract_all(text, F.lit(r"decimal\((\d+),\d+\)"), F.lit(1))
    scaled = F.forall(F.zip_with(scale, digits, lambda s, p: s.try_cast("int") <= p.try_cast("int")), lambda ok: ok)
    rest = F.regexp_replace(rest, r"(?<![a-z0-9_])(varchar|char|fixed_size_binary)\([1-9]\d*\)", "#")
    rest = F.regexp_replace(rest, rf"(?<![a-z0-9_])({'|'.join(sorted(SIMPLE_TYPES, reverse=True))})(?![a-z0-9_:(<])", "#")
    levels = F.sequence(F.lit(0), F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit(""))))  # one for each "<"
    rest = F.aggregate(levels, rest, lambda text, _: F.regexp_replace(text, _INNER, "#"))
    return (rest == "#") & scaled


def canonical_declarations(declarations: DataFrame) -> DataFrame:
    """Declarations with their canonical type; each distinct type text is read once and joined back."""
    types = declarations.select("type_text").distinct().withColumn("type", canonical_type(F.col("type_text")))
    return declarations.join(types, "type_text")


def type_conflicts(declarations: DataFrame) -> DataFrame:
    """Columns of an asset that pipelines declare with different types: one row per pipeline that declares it."""
    column = ["asset", "column_name"]
    clashing = declarations.groupBy(*column).agg(F.count_distinct("type").alias("types")).where("types > 1")
    return declarations.join(clashing, column).select(*column, "pipeline", "type", "types")


def size_conflicts(declarations: DataFrame) -> DataFrame:
    """Assets whose declarations differ in their number of columns: one row per pipeline."""
    sizes = declarations.groupBy("asset", "pipeline").agg(F.count("*").alias("columns"))
    clashing = sizes.groupBy("asset").agg(F.min("columns").alias("least"), F.max("columns").alias("most")).where("least < most")
    return sizes.join(clashing.select("asset"), "asset", "left_semi")


def richest_declaration(declarations: DataFrame) -> DataFrame:
    """Per asset the declaration that says most: a point per column and per constraint; ties keep the first."""
    points = F.lit(1)
    for said in (~F.col("nullable"), F.col("primary_key"), F.col("partition_key"), F.col("description") != ""):
        points = points + F.coalesce(said, F.lit(False)).cast("int")
    scored = declarations.groupBy("asset", "pipeline").agg(F.sum(points).alias("score"), F.min("position").alias("position"))
    return scored.groupBy("asset").agg(F.max(F.struct(
        "score", (-F.col("position")).alias("first"), "pipeline")).alias("best")).select("asset", "best.pipeline", "best.score")


def duplicate_columns(declarations: DataFrame) -> DataFrame:
    """Columns one declaration names twice, by exact spelling."""
    return declarations.groupBy("asset", "pipeline", "column_name").agg(F.count("*").alias("times")).where("times > 1")


def stored_type(canonical: Column) -> Column:
    """How a dataset stores a canonical type: lengths and types that are texts in files do not count as a change."""
    text = F.regexp_replace(canonical, r"(?<![a-z0-9_])(varchar|char)\(\d+\)", "string")
    text = F.regexp_replace(text, r"(?<![a-z0-9_])(uuid|json|time)(?![a-z0-9_:])", "string")
    return F.regexp_replace(text, r"(?<![a-z0-9_])fixed_size_binary\(\d+\)", "binary")


def schema_drift(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns that each declaration (asset, pipeline) and a dataset disagree on: missing, extra, type or nullability.

    Only a dataset that may hold nulls where none are declared has changed its nullability.
    """
    fields = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("actual_type"),
                       F.lit(f.nullable).alias("actual_nullable")) for f in actual.schema.fields]
    key = ["asset", "pipeline"]
    found = declared.select(*key).distinct().withColumn("f", F.explode(F.array(*fields))).select(*key, "f.*")
    said = declared.select(*key, "column_name", "type", "nullable", F.lit(True).alias("declared"))
    joined = said.join(found, [*key, "column_name"], "full")
    drift = (
        F.when(F.col("actual_type").isNull(), "missing").when(F.col("declared").isNull(), "extra")
        .when(~stored_type(F.col("type")).eqNullSafe(F.col("actual_type")), "type changed")
        .when(~F.col("nullable") & F.col("actual_nullable"), "nullability changed")
    )
    return joined.select(*key, "column_name", "type", "actual_type", drift.alias("drift")).where("drift IS NOT NULL")


def contract_violations(data: DataFrame, contract: list[dict]) -> DataFrame:
    """Rows that break each declared rule, counted: nulls, lengths in one pass, keys in one grouping per key.

    A contract without a rule has no violations. Column names may hold dots and other marks.
    """

    def column(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    checks, keys = [], []
    for declared in contract:
        name = declared["name"]
        if not declared.get("nullable", True):
            checks.append((name, "not null", F.count_if(column(name).isNull())))
        if declared.get("max_length"):
            checks.append((name, "length", F.count_if(F.length(column(name)) > declared["max_length"])))
        if declared.get("bytes"):
            checks.append((name, "byte length", F.count_if(F.octet_length(column(name)) != declared["bytes"])))
        if declared.get("unique"):
            keys.append(([name], "unique"))
    primary = [c["name"] for c in contract if c.get("primary_key")]
    if primary:
        keys.append((primary, "primary key"))
    parts = [data.sparkSession.createDataFrame([], "column_name string, rule string, violations long")]
    if checks:
        counts = data.agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
        parts.append(counts.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"c{i}").alias("violations"))
            for i, (n, rule, _) in enumerate(checks)])).alias("v")).select("v.*"))
    for names, rule in keys:
        held = reduce(Column.__and__, [column(n).isNotNull() for n in names])
        repeated = data.where(held).groupBy(*[column(n).alias(f"k{i}") for i, n in enumerate(names)]).agg(
            F.count("*").alias("held")).where("held > 1")
        parts.append(repeated.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("violations")).select(
            F.lit(",".join(names)).alias("column_name"), F.lit(rule).alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts).where("violations > 0")


def granularity_mismatches(assets: DataFrame, inferred: Column) -> DataFrame:
    """Assets whose declared granularity differs from what their partition columns suggest; advisory."""
    known = assets.withColumn("inferred", inferred)
    return known.where((F.col("inferred").isNotNull()) & (F.col("inferred") != F.col("granularity")))


def fingerprint(specs: DataFrame) -> DataFrame:
    """The sha256 of each version's ``[[task, hash], ...]`` text in task order, and whether it names a task twice.

    A version holds at most the few thousand tasks a pipeline may have, so its pairs fit one row.
    """
    versions = specs.groupBy("version").agg(
        F.sort_array(F.collect_list(F.struct("task_id", "text_hash"))).alias("pairs"),
        (F.count("*") > F.count_distinct("task_id")).alias("repeated"))
    text = F.to_json(F.transform("pairs", lambda p: F.array(p["task_id"], p["text_hash"])))
    return versions.select("version", F.when(~F.col("repeated"), F.sha2(text, 256)).alias("fingerprint"), "repeated")
