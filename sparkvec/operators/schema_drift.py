"""Schemas that drift between files: one consistent table for each dataset, and every change with its version.

Tagged-union inference: the schemas of all versions and files of a dataset are fused into one. A column (a *path*) keeps every
type that it ever had as an alternative, tagged; a row's value goes to the branch of its own tag and is converted to the
column's canonical type beside it. A path under which an alternative first appears, vanishes, or changes its name or type is
reported under the version where it does.

What a version holds is taken from its declaration, in whatever notation, and where that is lacking from the keys of its
rows; types are then those of the version before, or of the next for a column that is new. Version numbers decide, never
times. A column that is gone and one that is new are the same, renamed, if the values that records had under the one live on
under the other (at least ``RENAME_SHARE`` of the records with a value in both versions; best pairs first, each name once).

Everything is grouped by (dataset, version, column) after a map-side combine; rows are compared only by equal (dataset,
record, value), so neither a hot dataset nor a record sent very often gathers in one task.

Defined cases
    Versions of a dataset are compared in ascending order of those known; nothing is reported for the lowest. Repeated
    declarations: the newest ``created_at`` that can be read holds. Unreadable or null declarations count as lacking; so do
    those without any field. Null dataset names or versions and unreadable payloads are ignored. A declared column without a
    type has that of the version before or after. A version known by neither declaration nor rows isn't compared. Empty
    tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.session import cut

RENAME_SHARE = 0.8
#: fixed values: spellings of a type that mean the same
TYPES = {
    "int64": ("int64", "long", "bigint"), "int32": ("int32", "int", "integer"), "float64": ("float64", "double"), "float32": ("float32", "float"),
    "string": ("utf8", "large_utf8", "string"), "bool": ("bool", "boolean"),
}


def canonical_type(t: Column) -> Column:
    """One spelling for each type; timestamps of any unit are one type. Null for a blank one."""
    low = F.lower(F.trim(t))
    out = F.when(low == "", None).when(low.startswith("timestamp"), "timestamp")
    for name, spellings in TYPES.items():
        out = out.when(low.isin(*spellings), name)
    return out.otherwise(low)


def declared_fields(text: Column) -> Column:
    """``array<struct<name, type>>`` of a list of {name, type}, of an object {name: type}, or of "name: type, ..."; else null."""
    as_list = F.from_json(text, "array<struct<name:string,type:string>>")
    as_map = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("type")))
    # a comma inside brackets belongs to a type
    parts = F.split(text, r",(?![^\[\](){}<>]*[\])}>])")
    as_text = F.transform(parts, lambda p: F.struct(F.trim(F.split(p, ":", 2)[0]).alias("name"), F.trim(F.get(F.split(p, ":", 2), F.lit(1))).alias("type")))
    first = F.substring(F.ltrim(text), 1, 1)
    fields = F.when(first == "[", as_list).when(first == "{", as_map).when(F.contains(text, F.lit(":")), as_text)
    kept = F.filter(fields, lambda f: f["name"].isNotNull() & (f["name"] != ""))
    return F.when(F.size(kept) > 0, kept)


def canonical_value(v: Column) -> Column:
    """Numbers in one notation whether written as numbers or strings; other texts as they are."""
    return F.coalesce(v.try_cast("decimal(38,10)").cast("string"), v)


def _payload(batch_rows: DataFrame) -> DataFrame:
    rows = batch_rows.where(F.col("dataset_name").isNotNull() & F.col("schema_version").isNotNull())
    return rows.select("dataset_name", F.col("schema_version").alias("v"), F.from_json("payload_json", "map<string,string>").alias("m")).where("m is not null")


def fields_by_version(schema_versions: DataFrame, batch_rows: DataFrame) -> DataFrame:
    """``(dataset_name, v, ord, last_ord, name, type)``: the fields of every version; ord numbers a dataset's versions from 1."""
    key = ["dataset_name", "v"]
    newest = F.max(F.struct(F.col("created_at"), F.col("fields")))["fields"]
    known = schema_versions.where(F.col("dataset_name").isNotNull() & F.col("schema_version").isNotNull())
    declared = known.select("dataset_name", F.col("schema_version").alias("v"), "created_at", declared_fields(F.col("fields_json")).alias("fields")).where("fields is not null").groupBy(*key).agg(newest.alias("fields"))
    decl = declared.select(*key, F.explode("fields").alias("f")).groupBy(*key, F.col("f.name").alias("name")).agg(F.max(canonical_type(F.col("f.type"))).alias("type"))
    seen = _payload(batch_rows).select(*key, F.explode(F.map_keys("m")).alias("name")).distinct()
    lacking = seen.join(declared.select(*key), key, "left_anti").withColumn("type", F.lit(None).cast("string"))
    # by version and column, not by row: written once, so that the rows aren't read again for every use below
    fields = cut(decl.unionByName(lacking))
    versions = fields.select(*key).distinct()
    numbered = versions.withColumn("ord", F.row_number().over(W.partitionBy("dataset_name").orderBy("v")))
    numbered = numbered.withColumn("last_ord", F.max("ord").over(W.partitionBy("dataset_name")))
    return fields.join(numbered, key)


def lives(fields: DataFrame) -> DataFrame:
    """Every field row with ``life`` (an unbroken run of versions that hold the name) and a type for each version."""
    run = F.col("ord") - F.row_number().over(W.partitionBy("dataset_name", "name").orderBy("ord"))
    f = fields.withColumn("life", run)
    w = W.partitionBy("dataset_name", "name", "life").orderBy("ord")
    before = F.last("type", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("type", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return cut(f.withColumn("type", F.coalesce(before, after)))


def _turns(life: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names new at a version and names gone at a version: ``(dataset_name, v, prev_v, name)`` each."""
    spans = life.groupBy("dataset_name", "name", "life").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.first("last_ord").alias("last_ord"))
    step = versions.select("dataset_name", "ord", "v", F.lag("v").over(W.partitionBy("dataset_name").orderBy("ord")).alias("prev_v"))
    new = spans.where("a > 1").join(step.withColumnRenamed("ord", "a"), ["dataset_name", "a"]).select("dataset_name", "v", "prev_v", "name")
    gone = spans.where("b < last_ord").withColumn("ord", F.col("b") + 1).join(step, ["dataset_name", "ord"]).select("dataset_name", "v", "prev_v", "name")
    return cut(new), cut(gone)


def _evidence(batch_rows: DataFrame, which: DataFrame) -> DataFrame:
    """Distinct ``(dataset_name, v, side, name, rec, value)`` of the rows of the versions ``row_v`` under the names in ``which``; the rows
    are parsed once."""
    rows = _payload(batch_rows).withColumnRenamed("v", "row_v").join(which.select("dataset_name", "row_v").distinct(), ["dataset_name", "row_v"], "left_semi")
    cells = rows.select("dataset_name", "row_v", canonical_value(F.col("m")["id"]).alias("rec"), F.explode("m").alias("name", "value")).where("rec is not null and value is not null and name <> 'id'")
    return cut(cells.join(which, ["dataset_name", "row_v", "name"]).select("dataset_name", "v", "side", "name", "rec", F.xxhash64(canonical_value(F.col("value"))).alias("value")).distinct())


def renames(new: DataFrame, gone: DataFrame, batch_rows: DataFrame, share: float = RENAME_SHARE) -> DataFrame:
    """``(dataset_name, v, old_name, name)`` of columns whose values live on under another name."""
    both = new.select("dataset_name", "v").distinct().join(gone.select("dataset_name", "v").distinct(), ["dataset_name", "v"])
    sides = gone.select("dataset_name", "v", F.col("prev_v").alias("row_v"), "name", F.lit("old").alias("side")).unionByName(new.select("dataset_name", "v", F.col("v").alias("row_v"), "name", F.lit("new").alias("side")))
    cells = _evidence(batch_rows, sides.join(both, ["dataset_name", "v"]))
    x = cells.where("side = 'old'").drop("side").withColumnRenamed("name", "old_name")
    y = cells.where("side = 'new'").drop("side")
    pair = ["dataset_name", "v", "old_name", "name"]
    equal = x.join(y, ["dataset_name", "v", "rec", "value"]).groupBy(*pair).agg(F.countDistinct("rec").alias("eq"))
    compared = x.drop("value").distinct().join(y.drop("value").distinct(), ["dataset_name", "v", "rec"]).groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
    good = equal.join(compared, pair).where(F.col("eq") >= share * F.col("n"))
    left, out = cut(good), None
    rank = lambda c, other: F.row_number().over(W.partitionBy("dataset_name", "v", c).orderBy(F.desc(F.col("eq") / F.col("n")), F.desc("eq"), other))
    while True:
        # pairs that are each other's best; those whose best is taken choose again among the rest
        best = cut(left.withColumn("r1", rank("name", "old_name")).withColumn("r2", rank("old_name", "name")).where("r1 = 1 and r2 = 1").select(*pair))
        out = best if out is None else out.unionByName(best)
        if best.isEmpty():
            return out
        left = cut(left.join(best.select("dataset_name", "v", "name"), ["dataset_name", "v", "name"], "left_anti").join(best.select("dataset_name", "v", "old_name"), ["dataset_name", "v", "old_name"], "left_anti"))
        if left.isEmpty():
            return out


def changes(schema_versions: DataFrame, batch_rows: DataFrame, share: float = RENAME_SHARE) -> DataFrame:
    """``(dataset_name, schema_version, column_name, change_kind, detail)``: every change of a field.

    ``detail`` is the old name of a renamed column, ``old -> new`` for a retyped one, the type for an added one.
    """
    fields = fields_by_version(schema_versions, batch_rows)
    life = lives(fields)
    versions = fields.select("dataset_name", "ord", "v").distinct()
    new, gone = _turns(life, versions)
    ren = renames(new, gone, batch_rows, share)
    w = W.partitionBy("dataset_name", "name", "life").orderBy("ord")
    retyped = life.withColumn("old", F.lag("type").over(w)).where("old <> type").select("dataset_name", "v", "name", F.lit("retyped").alias("kind"), F.concat_ws(" -> ", "old", "type").alias("detail"))
    renamed = ren.select("dataset_name", "v", "name", F.lit("renamed").alias("kind"), F.col("old_name").alias("detail"))
    added = new.join(ren.select("dataset_name", "v", "name"), ["dataset_name", "v", "name"], "left_anti").join(life.select("dataset_name", "v", "name", "type"), ["dataset_name", "v", "name"]).select("dataset_name", "v", "name", F.lit("added").alias("kind"), F.col("type").alias("detail"))
    removed = gone.join(ren.select("dataset_name", "v", F.col("old_name").alias("name")), ["dataset_name", "v", "name"], "left_anti").select("dataset_name", "v", "name", F.lit("removed").alias("kind"), F.lit(None).cast("string").alias("detail"))
    out = retyped.unionByName(renamed).unionByName(added).unionByName(removed)
    return out.select("dataset_name", F.col("v").alias("schema_version"), F.col("name").alias("column_name"), F.col("kind").alias("change_kind"), "detail")


def lineage(schema_versions: DataFrame, batch_rows: DataFrame, share: float = RENAME_SHARE) -> DataFrame:
    """``(dataset_name, v, name, type, column_name, canonical_type)``: where each version's field ends up.

    ``column_name`` is the last name of the field through all its renamings; if two fields end under one name, the one that
    isn't the last of that name is called ``name@version`` by the first version of its last life.
    """
    fields = fields_by_version(schema_versions, batch_rows)
    life = lives(fields)
    new, gone = _turns(life, fields.select("dataset_name", "ord", "v").distinct())
    ren = renames(new, gone, batch_rows, share)
    spans = life.groupBy("dataset_name", "name", "life").agg(F.min("v").alias("from_v"), F.max("v").alias("to_v"), F.max_by("type", "ord").alias("last_type"))
    ends = spans.join(gone.select("dataset_name", F.col("prev_v").alias("to_v"), "name", F.col("v").alias("gone_v")), ["dataset_name", "to_v", "name"], "left")
    step = ends.join(ren.select("dataset_name", F.col("v").alias("gone_v"), F.col("old_name").alias("name"), F.col("name").alias("next_name")), ["dataset_name", "gone_v", "name"], "left")
    node = lambda n, v: F.concat_ws("\x00", n, v.cast("string"))
    links = step.select("dataset_name", "name", "life", node(F.col("name"), F.col("from_v")).alias("node"), F.when(F.col("next_name").isNotNull(), node(F.col("next_name"), F.col("gone_v"))).otherwise(node(F.col("name"), F.col("from_v"))).alias("to"))
    # names are followed by doubling the reach until it no longer changes; these rows are by column and life
    hop = links = cut(links)
    hop = hop.select("dataset_name", "node", "to")
    while True:
        nxt = hop.select("dataset_name", F.col("node").alias("to"), F.col("to").alias("to2"))
        hop = cut(hop.join(nxt, ["dataset_name", "to"], "left").select("dataset_name", "node", F.coalesce("to2", "to").alias("to"), (F.coalesce("to2", "to") != F.col("to")).alias("moved")))
        done = hop.where("moved").isEmpty()
        hop = hop.drop("moved")
        if done:
            break
    end = spans.select("dataset_name", node(F.col("name"), F.col("from_v")).alias("to"), F.col("name").alias("end_name"), F.col("from_v").alias("end_from"), F.col("last_type").alias("canonical_type"))
    named = end.withColumn("is_last", F.col("end_from") == F.max("end_from").over(W.partitionBy("dataset_name", "end_name")))
    final = hop.join(named, ["dataset_name", "to"]).select("dataset_name", "node", F.when(F.col("is_last"), F.col("end_name")).otherwise(F.concat_ws("@", "end_name", "end_from")).alias("column_name"), "canonical_type")
    by_life = links.select("dataset_name", "name", "life", "node").join(final, ["dataset_name", "node"])
    return life.join(by_life, ["dataset_name", "name", "life"]).select("dataset_name", "v", "name", "type", "column_name", "canonical_type")


def unified(schema_versions: DataFrame, batch_rows: DataFrame, share: float = RENAME_SHARE) -> DataFrame:
    """All rows of all datasets in one shape: ``(dataset_name, file_name, row_no, schema_version, written_at, cells)``.

    ``cells`` maps a column's last name to a tagged union: ``tag`` (the type the value had in its file), one branch for each
    kind of type (``as_long``, ``as_double``, ``as_bool``, ``as_timestamp``, ``as_string``; the tag's branch is filled), and
    ``canonical`` (the value as text of the column's last type; null where it can't be converted). Repeated rows come once.
    """
    own = lineage(schema_versions, batch_rows, share).select("dataset_name", F.col("v").alias("schema_version"), "name", "type", "column_name", "canonical_type")
    maps = own.groupBy("dataset_name", "schema_version").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("type", "column_name", "canonical_type")))).alias("names"))
    rows = batch_rows.where("payload_json is not null").select("dataset_name", "file_name", "row_no", "schema_version", "written_at", "payload_json").distinct()
    rows = rows.withColumn("m", F.from_json("payload_json", "map<string,string>")).where("m is not null").drop("payload_json").join(maps, ["dataset_name", "schema_version"])

    def cell(key: Column, value: Column) -> Column:
        tag, to = F.col("names")[key]["type"], F.col("names")[key]["canonical_type"]
        number = value.try_cast("double")
        canonical = F.when(to.isin("int64", "int32"), value.try_cast("decimal(38,6)").try_cast("bigint").cast("string")).when(to.isin("float64", "float32"), number.cast("string")).when(to == "bool", value.try_cast("boolean").cast("string")).when(to == "timestamp", value.try_cast("timestamp").cast("string")).otherwise(value)
        return F.struct(
            tag.alias("tag"),
            F.when(tag.isin("int64", "int32"), value.try_cast("decimal(38,6)").try_cast("bigint")).alias("as_long"), F.when(tag.isin("float64", "float32"), number).alias("as_double"),
            F.when(tag == "bool", value.try_cast("boolean")).alias("as_bool"), F.when(tag == "timestamp", value.try_cast("timestamp")).alias("as_timestamp"),
            F.when(tag.isNull() | ~tag.isin("int64", "int32", "float64", "float32", "bool", "timestamp"), value).alias("as_string"), canonical.alias("canonical"),
        )

    named = F.filter(F.map_entries("m"), lambda e: F.map_contains_key("names", e["key"]))
    cells = F.map_from_entries(F.transform(named, lambda e: F.struct(F.col("names")[e["key"]]["column_name"].alias("key"), cell(e["key"], e["value"]).alias("value"))))
    return rows.select("dataset_name", "file_name", "row_no", "schema_version", "written_at", cells.alias("cells"))


def alternatives(schema_versions: DataFrame, batch_rows: DataFrame, column_metadata: DataFrame | None = None, share: float = RENAME_SHARE) -> DataFrame:
    """``(dataset_name, column_name, type, first_version, last_version, registered)``: each path's types with where they appear.

    ``registered`` says whether the column registry knows the path with that type as its last one.
    """
    own = lineage(schema_versions, batch_rows, share)
    out = own.groupBy("dataset_name", "column_name", "type").agg(F.min("v").alias("first_version"), F.max("v").alias("last_version"))
    if column_metadata is None:
        return out.withColumn("registered", F.lit(None).cast("boolean"))
    reg = column_metadata.select("dataset_name", "column_name", canonical_type(F.col("col_type")).alias("type")).distinct().withColumn("registered", F.lit(True))
    return out.join(reg, ["dataset_name", "column_name", "type"], "left").withColumn("registered", F.coalesce("registered", F.lit(False)))


def wide(unified_rows: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """One dataset of :func:`unified` as an ordinary table with the given columns as canonical text."""
    return unified_rows.where(F.col("dataset_name") == dataset).select("file_name", "row_no", "schema_version", *[F.col("cells")[c]["canonical"].alias(c) for c in columns])
