"""Applying a stream of inserts, updates and deletes (a change feed) to a table.

The state is a signed multiset of record versions. A version is named by the ``seq`` of the entry that made it. Every
entry that takes effect contributes its before-image with weight -1 (the version that was alive until then) and its
after-image with weight +1; the weights are added to those of a base table, and what is left with a positive sum is the
current state. The sums are associative, so it doesn't matter in which order or how often files arrive.

Which version an entry replaces follows from three running maxima of its record (last insert, update and delete before
it). They are taken in blocks of ``block`` sequence numbers with a carry between blocks, so that a record that holds a
large part of all changes is spread over many tasks.

Defined cases
    Entries with a null ``seq``, and those whose record is null or no valid JSON, are ignored. Entries of the same dataset
    and ``seq`` are one entry: the one with the latest ``entry_ts`` (a null one is the earliest), then the greatest
    ``segment_no``, operation and record text. An entry without an integer ``id``, or with an unknown operation, changes
    nothing, but still takes part in the choice before. A null ``dataset_name`` is a dataset of its own. An empty feed
    gives the base. Columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INSERTS = ("insert", "put")
UPDATES = ("update", "patch")
DELETES = ("delete", "tombstone")
BLOCK = 65536


def json_or_null(text: Column) -> Column:
    """The text as a variant; null where it is null, no valid JSON, or the JSON literal null.

    The parser ignores what follows a value (``12 "a"`` would pass as 12), so the text is parsed as the only element of an array, and
    where a bracket inside it might have ended that array, as the only value of an object too.
    """
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    whole = F.when(text.rlike(r"\]\s*[^\s\]}]"), F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()).otherwise(F.lit(True))
    v = F.try_variant_get(one, "$[0]", "variant")
    return F.when((F.size(one.try_cast("array<variant>")) == 1) & whole & ~F.is_variant_null(v), v)


def integer_id(value: Column) -> Column:
    """The integer value of an id that may be written as 7, 7.0, "7" or "7.0"; null if it is none."""
    n = value.try_cast("decimal(38,6)")
    return F.when(n == F.floor(n), n.try_cast("bigint"))


def operation(op: Column) -> Column:
    """I, U, D or null for the spellings of an operation, whatever their case."""
    o = F.lower(F.trim(op))
    return F.when(o.isin(*INSERTS), "I").when(o.isin(*UPDATES), "U").when(o.isin(*DELETES), "D")


def deduplicated(changes: DataFrame, with_record: bool = False) -> DataFrame:
    """``(dataset_name, rec_id, seq, kind[, record_json])``: one row for each entry that counts."""
    v = json_or_null(F.col("record_json"))
    rec = integer_id(F.try_variant_get(v, "$.id", "string"))
    rows = (
        changes.select("dataset_name", "seq", "entry_ts", "segment_no", "op", "record_json")
        .where(F.col("seq").isNotNull() & F.col("record_json").isNotNull())
        .withColumn("_v", v)
        .where(F.col("_v").isNotNull())
    )
    newest = F.struct(
        F.col("entry_ts").cast("bigint").alias("ts"), F.col("segment_no").cast("bigint").alias("segment"), F.coalesce(operation(F.col("op")), F.lit("")).alias("kind"),
        F.xxhash64("record_json").alias("h"), rec.alias("rec_id"), *([F.col("record_json")] if with_record else []),
    )
    one = rows.groupBy("dataset_name", F.col("seq").cast("bigint").alias("seq")).agg(F.max(newest).alias("e"))
    out = one.select("dataset_name", F.col("e.rec_id").alias("rec_id"), "seq", F.col("e.kind").alias("kind"), *([F.col("e.record_json").alias("record_json")] if with_record else []))
    return out.where(F.col("rec_id").isNotNull() & (F.col("kind") != ""))


def signed_images(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(dataset_name, rec_id, version, weight)`` of the before- and after-images that the entries contribute."""
    key = ["dataset_name", "rec_id"]
    e = entries.select(*key, "seq", "kind").withColumn("block", F.floor(F.col("seq") / F.lit(block)))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq")))
    # carry: the three maxima over all earlier blocks of the record
    sums = e.groupBy(*key, "block").agg(at("I").alias("i"), at("U").alias("u"), at("D").alias("d"))
    before = W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*[F.col(k).alias(f"_{k}") for k in (*key, "block")], *[F.max(c).over(before).alias(f"c{c}") for c in "iud"])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*key, "block")]
    within = W.partitionBy(*key, "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    running = lambda kind: F.greatest(at(kind).over(within), F.col("c" + kind.lower()))
    seen = e.join(carry, on, "inner").select(*key, "seq", "kind", *[running(k).alias(k) for k in "IUD"])
    alive = F.col("I").isNotNull() & (F.col("D").isNull() | (F.col("I") > F.col("D")))
    old = F.greatest("I", "U")
    image = lambda version, weight: F.struct(version.alias("version"), F.lit(weight).alias("weight"))
    images = F.array(
        F.when((F.col("kind") == "I") | ((F.col("kind") == "U") & alive), image(F.col("seq"), 1)),
        F.when(alive, image(old, -1)),
    )
    return seen.select(*key, F.explode(F.array_compact(images)).alias("x")).select(*key, "x.version", "x.weight")


def apply_changes(changes: DataFrame, base: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``(dataset_name, rec_id, seq)`` of every record alive after all changes; ``seq`` is that of its last change.

    ``base`` has the same three columns: the state before the changes, whose versions take part with weight +1.
    """
    entries = deduplicated(changes)
    if base is not None:
        entries = entries.unionByName(base.select("dataset_name", F.col("rec_id").cast("bigint").alias("rec_id"), F.col("seq").cast("bigint").alias("seq")).withColumn("kind", F.lit("I")))
    total = signed_images(entries, block).groupBy("dataset_name", "rec_id", "version").agg(F.sum("weight").alias("weight"))
    return total.where(F.col("weight") > 0).select("dataset_name", "rec_id", F.col("version").alias("seq"))


def current_records(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(dataset_name, rec_id, seq, n_fields, record)``: the current records with their fields.

    ``record`` is a map from field to the JSON text of its value: the fields of the record's last insert, each replaced by the
    latest update that holds it. Fields are merged by an aggregate per field, so a record that changes very often is
    combined on the map side first.
    """
    key = ["dataset_name", "rec_id"]
    entries = deduplicated(changes, with_record=True)
    alive = apply_changes(changes, block=block)
    born = entries.where("kind = 'I'").groupBy(*key).agg(F.max("seq").alias("born"))
    match = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    a, b = alive.alias("a"), born.alias("b")
    living = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]).select(*[F.col(f"a.{k}").alias(f"_{k}") for k in key], F.col("a.seq").alias("last"), "born")
    writes = entries.where("kind <> 'D'").join(living, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).where(F.col("seq") >= F.col("born"))
    fields = writes.select(*key, "last", "seq", F.explode(F.from_json("record_json", "map<string,string>")).alias("field", "value"))
    latest = fields.groupBy(*key, "last", "field").agg(F.max(F.struct("seq", "value"))["value"].alias("value"))
    whole = latest.groupBy(*key, "last").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("record"))
    return whole.select(*key, F.col("last").alias("seq"), F.size("record").cast("bigint").alias("n_fields"), "record")
