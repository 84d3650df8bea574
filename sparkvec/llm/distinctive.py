"""How distinctive a term is per record: residuals of a correspondence analysis.

With ``n`` tokens in all, ``r`` of them in the record and ``c`` of the term, the expected count is ``r * c / n``. The score is
the adjusted standardised residual ``(tf - r*c/n) / sqrt(r*c/n * (1 - r/n) * (1 - c/n))``: observed minus expected count over
the square root of the expectation, with its variance adjusted by the record's and the term's margins. Common terms are
expected everywhere and score about 0; rare terms that pile up in a record score high.

Plan: one shuffle counts terms by record (combined on the map side), written once; one counts by term. The join of the two would put a
common term's records into one task, so terms that hold at least ``1 / HOT_TERMS`` of all tokens are joined by broadcast: by
that share there can be at most ``HOT_TERMS`` of them, however large the corpus. All others are joined by a shuffle, in which
no term holds more than that share.

Defined cases
    Null ids and null or blank texts have no terms and count nowhere. Rows that repeat an id with the same text are one
    record; an id with several texts is one record with the terms of all of them. If one record or one term is all there is,
    the adjusted variance is 0 and the score is 0. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions.text import tokenize
from sparkvec.llm.vectors import marks
from sparkvec.session import cut

HOT_TERMS = 10_000


def term_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, term, doc_len, tf)`` over the distinct rows of id and text.

    A record's length comes from its own row. Only ids that may have several rows (told by a bitmap of fixed size) are shuffled
    with their texts.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = marks(rows, repeated)
    pieces = tokenize(F.col("text"))
    once = marked.where("not marked").select("id", pieces.alias("terms")).withColumn("doc_len", F.size("terms").cast("bigint"))
    several = marked.where("marked").select("id", "text").dropDuplicates(["id", "text"]).select("id", pieces.alias("terms"))
    lengths = several.groupBy("id").agg(F.sum(F.size("terms")).alias("doc_len"))
    flat = once.unionByName(several.join(lengths, "id")).select(F.col("id").alias("doc_id"), "doc_len", F.explode_outer("terms").alias("term")).where("term is not null")  # an inner explode would split texts again, in filters inferred at the scans
    return flat.groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def residual(count: Column, record: Column, term: Column, n: Column) -> Column:
    """The adjusted standardised residual of a count, given the margins of its record and its term."""
    expected = record * term / n
    spread = expected * (1 - record / n) * (1 - term / n)
    return F.when(spread > 0, (count - expected) / F.sqrt(spread)).otherwise(F.lit(0.0))


def residuals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_terms: int = HOT_TERMS) -> DataFrame:
    """``(doc_id, term, tf, doc_len, doc_freq, coll_freq, n, score)`` for every term of every record."""
    tf = cut(term_counts(df, id_col, text_col))  # texts are split once, not for each use below
    by_term = tf.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("coll_freq"))
    term = by_term.withColumn("n", tf.agg(F.sum("tf").alias("n")).scalar())
    is_hot = F.col("coll_freq") * hot_terms >= F.col("n")
    hot, cold = term.where(is_hot), term.where(~is_hot)
    names = F.broadcast(hot.select("term"))
    joined = tf.join(F.broadcast(hot), "term").unionByName(tf.join(names, "term", "left_anti").join(cold, "term"))
    score = residual(F.col("tf"), F.col("doc_len"), F.col("coll_freq"), F.col("n"))
    return joined.select("doc_id", "term", "tf", "doc_len", "doc_freq", "coll_freq", "n", score.alias("score"))


def top_terms(df: DataFrame, k: int = 10, **columns: str) -> DataFrame:
    """Every record's ``k`` most distinctive terms with their rank; ties go to the smaller term.

    The window's limit is taken before the shuffle too, so a record sends at most ``k`` terms from each task.
    """
    best = W.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "term")
    ranked = residuals(df, **columns).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "term", "tf", "score")


def found(df: DataFrame) -> DataFrame:
    """The strikingly frequent terms that few records share (p5_found).

    Candidates are drawn by the score: a case's count is at least ``max(3, doc_len / 40)``, and for given margins the residual
    grows with the count, so a case's score is at least the residual of that count. Every step of that sum (minus, divided by
    a positive number) keeps the order in floating point as well, so no case is lost. What passes is checked by its counts.
    """
    r = residuals(df)
    least = residual(F.greatest(F.lit(3.0), F.col("doc_len") / 40), F.col("doc_len"), F.col("coll_freq"), F.col("n"))
    return r.where(F.col("score") >= least).where("tf >= 3 and tf * 40 >= doc_len and doc_freq between 2 and 6").select("doc_id", "term")
