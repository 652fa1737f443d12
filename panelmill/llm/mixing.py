"""Mixing sources to target weights: hash-random keys, prefix sums by range, a cut at each source's budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import fresh, settle

#: A word is a run of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def targets(by_source: DataFrame, most_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds target (double) to one row per source (source, source_size).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. They share the sum
    of all sizes by weight; a share stops at most_copies times its source's size and the
    excess is reshared. Sorted by size per weight, the stopped sources are a prefix, so two
    running sums over the few source rows find them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    lean = Window.orderBy((F.col("source_size") / F.col("weight")), "sid")
    before = lean.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    out = by_source.withColumn("sid", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", pick.cast("long"))
    out = out.withColumn("left_size", F.sum("source_size").over(every) - most_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    out = out.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = (F.lit(float(most_copies)) * F.col("source_size") * F.col("left_weight") <= F.col("weight").cast("double") * F.col("left_size")).cast("int")
    out = out.withColumn("full", full).withColumn("full", F.min("full").over(lean))
    rest = F.sum("source_size").over(every) - most_copies * F.sum(F.col("source_size") * F.col("full")).over(every)
    open_weight = F.sum(F.col("weight") * (1 - F.col("full"))).over(every)
    share = (F.col("weight") * rest).cast("double") / F.nullif(open_weight, F.lit(0)).cast("double")
    return out.withColumn("target", F.when(F.col("full") == 1, (most_copies * F.col("source_size")).cast("double")).otherwise(share)).select(
        "source", "sid", "source_size", "n_rows", "target")


def hash_key(seed: str, key: Column, text: Column) -> Column:
    """Hash-random order: equal on every rerun and on every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def decide(df: DataFrame, id_col: str, text_col: str, source_col: str, most_copies: int, seed: str, bucket_rows: int, other: Column | None = None) -> DataFrame:
    """What the mix takes of each group of rows equal in id, text, source and other: many rows, of which the first starts at `begin`
    words of its source's order, with rest and epochs of the source.

    Equal rows are one row from the scan on, and the order's hash is of id and text, so neither repeated rows nor
    rows of one id, nor those without, meet in one task.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), hash_key(seed, F.col(id_col), F.col(text_col)).alias("hash"),
                      (F.lit(0) if other is None else other).cast("long").alias("other"))
    alike = settle(sized.groupBy("doc_id", "source", "hash", "size", "other").agg(F.count("*").alias("many")))
    by_source = targets(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.count("*").alias("n_rows")), most_copies)
    budget = F.least(F.round("target").cast("long"), most_copies * F.col("source_size"))
    by_source = by_source.withColumn("budget", budget).withColumn(
        "epochs", F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0))).withColumn(
        "rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    digits = F.least(F.lit(8), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n_rows") / F.lit(float(bucket_rows))))))
    by_source = settle(by_source.withColumn("digits", digits.cast("int")))
    rows = alike.withColumnRenamed("source", "own").join(by_source, F.col("own").eqNullSafe(F.col("source")))
    rows = rows.withColumn("range", F.expr("substring(hash, 1, digits)"))
    sums = rows.groupBy("sid", "range").agg(F.sum(F.col("size") * F.col("many")).alias("range_size"))
    ahead = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(ahead), F.lit(0))).select("sid", "range", "offset")
    inside = Window.partitionBy("sid", "range").orderBy("hash", "size", "doc_id", "other").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("many")).over(inside), F.lit(0))).join(sums, ["sid", "range"])
    return rows.withColumn("begin", F.col("offset") + F.col("inside"))


def mix_to_targets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   most_copies: int = 3, seed: str = "mix", bucket_rows: int = 4096) -> DataFrame:
    """How many words of each row the mix takes.

    Returns one row per input row: doc_id, size, source_size, target, taken. size counts words of the whole text (null text:
    0). In each source rows are in the order of a hash of their id and text; the whole source is taken as often as
    its budget (the rounded target) allows, then once more up to the budget, cutting the row
    at the border. A row's running total is its range's offset plus the sum inside the range:
    ranges are leading digits of the hash, enough of them that none holds much over bucket_rows
    rows, so a source with a third of all rows is split like any other.

    Null ids, repeated ids and repeated rows are rows of their own; null source is a source, the
    last one; empty texts have size 0 and taken 0; an empty table gives an empty result.
    """
    rows = decide(df, id_col, text_col, source_col, most_copies, seed, bucket_rows)
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("begin") - F.col("nth") * F.col("size")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def take_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_copies: int = 3, seed: str = "mix",
                 bucket_rows: int = 4096) -> DataFrame:
    """The rows of docs as the mix takes them, columns as in docs: whole copies, and a last one cut after its words taken.

    Equal rows are one row from the scan on, which is taken as often as they all are. n_chars, if there is one, is the length of
    a cut text. Rows of which nothing is taken go, and so do those without words (null, empty or white texts). Columns may have
    any names. An empty table gives an empty result.
    """
    m_hash, m_other = fresh(docs.columns, "mix_hash", "mix_other")
    plain = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in docs.dtypes if c not in (id_col, text_col, source_col)]
    keyed = docs.select("*", hash_key(seed, F.col(id_col), F.col(text_col)).alias(m_hash), F.xxhash64(F.lit(0), *plain).alias(m_other))
    taken = decide(keyed, id_col, text_col, source_col, most_copies, seed, bucket_rows, F.col(m_other)).where("size > 0")
    last = F.greatest(F.lit(0), F.least(F.col("size") * F.col("many"), F.col("rest") - F.col("begin")))
    taken = taken.withColumn("last", last).select(
        F.col("doc_id").alias("t_id"), F.col("own").alias("t_source"), F.col("hash").alias("t_hash"), F.col("other").alias("t_other"),
        (F.col("epochs") * F.col("many") + F.expr("last div size")).alias("whole"), (F.col("last") % F.col("size")).alias("words"))
    rows = keyed.groupBy(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(m_hash).alias("hash"), F.col(m_other).alias("other")).agg(
        F.any_value(F.struct(*docs.columns)).alias("row"))
    rows = rows.join(taken, F.col("id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source"))
                     & (F.col("hash") == F.col("t_hash")) & (F.col("other") == F.col("t_other")))
    copies = F.col("whole") + (F.col("words") > 0).cast("long")
    rows = rows.where(copies > 0).select("row", "whole", "words", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy")).withColumn("cut", F.col("copy") > F.col("whole"))
    text = F.col("row").getField(text_col)
    rows = rows.withColumn("part", F.udf(cut_words, "string", useArrow=True)(F.when(F.col("cut"), text), F.col("words")))
    out = {text_col: F.when(F.col("cut"), F.col("part")).otherwise(text)}
    if "n_chars" in docs.columns:
        n_chars = F.col("row").getField("n_chars")
        out["n_chars"] = F.when(F.col("cut"), F.length("part").cast(docs.schema["n_chars"].dataType)).otherwise(n_chars)
    return rows.select(*[out.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def cut_words(text: str | None, words: int) -> str | None:
    """The text up to the end of its word number `words`."""
    if text is None:
        return None
    end = 0
    for k, m in enumerate(re.finditer(WORD, text), 1):
        end = m.end()
        if k == words:
            break
    return text[:end]
