"""Which names stand inside which texts, without holding every name against every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def _grams(c: Column, size: int) -> Column:
    """The distinct n-grams of a text's letters; the text is cut into letters, which are zipped with those further on, so the work grows with the length."""
    letters = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    out = letters
    for k in range(1, size):
        out = F.zip_with(out, F.slice(letters, F.lit(k + 1), F.length(c)), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.array_compact(out))


def contained(texts: DataFrame, text: str, names: DataFrame, name: str, size: int = 3) -> DataFrame:
    """Distinct (text, name) with the name standing in the text, letter by letter; null on either side meets nothing, the empty name every text.

    Texts are indexed by their letter n-grams, of which only those that some name has are kept.
    A name is looked up by the one of its n-grams that the fewest texts have, names shorter than
    n-grams by themselves; what is found is compared in full.
    """
    t = written(texts.select(F.col(text).alias("text")).where("text is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    n = written(names.select(F.col(name).alias("name")).where("name is not null").distinct())
    sizes = [r[0] for r in n.where("name <> ''").select(F.least(F.length("name"), F.lit(size))).distinct().collect()]  # at most `size` rows
    empty = t.select("text").crossJoin(n.where("name = ''"))  # one row at most on the right
    if not sizes:
        return empty
    parts = written(n.where("name <> ''").select("name", F.explode(F.when(F.length("name") >= size, _grams(F.col("name"), size)).otherwise(F.array("name"))).alias("gram")))
    every = F.flatten(F.array(*(_grams(F.col("text"), k) for k in sizes)))
    found = written(t.select("id", F.explode(every).alias("gram")).join(parts.select("gram").distinct(), "gram", "left_semi"))
    # a name of which no text has one n-gram stands nowhere
    times = parts.join(found.groupBy("gram").agg(F.count("*").alias("times")), "gram", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    rarest = times.groupBy("name").agg(F.min_by("gram", F.struct("times", "gram")).alias("gram"), F.min("times").alias("times")).where("times > 0").drop("times")
    return found.join(rarest, "gram").join(t, "id").where(F.contains("text", "name")).select("text", "name").unionByName(empty)
