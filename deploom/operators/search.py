"""Many search terms and many globs at once, by indexes that ids meet in equi-joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deploom.functions.glob import to_regex
from deploom.functions.storage import small, written

#: Characters that a term, and the literal prefix or suffix of a pattern, are looked up by.
LITERAL = 16


def find_terms(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id): distinct ids that hold a term, in any case. terms: (term); empty and null ones find nothing.

    A term is looked up whole, by its first LITERAL characters if it is longer: ids give their substrings of the lengths in use, which meet the terms in an
    equi-join. So the work follows the ids and what is found, however many ids share a short piece of many terms.
    """
    low = F.lower("term")
    wanted = written(terms.select("term", low.alias("low"), F.substring(low, 1, LITERAL).alias("piece")).where("term <> ''").distinct())
    lengths = wanted.select(F.length("piece").alias("size")).distinct()  # LITERAL rows at most
    # Pieces take far longer than their bytes tell, so ids are dealt over a set number of tasks.
    own = nodes.select("id").where("id is not null").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").distinct().withColumn("low_id", F.lower("id"))
    own = own.join(F.broadcast(lengths), F.length("low_id") >= F.col("size"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low_id") - F.col("size") + 1), lambda i: F.substr("low_id", i, F.col("size"))))
    met = own.select("id", "low_id", F.explode(pieces).alias("piece")).join(small(wanted, 40), "piece")
    return met.where((F.length("low") <= LITERAL) | F.contains("low_id", F.col("low"))).select("term", "id")


def regex_of(column):
    @F.pandas_udf("string")
    def run(patterns: pd.Series) -> pd.Series:
        return patterns.map(to_regex)

    return run(column)


def match_globs(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, id): ids that match a shell pattern. patterns: (pattern); null ones match nothing.

    A pattern is indexed by its literal beginning or end, whichever is longer. Ids look themselves up by their own beginnings and ends of the lengths in use, so an
    id meets the patterns that share one with it and no others, and only these are matched. Patterns with neither, such as `*x*`, meet every id.
    """
    p = patterns.select("pattern").where("pattern is not null").distinct()
    first, last = F.regexp_extract("pattern", r"(?s)\A([^*?\[]*)", 1), F.regexp_extract("pattern", r"(?s)([^*?\]]*)\z", 1)
    head, tail = F.substring(first, 1, LITERAL), F.right(last, F.lit(LITERAL))
    # A closing bracket may be literal too; cutting there only makes the index coarser.
    at_end = F.length(tail) > F.length(head)
    keyed = p.select("pattern", at_end.alias("at_end"), F.when(at_end, tail).otherwise(head).alias("literal")).withColumn("size", F.length("literal"))
    sizes = keyed.select("at_end", "size").distinct()  # twice LITERAL + 1 rows at most
    own = nodes.select("id").distinct().join(F.broadcast(sizes), F.length("id") >= F.col("size"))
    own = own.withColumn("literal", F.when(F.col("at_end"), F.right("id", F.col("size"))).otherwise(F.substr("id", F.lit(1), F.col("size"))))
    met = own.join(keyed.withColumn("regex", regex_of("pattern")), ["at_end", "size", "literal"])
    return met.where(F.rlike("id", F.col("regex"))).select("pattern", "id")
