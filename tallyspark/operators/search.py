"""Text search by posting lists: a stored trigram index of each organization's rows, for terms of three letters and more.

A row's texts are lower-cased and cut into trigrams; a posting is (org, gram, id), stored by organization and sorted by
gram, so that a lookup reads the row groups of a few grams. A row that holds a term holds all trigrams of its literal
stretches; rows whose postings have them all are candidates, and `like_term` on the rows themselves decides. A term
without a stretch of three letters, such as one of wildcards, reads the rows of its organization as before.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import like_term

GRAM = 3


def _grams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def term_grams(term: str) -> list[str]:
    """The trigrams that a text must hold to match a term; none where the term has no stretch that is long enough."""
    stretches = [s for s in re.split(r"[%_]", term.lower()) if len(s) >= GRAM]
    return sorted({s[i : i + GRAM] for s in stretches for i in range(len(s) - GRAM + 1)})


def postings(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(org, gram, id) of `rows` (org, id, …) by the texts under `columns`; null texts have none."""
    texts = F.array_distinct(F.flatten(F.array(*(_grams(F.coalesce(c, F.lit(""))) for c in columns.values()))))
    return rows.select("org", "id", F.explode(texts).alias("gram")).select("org", "gram", "id")


def write_index(rows: DataFrame, columns: dict[str, Column], path: str) -> None:
    """The postings as Parquet, a folder an organization, each sorted by gram."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranged by id too: a frequent gram of a large organization lies in several files
    dealt = postings(rows, columns).repartitionByRange(n, "org", "gram", "id").sortWithinPartitions("org", "gram", "id")
    dealt.write.partitionBy("org").mode("overwrite").parquet(path)


def candidates(spark: SparkSession, path: str, org: int, term: str) -> DataFrame | None:
    """(id): the rows of the organization whose postings have all trigrams of the term; null where it has none."""
    grams = term_grams(term)
    if not grams:
        return None
    found = spark.read.schema("gram string, id long, org long").parquet(path).where((F.col("org") == org) & F.col("gram").isin(grams))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("id")


def search(rows: DataFrame, columns: dict[str, Column], path: str, org: int, term: str) -> DataFrame:
    """The rows of the organization that match the term in one of the columns, as a scan with `like_term` gives them."""
    mine = rows.where(F.col("org") == org)
    hit = F.lit(False)
    for column in columns.values():
        hit = hit | F.coalesce(like_term(column, term), F.lit(False))
    near = candidates(rows.sparkSession, path, org, term)
    return (mine if near is None else mine.join(near, "id", "left_semi")).where(hit).select(rows.columns)
