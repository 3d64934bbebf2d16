"""Many searches at once by an inverted index of short pieces.

Every text is indexed by its distinct pieces of one, two and three characters. A term is
looked up by the piece of it that the fewest rows have (a term of one or two
characters is a piece itself), and the rows found are confirmed by ``contains``. So a
batch of terms is one pass over the postings and equi-joins only, where each search box
would scan the whole table for its term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import students_directory

LONGEST = 3


def _pieces(text: Column, n: int) -> Column:
    """All runs of ``n`` characters; none if the text is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, n))


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(piece, key): the distinct pieces of each row's lower-cased text. Null texts have none."""
    low = F.lower(F.col(text))
    every = F.array_distinct(F.flatten(F.array(*[_pieces(low, n) for n in range(1, LONGEST + 1)])))
    return rows.select(key, F.explode(every).alias("piece"))


def search_many(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(term, key) for every term (column ``term``) and row whose text contains it, both lower-cased.

    ``key`` is unique. Terms that are empty or null find nothing (an empty box asks for no search).
    """
    index = postings(rows, key, text)
    asked = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    own = F.when(F.length("term") <= LONGEST, F.array("term")).otherwise(F.array_distinct(_pieces(F.col("term"), LONGEST)))
    counts = index.groupBy("piece").agg(F.count("*").alias("n"))
    # A piece that no row has ends the search for its term here.
    rarest = (asked.select("term", F.explode(own).alias("piece")).join(counts, "piece", "left")
              .groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
              .where("p.n > 0").select("term", F.col("p.piece").alias("piece")))
    found = rarest.join(index, "piece").select("term", key)
    low = rows.select(key, F.lower(F.col(text)).alias("low"))
    return found.join(low, key).where(F.col("low").contains(F.col("term"))).select("term", key)


def search_jobs_many(T) -> DataFrame:
    """F13 for every word of the job types and of the company names, and for their first two letters."""
    text = F.concat_ws(" ", "job_title", "company_name", "job_type")
    rows = T.job.join(T.company.select("company_id", "company_name"), "company_id").select("job_id", text.alias("text"))
    words = (T.job.select(F.explode(F.split("job_type", " ")).alias("term")).distinct()
             .unionByName(T.company.select(F.substring("company_name", -6, 6).alias("term"))))
    return search_many(rows, "job_id", "text", words.unionByName(words.select(F.substring("term", 1, 2).alias("term"))))


def search_students_many(T) -> DataFrame:
    """F12-F14 on students: the last three characters of every name, in all that the directory shows."""
    shown = F.concat_ws(" ", F.col("student_id").cast("string"), "name", "department_name",
                        F.col("graduation_year").cast("string"), "email")
    rows = students_directory(T).select("student_id", shown.alias("text"))
    return search_many(rows, "student_id", "text", T.student.select(F.substring("name", -3, 3).alias("term")))
