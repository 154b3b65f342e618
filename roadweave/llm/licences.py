"""Licence scan: canonical texts looked up by digest.

A text becomes canonical line by line: lower case, copyright lines dropped, equivalent spellings made one, everything
but letters and digits one space; lines without any left are dropped, the others joined by a space. The digest of a
whole document, and of each of its lines, is joined to the digests of known licence texts, made the same way. Only
built-in column functions; one pass over the documents, nothing but digests moves, and the known ones are sent
to all tasks when they are few.

Defined cases: a null or empty text, and one of copyright lines only, matches nothing; a licence met on several lines
of a document is one row with their number; a document of one licence line matches as a line and as a document; a
digest known under several names gives a row for each; repeated documents count each; texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.licence_digests import DIGESTS
from roadweave.llm.licence_texts import KNOWN

BROADCAST_ROWS = 100_000
COPYRIGHT_LINE = r"^[ \t*#/;-]*(copyright[ \t]*)?(\(c\)|©|copyright[ \t]+[0-9<\[{])"
SPELLINGS = {
    "licence": "license", "sub-license": "sublicense", "organisation": "organization", "favour": "favor",
    "non-infringement": "noninfringement", "acknowledgement": "acknowledgment", "http://": "https://", "&": " and ",
}
OTHER = r"[^\p{L}\p{N}]+"


def _canonical_line(line: Column) -> Column:
    line = F.lower(line)
    plain = line
    for old, new in SPELLINGS.items():
        plain = F.replace(plain, F.lit(old), F.lit(new))
    plain = F.trim(F.regexp_replace(plain, OTHER, " "))
    return F.when(F.regexp_like(line, F.lit(COPYRIGHT_LINE)), F.lit("")).otherwise(plain)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), _canonical_line), lambda x: x != "")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(licence, digest) of known texts, and of those known by digest only."""
    rows = spark.createDataFrame(texts, "licence string, text string")
    return rows.withColumn("canonical", F.array_join(canonical_lines(F.col("text")), " ")).where("canonical <> ''").select(
        "licence", _digest(F.col("canonical")).alias("digest")).unionByName(
        spark.createDataFrame(digests, "licence string, digest string")).distinct()


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, unit, licence, hits): licences that a document is (unit `document`) or has as lines (unit `line`)."""
    lines = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    each = F.transform("lines", lambda x: F.struct(F.lit("line").alias("unit"), _digest(x).alias("digest")))
    whole = F.struct(F.lit("document").alias("unit"), _digest(F.array_join("lines", " ")).alias("digest"))
    units = lines.select("row", "doc_id", F.inline(F.concat(each, F.array(whole))))
    few = known.count() <= BROADCAST_ROWS
    # only what is known is left to be counted
    return units.join(F.broadcast(known) if few else known, "digest").groupBy("row", "doc_id", "unit", "licence", "digest").agg(
        F.count("*").alias("hits")).select("doc_id", "unit", "licence", "hits")


def scan_sql(texts: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> str:
    """The same scan of `documents` as a DuckDB statement."""
    line = "lower(x)"
    for old, new in SPELLINGS.items():
        line = f"replace({line}, '{old}', '{new}')"
    lines = (f"list_filter(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(lower(x), '{COPYRIGHT_LINE}') "
             f"THEN '' ELSE trim(regexp_replace({line}, '{OTHER}', ' ', 'g')) END), lambda x: x <> '')")
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in texts)
    more = ", ".join(f"('{name}', '{digest}')" for name, digest in digests)
    return f"""
WITH known AS (SELECT licence, sha256(canonical) AS digest FROM (SELECT licence, array_to_string({lines}, ' ') AS canonical
        FROM (VALUES {values}) AS t(licence, text)) WHERE canonical <> ''
    UNION SELECT licence, digest FROM (VALUES {more}) AS t(licence, digest)),
d AS (SELECT row_number() OVER () AS row, doc_id, {lines} AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'document' AS unit, array_to_string(lines, ' ') AS canonical, 1 AS hits FROM d
    UNION ALL SELECT doc_id, 'line', x, count(*) FROM (SELECT row, doc_id, unnest(lines) AS x FROM d) GROUP BY row, doc_id, x)
SELECT doc_id, unit, licence, hits::BIGINT AS hits FROM u JOIN known ON known.digest = sha256(u.canonical) WHERE canonical <> ''"""
