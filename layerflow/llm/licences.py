"""Licence scans by canonical digests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.llm.common import query, table, text_or_empty
from layerflow.llm.licence_texts import EQUIVALENT_SPELLINGS, LICENCES, TITLES, known_texts

#: A line that only says who holds the copyright, in canonical spelling. It differs from copy
#: to copy of the same licence.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*(?:[0-9]{4}|©|\(c\)|all rights reserved)[^\n]*$"


VARIANTS = r"\b(?:" + "|".join(other for other, _ in EQUIVALENT_SPELLINGS) + r")\b"


#: What a text must have to have a copyright line.
COPYRIGHT_SIGNS = ("copyright", "(c)", "©")


#: A line that only reserves all rights.
RIGHTS_LINE = r"(?m)^[ \t]*all rights reserved[ \t.]*\r?$"

#: Words that titles begin with, and a title on the first line that has words, before others.
TITLE_WORDS = sorted({"the"} | {t.split()[0].split("-")[0].split("/")[0] for t in TITLES})
_NAMES = "|".join(re.escape(t).replace("license", "licen[cs]e") for t in sorted(TITLES, key=len, reverse=True))
TITLE_LINE = rf"\A[^\p{{L}}\p{{N}}]*+(?:the )?(?:{_NAMES})(?:[ \t]*\((?:the )?(?:mit|expat|isc|bsd|zlib|0bsd)\))?[^\p{{L}}\p{{N}}\n]*\n"


def _without_copyright(text: Column) -> Column:
    """In lower case, without copyright lines, a title and lines that reserve all rights."""
    low = F.lower(text)
    signed = F.lit(False)
    for sign in COPYRIGHT_SIGNS:
        signed = signed | F.contains(low, F.lit(sign))
    low = F.when(signed, F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)
    low = F.when(F.contains(low, F.lit("all rights reserved")), F.regexp_replace(low, RIGHTS_LINE, " ")).otherwise(low)
    titled = F.contains(low, F.lit("\n")) & _first_word(low).isin(*TITLE_WORDS)
    return F.when(titled, F.regexp_replace(low, TITLE_LINE, " ")).otherwise(low)


def _first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]++)", 1)


def _first_spellings(word: str) -> set[str]:
    """The first words that a text can have before equivalent spellings are made one, if
    ``word`` is the first one afterwards."""
    found = {word}
    while more := {o.split()[0] for o, usual in EQUIVALENT_SPELLINGS if usual.split()[0] in found} - found:
        found |= more
    return found


def with_digest(df: DataFrame, text: str, into: str = "digest", first: list[str] | None = None) -> DataFrame:
    """Add the digest of the canonical form of a text: lower case, copyright lines, a title line
    at the top and lines with only 'All rights reserved.' removed, every run of characters other than letters and digits one blank, and equivalent spellings
    made one. The spellings are only gone through in texts that have one of them. Given the
    words in ``first``, texts that begin with none of them are left out before."""
    df = df.withColumn(into, _without_copyright(F.col(text)))
    if first is not None:
        df = df.where(_first_word(F.col(into)).isin(*first))
    df = df.withColumn(into, F.btrim(F.regexp_replace(into, r"[^\p{L}\p{N}]+", " ")))
    spelt = F.col(into)
    for other, usual in EQUIVALENT_SPELLINGS:
        spelt = F.regexp_replace(spelt, rf"\b{other}\b", usual)
    return df.withColumn(into, F.sha2(F.when(F.col(into).rlike(VARIANTS), spelt).otherwise(F.col(into)), 256))


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """The digests of the known licences as (licence, digest, first): ``first`` are the words
    that their texts begin with. Texts that are equal in canonical form are one licence, named
    by the first of their names."""
    rows = spark.createDataFrame(known_texts() if texts is None else sorted(texts.items()), "licence string, text string")
    rows = with_digest(rows, "text").withColumn("first", _first_word(_without_copyright(F.col("text"))))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.collect_set("first").alias("first"))


def scan_licences(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where whole texts, or whole lines of them, are known licences or licence notices.

    One row (key, line, licence, digest) per find: line 0 is the whole text, other lines count
    from 1 by line feeds. Only entire texts and entire lines count, never parts. Texts with
    nothing but punctuation, and null texts, have no find; a text of one line can be found as
    line 0 and as line 1. Repeated rows repeat their finds.

    The join is on the digest. Texts whose first word is that of no known licence have no find
    and are left out before the rest of their canonical form is made. ``known`` is left to
    Spark to broadcast by its measured size.
    """
    words = {w for r in known.select("first").collect() for f in r["first"] if f for w in _first_spellings(f)}
    text = text_or_empty()
    units = docs.select(F.col(key), F.posexplode(F.concat(F.array(text), F.split(text, "\n"))).alias("line", "unit"))
    units = with_digest(units, "unit", first=sorted(words)).select(key, "line", "digest")
    return units.join(known, "digest").select(
        key, F.col("line").cast("long").alias("line"), "licence", "digest"
    )


def _sql() -> str:
    def canon(x: str) -> str:
        line = COPYRIGHT_LINE.replace("'", "''")
        out = f"regexp_replace(lower({x}), '{line}', ' ', 'g')"
        out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        for other, usual in EQUIVALENT_SPELLINGS:
            out = rf"regexp_replace({out}, '\b{other}\b', '{usual}', 'g')"
        return out

    rows = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in sorted(LICENCES.items()))
    return f"""
WITH k AS (SELECT sha256({canon('t')}) AS digest, min(n) AS licence FROM (VALUES {rows}) v(n, t) GROUP BY 1),
u AS (SELECT doc_id, 0::BIGINT AS line, coalesce(text, '') AS unit FROM documents
  UNION ALL SELECT doc_id, unnest(range(1, len(l) + 1)), unnest(l)
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
h AS (SELECT doc_id, line, sha256({canon('unit')}) AS digest FROM u WHERE unit <> '')
SELECT doc_id, line::BIGINT AS line, licence, digest FROM h JOIN k USING (digest) WHERE digest <> sha256('')
"""


@query("op5_licences", _sql())
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences in all documents."""
    return scan_licences(table(spark, sf_dir, "documents"), known_licences(spark))
