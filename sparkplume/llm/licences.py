"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, copyright statements (up to a licence phrase or the end of their line) and
reservations of rights cut, equivalent spellings
and phrases put into one, punctuation and runs of space reduced to single blanks. Its digest is looked up among the digests of known licences
in a hash join. Besides the whole text, each of its lines is looked up as a text of its own, since notices usually stand
as one line of a document.

Everything is column expressions. The known licences are a table given by the caller (KNOWN and full texts by default);
only digests and ids are joined or shuffled, never texts. Every line is looked up that can match: a known form holds a
word that no spelling rule makes up, or the stem ``licens``, which comes from ``licen`` or from a phrase with ``under``. A
line that holds none of these words in any way is passed over before it is brought to its form. A text known by its digest
alone must hold the stem. The SQL below states the same rule and brings every line to its form.

Defined results: null and empty texts, and texts that are empty in canonical form, match nothing. A known text that is
null or empty in canonical form is never matched; known texts of equal form share their hits, smallest name first. Every
input row gives a row, whatever its id; rows that repeat an id share the licences of their lines. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkplume.llm.licence_texts import DIGESTS, TEXTS

# fixed values: notices by the licence they declare
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "This work is licensed under the Apache License, version 2"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GPL v3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0"),
)

# fixed values: equivalent spellings, as pattern and replacement over lower-case words between single blanks
SPELLINGS = (
    ("licenc", "licens"),
    ("(^| )version ([0-9])", "$1v$2"),
    ("(^| )v ([0-9])", "$1v$2"),
    ("(^| )v([0-9]+) 0( |$)", "$1v$2$3"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("creative commons attribution", "cc by"),
    ("(this|the) (work|software|program|file|code) is ", ""),
    ("(released|distributed|available|provided) under", "licensed under"),
    ("(^| )the ", "$1"),
)
# a statement of copyright, not the word in a licence's own sentences; it ends where a licence phrase begins, or with its line
MARK = r"copyright *(?:\(c\)|©|by |[0-9]{4}|\[|<)|(?:\(c\) *[0-9]{4}|©)"
HEAD = r"^[^a-z0-9]*copyright(?: *\z| )"  # the word at the head of a line, unless it goes on like a sentence
SENTENCE = r"^[^a-z0-9]*copyright (?:licen|notice|holder|owner|law|statement|interest|disclaim|(?:act|or|and|to|in|is|of|on|for|the)\b)"
PHRASE = (
    r"\b(?:(?:(?:this|the) (?:work|software|program|file|code) is )?(?:licen[cs]ed|released|distributed|available|provided) under"
    r"|permission is|redistribution and use)\b|all rights reserved|\z"
)
RESERVED = "all rights reserved"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
STEM = "licens"
STEM_FROM = ("licen", "under")  # what a line holds whose form holds the stem
MOST_WORDS = 64  # beyond so many different words in known texts every line is brought to its form


def canonical(text: Column) -> Column:
    """The canonical form; empty for null."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")

    def cut(line: Column) -> Column:
        stated = line.contains("copyright") | line.contains("(c)") | line.contains("©")
        head = line.rlike(HEAD) & ~line.rlike(SENTENCE)
        plain, headed = (F.regexp_replace(line, f"(?s)(?:{x}).*?({PHRASE})", " $1") for x in (MARK, f"{MARK}|{HEAD}"))
        out = F.when(stated, F.when(head, headed).otherwise(plain)).otherwise(line)
        return F.replace(out, F.lit(RESERVED), F.lit(" "))

    out = F.array_join(F.transform(lines, cut), " ")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def known_licences(spark: SparkSession, known=KNOWN + TEXTS, digests=DIGESTS) -> DataFrame:
    """(digest, licence, words) of the known texts, and of those given by their digest; a line that matches holds one of ``words``."""
    rows = spark.createDataFrame([(n, t) for n, t in known], "licence string, text string")
    rows = rows.select("licence", canonical(F.col("text")).alias("form")).where("form <> ''")
    stem = F.array(*[F.lit(w) for w in STEM_FROM])
    # a word of five letters or more is made up by no rule; the empty one is in every line
    words = F.when(F.col("form").contains(STEM), stem).otherwise(F.array(F.regexp_extract("form", "[a-z]{5,}", 0)))
    rows = rows.select(F.sha2("form", 256).alias("digest"), "licence", words.alias("words"))
    rows = rows.union(spark.createDataFrame([(d, n) for n, d in digests], "digest string, licence string").select("*", stem))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.flatten(F.collect_set("words")).alias("words"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, licence, line_licences).

    ``digest`` is that of the whole canonical text (null if it is empty), ``licence`` the known licence of that digest,
    ``line_licences`` the licences of the lines, sorted and joined by commas (empty if none).
    """
    rows = docs.select("doc_id", "text")
    words = sorted(r[0] for r in known.select(F.explode("words")).distinct().limit(MOST_WORDS + 1).collect())
    known = known.select("digest", "licence")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    if len(words) <= MOST_WORDS and "" not in words:
        lines = F.filter(lines, lambda line: F.lower(line).rlike("|".join(words)) if words else F.lit(False))
    notices = rows.select("doc_id", F.explode(lines).alias("line")).withColumn("form", canonical(F.col("line")))
    notices = notices.where("form <> ''").select("doc_id", F.sha2("form", 256).alias("digest")).join(known, "digest")
    # one short list per document: at most every known licence once
    found = notices.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("line_licences"))
    found = found.withColumnRenamed("doc_id", "own_id")
    whole = rows.select("doc_id", canonical(F.col("text")).alias("form"))
    whole = whole.select("doc_id", F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"))
    out = whole.join(known, "digest", "left").join(found, F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    return out.select("doc_id", "digest", "licence", F.coalesce("line_licences", F.lit("")).alias("line_licences"))


def scan_sql(known=KNOWN + TEXTS, digests=DIGESTS) -> str:
    """The scan of ``documents`` in the SQL of DuckDB; every line is brought to its form."""

    def form(text: str) -> str:
        plain, headed = (
            f"regexp_replace(l, '(?s)(?:{x}).*?({PHRASE})', ' \\1', 'g')" for x in (MARK, f"{MARK}|{HEAD}")
        )
        cut = f"""CASE WHEN NOT regexp_matches(l, 'copyright|\\(c\\)|©') THEN l
            WHEN regexp_matches(l, '{HEAD}') AND NOT regexp_matches(l, '{SENTENCE}') THEN {headed} ELSE {plain} END"""
        out = f"list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: replace({cut}, '{RESERVED}', ' '))"
        out = f"trim(regexp_replace(array_to_string({out}, ' '), '{NOT_WORD}', ' ', 'g'))"
        for pattern, replacement in SPELLINGS:
            own = replacement.replace("$", "\\")
            out = f"regexp_replace({out}, '{pattern}', '{own}', 'g')"
        return f"trim({out})"

    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known)
    given = ", ".join(f"('{d}', '{n}')" for n, d in digests)
    return f"""
        WITH known AS (
            SELECT digest, min(licence) AS licence FROM (
                SELECT sha256(form) AS digest, licence
                FROM (SELECT licence, {form('text')} AS form FROM (VALUES {values}) AS k(licence, text)) WHERE form <> ''
                UNION ALL SELECT * FROM (VALUES {given}) AS g(digest, licence)) GROUP BY 1
        ), whole AS (
            SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest
            FROM (SELECT doc_id, {form('text')} AS form FROM documents)
        ), notices AS (
            SELECT doc_id, sha256(form) AS digest FROM (
                SELECT doc_id, {form('line')} AS form
                FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
            ) WHERE form <> ''
        ), found AS (
            SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences
            FROM notices JOIN known USING (digest) GROUP BY doc_id
        )
        SELECT w.doc_id, w.digest, k.licence, coalesce(f.line_licences, '') AS line_licences
        FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.doc_id IS NOT DISTINCT FROM f.doc_id"""
