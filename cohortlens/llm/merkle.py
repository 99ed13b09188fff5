"""Document fingerprints: Merkle trees of texts, with DataFrame functions only.

Sections are split at ``\\n\\n``, paragraphs at ``\\n``, and a paragraph into leaves: up to 24 code points and the marks
``.!?`` behind them, so leaves fall into step again after the next mark. A leaf's hash is the SHA-256 of its text,
that of a paragraph, section or document the SHA-256 of its children's hashes in order; so equal roots mean equal
texts, and branches with unequal hashes lead to the edits.

A fingerprint is ``root|section;section...``, a section ``hash:paragraph,paragraph...`` and a paragraph
``hash~leaves``; sections and paragraphs have 16 hexadecimal digits of their hashes, leaves 6, without a separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.runtime import Scratch, shuffle_partitions

_LEAF = r"(?s)[^.!?]{1,24}[.!?]*|[.!?]+"
_LEAF_DIGITS, _NODE_DIGITS = 6, 16
_NO_ID = -(2**63)


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaf_hashes(text: Column) -> Column:
    """Hashes of the leaves of each paragraph of each section."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), _sha)
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def with_tree(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds ``name`` (the fingerprint) and ``name_leaves`` (the distinct leaves as numbers)."""
    a, b, c = f"__{name}_a", f"__{name}_b", f"__{name}_c"
    rows = rows.withColumn(a, leaf_hashes(text))
    paragraph = lambda leaves: F.struct(_sha(F.array_join(leaves, "")).alias("hash"), leaves.alias("leaves"))
    rows = rows.withColumn(b, F.transform(a, lambda s: F.transform(s, paragraph)))
    section = lambda s: F.struct(_sha(F.array_join(F.transform(s, lambda p: p["hash"]), "")).alias("hash"), s.alias("paragraphs"))
    rows = rows.withColumn(c, F.transform(b, section))
    short = lambda x: F.substr(x, F.lit(1), F.lit(_NODE_DIGITS))
    leaf = lambda x: F.substr(x, F.lit(1), F.lit(_LEAF_DIGITS))
    one = lambda p: F.concat(short(p["hash"]), F.lit("~"), F.array_join(F.transform(p["leaves"], leaf), ""))
    body = F.transform(c, lambda s: F.concat(short(s["hash"]), F.lit(":"), F.array_join(F.transform(s["paragraphs"], one), ",")))
    root = _sha(F.array_join(F.transform(c, lambda s: s["hash"]), ""))
    number = lambda x: F.conv(leaf(x), 16, 10).cast("int")
    rows = rows.withColumn(name, F.concat(root, F.lit("|"), F.array_join(body, ";"))).withColumn(f"{name}_leaves", F.array_distinct(F.transform(F.flatten(F.flatten(a)), number)))
    return rows.drop(a, b, c)


def likeness(a: Column, b: Column) -> Column:
    """Twice the number of common leaves over the number of leaves of both; 1 if neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def leaves_of(fingerprint: Column) -> Column:
    """The distinct leaves of a fingerprint as numbers, as ``with_tree`` gives them."""
    runs = F.regexp_extract_all(fingerprint, F.lit("~([0-9a-f]+)"), F.lit(1))
    each = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(f".{{{_LEAF_DIGITS}}}"), F.lit(0))))
    return F.array_distinct(F.transform(each, lambda x: F.conv(x, 16, 10).cast("int")))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Places (section, paragraph), from 0, where two fingerprints differ; only sections with unequal hashes are entered."""
    x, y = (F.split(F.substring_index(c, "|", -1), ";") for c in (a, b))
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    upto = lambda u, v: F.sequence(F.lit(0), F.greatest(F.size(u), F.size(v)) - 1)

    def inside(i: Column) -> Column:
        u, v = (F.split(F.substring_index(at(c, i), ":", -1), ",") for c in (x, y))
        unequal = F.filter(upto(u, v), lambda j: F.substring_index(at(u, j), "~", 1) != F.substring_index(at(v, j), "~", 1))
        return F.transform(unequal, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    branches = F.filter(upto(x, y), lambda i: F.substring_index(at(x, i), ":", 1) != F.substring_index(at(y, i), ":", 1))
    return F.flatten(F.transform(branches, inside))


def fingerprint_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to every row (a column of that name is replaced); a null text counts as empty.

    Rows are judged one by one: repeated rows get equal fingerprints, an empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != "fingerprint"]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return with_tree(row, F.col("__text"), "fingerprint").select("__row.*", "fingerprint")


def next_keys(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, h, n, next_key, next_h) of the distinct (key, h, n), where the next one is the next lower, after the last the first.

    Only these numbers are sorted, by ranges: within a partition a window sees the next row, and the first row of
    each partition (one row a partition) is carried to the last one of the partition before it.
    """
    spark = rows.sparkSession
    down = [F.col("key").desc(), F.col("h").desc()]
    ordered = rows.select("key", "h", "n").distinct().repartitionByRange(shuffle_partitions(spark), *down)
    ordered = scratch.keep(ordered.withColumn("part", F.spark_partition_id()), "order")
    first = ordered.groupBy("part").agg(F.max(F.struct("key", "h")).alias("own"))
    along = Window.orderBy("part")  # over one row a partition
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    border = first.select("part", F.coalesce(F.lead("own").over(along), F.first("own").over(whole)).alias("border"))
    inside = F.lead(F.struct("key", "h")).over(Window.partitionBy("part").orderBy(*down))
    after = F.coalesce(F.col("after"), F.col("border"))
    found = ordered.withColumn("after", inside).join(border, "part").select("key", "h", "n", after.alias("after"))
    return scratch.keep(found.select("key", "h", "n", F.col("after.key").alias("next_key"), F.col("after.h").alias("next_h")), "next")


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, edited, next_leaves): each text, its edited text, and the leaves of the next document.

    The next document is the one with the next lower id; after the last comes the first. A null id counts as the
    lowest. Of rows that repeat an id, the one with the larger text hash comes first; rows equal in id and text
    have the same next one, the next different row. A null text counts as empty. An empty table gives an empty one.

    Texts are shuffled once, by their own key; what a document needs of its next one is sent to it.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    key = F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID))
    after = next_keys(rows.select(key.alias("key"), "h", F.char_length("text").alias("n")), scratch)
    cut = F.floor(F.col("n") / 3).cast("int")
    asked = after.select(F.col("key").alias("to_key"), F.col("h").alias("to_h"), cut.alias("cut"), "next_key", F.col("next_h").alias("h"))
    sent = rows.join(asked.hint("merge"), [key == F.col("next_key"), rows["h"] == asked["h"]])
    sent = with_tree(sent.select("to_key", "to_h", "cut", "text"), F.col("text"), "next")
    sent = sent.select("to_key", "to_h", F.substr("text", F.lit(1), F.col("cut")).alias("head"), "next_leaves")
    sent = sent.groupBy("to_key", "to_h").agg(F.first("head").alias("head"), F.first("next_leaves").alias("next_leaves"))  # repeated rows send the same
    both = rows.join(sent.hint("merge"), [key == F.col("to_key"), F.col("h") == F.col("to_h")])
    n = F.char_length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    return both.select(F.col("id").alias(id_col), "text", edited.alias("edited"), "next_leaves")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to it and to the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = edited_texts(docs)
    rows = with_tree(with_tree(rows, F.col("text"), "fingerprint"), F.col("edited"), "edited_fingerprint")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        _sha(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint_leaves"), F.col("edited_fingerprint_leaves")).alias("near_edited"),
        likeness(F.col("fingerprint_leaves"), F.col("next_leaves")).alias("near_next"),
    )
