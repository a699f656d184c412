"""Operator 7: Merkle-tree fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A leaf: up to six words, closed early by a word that ends a sentence.
LEAF = r"(?:\S*[^\s.!?]\s+){0,5}\S+"
#: Hex digits of a leaf's digest, and of a section's.
WIDTH, NODE = 8, 16
#: First digits of the digest of a line that closes its section, beside blank lines: sections of four lines on average, wherever an edit before them moves them.
CLOSING = "0123"


def tree(text: Column) -> Column:
    """Digests of the leaves of paragraphs of sections: array<array<array<string>>>.

    Paragraphs part at line ends; sections part at blank lines, and after a line whose own digest says so.
    """
    leaf = lambda x: F.substring(F.sha2(x, 256), 1, WIDTH)
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), leaf)
    closed = F.transform(F.split(text, "\n"), lambda p: F.when(F.substring(F.md5(p), 1, 1).isin(*CLOSING), F.concat(p, F.lit("\n"))).otherwise(p))
    return F.transform(F.split(F.array_join(closed, "\n"), r"\n[ \t\r]*\n"), lambda s: F.transform(F.split(s, "\n"), paragraph))


def sections(nodes: Column) -> Column:
    """The branches under the root: digest (of the digests of its paragraphs), paragraphs (each its leaves in a row), leaves."""
    joined = lambda s: F.transform(s, lambda p: F.array_join(p, ""))
    digest = lambda s: F.substring(F.sha2(F.array_join(F.transform(joined(s), lambda p: F.sha2(p, 256)), ""), 256), 1, NODE)
    return F.transform(nodes, lambda s: F.struct(digest(s).alias("digest"), F.array_join(joined(s), ";").alias("paragraphs"), F.flatten(s).alias("leaves")))


def fingerprint(text: Column, branches: Column) -> Column:
    """root/section/section...: a section is its digest, ':', and its paragraphs joined by ';', a paragraph its leaves of WIDTH digits.

    The root digests the whole text and the digests of the sections, each of which digests its paragraphs.
    """
    root = F.sha2(F.concat(F.sha2(text, 256), F.array_join(F.transform(branches, lambda s: s["digest"]), "")), 256)
    return F.concat(root, F.lit("/"), F.array_join(F.transform(branches, lambda s: F.concat(s["digest"], F.lit(":"), s["paragraphs"])), "/"))


def differing(branches: Column, others: Column) -> Column:
    """Numbers (from 0) of the branches whose digests the other tree lacks: where an edit is."""
    known = F.transform(others, lambda s: s["digest"])
    return F.filter(F.transform(branches, lambda s, i: F.when(~F.array_contains(known, s["digest"]), i)), lambda i: i.isNotNull())


def likeness(same: Column, a: Column, away_a: Column, b: Column, away_b: Column) -> Column:
    """1 for equal texts; else the share of leaves in common, by descending: a branch with an equal digest is whole, and only differing ones are opened."""
    leaves = lambda x: F.aggregate(x, F.lit(0), lambda n, s: n + F.size(s["leaves"]))
    opened = lambda x, away: F.array_distinct(F.flatten(F.transform(away, lambda i: F.get(x, i)["leaves"])))
    inside = lambda x, away: F.aggregate(away, F.lit(0), lambda n, i: n + F.size(F.get(x, i)["leaves"]))
    rest_a, rest_b = opened(a, away_a), opened(b, away_b)
    whole = leaves(a) - inside(a, away_a) + leaves(b) - inside(b, away_b)
    both, total = whole + 2 * F.size(F.array_intersect(rest_a, rest_b)), whole + F.size(rest_a) + F.size(rest_b)
    return F.when(same, 1.0).otherwise(F.coalesce(F.try_divide(both.cast("double"), total.cast("double")), F.lit(0.0)))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections in which fingerprint ``a`` has what ``b`` lacks; empty for equal roots."""
    digests = lambda x: F.transform(F.slice(F.split(x, "/"), 2, 1 << 30), lambda s: F.struct(F.substring(s, 1, NODE).alias("digest")))
    return F.when(F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1), F.array().cast("array<int>")).otherwise(differing(digests(a), digests(b)))


def _bucket(key: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``: a binary search; null: -1."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    array = F.lit(bounds) if bounds else F.array().cast("array<long>")
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]) if steps else F.array().cast("array<int>"), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(array, at + s - 1) <= key, F.lit(False)), at + s).otherwise(at))
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)


def _prefix(text: Column) -> Column:
    """The first seven bytes of a text as a number that orders as the text does."""
    return F.conv(F.rpad(F.substring(F.hex(F.encode(text, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the text of the next document in descending doc_id order; the first follows the last.

    Ranges of doc_id are dealt to tasks; a range also gets the first row of the range below it, so no window spans the
    table.  Numbers are cut by approximate percentiles, any other type by the first bytes of its text (ids that share them share
    a range).  Null doc_ids come last; equal ids go by their texts.
    """
    spark = docs.sparkSession
    n = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType
    place = F.col("doc_id").cast("long") if isinstance(kind, IntegralType) else _prefix(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select(F.percentile_approx(place, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    rows = rows.withColumn("part", _bucket(place, sorted(set(found or []))))
    tops = sorted(((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()), key=lambda x: x[0], reverse=True)
    if not tops:
        return rows.select("doc_id", "text", F.lit("").alias("next_text"))
    heads = [(part, top, tops[i - 1][0]) for i, (part, top) in enumerate(tops)]  # each range's head also closes the range above
    heads = F.broadcast(spark.createDataFrame(heads, f"part int, top {kind.simpleString()}, above int"))  # one row a range
    head = rows.join(heads, (rows["part"] == heads["part"]) & rows["doc_id"].eqNullSafe(heads["top"]))
    head = head.groupBy("above").agg(F.min("text").alias("text")).select(F.lit(None).cast(kind).alias("doc_id"), "text", F.col("above").alias("part"), F.lit(1).alias("guest"))
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("guest", F.lit(0)).unionByName(head).withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def merkle_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last half replaced from the next document), and their likeness.

    ``edited_sections`` and ``next_sections`` number the sections of the text that the edited text, and the next document, lack.
    Null text is empty; equal texts have equal fingerprints; a single document is its own next one; doc_id may be null or repeated
    (see with_next); an empty table gives an empty result; further columns are ignored.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("*", *[sections(tree(F.col(c))).alias(name) for c, name in (("text", "t"), ("edited", "e"), ("next_text", "x"))])
    prints = [fingerprint(F.col(c), F.col(name)).alias(out) for c, name, out in (("text", "t", "fingerprint"), ("edited", "e", "edited_fingerprint"))]
    away = [differing(F.col(x), F.col(y)).alias(f"{x}{y}") for x, y in ("te", "et", "tx", "xt")]
    same = [(F.col("text") == F.col(c)).alias(name) for c, name in (("edited", "same_e"), ("next_text", "same_x"))]
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *prints, *away, *same, "t", "e", "x")
    near = [likeness(F.col(f"same_{y}"), F.col("t"), F.col(f"t{y}"), F.col(y), F.col(f"{y}t")) for y in "ex"]
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"), F.col("te").alias("edited_sections"), F.col("tx").alias("next_sections"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("edited_sections", "next_sections")})

