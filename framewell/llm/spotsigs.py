"""Document fingerprints by SpotSigs. DataFrame functions only.

A text is lower-cased and cut into words of letters and digits. Each run of common words
(the fixed list below) is an anchor; its spot is the chain of the ``CHAIN`` content words
that follow it. A stretch of ``STRETCH`` content words without a common word is followed
by an anchor of its own, so tables and lists have spots too, and the text's start is one.
A signature is the hash of anchor and chain; a document's set of signatures, sorted, is
its fingerprint (eight hex digits each).

Sets are compared by Jaccard likeness. ``near_pairs`` partitions sets by length: two sets
of sizes a <= b with a < t*b can't be that like, so a set meets only its own length class
and the next, through the signatures of its prefix, and is then verified.

Defined results: null and empty texts have the empty fingerprint; a text without any
letter or digit has one signature, of the whole text; two empty fingerprints have
likeness 1, an empty and another 0; equal texts have equal fingerprints; equal ids follow
each other in text order; rows with a null id come after all others; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_sha256, partitions

#: Common words of four languages (fixed values).
COMMON = (
    "a an and are as at be by for from has he her his in is it its of on or that the they this to was were which with "
    "au aux ce ces dans de des du elle en est et il la le les leur ou par pas pour que qui se sur un une "
    "als auf aus bei das dem den der die ein eine er es für im ist mit nicht sich sie und von wird zu "
    "al como con del el ella las lo los más no para por sin su sus una y"
)
CHAIN, STRETCH = 2, 8


def _alternation(words: list[str]) -> str:
    """A pattern of the words, grouped by first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{k}(?:{'|'.join(sorted(v, key=len, reverse=True))})" for k, v in by.items()) + ")"


#: A run is cut after eight common words: the pattern engine's stack grows with a group's repeats.
_ANCHORS = rf"((?: {_alternation(COMMON.split())}(?= )){{1,8}})"
_LONG = rf"((?: [^ \n\t]+){{{STRETCH}}})(?= )"


def signatures(text: Column) -> Column:
    """Sorted array<bigint> of the text's distinct signatures."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(words, _ANCHORS, "\n$1\t"), _LONG, "$1\n\t")
    parts = F.split(marked, "\n")
    # a part is " anchor words\t content words "; only the first has no tab
    content = lambda p: F.trim(F.substring_index(p, "\t", -1))

    def spots(all_parts):
        """``all_parts`` is bound by an outer transform, so the patterns run once for a text."""

        def spot(p, i):
            chain = F.substring_index(F.trim(F.concat_ws(" ", content(p), content(F.coalesce(F.get(all_parts, i + 1), F.lit(""))))), " ", CHAIN)
            anchor = F.when(F.instr(p, "\t") > 0, F.substring_index(p, "\t", 1)).otherwise(F.lit(""))
            return F.when(chain != "", F.xxhash64(anchor, chain).bitwiseAND(0xFFFFFFFF))

        return F.transform(all_parts, spot)

    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.array(parts), spots)[0])))
    whole = F.array(F.xxhash64(text).bitwiseAND(0xFFFFFFFF))
    return F.transform(F.array(found), lambda f: F.when((F.size(f) == 0) & (F.length(text) > 0), whole).otherwise(f))[0]


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Column]:
    """Rows (id, text, next_text, ghost) dealt out in id ranges, and the window over them.

    The next row is that of the next smaller id, after the last the first. A range also holds
    a copy (ghost) of the first row of the next range, one for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(2, partitions(spark))
    cuts = rows.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted({int(c) for c in cuts})
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(id_col))), F.lit(0)) if cuts else F.lit(0)
    place = F.when(F.col(id_col).isNull(), -1).otherwise(place).cast("int")
    rows = rows.withColumn("part", place)
    heads = {r["part"]: r["head"] for r in rows.where(F.col(id_col).isNotNull()).groupBy("part").agg(F.max(id_col).alias("head")).collect()}  # a row for each range
    order = sorted(heads, reverse=True)
    lead = {heads[after]: at for at, after in zip(order, [*order[1:], *order[:1]], strict=True)}  # head id -> the range it follows
    rows = rows.withColumn("ghost", F.lit(0))
    if lead:
        target = F.create_map(*[F.lit(x) for kv in lead.items() for x in kv])
        first = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col(id_col).isin([*lead]))
        rows = rows.unionByName(first.withColumn("part", target[F.col(id_col)].cast("int")).withColumn("ghost", F.lit(1)))
    w = Window.partitionBy("part").orderBy("ghost", F.col(id_col).desc_nulls_last(), "text")
    return rows.withColumn("next_text", F.coalesce(F.lead("text").over(w), F.lit(""))), w


def digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to the latter and to the next document."""
    rows, w = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("doc_id", "part", "ghost", "text", n.cast("long").alias("n_chars"), hex_sha256(F.col("edited")).alias("edited_sha256"), signatures(F.col("text")).alias("s"), signatures(F.col("edited")).alias("e"))
    rows = rows.withColumn("t", F.coalesce(F.lead("s").over(w), F.array().cast("array<bigint>"))).where(F.col("ghost") == 0)
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("t")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, near) of distinct fingerprints with likeness of ``threshold`` or more, by their smallest doc ids.

    Equal fingerprints are one class; empty ones make no pair.
    """
    sets = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("s")).groupBy("s").agg(F.min("doc_id").alias("id")).where(F.size("s") > 0)
    n = F.size("s")
    sets = sets.withColumn("n", n).withColumn("class", F.floor(F.log(n.cast("double")) / -math.log(threshold)).cast("int"))
    keys = F.slice("s", 1, n - F.ceil(threshold * n - 1e-9).cast("int") + 1)
    left = sets.select("id", "s", "n", "class", F.explode(keys).alias("k"))
    right = left.select(F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("n").alias("n2"), F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class"), "k")
    met = left.join(right, ["class", "k"]).where((F.col("n") < F.col("n2")) | (F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2"))).where(F.col("n") >= F.col("n2") * threshold - 1e-9)
    near = likeness(F.col("s"), F.col("s2"))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), near.alias("near")).where(F.col("near") >= threshold).distinct()
