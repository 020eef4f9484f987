"""Mixing sources to target weights by systematic sampling.

Sources stand in code point order, null last, and take weights in rotation. They share FACTOR of all sizes by weight; a
target stops at CAP times its source's size and the excess is shared again by weight until none is above. Within a
source every document expects target / size copies. The expected copies are summed in an order that runs through the
sizes (size class, salt, size, doc_id), one offset is added, and a document is emitted once for each integer that its
stretch of the sum crosses; so each stretch of sizes contributes its share and the taken words come near the target.

The sum is taken in three levels: row numbers within (source, size class, salt), running counts over the salts of a size class,
and over a source's size classes, of which it has a bounded number. Salts come from a hash of the id, one for each GROUP rows
of the source and size class, so a source or size with a third of all rows makes more groups, not larger ones. The offset is
uniform in 0..1, a hash of the seed and the source's place: reruns agree.

Defined cases: a null or wordless text has size 0 and takes 0; a source of no words has target 0; repeated rows count
and are sampled as rows of their own; null doc_ids go first in their group, and are dealt to groups by text; columns other than doc_id, source and text
are carried by `mixed` and ignored by `mix_plan`; a size is the number of words [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import staged

WEIGHTS, FACTOR, CAP = (5, 2, 1), 1.5, 2.0
GROUP = 500


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(text: Column) -> Column:
    """0 to 2**32 - 1, by the first 32 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, place, source_size, target) from one row (source, source_size) for each source.

    Sources fill in order of CAP * size / weight: those before the level are at their cap, the rest share what is left
    by weight. The windows run over sources, not documents."""
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    out = sizes.withColumn("place", F.row_number().over(place)).withColumn("weight", turn)
    out = out.withColumn("cap", F.col("source_size") * CAP).withColumn("level", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("level", "place")
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * FACTOR - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("share", left / weight).withColumn("open", F.col("share") < F.col("level"))
    out = out.withColumn("final", F.min(F.when(F.col("open"), F.struct("level", "place", "share"))).over(everything))
    return out.select("source", "place", "source_size", F.coalesce(F.least("cap", F.col("final.share") * F.col("weight")), "cap").alias("target"))


def size_class(size: Column) -> Column:
    """Sizes under 16 themselves, then 8 classes an octave: a bounded number."""
    octave = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(octave * 16 + F.expr("shiftright(size, length(bin(size)) - 4)"))


def _copies(held: DataFrame, seed: int) -> DataFrame:
    """held (source, size, mark, doc_id, ...) with source_size, target and copies; mark is the hash that salts come from."""
    held = held.withColumn("class", size_class(F.col("size")))
    classes = staged(held.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    sizes = staged(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"))))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = classes.select(
        "source", "class", (F.floor(F.col("n") / GROUP) + 1).alias("salts"),
        before(Window.partitionBy("source").orderBy("class")).alias("class_start")
    )
    starts = starts.withColumnsRenamed({"source": "s", "class": "c"}).join(sizes, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    here = lambda rows: rows["source"].eqNullSafe(F.col("s")) & (rows["class"] == F.col("c"))
    salted = held.join(starts, here(held)).withColumn("salt", F.pmod("mark", "salts")).drop("s", "c", "salts", "mark")
    groups = staged(salted.groupBy("source", "class", "salt").agg(F.count("*").alias("n")))
    order = Window.partitionBy("source", "class").orderBy("salt")
    levels = groups.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("salt").alias("t"), before(order).alias("salt_start"))
    own = Window.partitionBy("source", "class", "salt").orderBy("size", "doc_id")
    ranked = salted.withColumn("rank", F.row_number().over(own))
    out = ranked.join(levels, here(ranked) & (ranked["salt"] == F.col("t")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    number = (F.col("class_start") + F.col("salt_start") + F.col("rank")).cast("double")
    offset = hashed(F.concat(F.lit(f"{seed}:"), F.col("place").cast("string"))) / F.lit(2.0**32)
    copies = F.floor(offset + expected * number) - F.floor(offset + expected * (number - 1.0))
    return out.withColumn("copies", copies).drop("class", "salt", "rank", "class_start", "salt_start", "place", "s", "c", "t")


def _mark() -> Column:
    return hashed(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).alias("mark")


def mix_report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words the mix takes of each document."""
    held = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _mark()))
    return _copies(held, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each row of docs once for each of its copies, all columns kept, and its number from 1 in `copy`
    (a column of that name is replaced)."""
    carried = docs.drop("copy")
    held = carried.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), _mark())
    kept = _copies(held, seed).filter("copies > 0")
    return kept.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
