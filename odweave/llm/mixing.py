"""Mixing sources to target weights: whole copies first, then Pareto order sampling of what is left of each target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.llm.audit import text_words
from odweave.operators.joins import join
from odweave.operators.windows import add_row_id, in_order, scan_stored
from odweave.session import materialize

#: Letters of a hash that make a document's random number: 48 bits, so that number and complement are exact doubles.
_DIGITS = 12


def random_number(key: Column, seed: int) -> Column:
    """Between 0 and 1, neither included, from seed and key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 4 * _DIGITS))


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``sources`` (source, source_size) with target: weighted shares of ``share`` times all sizes, none above its cap.

    A target stops at ``most`` times its source's size and the excess is reshared by weight until none is above. That is
    one common level of target per weight: in the order of cap per weight, the level at a source is what is left after
    the sources before it took their caps; the sources whose cap holds the level share it.
    """
    numbered = add_row_id(sources, ["source"], "__no")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("__no") - 1, F.lit(len(weights))).cast("int") + 1)
    caps = numbered.withColumns({"weight": weight.cast("bigint"), "cap": F.col("source_size") * most})
    caps = in_order(caps.withColumn("per", F.col("cap") / F.col("weight")), ["per", "source"])
    scanned = scan_stored(caps, ["per", "source"], {"caps": "cap", "weights": "weight"}, None, ())
    budget, heavy = caps.agg(F.sum("source_size") * share).scalar(), caps.agg(F.sum("weight")).scalar()
    level = (budget - (F.col("caps") - F.col("cap"))) / (heavy - (F.col("weights") - F.col("weight")))
    found = materialize(scanned.withColumn("level", level))
    held = found.agg(F.max(F.when(F.col("per") >= F.col("level"), F.col("level")))).scalar()
    target = F.least(F.col("cap").cast("double"), F.coalesce(held, F.lit(0.0)) * F.col("weight"))
    return found.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 13,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Per row of ``docs``: key, size (words), source_size, target (its source's) and taken (words that the mix takes).

    Sources, by code point with the missing one last, weigh ``weights``, repeating. Every document is expected
    target / source_size times: the whole part of it is copies that all its documents get for certain, the fraction is
    their inclusion probability in a Pareto order sample. Random odds over inclusion odds rank the documents; the sample has a fixed
    size, in words: a source's documents are taken in that order as long as their middle lies within what is left of the target, so
    the words taken come as near to it as whole documents in this order can, within half of one document.

    The random odds come from seed and key, so reruns agree. Equal ranks go by key. A missing text has no words and takes none;
    documents without source are a source of their own; a missing key counts as an empty string in the hash and comes last among
    ties; repeated rows are taken one by one; an empty table gives no rows; other columns are not read. A source may hold any
    part of the rows: its order is scanned in ranges.
    """
    size = F.size(text_words(F.coalesce(docs[text], F.lit("")))).cast("bigint")
    rows = materialize(docs.select(docs[key].alias("key"), docs[source].cast("string").alias("source"), size.alias("size")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    number, chance = random_number(F.col("key"), seed), F.try_divide("left", "source_size")
    odds = F.try_divide(number / (1 - number), chance / (1 - chance))
    ranked = join(rows, plan, by="source").withColumn("odds", odds)
    order = ["odds", "key"]
    scanned = scan_stored(in_order(ranked, order, ["source"]), order, {"upto": "size"}, None, ["source"])
    drawn = F.col("odds").isNotNull() & (2 * F.col("upto") - F.col("size") <= 2 * F.col("left"))
    return scanned.select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * (F.col("whole") + drawn.cast("int"))).alias("taken")
    )
