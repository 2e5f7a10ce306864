"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a shuffled stream of its documents, cut into blocks of equally many words. The mix is a sequence of slots: slot ``t``
maps the van der Corput point of ``t`` (its bits mirrored behind the point) through the cumulative weights to a source, and takes the next
block of that source, starting again at its first block after the last. Any stretch of the schedule holds the sources in nearly their
target shares. The slots of a source are read off its interval: the points of the slots below 2 ** L are the multiples of 2 ** -L, so
those inside the interval, mirrored, are its slots, whatever its share. A source leaves the schedule once it has given its target; its
last slot takes only the words that are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from countspark.functions.scans import scan
from countspark.llm.common import WORD
from countspark.session import keep, small

#: Weights by the order of the sources.
WEIGHTS = (3, 1, 2)
#: Slots of the mix at which the length of a block is aimed; small mixes get blocks of one word.
SLOTS = 1 << 14
#: Slots of a source that one row is expanded to at once.
RUN = 4096


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, weight, place, target)`` from ``(source, size)``, one row per source.

    Sources take ``weights`` by turns, by code point, null last, and share ``share`` times all words. A target stops at ``most`` times
    its source's size; what is above goes to the others by weight until none is above. Needs ``share <= most``.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = scan(per.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()], number="place").drop("_all")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = keep(per.select("source", "source_size", "place", turn.alias("weight")))
    cap = F.col("source_size") * F.lit(float(most))
    # by falling weight per cap: if all before a source are full, the others share the rest at the level of its row; the first row whose level its cap is above holds
    parts = per.select("weight", "source_size", (cap / F.col("weight")).alias("ratio"), F.lit(0).alias("_all"))
    parts = scan(parts, ["_all"], [F.col("ratio"), F.col("source_size")], number="_n", sums={"_done": "source_size", "_met": "weight"}, totals={"_all_words": "source_size", "_weights": "weight"})
    level = (F.lit(share) * F.col("_all_words") - F.lit(most) * (F.col("_done") - F.col("source_size"))) / (F.col("_weights") - F.col("_met") + F.col("weight"))
    got = parts.withColumn("level", level).where("level < ratio").agg(F.min_by("level", "_n").alias("level")).first()["level"]
    aim = cap if got is None else F.least(cap, F.col("weight") * F.lit(got))  # none: all are full
    return per.withColumn("target", aim.cast("double"))


def schedule(demand: DataFrame) -> DataFrame:
    """``(source_no, rank, slot)`` for the ``rank``-th slot (from 0) of each source, for ``need`` slots each.

    ``demand`` has ``(place, need, goal)`` with one row per source; goals are whole numbers, at least 1 where slots are needed, below 2 ** 62
    in all. A source takes from the first 2 ** L slots, with L so that they hold the slots it needs and about as many more, so the
    work is twice the slots; runs of slots are spread over the tasks and ranked by a distributed row number.
    """
    asked = demand.where("need > 0").withColumn("_all", F.lit(0))
    shares = scan(asked, ["_all"], [F.col("place")], sums={"_upto": "goal"}, totals={"_total": "goal"})
    level = F.ceil(F.log2((F.col("need") + 1) * (F.col("_total") / F.col("goal")))).cast("int")
    # first multiple of 2 ** -L at or above a / total, exactly
    above = lambda a: F.expr(f"cast((cast({a} as decimal(19,0)) * cast(shiftleft(1L, level) as decimal(19,0)) + cast(_total as decimal(19,0)) - 1) div cast(_total as decimal(19,0)) as bigint)")
    shares = shares.withColumn("level", F.least(level, F.lit(62))).withColumn("_from", F.col("_upto") - F.col("goal"))
    shares = shares.withColumn("first", above("_from")).withColumn("count", above("_upto") - F.col("first"))
    runs = shares.select("place", "need", "level", "first", "count", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / RUN))).alias("run"))
    runs = runs.repartition("place", "run")
    at = F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("count")) - 1)
    points = runs.select(F.col("place").alias("source_no"), "need", "level", "first", F.explode(at).alias("at")).withColumn("point", F.col("first") + F.col("at"))
    mirrored = F.when(F.col("level") == 0, F.lit(0)).otherwise(F.conv(F.reverse(F.lpad(F.bin("point"), F.col("level"), F.lit("0"))), 2, 10).cast("bigint"))
    slots = points.select("source_no", "need", mirrored.cast("bigint").alias("slot"))
    return scan(slots, ["source_no"], [F.col("slot")], number="_n").where("_n <= need").select("source_no", (F.col("_n") - 1).cast("bigint").alias("rank"), "slot")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0,
        weights: tuple[int, ...] = WEIGHTS, slots: int = SLOTS) -> DataFrame:
    """One row per document: ``key``, ``size``, ``source_size``, ``target`` (both of its source), ``taken`` (words, repeats counted),
    ``first_slot`` (the first slot that takes words of it; null if none).

    A document that straddles the end of a block belongs to both blocks; the words of the document behind the end of the last slot
    are not taken, so the words taken from a source are its target, rounded. No document gives more than ``most`` times its size.
    Null texts and texts without words have size 0 and give nothing. Null is a source of its own. The stream of a source is ordered by
    a hash of key and text, so the result does not depend on the order of the rows; of equal rows any may come first. An empty table
    gives an empty result; other columns are ignored.
    """
    return _mix(docs, key, text, source, share, most, weights, slots).drop("at").withColumnRenamed("id", key)


def mix_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows of ``docs`` with ``taken`` and ``first_slot`` of ``mix`` behind their columns (columns of these names are replaced)."""
    found = keep(_mix(docs, key, text, options.pop("source", "source"), **{"share": 1.5, "most": 2.0, "weights": WEIGHTS, "slots": SLOTS} | options)
                 .select(F.col("id").alias("_id"), F.col("at").alias("_at"), "taken", "first_slot"))
    rows = docs.drop("taken", "first_slot")
    same = rows[key].eqNullSafe(found["_id"]) & (F.xxhash64(rows[key], rows[text]) == found["_at"])
    if found.groupBy("_id", "_at").count().where("count > 1").isEmpty():
        return rows.join(found, same).drop("_id", "_at")
    # of equal rows any may have any of their shares, but each of them one
    each = W.partitionBy("_id", "_at").orderBy("taken", "first_slot")
    found = found.withColumn("_no", F.row_number().over(each))
    named = rows.withColumns({"_key": rows[key], "_hash": F.xxhash64(rows[key], rows[text])})
    named = named.withColumn("_nth", F.row_number().over(W.partitionBy("_key", "_hash").orderBy("_hash")))
    same = named["_key"].eqNullSafe(found["_id"]) & (named["_hash"] == found["_at"]) & (named["_nth"] == found["_no"])
    return named.join(found, same).drop("_id", "_at", "_no", "_key", "_hash", "_nth")


def _mix(docs: DataFrame, key: str, text: str, source: str, share: float, most: float, weights: tuple[int, ...], slots: int) -> DataFrame:
    """``mix`` with the key as ``id`` and the hash of key and text as ``at``."""
    rows = keep(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
                            F.xxhash64(F.col(key), F.col(text)).alias("at")))
    targets = keep(source_targets(rows, share=share, most=most, weights=weights).withColumn("goal", F.round("target").cast("bigint")))
    total = targets.agg(F.sum("goal")).first()[0] or 0
    block = max(1, total // slots)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    per_round = F.ceil(F.col("source_size") / block).cast("bigint")  # the last block of a round may be shorter
    targets = targets.withColumn("need", (rounds * per_round + F.ceil((F.col("goal") - rounds * F.col("source_size")) / block)).cast("bigint"))
    plan = keep(schedule(targets.select("place", "need", "goal")))
    named = targets.select(F.col("source").alias("_source"), "place", "source_size", "target", "goal")
    # the blocks that are used: how many words of each, over all rounds of its source
    length = F.least(F.lit(block), F.col("source_size") - F.col("b") * block)
    uses = plan.join(small(named), F.col("source_no") == F.col("place"))
    uses = uses.select("source_no", "slot", "source_size", "goal", (F.col("rank") % per_round).alias("b"), F.floor(F.col("rank") / per_round).alias("round"))
    left = F.col("goal") - F.col("round") * F.col("source_size") - F.col("b") * block
    uses = uses.select("source_no", "b", "slot", F.greatest(F.lit(0), F.least(length, left)).alias("words")).where("words > 0")
    # the streams: where each document lies in its source
    streams = scan(rows.where("size > 0"), ["source"], [F.col("at"), F.col("id")], sums={"_end": "size"})
    where = streams.join(small(named), F.col("source").eqNullSafe(F.col("_source")))
    where = where.withColumn("_uid", F.monotonically_increasing_id())
    where = keep(where.select("_uid", "id", "at", "size", "source_size", "target", "place", (F.col("_end") - F.col("size")).alias("start"), F.col("_end").alias("end")))
    in_blocks = where.select("_uid", "place", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("doc_b"))
    low = F.greatest(F.col("start") - F.col("doc_b") * block, F.lit(0))
    high = F.least(F.col("end") - F.col("doc_b") * block, F.lit(block))
    met = in_blocks.join(uses, (F.col("place") == F.col("source_no")) & (F.col("doc_b") == F.col("b"))).select(
        F.col("_uid").alias("_of"), "slot", F.greatest(F.lit(0), F.least(high, F.col("words")) - low).alias("got")).where("got > 0")
    taken = met.groupBy("_of").agg(F.sum("got").alias("taken"), F.min("slot").alias("first_slot"))
    full = where.join(taken, F.col("_uid") == F.col("_of"), "left").select(
        "id", "at", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot")
    empty = rows.where("size = 0").join(small(named), F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "at", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("bigint").alias("first_slot"))
    return full.unionByName(empty)


