"""Chains of pieces put in order by pointer doubling, so that no task ever holds a whole chain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogena.storage import written

PIECE = ("group", "piece", "a", "b", "a_side", "b_side", "n", "least")


def _arcs(pieces: DataFrame) -> DataFrame:
    """Each piece in both directions: from ``enter`` to ``leave``; ``way`` is 0 from a to b."""
    both = F.explode(
        F.array(
            F.struct(F.lit(0).alias("way"), F.col("a").alias("enter"), F.col("a_side").alias("enter_side"), F.col("b").alias("leave"), F.col("b_side").alias("leave_side")),
            F.struct(F.lit(1).alias("way"), F.col("b").alias("enter"), F.col("b_side").alias("enter_side"), F.col("a").alias("leave"), F.col("a_side").alias("leave_side")),
        )
    )
    return pieces.select("group", "piece", "n", "least", both.alias("x")).select("group", "piece", "n", "least", "x.*")


def _doubled(pieces: DataFrame, cuts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Arcs that reach an end, as (group, piece, way, end, end_side, after), and those that never do, as (group, piece, low).

    ``after`` adds up n from the arc to the end, itself included; ``low`` is the least place of the ring.  Places in ``cuts``
    (group, place) join nothing.
    """
    arcs = written(_arcs(pieces), "arcs")
    enters = arcs.select("group", F.col("enter").alias("leave"), F.col("piece").alias("to_piece"), F.col("way").alias("to_way"))
    if cuts is not None:
        enters = enters.join(cuts.select("group", F.col("place").alias("leave")), ["group", "leave"], "left_anti")
    met = arcs.join(enters, ["group", "leave"], "left").where("to_piece IS NULL OR to_piece <> piece OR to_way = way")
    # of an arc whose only way on is back over itself nothing is left by the filter above: it ends
    onward = met.groupBy("group", "piece", "way").agg(F.max("to_piece").alias("to_piece"), F.max("to_way").alias("to_way"))
    state = arcs.join(onward, ["group", "piece", "way"], "left")
    state = written(state.select("group", "piece", "way", "to_piece", "to_way", F.col("n").alias("after"), F.col("leave").alias("end"), F.col("leave_side").alias("end_side"), "least"), "state")
    # a window of 2^k arcs covers any ring once 2^k is the most pieces of a group
    most = pieces.groupBy("group").agg(F.count("*").alias("c")).agg(F.max("c")).collect()[0][0] or 1
    for _ in range(math.ceil(math.log2(most)) + 1):
        going = state.where("to_piece IS NOT NULL")
        if going.isEmpty():
            break
        step = state.select("group", F.col("piece").alias("to_piece"), F.col("way").alias("to_way"), F.col("to_piece").alias("on_piece"), F.col("to_way").alias("on_way"), F.col("after").alias("more"), F.col("end").alias("on_end"), F.col("end_side").alias("on_side"), F.col("least").alias("low"))
        # arcs that have ended stay to be joined with, those that haven't go on
        told = written(
            going.join(step, ["group", "to_piece", "to_way"]).select(
                "group", "piece", "way", F.col("on_piece").alias("to_piece"), F.col("on_way").alias("to_way"), (F.col("after") + F.col("more")).alias("after"), F.col("on_end").alias("end"), F.col("on_side").alias("end_side"), F.least("least", "low").alias("least")
            ),
            "told",
        )
        state = written(state.where("to_piece IS NULL").unionByName(told), "state")
    ended = state.where("to_piece IS NULL").select("group", "piece", "way", "end", "end_side", "after")
    rings = state.where("to_piece IS NOT NULL").groupBy("group", "piece").agg(F.min("least").alias("low"))
    return ended, rings


def _placed(pieces: DataFrame, ended: DataFrame, closed: bool) -> DataFrame:
    """(group, piece, line, offset, reversed, closed): a chain begins at its lesser end, and a ring goes out by its lesser side."""
    to = F.struct("end", "end_side", "after")
    ends = ended.groupBy("group", "piece").agg(F.max(F.when(F.col("way") == 0, to)).alias("b"), F.max(F.when(F.col("way") == 1, to)).alias("a"))
    forward = F.struct("a.end", "a.end_side") <= F.struct("b.end", "b.end_side")
    return ends.join(pieces.select("group", "piece", "n"), ["group", "piece"]).select(
        "group", "piece", F.when(forward, F.col("a.end")).otherwise(F.col("b.end")).alias("line"), (F.when(forward, F.col("a.after")).otherwise(F.col("b.after")) - F.col("n")).alias("offset"), (~forward).alias("reversed"), F.lit(closed).alias("closed")
    )


def chained(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order pieces that meet end to end: (group, piece, line, offset, reversed, closed) of open chains, and (group, piece, low) of rings.

    Pieces are (group, piece, a, b, a_side, b_side, n, least): from place a to place b over n steps, ``least`` being the least place
    on it.  At most two pieces of a group end at a place, whose sides tell them apart there.  A ring is to be cut at its place ``low``, by
    :func:`opened`, before it can be put in order.
    """
    pieces = written(pieces.select(*PIECE), "pieces")
    ended, rings = _doubled(pieces, None)
    rings = written(rings, "rings")
    return _placed(pieces, ended.join(rings, ["group", "piece"], "left_anti"), False), rings


def opened(pieces: DataFrame, cuts: DataFrame) -> DataFrame:
    """The same for pieces of rings that end at the places where they are cut (group, place): (group, piece, line, offset, reversed, closed)."""
    pieces = written(pieces.select(*PIECE), "pieces")
    ended, _ = _doubled(pieces, cuts)
    return _placed(pieces, ended, True)
