"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line's shingles are all its runs of CHARS characters; a shorter line is one run.  One permutation, a hash, orders them, and
the least ones are the signature.  Bands are neighbours in that order: of two sets at a similarity of 0.8 or more, at most a fifth of
the union is in one set alone, so that runs of neighbours in common are left wherever the others stand.  Runs of two do for sets of
up to five, of three for larger ones (see ``bands_of``).  Bands propose candidates; those whose signatures have enough in common are
confirmed by the exact Jaccard similarity of their shingles; distributed union-find then keeps one line of each component, the first by
document, row and place.  Lines that are equal are one line from the start.

Signatures are made without a line's whole set: runs are rows, and those whose hash is beyond a bound that follows the line's
length are left at once.  Lines of which too few stay are cut whole.  Texts travel only where signatures call for them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogena.llm.common import SMALL_BUCKET, dealt_pairs, filter_bits, key_filter, key_name, linked_components, shared_buckets, stash, through_filter

#: Characters in a run, and places of a line that are cut at once: by characters, where finding one costs its distance from the start, and by bytes.
CHARS, CUT, CUT_BYTES = 7, 16, 256
#: Bands of each size: hashes in a band -> the least and the greatest set that has such bands.
SIZES = {2: (1, 5), 3: (5, None)}
#: Bands of a size at most.
BANDS = 14
#: Least hashes of a line, its signature, and those that are expected to stay of its runs when these are made.
LEAST, TAKEN = BANDS + 2, 32
#: The chance at most that two lines at the least similarity have too few least hashes in common to be compared.
MISSED = 1e-5
#: Words of 64 bits in a line's parities.
WORDS = 16


def _runs(line: Column) -> Column:
    """The hashes of a line's runs, in no order and with repeats."""
    n = F.length(line)

    def cut(whole: Column, size: Callable[[Column], Column], at_once: int) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - CHARS) / at_once).cast("int")), lambda k: F.substring(whole, k * at_once + 1, F.lit(at_once + CHARS - 1)))
        return F.flatten(F.transform(parts, lambda part: F.transform(F.sequence(F.lit(1), size(part) - (CHARS - 1)), lambda i: F.xxhash64(F.substring(part, i, F.lit(CHARS))))))

    # where each character is a byte, runs are cut by bytes, whose hashes are the same; a pattern, which goes by UTF-16, finds those of
    # valid lines in which each character is one unit of that
    by_bytes, by_units = F.octet_length(line) == n, F.is_valid_utf8(line) & ~line.rlike(r"[\x{10000}-\x{10FFFF}]")
    found = F.transform(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{CHARS}}}))"), F.lit(1)), lambda x: F.xxhash64(x))
    return F.when(n < CHARS, F.array(F.xxhash64(line))).when(by_bytes, cut(line.cast("binary"), F.octet_length, CUT_BYTES)).when(by_units, found).otherwise(cut(line, F.length, CUT))


def shingles(line: Column) -> Column:
    """A line's set: the sorted distinct hashes of its runs."""
    return F.array_distinct(F.sort_array(_runs(line)))


def parities(lines: DataFrame) -> DataFrame:
    """(id, n, bits) for rows (id, line): the size of the line's set and, for each of 64 * WORDS classes of hashes, whether it has an odd number of them.

    An element of one set alone turns one bit, so two sets differ in at least as many elements as their bits differ.
    """
    runs = lines.select("id", F.explode(F.array_distinct(_runs(F.col("line")))).alias("x"))
    bit, word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("x", F.lit(64)).cast("int")), F.pmod(F.shiftright("x", 6), F.lit(WORDS))
    # columns of their own, so that they are made once a run and not once a word
    told = runs.select("id", bit.alias("bit"), word.cast("int").alias("word"))
    odd = lambda k: F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long")))
    return told.groupBy("id").agg(F.count("*").alias("n"), F.array(*[odd(k) for k in range(WORDS)]).alias("bits"))


def may_be_like(a_bits: Column, b_bits: Column, a_n: Column, b_n: Column, percent: int) -> Column:
    """Whether sizes and parities leave a similarity of ``percent`` possible; false only where it is less."""
    fits = 100 * F.least(a_n, b_n) >= percent * F.greatest(a_n, b_n)
    # both = (an + bn - apart) / 2, so 100 both >= percent (an + bn - both) says (100 + percent) apart <= (100 - percent) (an + bn)
    apart = reduce(Column.__add__, [F.bit_count(F.get(a_bits, F.lit(k)).bitwiseXOR(F.get(b_bits, F.lit(k)))) for k in range(WORDS)])
    return fits & ((100 + percent) * apart <= (100 - percent) * (a_n + b_n))


def _lines(docs: DataFrame, text_col: str, *cols: Column) -> DataFrame:
    rows = docs.select(*cols, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = rows.select("*", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).drop("text")
    # two 64-bit hashes name a line; blank lines have no name
    told = F.octet_length(F.ltrim(F.col("line"), F.lit(" \t\n\x0B\f\r"))) > 0
    return lines.withColumns({"h1": F.when(told, F.xxhash64("line")), "h2": F.when(told, F.xxhash64(F.lit("second"), "line"))})


def _wide(line: Column) -> Column:
    """Four bytes for each character: its UTF-32, or its own bytes under a mark that UTF-32 never has where they are no UTF-8."""

    def code(c: Column) -> Column:
        short = F.concat(F.element_at(F.array(F.lit("F8"), F.lit("F9"), F.lit("FA")), F.octet_length(c)), F.lpad(F.hex(c), 6, "0"))
        return F.when(F.is_valid_utf8(c), F.hex(F.encode(c, "UTF-32"))).when(F.octet_length(c) == 4, F.hex(c)).otherwise(short)

    odd = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.length(line)), lambda i: code(F.substring(line, i, F.lit(1)))), ""))
    return F.when(F.is_valid_utf8(line), F.encode(line, "UTF-32")).otherwise(odd)


def _at(wide: Column) -> Column:
    """Where a line's runs begin."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(wide) - (4 * CHARS - 1)), F.lit(4))


def _rank(wide: Column, at: Column) -> Column:
    """A run's place in the permutation."""
    return F.shiftright(F.xxhash64(F.substring(wide, at, F.lit(4 * CHARS))), 32).cast("int")


def signatures(named: DataFrame) -> DataFrame:
    """(id, h1, h2, h, whole) for rows (h1, h2, line), one for each name: a line's LEAST least ranks in order.

    Not whole are those of which too few ranks were under the bound for that; their h is no signature.
    """
    wide = named.select("h1", "h2", _wide(F.col("line")).alias("wide"))
    sized = wide.withColumn("m", F.greatest(F.lit(1), F.octet_length("wide") / 4 - (CHARS - 1)).cast("long"))
    bound = F.when(F.col("m") <= TAKEN, F.lit(1 << 31)).otherwise(F.floor(F.lit(TAKEN << 32) / F.col("m")) - (1 << 31))
    # an outer explode, as another one is preceded by a filter that widens each line once more
    runs = sized.select("h1", "h2", "m", "wide", bound.alias("bound"), F.explode_outer(_at(F.col("wide"))).alias("at"))
    rank = _rank(F.col("wide"), F.col("at"))
    # the first run stands for its line, of which no other may stay; it counts where it is under the bound
    taken = runs.where((rank < F.col("bound")) | (F.col("at") == 1)).select("h1", "h2", "m", F.when(rank < F.col("bound"), rank).alias("x"))
    sets = taken.groupBy("h1", "h2", "m").agg(F.collect_set("x").alias("h"))
    whole = (F.col("m") <= TAKEN) | (F.size("h") >= LEAST)
    return sets.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", F.slice(F.sort_array("h"), 1, LEAST).alias("h"), whole.alias("whole"))


def signature(line: Column) -> Column:
    """A line's LEAST least ranks in order, of all its runs."""
    ranks = F.transform(F.array(_wide(line)), lambda wide: F.transform(_at(wide), lambda at: _rank(wide, at)))[0]
    return F.slice(F.sort_array(F.array_distinct(ranks)), 1, LEAST)


def least_in_common(percent: int) -> int:
    """Of two signatures, the hashes that both have at least; at the least similarity fewer come with a chance of MISSED at most.

    Of the LEAST least hashes of the union each is in both sets with the chance of the similarity, and then in both signatures.
    """
    p, chance, need = percent / 100, 0.0, 0
    while need < LEAST and (chance := chance + comb(LEAST, need) * p**need * (1 - p) ** (LEAST - need)) <= MISSED:
        need += 1
    return need


def may_be_near(a: Column, b: Column, percent: int) -> Column:
    """Whether two signatures have enough in common; shorter ones than LEAST are whole sets, which must have the similarity."""
    return 100 * F.size(F.array_intersect(a, b)) >= F.least(F.lit(100 * least_in_common(percent)), percent * F.greatest(F.size(a), F.size(b)))


def _places(h: Column) -> Column:
    """Of each band of a set its size and where it begins, as one number."""
    n = F.size(h)
    none = F.array().cast("array<int>")
    begins = lambda size: F.sequence(F.lit(size * LEAST), size * LEAST + F.greatest(F.lit(1), F.least(F.lit(BANDS), n - size + 1)) - 1)
    return F.concat(*[F.when((n >= lo) & (F.lit(True) if hi is None else n <= hi), begins(size)).otherwise(none) for size, (lo, hi) in SIZES.items()])


def _key(h: Column, place: Column) -> Column:
    """The key of the band at a place; hashes pass over what is beyond the set or the band."""
    size, at = F.floor(place / LEAST).cast("int"), place % LEAST
    return F.xxhash64(size, F.get(h, at), *[F.when(size > k, F.get(h, at + k)) for k in range(1, max(SIZES))])


def bands_of(h: Column) -> Column:
    """A key for each band of a set: runs of neighbours among its least hashes.

    Of a union of u hashes, at least 4/5 in both sets, some run of r neighbours is in both: r = 2 for u = 5, r = 3 from 6 on.  So sets
    of at most BANDS + 2 lose nothing; larger ones lose a pair that has no such run among their first bands, which tests measure.
    """
    return F.transform(_places(h), lambda place: _key(h, place))


def met_under_one_key(few: DataFrame, all_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n) of the sides of ``dealt_pairs``, with n, bits and all keys of each row, whose parities leave them possible; n is both sizes.

    A pair meets under the least key that both have, from either side.  If that key has no rows here, its bucket was small, so that the pair
    has met, or all its members are linked.
    """
    other = all_.select(*[F.col(c).alias(f"other_{c}") for c in all_.columns])
    same = reduce(Column.__and__, [F.col(k) == F.col(f"other_{k}") for k in ("key", "i", "j")])
    like = may_be_like(F.col("bits"), F.col("other_bits"), F.col("n"), F.col("other_n"), percent)
    first = F.array_min(F.array_intersect("keys", "other_keys")) == F.col("key")
    met = few.join(other, same & (F.col("own") != F.col("other_own")) & like & first)
    return met.select(F.least("id", "other_id").alias("a"), F.greatest("id", "other_id").alias("b"), (F.col("n") + F.col("other_n")).alias("n"))


def line_duplicates(docs: DataFrame, percent: int = 80, pivots: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line: doc_id, row, line_no, keep_doc_id, keep_row, keep_line_no, kept.

    Lines are parts of a text between line feeds, numbered from 0; ``row`` numbers the input rows.  keep_* name the
    line that stays of the component, the least by doc_id (null last), row and line_no.  Blank lines are linked with nothing
    and stay.  A null text counts as an empty one, of one blank line; repeated rows have places of their own; other
    columns are ignored; an empty table gives an empty result.
    """
    return _found(docs, percent, pivots, id_col, text_col, F.monotonically_increasing_id())


def _found(docs: DataFrame, percent: int, pivots: int, id_col: str, text_col: str, row: Column) -> DataFrame:
    """The rows of :func:`line_duplicates`; ``row`` is the number of a row of ``docs``."""
    lines = _lines(docs, text_col, F.col(id_col).cast("long").alias("doc_id"), row.alias("row"))
    places = stash(lines.select("doc_id", "row", "line_no", "h1", "h2"), "places")
    named = _lines(docs, text_col).where(F.col("h1").isNotNull()).select("h1", "h2", "line")

    def texts(ids: DataFrame, name: str) -> DataFrame:
        """(id, line) of the lines told; lines that can't be among them are left out before any exchange."""
        names = stash(told.join(ids, "id").select("id", "h1", "h2"), "names")
        bits = filter_bits(names.count())
        maybe = through_filter(named, named["h1"], stash(key_filter(names, "h1", bits), "filter"), bits)
        return stash(maybe.groupBy("h1", "h2").agg(F.first("line").alias("line")).join(names, ["h1", "h2"]).select("id", "line"), name)

    distinct = stash(signatures(named), "signatures")
    told = distinct.select("id", "h1", "h2")
    least = distinct.where("whole").select("id", "h")
    short = distinct.where("NOT whole").select("id")
    if not short.isEmpty():
        least = least.unionByName(stash(texts(short, "short").select("id", signature(F.col("line")).alias("h")), "whole"))
    # the keys of bands_of; places are rows before they are hashed, so that a key is made once, and outside a lambda
    bands = least.select("id", "h", F.explode_outer(_places(F.col("h"))).alias("place"))
    buckets = shared_buckets(bands.select("id", F.size("h").cast("long").alias("n"), _key(F.col("h"), F.col("place")).alias("key")))
    near = stash(least.join(buckets.select("id").distinct(), "id"), "near")
    side = lambda x: near.select(F.col("id").alias(x), F.col("h").alias(f"{x}_h"))
    held: list[DataFrame] = []

    def wanted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        # (id, line) and (id, n, bits) of the lines that the first pairs ask for, and all of large buckets, which may meet later
        if not held:
            ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(buckets.where(F.col("c") > SMALL_BUCKET).select("id"))
            lines = stash(texts(ids.distinct(), "texts"), "wanted")
            held.extend([lines, stash(parities(lines), "parities")])
        return held[0], held[1]

    def compared(pairs: DataFrame) -> DataFrame:
        # pairs (a, b, n) whose parities leave them possible, n being both sizes together
        lines, _ = wanted(pairs)
        text = lambda x: lines.join(pairs.select(F.col(x).alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias(x), F.col("line").alias(f"{x}_line"))
        # 100 both >= percent (an + bn - both)
        like = (100 + percent) * F.size(F.array_intersect(_runs(F.col("a_line")), _runs(F.col("b_line")))) >= percent * F.col("n")
        return pairs.join(text("a"), "a").join(text("b"), "b").where(like).select("a", "b")

    def signed(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").where(may_be_near(F.col("a_h"), F.col("b_h"), percent)).drop("a_h", "b_h")

    def confirm(pairs: DataFrame) -> DataFrame:
        likely = stash(signed(pairs), "signed")
        _, told = wanted(likely)
        own = lambda x: told.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
        both = likely.join(own("a"), "a").join(own("b"), "b")
        left = both.where(may_be_like(F.col("a_bits"), F.col("b_bits"), F.col("a_n"), F.col("b_n"), percent))
        return compared(stash(left.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n")), "likely"))

    def confirm_blocks(rows: DataFrame) -> DataFrame:
        _, told = wanted(rows)
        ids = near.join(rows.select("id").distinct(), "id").select("id", bands_of(F.col("h")).alias("keys"))
        members = stash(ids.join(told, "id"), "members")
        few, all_ = (df.join(members, "id") for df in dealt_pairs(rows.drop("n")))
        pairs = met_under_one_key(few, all_, percent)
        return compared(stash(signed(stash(pairs.distinct(), "pairs")), "likely"))

    owner = linked_components(buckets, confirm, confirm_blocks, percent, pivots)
    ids = told
    ids = ids.withColumn("component", F.col("id")) if owner is None else ids.join(owner, ids["id"] == owner["node"], "left").select("id", "h1", "h2", F.coalesce("component", "id").alias("component"))
    ids = stash(ids.select("h1", "h2", "component"), "components")
    at = stash(places.join(ids, ["h1", "h2"], "left"), "told")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "line_no")
    firsts = at.where("component IS NOT NULL").groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("component", "first")
    out = at.join(firsts, "component", "left")
    keep = lambda c: F.when(F.col("first").isNull(), F.col(c)).otherwise(F.col("first")[c])
    kept = F.col("first").isNull() | ((F.col("first.row") == F.col("row")) & (F.col("first.line_no") == F.col("line_no")))
    return out.select("doc_id", "row", F.col("line_no").cast("long"), keep("doc_id").alias("keep_doc_id"), keep("row").alias("keep_row"), keep("line_no").cast("long").alias("keep_line_no"), kept.alias("kept"))


def without_line_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): each text with only its lines that stay. A null text becomes an empty one."""
    number = key_name(docs)
    keyed = stash(docs.withColumn(number, F.monotonically_increasing_id()), "keyed")  # numbered once
    gone = stash(_found(keyed, percent, 3, id_col, text_col, F.col(number)).where("NOT kept"), "gone")
    drops = gone.groupBy("row").agg(F.collect_set("line_no").alias("drops"))
    rows = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(number).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("drops"), i.cast("long")))
    return rows.join(drops, "row", "left").select("doc_id", F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))
