"""Helpers that the corpus operators share: written tables, id filters, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []

#: A word is a run of anything but these six ASCII blanks.
BLANKS = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset and the session is local,
    a temporary folder stands in for it; elsewhere its absence is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="orogena-"))
    return _OWN_DIR[0]


#: Rows of whole texts that a Python task holds at a time.
BATCH_ROWS = 512


def in_small_batches(docs: DataFrame) -> None:
    """Have the session send rows to Python tasks in batches that hold whole texts in bounded memory.

    Spark's default of 10,000 rows, twice over for pairs of texts, is tens to hundreds of megabytes on both sides.  A
    session that already asks for fewer rows keeps its own number.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orogena/{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_name(df: DataFrame) -> str:
    """A name for a row key that no column of ``df`` has, whatever its case."""
    name, taken = "__row", {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def told_apart(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The rows of ``docs`` and the name of a long column that tells them apart.

    That is the id where ids are longs, none null and no two alike; the rows are ``docs`` itself then and are not written again.
    Otherwise the rows are numbered, and a table of them is written so that the numbers hold.
    """
    if docs.select(id_col).dtypes[0][1] == "bigint" and docs.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__c")).where("__id IS NULL OR __c > 1").isEmpty():
        return docs, id_col
    row = key_name(docs)
    return stash(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def filter_bits(n: int) -> int:
    """Bits, as a power of two, of a filter for ``n`` keys: 16 to 32 a key, never above 2^25.

    The bound holds the broadcast table to 2^19 words.  Beyond some millions of keys the filter
    lets more rows through; what follows it is a join, so that costs time and never rows.
    """
    return max(12, min(25, max(1, n).bit_length() + 4))


def key_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap over hashed keys: one row (word, mask) for each 64-bit word with a bit set."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    return (
        keys.select(F.shiftright(slot, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("__bit"))
        .groupBy("__word")
        .agg(F.bit_or("__bit").alias("__mask"))
    )


def _looked_up(df: DataFrame, key: Column, filt: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    found = df.join(F.broadcast(filt), F.shiftright(slot, 6) == filt["__word"], "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    return found, F.coalesce(filt["__mask"], F.lit(0).cast("long")).bitwiseAND(bit) != 0


def through_filter(df: DataFrame, key: Column, filt: DataFrame, bits: int, within: bool = True) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter, or else those that can't; the filter has at most 2^bits / 64 rows."""
    found, may = _looked_up(df, key, filt, bits)
    return found.where(may if within else ~may).select(*[df[c] for c in df.columns])


def without(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't among those gone; nulls are equal.

    Only rows that the filter over the keys gone can't rule out are shuffled to be compared; others pass as they are.
    """
    keys = stash(gone.select(F.col(gone_key).alias("__gone")).distinct(), "gone")
    bits = filter_bits(keys.count())
    found, may = _looked_up(df, df[key], stash(key_filter(keys, "__gone", bits), "filter"), bits)
    cols = [df[c] for c in df.columns]
    maybe = found.where(may).select(*cols)
    return found.where(~may).select(*cols).unionByName(maybe.join(keys, maybe[key].eqNullSafe(keys["__gone"]), "left_anti"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as rows (node, component), component being the smallest node reached.

    Each round takes the smallest label among a node's neighbours and then follows that label's own
    label, so that stars settle at once and chains in a logarithmic number of rounds.  A round's labels
    are a written table.  Nodes without an edge don't appear.
    """
    both = stash(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.explode(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))).alias("e"))
        .select("e.x", "e.y")
        .distinct(),
        "edges",
    )
    labels = stash(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        onto = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        # a label is a node of the same component, so that its own label can only be smaller
        after = stash(step.join(onto, "to").select("node", "was", F.least("to", "jump").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where(F.col("was") != F.col("component")).isEmpty():
            return labels


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows (id, n, key, c) whose key another row has too, c rows having it.

    Keys that occur once, nearly all as a rule, are left out by a bitmap before the join.
    """
    shared = stash(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "keys")
    bits = filter_bits(shared.count())
    maybe = through_filter(rows, rows["key"], stash(key_filter(shared, "key", bits), "filter"), bits)
    return stash(maybe.join(shared, "key"), "shared")


#: Members of a bucket in a block, where two blocks meet in a task.
BLOCK_ROWS = 256


def dealt_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, id, own) of buckets as two sides (key, i, j, id, own) that meet block by block on (key, i, j).

    Of a bucket, the members outside its largest component are the first side and all members the second.
    """
    sizes = rows.groupBy("key", "own").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("own", F.struct("c", "own")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS)).cast("int")
    told = rows.join(sizes, "key").withColumn("ni", parts(F.col("all") - F.col("most"))).withColumn("nj", parts(F.col("all")))
    own_i, own_j = F.pmod(F.xxhash64("id", F.lit(1)), F.col("ni")).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("nj")).cast("int")
    few = told.where("own <> main").select("key", own_i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "id", "own")
    all_ = told.where(F.col("all") > F.col("most")).select("key", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), own_j.alias("j"), "id", "own")
    return few, all_


#: Members of a bucket that meet pair by pair at most; those of larger ones meet pivots and then block by block.
SMALL_BUCKET = 8


def linked_components(
    buckets: DataFrame, confirm: Callable[[DataFrame], DataFrame], confirm_blocks: Callable[[DataFrame], DataFrame], percent: int, pivots: int
) -> DataFrame | None:
    """Components (node, component) under the links that ``confirm`` finds among rows (id, n, key, c) that share a key.

    In a small bucket all members meet.  A large one has a pivot a round, which meets the members of other components;
    after the rounds, members of a bucket that are still in different components all meet block by block, rows
    (key, id, n, own) being given to ``confirm_blocks``, so that no link is lost.  No two meet whose sizes n alone rule out
    the similarity.  None if there is no link.
    """
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  an intersection is no larger than either set

    def met(rows: DataFrame, other: DataFrame, meet: Column) -> DataFrame:
        return rows.join(other, "key").where(meet & fits(F.col("n"), F.col("bn"))).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))

    def pivot(rows: DataFrame, turn: int) -> DataFrame:
        order = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
        first = rows.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("id"), F.col("n"), F.col("own"))).alias("v"))
        return stash(first.select("key", F.col("v.id").alias("b"), F.col("v.n").alias("bn"), F.col("v.own").alias("bown")), "pivots")

    small = buckets.where(F.col("c") <= SMALL_BUCKET).select("key", "id", "n")
    large = buckets.where(F.col("c") > SMALL_BUCKET).select("key", "id", "n", F.col("id").alias("own"))
    pairs = met(small, small.select("key", F.col("id").alias("b"), F.col("n").alias("bn")), F.col("id") < F.col("b"))
    tried = stash(pairs.unionByName(met(large, pivot(large, 0), F.col("id") != F.col("b"))).distinct(), "pairs")
    links = stash(confirm(tried), "links")
    owner = components(links)
    for turn in range(1, pivots + 1):
        now = large.join(owner, large["id"] == owner["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("own"))
        apart = stash(now.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("key"), "apart")
        bits = filter_bits(apart.count())
        large = stash(through_filter(now, now["key"], stash(key_filter(apart, "key", bits), "filter"), bits), "large")
        if large.isEmpty():
            break
        if turn < pivots:
            more = stash(met(large, pivot(large, turn), F.col("own") != F.col("bown")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            tried, found = tried.unionByName(more), stash(confirm(more), "links")
        else:
            found = stash(confirm_blocks(large), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            owner = components(links)
    return None if links.isEmpty() else owner
