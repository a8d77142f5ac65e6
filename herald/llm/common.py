"""What several operators share: word splitting, tables, checkpoints, connected components."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Keys of repeated rows that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Copies of a row that are numbered in one array.
TILE = 1 << 16
#: Bounds of an Arrow batch.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the checkpoint folder that the session names. Where it names none and all runs on one machine, one beside the
    warehouse; on a cluster that is an error, as the warehouse's default is the driver's own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: survives lost executors and cuts the lineage."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed(documents: DataFrame, *used: str) -> DataFrame:
    """``row`` (a struct of all columns), ``row_key`` (64 bits) and the ``used`` columns: null and repeated ids do not
    matter, names in the documents clash with none, and keys are the same in every reading.

    The key is a hash of all columns. Rows equal in all of them can stand for each other: they are counted, and the
    key takes in a number within the equal ones. Of 10**9 rows two share a key with probability 0.03. Maps and variants,
    which Spark does not hash, are hashed as JSON.
    """
    plain = {f.name: not re.search(r"\b(map<|variant\b)", f.dataType.simpleString()) for f in documents.schema}
    columns = [F.col("row").getField(c) if plain[c] else F.to_json(F.col("row").getField(c)) for c in documents.columns]
    hashed = documents.select(F.struct("*").alias("row")).withColumn("row_key", F.xxhash64(*columns, *[c.isNull() for c in columns]))
    shown = ["row", "row_key", *[F.col("row").getField(c).alias(c) for c in used]]
    repeated = cut(hashed.groupBy("row_key").count().where("count > 1").select("row_key"))
    many = repeated.count()
    if not many:
        return hashed.select(*shown)
    those = F.broadcast(repeated) if many <= BROADCAST_KEYS else repeated
    whole = F.col("row") if all(plain.values()) else F.to_json("row")
    copies = hashed.join(those, "row_key", "left_semi").groupBy("row_key", whole.alias("_same")).agg(F.first("row").alias("row"), F.count("*").alias("count"))
    # counted out by tiles, so that no array is longer than one, however often a row repeats; the cut is between the two
    # explosions, as Catalyst loses fields of the struct that it reads through both
    tiled = cut(copies.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / TILE)))))
    numbers = F.sequence(F.col("tile") * TILE + 1, F.least("count", (F.col("tile") + 1) * TILE))
    numbered = tiled.withColumn("copy", F.explode(numbers)).withColumn("row_key", F.xxhash64("row_key", "copy"))
    return hashed.join(those, "row_key", "left_anti").unionByName(numbered.select("row", "row_key")).select(*shown)


def unboxed(rows: DataFrame, documents: DataFrame, **changed: Column) -> DataFrame:
    """The columns of the documents out of ``row``, some of them changed."""
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def place_among(value: Column, edges: list[int]) -> Column:
    """How many of the ascending edges stand at or below a value, by bisection in one constant array."""
    if not edges:
        return F.lit(0)
    held = F.from_json(F.lit("[" + ",".join(map(str, edges)) + "]"), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    begin = F.struct(value.cast("bigint").alias("value"), F.lit(0).alias("at"))
    jump = lambda acc, step: F.when((F.get(held, acc["at"] + step - 1) <= acc["value"]).eqNullSafe(True), acc["at"] + step).otherwise(acc["at"])
    return F.aggregate(steps, begin, lambda acc, step: F.struct(acc["value"].alias("value"), jump(acc, step).alias("at")), lambda acc: acc["at"])


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a worker holds a few MB of texts (or one text). The same for all callers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as make it differ from the columns of a DataFrame."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def connected_components(edges: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Distributed union-find by contraction. edges: (a, b) -> rows (id, component), component the smallest id reachable.

    Each round every vertex moves to the neighbour (or itself) that comes first in a hashed order; edges are rewritten
    to those and loops dropped. The hashed order makes the number of edges fall geometrically whatever the shape (a
    chain in id order included). Hubs are harmless: the minimum is partially aggregated before its shuffle, and the
    joins have one row for each vertex on one side. Only the number of edges left comes to the driver.
    Nulls in a or b are ignored; vertices that stand in no edge, or only in loops, have no row.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast(id_type), F.col("b").cast(id_type)).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels, left = vertices.select("id", F.col("id").alias("at")), edges
    while True:
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        both = left.union(left.select("b", "a"))
        moves = cut(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("of"), F.least(order("a"), F.col("m"))["v"].alias("to")))
        labels = cut(labels.join(moves, labels["at"] == moves["of"], "left").select("id", F.coalesce("to", "at").alias("at")))
        ends = left.join(moves.withColumnRenamed("to", "x"), F.col("a") == F.col("of")).drop("of")
        left = cut(ends.join(moves.withColumnRenamed("to", "y"), F.col("b") == F.col("of")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if left.isEmpty():
            break
    smallest = labels.groupBy("at").agg(F.min("id").alias("component"))
    return cut(labels.join(smallest, "at").select("id", "component"))
