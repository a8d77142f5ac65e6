"""Operator 9: mixing sources to target weights by index-joined blocks (DataFrame functions only).

The words of a source, in ascending doc_id, form one stream that is cut into blocks of ``block`` words. The mix has a
slot for each block that the targets ask for, and ``shard`` slots make an output shard. Which source a slot goes to is
drawn by a keyed hash of its number, with the sources' shares as probabilities: the counts of a shard are a multinomial
draw. Over the whole mix such draws miss the targets by about the root of the counts, which a small source would feel;
so they are settled: what a source has drawn beyond its slots is given up, evenly along its draws, and goes to the
sources that lack as much. Totals are then exact.

A source's slots, numbered over the shards, run through one pseudorandom permutation of its blocks after another, and
blocks are joined by that index. No block is used more than ``most`` times, so no document gives more than ``most``
times its words. A permutation is a keyed Feistel network on a grid of nearly as many cells as there are blocks; a cell
beyond the last block is passed through it again. There are fewer such cells than the grid has rows, so for up to 4096
blocks ``WALK`` passes always end; for more, one in 64 or fewer needs a pass, so none needs WALK of them.

Draws and keys are MD5 of texts, so reruns agree and SQL can state them. What is held at once: one row per source (on
the driver too), one per shard and source in a window, and arrays of ``shard`` numbers at most.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herald.llm.common import WORD_CLASS, cut, place_among, table

WEIGHTS = (5, 2, 1)
BLOCK = 64
#: Slots of an output shard: about a million words.
SHARD = 1 << 14
MOST = 3
WALK = 64
ROUNDS = 4
#: Draws that a task makes.
DRAWS = 1 << 20


def sized(documents: DataFrame, *carried: str) -> DataFrame:
    """doc_id, carried columns, source, size: the number of words; a null text has none."""
    return documents.select("doc_id", *carried, "source", F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS + "+")), F.lit(0)).cast("bigint").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, rank, source_size, weight, target.

    Targets share the sum of all sizes by weight; one that would pass ``most`` times its source's size stops there and
    the excess is shared again by weight. The level (words per unit of weight) at which that ends comes from prefix
    sums over the sources in the order in which they stop. These windows hold one row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    every = W.partitionBy()
    stops = ranked.withColumn("weight", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    earlier = W.orderBy("stop", "rank").rowsBetween(W.unboundedPreceding, -1)
    words = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    level = words / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    # the first source in this order that need not stop sets the level of all that follow it
    levels = stops.withColumn("level", level).withColumn("open", F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level")))
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.min("open").over(every)["level"] * F.col("weight"))
    return levels.select("source", "rank", "source_size", "weight", F.round(target, 6).alias("target"))


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def drawn(digits: int, *parts: Column | str) -> Column:
    """A pseudorandom number of that many hexadecimal digits, keyed by the parts."""
    key = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("bigint")


def permuted(indices: DataFrame, index: str, blocks: str, *key: str) -> DataFrame:
    """The rows and ``place``: where the permutation of 0 to ``blocks`` - 1 with that key takes ``index``."""
    n, rows, width = F.col(blocks), F.col("_rows"), F.col("_width")
    shaped = indices.withColumn("_rows", F.ceil(F.sqrt(n)).cast("bigint")).withColumn("_width", _whole(n + rows - 1, rows))
    keyed = [F.col(k) for k in key]
    left_half = lambda k, left, right: (left + drawn(8, str(k), right, *keyed)) % rows
    right_half = lambda k, left, right: (right + drawn(8, str(k), left, *keyed)) % width

    def again(x: Column) -> Column:
        left, right = _whole(x, width), x % width
        for k in range(0, ROUNDS, 2):
            left = left_half(k, left, right)
            right = right_half(k + 1, left, right)
        return left * width + right

    # the first pass in columns of its own, so that no expression is repeated; few rows need another
    passed = shaped.withColumns({"_left": _whole(F.col(index), width), "_right": F.col(index) % width})
    for k in range(0, ROUNDS, 2):
        passed = passed.withColumn("_left", left_half(k, F.col("_left"), F.col("_right"))).withColumn("_right", right_half(k + 1, F.col("_left"), F.col("_right")))
    first = F.col("_left") * width + F.col("_right")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_first"), lambda at, _: F.when(at < n, at).otherwise(again(at)))
    return passed.withColumn("_first", first).withColumn("place", F.when(F.col("_first") < n, F.col("_first")).otherwise(walked)).drop("_rows", "_width", "_left", "_right", "_first")


def shard_counts(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """rank, blocks, shard, before, n: how many slots of a shard go to each source, and how many it has in earlier shards."""
    spark = sources.sparkSession
    # the last block of a source may hold fewer words, so slots are asked for by the mean words of its blocks
    asked = sources.where("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")).select("rank", "blocks", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"), F.col("blocks") * most).alias("slots"))
    wanted = asked.orderBy("rank").collect()  # one row per source
    edges = list(accumulate(r["slots"] for r in wanted))
    total = edges[-1] if edges else 0
    each = F.from_json(F.lit(json.dumps([r.asDict() for r in wanted])), "array<struct<rank:int,blocks:bigint,slots:bigint>>")
    ids = spark.range(0, total, 1, total // DRAWS + 1)
    source = F.get(each, place_among(drawn(12, "slot", F.col("id")) % max(total, 1), edges[:-1]))
    draws = ids.select(F.expr(f"id div {shard}").alias("shard"), source.alias("source"), F.lit(1).alias("drawn"))
    grid = spark.range(0, -(-total // shard)).select(F.col("id").alias("shard"), F.explode(each).alias("source"), F.lit(0).alias("drawn"))
    filled = draws.union(grid).select("shard", "source.*", "drawn").groupBy("shard", "rank", "blocks", "slots").agg(F.sum("drawn").alias("drawn"))
    in_order, of_source, of_shard = W.partitionBy("rank").orderBy("shard"), W.partitionBy("rank"), W.partitionBy("shard")
    upto = filled.withColumn("upto", F.sum("drawn").over(in_order.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("drawn").over(of_source))
    # given up: a source's surplus, in proportion to its draws so far
    surplus, lack = F.greatest(F.col("all") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("all"), F.lit(0))
    share = lambda draws: F.coalesce(_whole(draws * surplus, F.nullif("all", F.lit(0).cast("bigint"))), F.lit(0))  # noqa: E731  a small source may have no draw
    given = upto.withColumns({"low": share(F.col("upto") - F.col("drawn")), "high": share(F.col("upto")), "lack": lack})
    # taken up: those of all sources, in the order of the shards, by the sources that lack some, in their order
    freed = given.withColumns({"freed_low": F.sum("low").over(of_shard), "freed_high": F.sum("high").over(of_shard), "lack_high": F.sum("lack").over(of_shard.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))})
    got = F.greatest(F.least("freed_high", "lack_high") - F.greatest(F.col("freed_low"), F.col("lack_high") - F.col("lack")), F.lit(0))
    settled = freed.withColumn("n", F.col("drawn") - (F.col("high") - F.col("low")) + got)
    return settled.withColumn("before", F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).where("n > 0").select("rank", "blocks", "shard", "before", "n")


def uses(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """rank, shard, slot, block: every slot of the mix and the block that fills it."""
    slots = shard_counts(sources, block, shard, most).withColumn("slot", F.explode(F.sequence("before", F.col("before") + F.col("n") - 1)))
    turned = slots.withColumns({"turn": F.expr("slot div blocks"), "index": F.expr("slot % blocks")})
    return permuted(turned, "index", "blocks", "rank", "turn").select("rank", "shard", "slot", F.col("place").alias("block"))


def mix(documents: DataFrame, block: int = BLOCK, shard: int = SHARD, weights=WEIGHTS, most: int = MOST, row: str | None = None) -> dict[str, DataFrame]:
    """``documents``: doc_id, source, size, source_size, target, rank, start (of its words in the source's stream);
    ``pieces``: rank, block, doc_id, start, words (of a document in a block); ``slots``: rank, shard, slot, block.

    ``row`` names a column that tells rows of one doc_id apart; documents and pieces then have it too.
    Starts are sums over rows in the order of (source, doc_id): rows are dealt by ranges of that order, so a range is as
    large as any other, whatever the sources; the sums of the ranges are added up first, then the rows of each.
    """
    carried = [row] if row else []
    sizes = cut(sized(documents, *carried))
    sources = cut(targets(sizes, weights, most))
    ranked = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", *carried, "d.source", "size", "source_size", "target", "rank")
    order = ["doc_id", "size", *carried]
    placed = cut(ranked.repartitionByRange("rank", *order).withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    base = sums.select("rank", "part", F.coalesce(F.sum("words").over(W.partitionBy("rank").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = F.sum("size").over(W.partitionBy("rank", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    placed = placed.withColumn("upto", upto).join(base, ["rank", "part"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("part", "base", "upto")
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
        .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block))
        .select("rank", "block", "doc_id", *carried, "start", "words")
    )
    return {"documents": placed, "pieces": pieces, "slots": uses(sources, block, shard, most)}


def taken(documents: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; one row per input row.

    A null text has size 0 and nothing is taken; null sources are one source, the last; rows that share a doc_id (null
    ids share one, the first) keep their own places, ordered by size; a long text is cut into as many blocks as it
    needs; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    made = mix(documents, **how)
    times = made["slots"].groupBy("rank", "block").agg(F.count("*").alias("times"))
    # merged, not broadcast: both sides grow with the corpus
    used = made["pieces"].join(times.hint("merge"), ["rank", "block"])
    got = used.groupBy("rank", "doc_id", "start").agg(F.sum(F.col("words") * F.col("times")).cast("bigint").alias("taken"))
    same = (F.col("d.rank") == F.col("g.rank")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.start") == F.col("g.start")) & (F.col("d.size") > 0)
    return made["documents"].alias("d").join(got.alias("g").hint("merge"), same, "left").select("d.doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).drop("source")


def _drawn_sql(digits: int, text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, {digits}) as bigint)"


def _once_sql(x: str) -> str:
    left, right = f"({x}) // width", f"({x}) % width"
    for k in range(0, ROUNDS, 2):
        left = f"({left} + {_drawn_sql(8, f"'{k}:' || ({right}) || ':' || rank || ':' || turn")}) % grid"
        right = f"({right} + {_drawn_sql(8, f"'{k + 1}:' || ({left}) || ':' || rank || ':' || turn")}) % width"
    return f"({left}) * width + ({right})"


SQL = f"""
with recursive sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from per),
stops as (select *, ([5, 2, 1])[rank % 3 + 1] as weight, 3.0::double * source_size / ([5, 2, 1])[rank % 3 + 1] as stop from ranked),
levels as (select *, cast(sum(source_size) over () - 3 * coalesce(sum(source_size) over e, 0) as double) / cast(sum(weight) over () - coalesce(sum(weight) over e, 0) as double) as level
  from stops window e as (order by stop, rank rows between unbounded preceding and 1 preceding)),
opened as (select level from levels where level <= stop order by stop, rank limit 1),
sources as (select source, rank, source_size, round(least(3.0::double * source_size, (select level from opened) * weight), 6) as target from levels),
asked as (select *, least(cast(round(target * blocks / source_size) as bigint), blocks * 3) as slots from (select *, (source_size + {BLOCK - 1}) // {BLOCK} as blocks from sources where source_size > 0)),
edges as (select rank, blocks, slots, cast(sum(slots) over (order by rank rows unbounded preceding) as bigint) as edge from asked),
totals as (select coalesce(max(edge), 0) as total from edges),
ids as (select unnest(range(total)) as id, total from totals),
points as (select id // {SHARD} as shard, {_drawn_sql(12, "'slot:' || id")} % total as point from ids),
draws as (select shard, rank, count(*) as n from points p asof join edges e on p.point < e.edge group by all),
grid as (select s.shard, e.* from (select distinct shard from points) s, edges e),
filled as (select g.*, coalesce(d.n, 0) as drawn from grid g left join draws d on g.shard = d.shard and g.rank = d.rank),
upto as (select *, cast(sum(drawn) over (partition by rank order by shard rows unbounded preceding) as bigint) as upto, cast(sum(drawn) over (partition by rank) as bigint) as every from filled),
given as (select *, case when every > 0 then (upto - drawn) * greatest(every - slots, 0) // every else 0 end as low, case when every > 0 then upto * greatest(every - slots, 0) // every else 0 end as high, greatest(slots - every, 0) as lack from upto),
freed as (select *, cast(sum(low) over (partition by shard) as bigint) as freed_low, cast(sum(high) over (partition by shard) as bigint) as freed_high, cast(sum(lack) over (partition by shard order by rank rows unbounded preceding) as bigint) as lack_high from given),
settled as (select *, drawn - (high - low) + greatest(least(freed_high, lack_high) - greatest(freed_low, lack_high - lack), 0) as n from freed),
firsts as (select *, cast(sum(n) over (partition by rank order by shard rows unbounded preceding) as bigint) - n as before from settled),
slots as (select rank, blocks, unnest(range(before, before + n)) as slot from firsts where n > 0),
turned as (select rank, blocks, slot % blocks as x, slot // blocks as turn, cast(ceil(sqrt(blocks)) as bigint) as grid from slots),
shaped as (select *, (blocks + grid - 1) // grid as width from turned),
walk as (select rank, blocks, turn, grid, width, {_once_sql('x')} as x from shaped
  union all select rank, blocks, turn, grid, width, {_once_sql('x')} from walk where x >= blocks),
times as (select rank, x as block, count(*) as times from walk where x < blocks group by all),
placed as (select d.*, s.rank, s.source_size, s.target, cast(sum(size) over (partition by rank order by doc_id rows unbounded preceding) as bigint) - size as start from sized d join sources s on d.source is not distinct from s.source),
pieces as (select *, least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}) as words from (select *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) as block from placed where size > 0)),
got as (select doc_id, cast(sum(words * times) as bigint) as taken from pieces join times using (rank, block) group by doc_id)
select p.doc_id, p.size, p.source_size, p.target, coalesce(g.taken, 0) as taken from placed p left join got g on p.doc_id = g.doc_id
"""
