"""Mixing sources to target weights by hash thresholds (operator 4, DataFrame functions only).

Each document has a fixed hash. Per source, sizes are summed by the hash's leading bits; the bucket in
which the budget ends is refined by the next bits, alone, until it holds one document. A document is in
the mix if its hash lies below its source's threshold: a filter, no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_size, numbered, small, stage, table

#: Fifteen hexadecimal digits of an MD5.
HASH_BITS = 60
LEVEL_BITS = 10
SEED = "mix-1"
#: The weights that sources take in turn, and the most often that a source may be repeated.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 2
BUDGET = 1.5
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with ``target``: the budget by weight, no source above ``most`` times its size.

    Sharing out again what the full sources leave ends where every other source has one common amount per
    unit of weight; in order of ``most * size / weight`` that amount follows from running sums. Sources may be
    many (web hosts): they are numbered and summed like any large group, and only totals reach the driver.
    """
    nth = numbered(sizes, [], ["source"]).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    rated = stage(nth.withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap").cast("double") / F.col("weight")), "mix-sources")
    in_all, weight = (x or 0 for x in rated.agg(F.sum("source_size"), F.sum("weight")).first())
    upto = by_size(rated, [], ["fill", "nth"], lambda some, add: add(some, {"caps": F.col("cap"), "weighed": F.col("weight")}))
    level = (F.lit(budget * in_all) - (F.col("caps") - F.col("cap"))) / (F.lit(weight) - (F.col("weighed") - F.col("weight")))
    # The first source, in that order, which does not fill up sets the amount for all after it.
    first = upto.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("fill", "nth", "level"))).first()[0]
    share = F.col("cap").cast("double") if first is None else F.least(F.col("cap").cast("double"), F.lit(first["level"]) * F.col("weight"))
    return rated.select("source", "source_size", share.alias("target"))


def refine(rows: DataFrame, goals: DataFrame, level: int) -> DataFrame:
    """One level: for each source of ``goals`` (source, budget, done) the boundary bucket among ``rows`` (source, size, h).

    ``done`` is the size below the buckets seen. Returns (source, budget, done, lo, hi, one, at, rows, size): the
    size below the boundary bucket, its hash range, whether it holds one hash alone, its least hash, rows and size.
    """
    shift = HASH_BITS - LEVEL_BITS * (level + 1)
    hist = rows.groupBy("source", F.shiftrightunsigned("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    cum = hist.alias("b").join(small(goals).alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "bucket", "size", "rows", "h0", "h1", "budget", (F.col("done") + F.sum("size").over(W.partitionBy(F.col("b.source")).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).alias("upto"))
    over = cum.where(F.col("upto") > F.col("budget")).withColumn("nth", F.row_number().over(W.partitionBy("source").orderBy("bucket"))).where("nth = 1")
    return over.select("source", "budget", (F.col("upto") - F.col("size")).alias("done"), F.shiftleft("bucket", shift).alias("lo"), F.shiftleft(F.col("bucket") + 1, shift).alias("hi"), (F.col("h0") == F.col("h1")).alias("one"), F.col("h0").alias("at"), "rows", "size")


def limits(digest: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(source, source_size, target, whole, below, rows, take) of staged rows (source, size, h).

    ``whole`` is how often all of a source is taken; rows whose hash is less than ``below`` are taken once more,
    and of those at ``below``, of which there are ``rows``, as many, ``take``, as bring the source nearest its target.
    """
    sizes = digest.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stage(targets(sizes, weights, budget).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")), "mix-goals")
    open_ = stage(goals.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("done")), "mix-open")

    found, left = None, digest.select("source", "size", "h")
    for level in range(HASH_BITS // LEVEL_BITS):
        edge = stage(refine(left, open_, level), f"mix-edge{level}")
        # Rows of one hash are alike, so each is a share of their size.
        take = F.ceil((F.col("budget") - F.col("done")) / (F.col("size") / F.col("rows")) - 0.5)
        bound = edge.where("one").select("source", F.col("at").alias("below"), "rows", take.alias("take"))
        found = bound if found is None else found.unionByName(bound)
        open_ = edge.where(~F.col("one"))
        if not open_.take(1):
            break
        near = left.alias("r").join(small(open_).alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.h") >= F.col("e.lo")) & (F.col("r.h") < F.col("e.hi"))).select("r.source", "r.size", "r.h")
        left, open_ = stage(near, f"mix-left{level}"), open_.select("source", "budget", "done")

    return stage(goals.alias("g").join(found.alias("f"), F.col("g.source").eqNullSafe(F.col("f.source")), "left").select("g.source", "source_size", "target", "whole", F.coalesce("below", F.lit(-1).cast("long")).alias("below"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce("take", F.lit(0).cast("long")).alias("take")), "mix-limits")


def hashed(row_id: Column, text: Column) -> Column:
    """60 bits of a row's MD5, of its id and its text: rows of one id or of one text still go apart."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (row_id, text)]
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED} "), parts[0], F.lit(" "), parts[1])), 1, HASH_BITS // 4), 16, 10).cast("long")


def with_copies(rows: DataFrame, bounds: DataFrame, content: Column) -> DataFrame:
    """``rows`` (source, h and more) with source_size, target and ``copies``: how often the mix takes each, 0 to 2 times.

    Where the boundary falls among rows alike in id and text, these are numbered by a hash of their whole ``content``, a string, and so
    many are taken as are due: the same ones in any order and partitioning, and in a task that runs again.
    """
    both = rows.alias("d").join(small(bounds).alias("l"), F.col("d.source").eqNullSafe(F.col("l.source"))).select("d.*", "l.source_size", "l.target", "l.whole", "l.below", "l.rows", "l.take")
    at, out = F.col("h") == F.col("below"), [*rows.columns, "source_size", "target"]

    def counted(some: DataFrame, more: Column) -> DataFrame:
        return some.select(*out, F.least(F.col("whole") + more.cast("int"), F.lit(MAX_REPEATS)).alias("copies"))

    if not bounds.where("rows > 1").take(1):
        return counted(both, (F.col("h") < F.col("below")) | (at & (F.col("take") > 0)))
    tied = at & (F.col("rows") > 1)
    alike = stage(both.where(tied).withColumns({"tie": F.xxhash64(content), "row": F.monotonically_increasing_id()}), "mix-alike")
    alike = numbered(alike, ["source"], ["tie", "row"], "mix_nth")
    return counted(both.where(~tied), (F.col("h") < F.col("below")) | (at & (F.col("take") > 0))).unionByName(counted(alike, F.col("mix_nth") <= F.col("take")))


def mix(rows: DataFrame, source: Column, row_id: Column, text: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """Each row's (doc_id, source, size, source_size, target, copies): how often the mix takes it, 0 to 2 times.

    Whole copies of a source come first; the rest of its target is met by the rows below the threshold.
    Null sources form one source, after all others; null ids and texts hash like empty ones; of rows alike in id
    and text as many are taken as are due, so a source comes within half a row of its target; an empty table gives
    an empty result. The same rows give the same mix in any order and partitioning.
    """
    digest = stage(rows.select(row_id.alias("doc_id"), source.alias("source"), size.cast("long").alias("size"), hashed(row_id, text).alias("h")), "mix-digest")
    return with_copies(digest, limits(digest, weights, budget), F.col("doc_id").cast("string")).drop("h")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any more), each as often as the mix takes it.

    Nulls and rows alike count as in ``mix``; of rows that differ only in further columns the same are taken in any order and partitioning.
    """
    own = docs.select(F.struct("*").alias("kept"), "source", hashed(F.col("doc_id"), F.col("text")).alias("h"))
    digest = stage(docs.select("source", words(F.col("text")).alias("size"), hashed(F.col("doc_id"), F.col("text")).alias("h")), "mix-digest")
    taken = with_copies(own, limits(digest, weights, budget), F.to_json("kept"))
    return taken.select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("kept.*")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed at 5 : 2 : 1 to 150 % of their words; a null text has size 0."""
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, F.col("source"), F.col("doc_id"), F.col("text"), words(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


#: Sorts where the operator refines histograms: all rows of a source in order of their hash, with running sums.
OP4_SQL = f"""
with recursive rows_ as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
    ('0x' || substr(md5('{SEED} ' || coalesce(doc_id::varchar, '') || ' ' || coalesce(text, '')), 1, {HASH_BITS // 4}))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, list_extract({list(WEIGHTS)}, ((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int)::bigint as weight
  from rows_ group by source),
-- Share, fill the sources that have too much, share again, until none has.
shared(step, source, source_size, weight, target, is_full) as (
  select 0, source, source_size, weight, {BUDGET}::double * sum(source_size) over () / sum(weight) over () * weight, false from sources
  union all
  select step + 1, source, source_size, weight,
    case when is_full or target > {MAX_REPEATS} * source_size then ({MAX_REPEATS} * source_size)::double
      else ({BUDGET}::double * sum(source_size) over () - sum(case when is_full or target > {MAX_REPEATS} * source_size then {MAX_REPEATS} * source_size else 0 end) over ())
        / sum(case when is_full or target > {MAX_REPEATS} * source_size then 0 else weight end) over () * weight end,
    is_full or target > {MAX_REPEATS} * source_size
  from shared where step < (select count(*) from sources)),
goals as (
  select source, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end as whole
  from shared where step = (select count(*) from sources)),
upto as (
  select doc_id, r.source, size, h, source_size, target, whole, target - whole * source_size as budget, row_number() over (partition by r.source, h) as nth,
    (sum(size) over (partition by r.source order by h))::double as upto, (sum(size) over (partition by r.source, h))::double as alike, count(*) over (partition by r.source, h) as n
  from rows_ r join goals g on r.source is not distinct from g.source),
edge as (select source, min(h) as bound_h from upto where upto > budget group by source),
counted as (
  select u.*, least(whole + case when h < bound_h then 1 when h = bound_h and nth <= ceil((budget - (upto - alike)) / (alike / n) - 0.5) then 1 else 0 end, {MAX_REPEATS})::int as copies
  from upto u left join edge e on u.source is not distinct from e.source)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, source, copies from counted
"""
