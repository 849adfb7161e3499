"""Names of their own for files that meet in one folder, as if they came one after another.

A file takes its own name if that is free when it comes, else the first free one of stem_0001, stem_0002 and so on; names
of files that are in the folder already are never free. The names that the files of one stem try for are theirs, but for
two: their own, which overflow from a shorter stem may have taken (x_0001 from x), and numbered ones that are the own
names of other files. So what must be known is, for each numbered name that others have, who came first. Files of a stem
are ranked, the taken numbers of a stem are gaps in what is free, and the j-th file that needs a number gets the j-th free
one: j and as many gaps as lie below it. Whether a number is a gap depends on when the overflow would reach it, and that on
the gaps below and on shorter stems, so gaps are worked out again until they stay the same. No stem's files gather in
one task: ranks and gaps are running sums over sorted ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions import text
from speechlake.operators.ranking import group_row_numbers, group_running_sums, row_numbers
from speechlake.session import work_folder

#: Names that others have, at most, that meet the ranked files by broadcast.
BROADCAST_ROWS = 100_000
_NUMBERED = r"(?s)^(.*)_(\d{4,18})$"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _numbered(stem: Column) -> tuple[Column, Column]:
    """(stem, number) of a stem that the rule would make, else nulls."""
    number = F.regexp_extract(stem, _NUMBERED, 2).try_cast("long")
    made = (number >= 1) & (F.format_string("%04d", number) == F.regexp_extract(stem, _NUMBERED, 2))
    return F.when(made, F.regexp_extract(stem, _NUMBERED, 1)), F.when(made, number)


def unique_names(rows: DataFrame, path: str, order: str, name: str = "packed_name", existing: DataFrame | None = None) -> DataFrame:
    """rows with a name of their own. order: a column that orders them, without ties; existing: (name) of files that are there."""
    timed = row_numbers(rows, [F.col(order).asc()], "_t").withColumns({"_stem": text.file_stem(F.col(path)), "_ext": text.file_suffix(F.col(path))})
    ranked = _written(group_row_numbers(timed, ["_stem", "_ext"], [F.col("_t").asc()], "_rank", "_size"), "ranked")
    groups = _written(ranked.where("_rank = 1").select("_stem", "_ext", F.col("_t").alias("first"), "_size"), "groups")
    there = rows.sparkSession.createDataFrame([], "name string") if existing is None else existing.select("name").distinct()
    there = _written(there.select(text.file_stem(F.col("name")).alias("_stem"), text.file_suffix(F.col("name")).alias("_ext"), F.lit(0).cast("long").alias("first")), "there")
    # every name that is someone's own, and when it is asked for at the earliest; 0: it is there from the beginning
    owned = groups.select("_stem", "_ext", "first").unionByName(there).groupBy("_stem", "_ext").agg(F.min("first").alias("first"))
    base, number = _numbered(F.col("_stem"))
    child = owned.select(base.alias("base"), F.col("_ext").alias("e"), number.alias("number"), F.col("_stem").alias("child"), F.col("first").alias("asked")).where("base is not null")
    parent = groups.where("_size > 1").unionByName(groups.join(there.select("_stem", "_ext"), ["_stem", "_ext"], "left_semi")).unionByName(groups.where(_numbered(F.col("_stem"))[0].isNotNull())).distinct()
    edges = _written(child.join(parent.select(F.col("_stem").alias("base"), F.col("_ext").alias("e"), "_size"), ["base", "e"]), "edges")
    lost0 = there.select("_stem", "_ext")
    lost, gaps = _gaps(ranked, groups, edges, lost0)
    over = F.when(F.col("_lost"), F.col("_rank")).otherwise(F.col("_rank") - 1)
    placed = ranked.join(lost.select("_stem", "_ext", F.lit(True).alias("_own_lost")), ["_stem", "_ext"], "left").withColumn("_lost", F.coalesce("_own_lost", F.lit(False))).withColumn("_need", over)
    if gaps is None:
        return placed.withColumn(name, _name(F.col("_need"))).select(*rows.columns, name)
    # files and gaps in one order; a gap counts for every file that needs the number at its place or a later one
    marks = gaps.select(F.col("base").alias("_stem"), F.col("e").alias("_ext"), F.col("free").alias("_need"), F.lit(0).alias("_kind"))
    both = placed.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    summed = group_running_sums(both, ["_stem", "_ext"], [F.col("_need").asc(), F.col("_kind").asc()], F.when(F.col("_kind") == 0, 1.0).otherwise(0.0), "_skipped").where("_kind = 1")
    return summed.withColumn(name, _name(F.when(F.col("_need") > 0, F.col("_need") + F.col("_skipped").cast("long")).otherwise(F.lit(0).cast("long")))).select(*rows.columns, name)


def _name(number: Column) -> Column:
    return F.when(number == 0, F.concat("_stem", "_ext")).otherwise(F.concat("_stem", F.lit("_"), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit("0")), "_ext"))


def _gaps(ranked: DataFrame, groups: DataFrame, edges: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((_stem, _ext) of stems whose own name is lost to another, (base, e, free) of numbers that are gaps: free is the first place among the free numbers that lies above the gap)."""
    if edges.isEmpty():
        return there, None
    small = edges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lost, known = _written(there, "lost"), None
    gap = edges.withColumn("gap", F.lit(True))
    while True:
        # how many gaps lie below each number, and which file would come to it
        below = group_running_sums(gap, ["base", "e"], [F.col("number").asc()], F.when(F.col("gap"), 1.0).otherwise(0.0), "below")
        own = F.coalesce("own_lost", F.lit(False))
        turned = below.join(lost.select(F.col("_stem").alias("base"), F.col("_ext").alias("e"), F.lit(True).alias("own_lost")), ["base", "e"], "left")
        place = _written(turned.withColumn("free", F.col("number") - F.col("below").cast("long")).withColumn("rank", F.col("free") + F.when(own, 0).otherwise(1)).drop("below", "own_lost", "gap"), "places")
        side = F.broadcast(place) if small else place
        when = ranked.select(F.col("_stem").alias("base"), F.col("_ext").alias("e"), F.col("_rank").alias("rank"), F.col("_t").alias("comes"))
        met = _written(side.join(when, ["base", "e", "rank"], "inner").select("base", "e", "number", "comes"), "met")
        # a gap: its owner asks before the overflow comes; where no overflow comes it makes no difference
        gap = _written(place.join(met, ["base", "e", "number"], "left").withColumn("gap", F.coalesce(F.col("asked") < F.col("comes"), F.lit(False))), "gaps")
        taken = gap.where(F.col("comes").isNotNull() & ~F.col("gap")).select(F.col("child").alias("_stem"), F.col("e").alias("_ext"))
        lost = _written(there.unionByName(taken.join(groups, ["_stem", "_ext"], "left_semi").select("_stem", "_ext")).distinct(), "lost")
        now = gap.agg(F.count_if("gap"), F.sum(F.when(F.col("gap"), F.xxhash64("base", "e", "number")).cast("decimal(38,0)")), F.count("comes")).first(), lost.agg(F.count("*"), F.sum(F.xxhash64("_stem", "_ext").cast("decimal(38,0)"))).first()
        gap = gap.drop("comes", "free", "rank")
        if now == known:
            # the j-th free number lies above the gap from place free on
            return lost, place.join(gap.where("gap").select("base", "e", "number"), ["base", "e", "number"]).select("base", "e", "free")
        known = now
