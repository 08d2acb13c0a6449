"""All pairs within groups, for results that must list them, without one task ever holding a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of one block; a task holds two blocks of one group at a time.
BLOCK = 512


def pairs_within(members: DataFrame, group: str, record_id: str, *, block: int = BLOCK) -> DataFrame:
    """``(id_a, id_b)``, smaller first, of every two distinct ids of a group.

    A group of n members is cut into n / ``block`` blocks by the hash of the id; every two blocks meet in a task of
    their own, so a group with a third of all rows is spread over as many tasks as its output asks for. Repeated
    rows of one id count once; a null group or id has no pairs.
    """
    m = members.select(F.col(group).alias("g"), F.col(record_id).cast("bigint").alias("id")).where("g is not null and id is not null").distinct()
    sizes = m.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    cut = m.join(sizes, "g").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    cells = cut.select("g", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.groupBy("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.sort_array(F.collect_list(F.struct("id", "own"))).alias("ids"))
    first = cells.select("lo", "hi", "ids", F.posexplode("ids").alias("pos", "a"))
    later = F.slice("ids", F.col("pos") + 2, F.size("ids"))
    second = F.when(F.col("lo") == F.col("hi"), later).otherwise(F.filter(later, lambda b: b["own"] != F.col("a.own")))
    return first.select(F.col("a.id").alias("id_a"), F.explode(second).alias("b")).select("id_a", F.col("b.id").alias("id_b"))
