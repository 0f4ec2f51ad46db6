"""Members of linked classes, with hot classes split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathtide.session import cut, sized_broadcast

#: Members of a class that are paired in one part.
PART = 4096


def members_of_links(links: DataFrame, left: DataFrame, right: DataFrame, key: list[str], item: str) -> DataFrame:
    """``links`` with the members of both classes: the other columns of links, id_a, id_b.

    links: columns a_<key> and b_<key>; left and right: key and ``item``. A class with more than
    ``PART`` members is paired in parts of about so many, a part of one side with all parts of the
    other, so that no class is one task's work. Classes are counted with a combine before the shuffle.
    """
    out = links
    for side, members in (("a", left), ("b", right)):
        own = [f"{side}_{k}" for k in key]
        members = members.select(*[F.col(k).alias(o) for k, o in zip(key, own, strict=True)], F.col(item).alias(f"id_{side}"))
        sizes = members.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PART).withColumn("_parts", F.ceil(F.col("_n") / PART)).drop("_n")
        parts = F.coalesce("_parts", F.lit(1))
        sizes = cut(sizes)
        sizes = sized_broadcast(sizes, sizes.count())
        members = members.join(sizes, own, "left").withColumn("_part", F.pmod(F.xxhash64(f"id_{side}"), parts)).drop("_parts")
        out = out.join(sizes, own, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
        out = out.join(members, [*own, "_part"]).drop("_part")
    return out
