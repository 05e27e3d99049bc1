"""What terms descend from, as a fixpoint over a table of edges.

Semi-naive: each round joins only the pairs that the last one found with the
edges, and keeps those not seen before.  There is a round for each level of the
hierarchy (and one that finds nothing), so cycles end where they close.  A parent that a large
part of all terms share is a hot key of that join, and is spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import spread_join
from .tables import kept


def ancestors(edges: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, ancestor: every term of ``terms`` (term) and of ``edges`` (term, parent) with itself and all that is reached from it.

    Null terms and parents are left out; repeated edges count once; a parent that is no
    term itself is an ancestor without ancestors.
    """
    links = kept(edges.where("term IS NOT NULL AND parent IS NOT NULL").select("term", "parent").distinct())
    every = links.select("term") if terms is None else links.select("term").unionAll(terms.where("term IS NOT NULL").select("term"))
    found = [kept(every.distinct().select("term", F.col("term").alias("ancestor")))]
    step = links.select(F.col("term").alias("ancestor"), "parent")
    latest = found[0]
    while True:
        reached = spread_join(latest, step, ["ancestor"], "inner").select("term", F.col("parent").alias("ancestor")).distinct()
        latest = kept(reached.join(reduce(DataFrame.unionAll, found), ["term", "ancestor"], "left_anti"))
        if not latest.limit(1).count():
            return reduce(DataFrame.unionAll, found)
        found.append(latest)
