"""The edge table: loops apart, inverses, lookups, dictionaries, statistics, sampling, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import inverse, is_inverse
from ..storage import discard, written


def edges(kg: DataFrame) -> DataFrame:
    """Distinct triples that aren't loops."""
    return kg.where("h <> t").select("h", "r", "t").distinct()


def loops(kg: DataFrame) -> DataFrame:
    return kg.where("h = t").select("r", F.col("h").alias("e")).distinct()


def with_inverse(triples: DataFrame) -> DataFrame:
    """Both directions; one scan, exploded."""
    both = F.array(F.struct("h", "r", "t"), F.struct(F.col("t").alias("h"), inverse(F.col("r")).alias("r"), F.col("h").alias("t")))
    return triples.select(F.inline(both))


def add_triples(kg: DataFrame, more: DataFrame) -> DataFrame:
    return kg.unionByName(more).dropDuplicates(["h", "r", "t"])


def is_true(queries: DataFrame, kg: DataFrame) -> DataFrame:
    """The queries that are triples of the graph."""
    return queries.join(kg, ["h", "r", "t"], "left_semi")


def is_true_either_way(queries: DataFrame, kg: DataFrame) -> DataFrame:
    """As is_true(), for queries of relations and of their inverses."""
    turned = is_inverse(F.col("r"))
    h, t = F.when(turned, F.col("t")).otherwise(F.col("h")), F.when(turned, F.col("h")).otherwise(F.col("t"))
    asked = queries.select("h", "r", "t", h.alias("__h"), F.when(turned, inverse(F.col("r"))).otherwise(F.col("r")).alias("__r"), t.alias("__t"))
    known = kg.select(F.col("h").alias("__h"), F.col("r").alias("__r"), F.col("t").alias("__t"))
    return asked.join(known, ["__h", "__r", "__t"], "left_semi").select("h", "r", "t")


def is_false(queries: DataFrame, kg: DataFrame) -> DataFrame:
    return queries.join(kg, ["h", "r", "t"], "left_anti")


def tails(kg: DataFrame, questions: DataFrame) -> DataFrame:
    """(h, r) -> t."""
    return questions.join(kg, ["h", "r"])


def heads(kg: DataFrame, questions: DataFrame) -> DataFrame:
    """(r, t) -> h."""
    return questions.join(kg, ["r", "t"])


def by_entity(kg: DataFrame, entity: str) -> DataFrame:
    """Triples with the entity as head, in both directions, each once."""
    return with_inverse(kg.where((F.col("h") == entity) | (F.col("t") == entity))).where(F.col("h") == entity).distinct()


def relation_stats(kg: DataFrame) -> DataFrame:
    """Triples (loops apart), distinct heads and tails, loops. Rows are counted at each end of a relation first, so no distinct count is spread out."""
    n, loops = F.count_if(F.col("h") != F.col("t")), F.count_if(F.col("h") == F.col("t"))
    at_head = kg.groupBy("r", "h").agg(n.alias("n"), loops.alias("loops")).groupBy("r")
    at_head = at_head.agg(F.sum("n").alias("triples"), F.count_if(F.col("n") > 0).alias("heads"), F.sum("loops").alias("loops"))
    at_tail = kg.groupBy("r", "t").agg(n.alias("n")).groupBy("r").agg(F.count_if(F.col("n") > 0).alias("tails"))
    # a row for each relation
    return at_head.join(at_tail, "r").select("r", "triples", "heads", "tails", "loops")


def functional_relations(kg: DataFrame) -> DataFrame:
    return relation_stats(kg).where("triples > 0 and triples = heads").select("r", "triples")


def degree(kg: DataFrame) -> DataFrame:
    """Edges at each node."""
    return edges(kg).select(F.explode(F.array("h", "t")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def ranked(rows: DataFrame, order: list[Column], name: str, keep: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """Adds the number of rows (of different ones, with ``distinct``: the order is of all columns then) before each one in a total order; only the columns ``keep`` stay.

    Rows are range-partitioned and sorted, then written; a partition's are numbered from the sum of the sizes of those before it.
    """
    keep = keep or rows.columns
    spread = rows.repartitionByRange(*order)
    spread = (spread.distinct() if distinct else spread).sortWithinPartitions(*order)  # equal rows are in one partition already
    placed = written(spread.select(*keep, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row")), "ranked")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    # one row for each range partition
    return placed.join(F.broadcast(before), "__part").select(*keep, (F.col("__base") + F.col("__row")).alias(name))


def dictionary(names: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Ids from 1 in name order, without a window over everything.

    Names are range-partitioned and sorted, then written; a partition's rows are numbered
    from the sum of the sizes of those before it (one number for each partition).
    """
    spread = names.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = written(spread.select(column, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")), "dictionary")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # one row for each partition: bounded by the number of shuffle partitions
    return placed.join(F.broadcast(before), "part").select((F.col("base") + F.col("row") + 1).alias(key), column)


def numbered_nodes(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triples with the numbers of their nodes (of all nodes there are, in name order) in place of the names, and (id, node)."""
    ids = written(dictionary(triples.select(F.explode(F.array("h", "t")).alias("node")), "node"), "node_numbers")
    a, b = (ids.select(F.col("node").alias(c), F.col("id").alias(x)) for c, x in (("h", "a"), ("t", "b")))
    return written(triples.join(a, "h").join(b, "t").select(F.col("a").alias("h"), "r", F.col("b").alias("t")), "numbered"), ids


def numbered(triples: DataFrame) -> DataFrame:
    """The triples of numbered_nodes()."""
    out, ids = numbered_nodes(triples)
    discard(ids)
    return out


def entity_dictionary(kg: DataFrame) -> DataFrame:
    return dictionary(kg.select(F.explode(F.array("h", "t")).alias("entity")), "entity", "entity_id")


def relation_dictionary(kg: DataFrame) -> DataFrame:
    """Original relations from 1 to N, inverses from N + 1: (relation_id, relation, inverse_id, is_inverse)."""
    ids = dictionary(kg.select("r"), "r", "relation_id")
    n = ids.agg(F.count("*").alias("n"))
    base = ids.crossJoin(F.broadcast(n))  # a single number
    forward = base.select("relation_id", F.col("r").alias("relation"), (F.col("relation_id") + F.col("n")).alias("inverse_id"), F.lit(False).alias("is_inverse"))
    backward = base.select((F.col("relation_id") + F.col("n")).alias("relation_id"), inverse(F.col("r")).alias("relation"), F.col("relation_id").alias("inverse_id"), F.lit(True).alias("is_inverse"))
    return forward.unionAll(backward)


def dictionary_summary(kg: DataFrame) -> DataFrame:
    """Entities, and mean name lengths of entities and relations."""
    e = kg.select(F.explode(F.array("h", "t")).alias("x")).distinct().agg(F.count("*").alias("entities"), F.sum(F.length("x")).alias("entity_chars"))
    r = kg.select("r").distinct().agg(F.count("*").alias("relations"), F.sum(F.length("r")).alias("relation_chars"))
    return e.crossJoin(r)  # two single rows


def sample_fanout(kg: DataFrame, more_than: int = 10, keep: int = 5000) -> DataFrame:
    """Triples of heads with more than ``more_than`` tails of a relation, at most ``keep`` each in a hashed order."""
    group = Window.partitionBy("h", "r")
    rows = kg.withColumn("n", F.count("*").over(group)).where(F.col("n") > more_than)
    return rows.withColumn("k", F.row_number().over(group.orderBy(F.md5(F.concat("h", "r", "t")), "t"))).where(F.col("k") <= keep).select("h", "r", "t")


def random_triples(kg: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """``n`` triples of each relation, the first in an order hashed with the seed."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "h", "t"))
    return kg.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(order, "h", "t"))).where(F.col("k") <= n).select("h", "r", "t")


def random_entities(kg: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement from the distinct heads, and tails, of each relation: (r, side, draw, entity).

    Entities are numbered within relation and side from one numbering of all; a draw's number comes from an md5, so any engine can repeat it.
    """
    ends = kg.select("r", F.explode(F.array(F.struct(F.lit("head").alias("side"), F.col("h").alias("e")), F.struct(F.lit("tail").alias("side"), F.col("t").alias("e")))).alias("x")).select("r", "x.*").distinct()
    numbered = ranked(ends, [F.col("r"), F.col("side"), F.col("e")], "n")
    sizes = numbered.groupBy("r", "side").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    draws = sizes.select("r", "side", "first", "size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "r", "side", "draw", F.lit(seed))), 1, 12), 16, 10).cast("long")
    draws = draws.select("r", "side", "draw", (F.col("first") + F.pmod(number, F.col("size"))).alias("n"))
    return draws.join(numbered, ["r", "side", "n"]).select("r", "side", "draw", F.col("e").alias("entity"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection and of both differences of two triple sets."""
    key = ["h", "r", "t"]
    tagged = a.select(*key, F.lit(1).alias("side")).unionAll(b.select(*key, F.lit(2).alias("side"))).groupBy(*key).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return tagged.agg(
        F.count_if((F.col("lo") == 1) & (F.col("hi") == 2)).alias("common"), F.count_if(F.col("hi") == 1).alias("only_first"), F.count_if(F.col("lo") == 2).alias("only_second")
    )
