"""Triples from text files and from the star schema; the edge table that every operator works on."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import application_dir

INVERSE = "INVERSE_"


def read_triples(spark: SparkSession, path: str, ignore4plus: bool = True) -> DataFrame:
    """Lines of three fields, split at tabs, or at spaces if that gives fewer than three.

    Lines of up to two characters are skipped. With ``ignore4plus`` further fields are
    dropped; without it four fields need a final ``.``, and in five or more the fields
    after the second are one value whose spaces become ``_``.
    """
    line = spark.read.text(path).where(F.length("value") > 2)
    tabs, spaces = F.split("value", "\t"), F.split("value", " +")
    rows = line.select(F.when(F.size(tabs) < 3, spaces).otherwise(tabs).alias("f")).where(F.size("f") >= 3)
    f = F.col("f")
    if ignore4plus:
        tail: Column = f[2]
    else:
        rows = rows.where((F.size("f") != 4) | (F.get("f", F.lit(3)) == "."))
        tail = F.when(F.size("f") <= 4, f[2]).otherwise(F.array_join(F.slice("f", F.lit(3), F.size("f") - 2), "_"))
    return rows.select(f[0].alias("h"), f[1].alias("r"), tail.alias("t"))


def load_triples(spark: SparkSession, path: str, inverses: bool = True, ignore4plus: bool = True) -> DataFrame:
    """The edges of a file, loops apart, each once; in both directions unless only evaluated against."""
    read = read_triples(spark, path, ignore4plus).where("h <> t").distinct()
    if not inverses:
        return read
    back = F.struct(F.col("t").alias("h"), F.concat(F.lit(INVERSE), "r").alias("r"), F.col("h").alias("t"))
    return read.select(F.inline(F.array(F.struct("h", "r", "t"), back)))


def read_split(spark: SparkSession, folder: str) -> DataFrame:
    """``train.txt`` of a data set: lines of exactly three fields, at tabs or else at white space."""
    line = spark.read.text(f"{folder}/train.txt")
    f = F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+"))
    return line.select(f.alias("f")).where(F.size("f") == 3).select(F.col("f")[0].alias("h"), F.col("f")[1].alias("r"), F.col("f")[2].alias("t"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of exactly three tab-separated fields."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == 3)
    return rows.select(F.col("f")[0].alias("h"), F.col("f")[1].alias("r"), F.col("f")[2].alias("t")).distinct()


@dataclass(frozen=True)
class Projection:
    """One relation as a projection of the star schema; ``many`` if it can repeat a triple."""

    h: str
    t: str
    source: str
    many: bool = False

    def sql(self, name: str) -> str:
        return f"SELECT {'DISTINCT ' if self.many else ''}{self.h} AS h, '{name}' AS r, {self.t} AS t FROM {self.source}"


RELATIONS = {
    "custNation": Projection("concat('C', c_custkey)", "concat('N', c_nationkey)", "customer"),
    "custSegment": Projection("concat('C', c_custkey)", "concat('G_', c_mktsegment)", "customer"),
    "custRegion": Projection("concat('C', c_custkey)", "concat('R', n_regionkey)", "customer JOIN nation ON c_nationkey = n_nationkey"),
    "suppNation": Projection("concat('S', s_suppkey)", "concat('N', s_nationkey)", "supplier"),
    "suppRegion": Projection("concat('S', s_suppkey)", "concat('R', n_regionkey)", "supplier JOIN nation ON s_nationkey = n_nationkey"),
    "inRegion": Projection("concat('N', n_nationkey)", "concat('R', n_regionkey)", "nation"),
    "placedBy": Projection("concat('O', o_orderkey)", "concat('C', o_custkey)", "orders"),
    "priority": Projection("concat('O', o_orderkey)", "concat('Q_', o_orderpriority)", "orders"),
    "status": Projection("concat('O', o_orderkey)", "concat('Z_', o_orderstatus)", "orders"),
    "hasPart": Projection("concat('O', l_orderkey)", "concat('P', l_partkey)", "lineitem", True),
    "orderSupp": Projection("concat('O', l_orderkey)", "concat('S', l_suppkey)", "lineitem", True),
    "suppliedBy": Projection("concat('P', l_partkey)", "concat('S', l_suppkey)", "lineitem", True),
    "brand": Projection("concat('P', p_partkey)", "concat('B_', p_brand)", "part"),
    "ptype": Projection("concat('P', p_partkey)", "concat('T_', p_type)", "part"),
    "did": Projection("concat('U', user_id)", "concat('E_', event_type)", "events", True),
    "returnedPart": Projection("concat('O', l_orderkey)", "concat('P', l_partkey)", "lineitem WHERE l_returnflag = 'R'", True),
    "supplies": Projection("concat('S', l_suppkey)", "concat('P', l_partkey)", "lineitem WHERE l_linestatus = 'O'", True),
    "fulfils": Projection("concat('S', l_suppkey)", "concat('O', l_orderkey)", "lineitem WHERE l_linestatus = 'F'", True),
    "hosts": Projection("concat('N', s_nationkey)", "concat('S', s_suppkey)", "supplier"),
    "tradesWith": Projection(
        "concat('N', c_nationkey)", "concat('N', s_nationkey)",
        "orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey", True,
    ),
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def kg_sql(relations: tuple[str, ...] | list[str] | None = None) -> str:
    """The triples of some (or all) relations as one query; the same text runs in other SQL engines.

    Relations never share a triple, so duplicates are removed inside a projection only,
    where its source can repeat one, and relations that aren't asked for aren't scanned.
    """
    return "\nUNION ALL ".join(RELATIONS[r].sql(r) for r in relations or RELATIONS)


#: Relations of a folder that this application has stored already: {(application, folder): names}.
_STORED: dict[tuple[str, str], set[str]] = {}


def stored_kg(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """star_schema_kg(), kept as a table by relation in the shared folder.

    A relation is projected from the star schema when an application first asks for it; from
    then on a plan has one scan for all its relations, pruned to their folders.
    """
    wanted = list(relations or RELATIONS)
    key = f"{spark.sparkContext.applicationId}", sf_dir
    root = f"{application_dir(spark)}/kg-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    have = _STORED.setdefault(key, set())
    missing = [r for r in wanted if r not in have]
    if missing:
        star_schema_kg(spark, sf_dir, missing).write.mode("append").partitionBy("r").parquet(root)
        have.update(missing)
    found = spark.read.schema("h string, t string, r string").option("basePath", root)
    return found.parquet(*[f"{root}/r={r}" for r in wanted]).select("h", "r", "t")


def star_schema_kg(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """The knowledge graph (h, r, t) over the driver's tables."""
    sql = kg_sql(relations)
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)
