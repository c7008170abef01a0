"""Top-down mining: atoms as element sets, exact overlaps of atoms as rules, min-hash candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.relations import INVERSE, SEPARATOR, inverse, path_length
from ..storage import written
from .graph import with_inverse
from .paths import closing_supports, large_relations, longer_paths, pair_counts, path_supports
from .threesteps import three_step_supports

METRICS = ("support", "body_size", "head_size")


def metric_columns(df: DataFrame) -> DataFrame:
    """Adds confidence, coverage and Jaccard similarity to support, body_size and head_size."""
    s, b, h = (F.col(c).cast("double") for c in METRICS)
    return df.withColumn("confidence", s / b).withColumn("coverage", s / h).withColumn("jaccard", s / (b + h - s))


def binary_atoms(edges: DataFrame) -> DataFrame:
    """(atom, x, y) of every relation in both directions."""
    return with_inverse(edges).select(F.col("r").alias("atom"), F.col("h").alias("x"), F.col("t").alias("y"))


def unary_atoms(edges: DataFrame, loops: DataFrame, min_size: int) -> DataFrame:
    """(atom, kind, relation, constant, x): r(X,c), r(X,·) and r(X,X), both directions, of at least ``min_size`` elements.

    The sizes come from partial aggregation; elements are joined back to the atoms that stay.
    """
    both = with_inverse(edges)
    const = both.select(F.concat("r", F.lit("("), "t", F.lit(")")).alias("atom"), F.lit("const").alias("kind"), F.col("r").alias("relation"), F.col("t").alias("constant"), F.col("h").alias("x"))
    exists = both.select(F.concat("r", F.lit("(·)")).alias("atom"), F.lit("exists").alias("kind"), F.col("r").alias("relation"), F.lit("·").alias("constant"), F.col("h").alias("x")).distinct()
    loop = loops.select(F.concat("r", F.lit("(X)")).alias("atom"), F.lit("loop").alias("kind"), F.col("r").alias("relation"), F.lit("X").alias("constant"), F.col("e").alias("x"))
    rows = const.unionAll(exists).unionAll(loop)
    large = rows.groupBy("atom").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return rows.join(large, "atom")


def is_head_atom():
    """Constant atoms in either direction; binary and loop atoms forward only; never an existence atom."""
    return (F.col("kind") == "const") | ((F.col("kind") == "loop") & ~F.startswith("relation", F.lit(INVERSE)))


def overlap_rules(heads: DataFrame, bodies: DataFrame, element: list[str], min_support: int) -> DataFrame:
    """Rules head <- body of atoms that share at least ``min_support`` elements.

    ``heads`` has (head, head_size, *element), ``bodies`` (body, body_size, *element); both distinct.
    """
    pairs = heads.join(bodies, element).where("head <> body").groupBy("head", "body").agg(F.count("*").alias("support"), F.first("head_size").alias("head_size"), F.first("body_size").alias("body_size"))
    return metric_columns(pairs.where(F.col("support") >= min_support))


def _sized(rows: DataFrame, name: str, element: list[str]) -> DataFrame:
    sizes = rows.groupBy(name).agg(F.count("*").alias(f"{name}_size"))
    return rows.select(name, *element).join(sizes, name)  # small for relations; many for paths, so Spark's own size check decides


def binary_rules(edges: DataFrame, min_support: int) -> DataFrame:
    """r <- r' and r <- inverse r', exactly."""
    bodies = _sized(binary_atoms(edges).withColumnRenamed("atom", "body"), "body", ["x", "y"])
    heads = _sized(edges.select(F.col("r").alias("head"), F.col("h").alias("x"), F.col("t").alias("y")), "head", ["x", "y"])
    return overlap_rules(heads, bodies, ["x", "y"], min_support)


def path_rules(heads: DataFrame, paths: DataFrame, min_support: int) -> DataFrame:
    """Rules of relation heads over path bodies; ``paths`` has distinct (path, h, t)."""
    bodies = _sized(paths.select(F.col("path").alias("body"), F.col("h").alias("x"), F.col("t").alias("y")), "body", ["x", "y"])
    head_rows = _sized(heads.select(F.col("r").alias("head"), F.col("h").alias("x"), F.col("t").alias("y")), "head", ["x", "y"])
    return overlap_rules(head_rows, bodies, ["x", "y"], min_support)


def two_step_rules(edges: DataFrame, min_support: int) -> DataFrame:
    """Rules of every relation over every two-step path, steps in both directions; body sizes of paths that have a rule only."""
    steps = with_inverse(edges)
    found = written(closing_supports(edges, steps, min_support), "two_step_supports")
    sizes = pair_counts(steps, found.select("r1", "r2").distinct(), both_ways=True).withColumnRenamed("pairs", "body_size")
    heads = edges.groupBy(F.col("r").alias("head")).agg(F.count("*").alias("head_size"))
    rows = found.join(sizes, ["r1", "r2"]).join(F.broadcast(heads), "head")
    return metric_columns(rows.select("head", F.concat_ws(SEPARATOR, "r1", "r2").alias("body"), "support", "body_size", "head_size"))


def forward_rules(heads: DataFrame, steps: DataFrame, min_support: int) -> DataFrame:
    """Rules of the relations of ``heads`` over the two-step paths of ``steps``, without a table of the paths' pairs."""
    pairs, supports = path_supports(heads, steps)
    sizes = heads.groupBy(F.col("r").alias("head")).agg(F.count("*").alias("head_size"))
    rows = supports.where(F.col("support") >= min_support).join(pairs.withColumnRenamed("pairs", "body_size"), ["r1", "r2"]).join(F.broadcast(sizes), "head")  # a row for each relation
    return metric_columns(rows.select("head", F.concat_ws(SEPARATOR, "r1", "r2").alias("body"), "support", "body_size", "head_size"))


def mine(edges: DataFrame, config: Config = Config(), budget: int = 1_000_000) -> DataFrame:
    """All rules of relations over paths of up to ``config.max_path_length`` steps, with exact metrics and the body's length.

    Supports of longer bodies come from joining every path's pairs with the heads' triples, those of one step from shared_pairs();
    a rule needs ``config.min_supp`` of them and a body other than its head.
    """
    found = longer_paths(large_relations(edges, config.min_supp), config.max_path_length, config.min_supp, config.min_entity_supp, budget)
    starts = written(found.select("h").distinct(), "path_starts")
    longer = path_supports_listed(edges.join(starts, "h", "left_semi"), found, config.min_supp)
    sizes = edges.groupBy("r").agg(F.count("*").alias("n"))  # a row for each relation
    bodies = sizes.where(F.col("n") >= config.min_supp).select(F.inline(F.array(F.struct(F.col("r").alias("body"), F.col("n").alias("body_size")), F.struct(inverse(F.col("r")).alias("body"), F.col("n").alias("body_size")))))
    one = shared_pairs(edges, config.min_supp).join(F.broadcast(bodies), "body").select("head", "body", "support", "body_size")
    rows = longer.unionByName(one).join(F.broadcast(sizes.select(F.col("r").alias("head"), F.col("n").alias("head_size"))), "head")
    return metric_columns(rows.select("head", "body", "support", "head_size", "body_size")).withColumn("steps", path_length(F.col("body")))


def mine_all(edges: DataFrame, min_support: int) -> DataFrame:
    """mine() for up to three steps without a budget: rules over every path, none of whose joins is left out. Pairs of paths are counted and not listed."""
    sizes = edges.groupBy("r").agg(F.count("*").alias("n"))  # a row for each relation
    bodies = sizes.select(F.inline(F.array(F.struct(F.col("r").alias("body"), F.col("n").alias("body_size")), F.struct(inverse(F.col("r")).alias("body"), F.col("n").alias("body_size")))))
    one = shared_pairs(edges, min_support).join(F.broadcast(bodies), "body").select("head", "body", "support", "body_size")
    longer = three_step_supports(edges, min_support).select("head", F.concat_ws(SEPARATOR, "r1", "r2", "r3").alias("body"), "support", "body_size")
    rows = one.unionByName(longer).join(F.broadcast(sizes.select(F.col("r").alias("head"), F.col("n").alias("head_size"))), "head")
    return metric_columns(rows.select("head", "body", "support", "head_size", "body_size")).withColumn("steps", path_length(F.col("body")))


def path_supports_listed(heads: DataFrame, paths: DataFrame, min_support: int) -> DataFrame:
    """(head, body, support, body_size) of listed (path, h, t)."""
    sizes = paths.groupBy(F.col("path").alias("body")).agg(F.count("*").alias("body_size"))
    found = heads.select(F.col("r").alias("head"), "h", "t").join(paths.withColumnRenamed("path", "body"), ["h", "t"]).where("head <> body")
    return found.groupBy("head", "body").agg(F.count("*").alias("support")).where(F.col("support") >= min_support).join(sizes, "body").select("head", "body", "support", "body_size")


def _met(ranges: list) -> list[list[str]]:
    """Groups of the relations (r, h0, h1, t0, t1) whose names let them share a pair of nodes, one way or the other; a relation that can't isn't in any."""
    touch = lambda a, b: a[0] <= b[1] and b[0] <= a[1]
    ends = {x["r"]: ((x["h0"], x["h1"]), (x["t0"], x["t1"])) for x in ranges}
    meet = {a: {b for b, (h, t) in ends.items() if a != b and touch(ends[a][0], h) and touch(ends[a][1], t) or touch(ends[a][0], t) and touch(ends[a][1], h)} for a in ends}
    groups, left = [], {a for a in meet if meet[a]}
    while left:
        group, new = set(), {min(left)}
        while new:
            group |= new
            new = set().union(*(meet[a] for a in new)) - group
        groups.append(sorted(group))
        left -= group
    return groups


def shared_pairs(edges: DataFrame, min_support: int) -> DataFrame:
    """(head, body, support): triples of a relation that another, or an inverse, has too.

    An edge goes once into a shuffle, whichever rules it is in: a pair of nodes gets one bit for each relation and direction. Relations
    whose ends lie in different ranges of names share no pair; each group of the others is counted and its shuffle files deleted.
    """
    ranges = edges.groupBy("r").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("t").alias("t0"), F.max("t").alias("t1")).collect()  # a row for each relation
    out = None
    for group in _met(ranges):
        bits = [(r, d) for r in group for d in (True, False)]
        code = {b: divmod(i, 62) for i, b in enumerate(bits)}
        words = range(1 + max(w for w, _ in code.values()))
        table = [(r, code[r, True][0], 1 << code[r, True][1], code[r, False][0], 1 << code[r, False][1]) for r in group]
        codes = F.broadcast(edges.sparkSession.createDataFrame(table, "r string, w1 int, b1 long, w0 int, b0 long"))  # a row for each relation
        up = F.col("h") < F.col("t")
        rows = edges.where(F.col("r").isin(group)).join(codes, "r").select(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b"), F.when(up, F.col("w1")).otherwise(F.col("w0")).alias("w"), F.when(up, F.col("b1")).otherwise(F.col("b0")).alias("bit"))
        masks = [f"m{w}" for w in words]
        sets = rows.groupBy("a", "b").agg(*[F.bit_or(F.when(F.col("w") == w, F.col("bit")).otherwise(F.lit(0))).alias(m) for w, m in enumerate(masks)])
        sets = written(sets.groupBy(*masks).agg(F.count("*").alias("n")), "shared_pairs")  # a row for each set of relations that share pairs
        own = edges.sparkSession.createDataFrame([(r, d, *code[r, d]) for r, d in bits], "r string, up boolean, w int, i int")
        is_set = F.expr("(shiftright(masks[w], i) & 1) = 1")
        held = sets.select("n", F.array(*masks).alias("masks")).crossJoin(F.broadcast(own)).where(is_set)  # a row for each relation and direction
        both = held.select("n", "masks", F.col("r").alias("head"), F.col("up").alias("head_up")).crossJoin(F.broadcast(own)).where(is_set)
        body = F.when(F.col("head_up") == F.col("up"), F.col("r")).otherwise(F.concat(F.lit(INVERSE), "r"))
        one = both.select("head", body.alias("body"), "n").where("head <> body").groupBy("head", "body").agg(F.sum("n").alias("support"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return edges.select(F.col("r").alias("head"), F.col("r").alias("body"), F.lit(0).cast("long").alias("support")).limit(0)
    return out.where(F.col("support") >= min_support)


def zero_rules(edges: DataFrame, min_support: int) -> DataFrame:
    """r(X,c) <- nothing, both directions: support is the number of X, body size that of the relation."""
    both = with_inverse(edges)
    size = both.groupBy("r").agg(F.count("*").alias("body_size"))
    rows = both.groupBy("r", "t").agg(F.count("*").alias("support")).where(F.col("support") >= min_support).join(F.broadcast(size), "r")
    return rows.select(F.concat("r", F.lit("(X,"), "t", F.lit(")")).alias("head"), "support", F.col("support").alias("head_size"), "body_size", (F.col("support") / F.col("body_size")).alias("confidence"))


def unary_rules(atoms: DataFrame, min_support: int, kinds: tuple[str, ...] = ("const", "exists", "loop")) -> DataFrame:
    """Rules between unary atoms; bodies of the given kinds."""
    heads = atoms.where(is_head_atom()).select(F.col("atom").alias("head"), F.col("size").alias("head_size"), "x")
    bodies = atoms.where(F.col("kind").isin(*kinds)).select(F.col("atom").alias("body"), F.col("size").alias("body_size"), "x")
    return overlap_rules(heads, bodies, ["x"], min_support)


def path_unary_rules(edges: DataFrame, first: str, second: str, min_support: int) -> DataFrame:
    """Heads r(X,c) over two-step bodies first·second(X,c2), without elements that prove the head by themselves.

    With head constant c, every x with first(x, c) leaves the body before it is counted.
    """
    a = edges.where(F.col("r") == first).select(F.col("h").alias("x"), F.col("t").alias("m"))
    b = edges.where(F.col("r") == second).select(F.col("h").alias("m"), F.col("t").alias("c2"))
    body = a.join(b, "m").where("x <> c2").select("x", "c2").distinct()
    sizes = body.groupBy("c2").agg(F.count("*").alias("full_size"))
    heads = edges.select(F.col("r").alias("head_relation"), F.col("t").alias("c"), F.col("h").alias("x"))
    proven = a.select("x", F.col("m").alias("c")).distinct().withColumn("proven", F.lit(True))
    pairs = body.join(heads, "x").join(proven, ["x", "c"], "left").groupBy("head_relation", "c", "c2").agg(F.count_if(F.col("proven").isNull()).alias("support"))
    lost = body.join(proven.drop("proven"), "x").groupBy("c", "c2").agg(F.count("*").alias("lost"))
    rows = pairs.where(F.col("support") >= min_support).join(sizes, "c2").join(lost, ["c", "c2"], "left")
    return rows.select("head_relation", "c", "c2", "support", (F.col("full_size") - F.coalesce("lost", F.lit(0))).alias("body_size"))


def better_than(gain: float, confidence: str, jaccard: str) -> Column:
    """Whether a row's confidence and Jaccard similarity beat the given ones, the former by the factor ``gain``."""
    return (F.col("confidence") > gain * F.col(confidence)) & (F.col("jaccard") > F.col(jaccard))


def two_step_unary_rules(edges: DataFrame, rows: DataFrame, min_support: int) -> DataFrame:
    """path_unary_rules() for all two-step bodies at once, of heads in both directions: (head_relation, c, r1, r2, c2, support, body_size).

    ``rows`` are groundings (r1, r2, h, m, t). Where the first step is the head's relation or leads to its constant, the x it proves leave the body.
    """
    path = ["r1", "r2"]
    body = written(rows.select(*path, F.col("h").alias("x"), F.col("t").alias("c2")).distinct(), "unary_bodies")
    sizes = body.groupBy(*path, "c2").agg(F.count("*").alias("full_size")).where(F.col("full_size") >= min_support)
    body = body.join(sizes.select(*path, "c2"), [*path, "c2"], "left_semi")
    heads = with_inverse(edges).select(F.col("r").alias("head_relation"), F.col("t").alias("c"), F.col("h").alias("x"))
    proven = rows.select(*path, F.col("h").alias("x"), F.col("m").alias("c")).distinct()
    held = body.join(heads, "x")
    pairs = held.join(proven, [*path, "x", "c"], "left_anti").groupBy("head_relation", "c", *path, "c2").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    lost = body.join(proven, [*path, "x"]).groupBy(*path, "c", "c2").agg(F.count("*").alias("lost"))
    found = pairs.join(sizes, [*path, "c2"]).join(lost, [*path, "c", "c2"], "left")
    return found.select("head_relation", "c", *path, "c2", "support", (F.col("full_size") - F.coalesce("lost", F.lit(0))).alias("body_size"))


def verified_candidates(atoms: DataFrame, min_support: int, bins: int = 256, ratio: float = 0.8) -> DataFrame:
    """Rules whose atoms are min-hash candidates, verified on their elements: exact metrics of those found, without pairing all atoms of an element."""
    pairs = written(lsh_candidates(atoms, min_support, bins, ratio).select("head", "body"), "candidates")
    sizes = atoms.select("atom", "size").distinct()
    elements = atoms.select("atom", "x")
    both = pairs.join(elements.withColumnRenamed("atom", "head"), "head").join(elements.withColumnRenamed("atom", "body"), ["body", "x"])
    found = both.groupBy("head", "body").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    found = found.join(sizes.select(F.col("atom").alias("head"), F.col("size").alias("head_size")), "head").join(sizes.select(F.col("atom").alias("body"), F.col("size").alias("body_size")), "body")
    return metric_columns(found.select("head", "body", "support", "head_size", "body_size"))


def conjunctive_rules(atoms: DataFrame, rules: DataFrame, min_support: int, gain: float = 1.5) -> DataFrame:
    """head <- body1, body2 for pairs of rules of one head; kept if the pair is better than each one: a confidence over ``gain`` times its, and a larger Jaccard similarity.

    ``rules`` are those to be combined (head, body, head_size, confidence, jaccard).
    """
    elements = atoms.select("atom", "x")
    a = rules.select("head", "head_size", F.col("body").alias("body1"), F.col("confidence").alias("conf1"), F.col("jaccard").alias("jac1"))
    b = rules.select("head", F.col("body").alias("body2"), F.col("confidence").alias("conf2"), F.col("jaccard").alias("jac2"))
    pairs = a.join(b, "head").where("body1 < body2")
    both = pairs.select("body1", "body2").distinct().join(elements.withColumnRenamed("atom", "body1"), "body1").join(elements.withColumnRenamed("atom", "body2"), ["body2", "x"])
    size = both.groupBy("body1", "body2").agg(F.count("*").alias("body_size")).where(F.col("body_size") >= min_support)
    joint = both.join(pairs.select("head", "body1", "body2"), ["body1", "body2"]).join(elements.withColumnRenamed("atom", "head"), ["head", "x"])
    joint = joint.groupBy("head", "body1", "body2").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    rows = metric_columns(joint.join(size, ["body1", "body2"]).join(pairs, ["head", "body1", "body2"]))
    return rows.where(better_than(gain, "conf1", "jac1") & better_than(gain, "conf2", "jac2")).select("head", "body1", "body2", "support", "body_size", "confidence", "jaccard")


# --- min-hash --------------------------------------------------------------------


def minhash_signatures(atoms: DataFrame, bins: int = 256) -> DataFrame:
    """(atom, bin, value): one-permutation min-hash; an empty bin takes the value of the next filled one.

    One hash for each element; bins are minima with map-side combination.
    """
    h = F.xxhash64("x")
    filled = atoms.select("atom", F.pmod(h, F.lit(bins)).cast("int").alias("bin"), F.abs(F.xxhash64(F.col("x"), F.lit(1)).bitwiseAND((1 << 62) - 1)).alias("v"))
    filled = filled.groupBy("atom", "bin").agg(F.min("v").alias("v"))
    packed = filled.groupBy("atom").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m"))  # at most `bins` entries
    keys = F.array_sort(F.map_keys("m"))
    after = lambda b: F.coalesce(F.get(F.filter(keys, lambda k: k >= b), F.lit(0)), F.element_at(keys, 1))
    return packed.select("atom", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.alias("bin"), F.element_at("m", after(b)).alias("value")))).alias("s")).select("atom", "s.*")


def lsh_candidates(atoms: DataFrame, min_support: int, bins: int = 256, ratio: float = 0.8) -> DataFrame:
    """(head, body, collisions, estimate): pairs whose estimated intersection is at least ``ratio`` times ``min_support``."""
    sig = minhash_signatures(atoms, bins)
    info = atoms.select("atom", "kind", "relation", "size").distinct()
    heads = sig.join(info.where(is_head_atom()), "atom").select(F.col("atom").alias("head"), F.col("size").alias("head_size"), "bin", "value")
    bodies = sig.join(info, "atom").select(F.col("atom").alias("body"), F.col("size").alias("body_size"), "bin", "value")
    pairs = heads.join(bodies, ["bin", "value"]).where("head <> body").groupBy("head", "body").agg(F.count("*").alias("collisions"), F.first("head_size").alias("head_size"), F.first("body_size").alias("body_size"))
    j = F.col("collisions") / bins
    pairs = pairs.withColumn("estimate", j * (F.col("head_size") + F.col("body_size")) / (1 + j))
    return pairs.where(F.col("estimate") >= ratio * min_support).select("head", "body", "collisions", "estimate")


def largest_buckets(atoms: DataFrame, most: int = 10, bins: int = 256) -> DataFrame:
    """The ``most`` largest min-hash buckets of each kind of atom: (kind, place, n)."""
    info = atoms.select("atom", "kind").distinct()
    buckets = minhash_signatures(atoms, bins).join(info, "atom").groupBy("kind", "bin", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "bin", "value")
    return buckets.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("kind", "place", "n")


def bucket_stats(atoms: DataFrame, bins: int = 256) -> DataFrame:
    """Number and sizes of min-hash buckets by kind of atom."""
    info = atoms.select("atom", "kind").distinct()
    buckets = minhash_signatures(atoms, bins).join(info, "atom").groupBy("kind", "bin", "value").agg(F.count("*").alias("n"))
    return buckets.groupBy("kind").agg(F.count("*").alias("buckets"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"))
