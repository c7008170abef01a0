"""Writers: rule files, metric JSON, predictions, partitions, triples."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_lines(rules: DataFrame) -> DataFrame:
    """(head, value): ``bodySize, support, confidence, head <= body``, by tabs."""
    line = F.concat_ws("\t", F.col("body_size").cast("string"), F.col("support").cast("string"), F.col("confidence").cast("string"), F.concat("head", F.lit(" <= "), "body"))
    return rules.select("head", "confidence", line.alias("value"))


def write_rules(rules: DataFrame, path: str) -> None:
    """Text lines, heads together, each head's rules by falling confidence."""
    rule_lines(rules).repartition("head").sortWithinPartitions("head", F.desc("confidence"), "value").select("value").write.text(path)


def _metrics(rules: DataFrame) -> DataFrame:
    size = [F.col("size")] if "size" in rules.columns else []  # of merged rules: how many were merged
    metric = F.struct(F.col("jaccard"), F.col("support"), F.col("head_size").alias("headSize"), F.col("body_size").alias("bodySize"), F.col("confidence"), *size)
    return rules.groupBy("head").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("body", metric)))).alias("metrics"))


def rules_json(rules: DataFrame) -> DataFrame:
    """(head, value): one JSON object ``{body: metric}`` for each head."""
    return _metrics(rules).select("head", F.to_json("metrics").alias("value"))


def write_json(rules: DataFrame, path: str) -> None:
    """One JSON object ``{head: {body: metric}}`` in a line for each head."""
    _metrics(rules).select(F.to_json(F.create_map("head", "metrics")).alias("value")).write.text(path)


def snapshot_lines(rules: DataFrame) -> DataFrame:
    """``predicted, correct, confidence, rule`` by tabs."""
    return rules.select(F.concat_ws("\t", F.col("predicted").cast("string"), F.col("correct").cast("string"), F.col("confidence").cast("string"), "rule").alias("value"))


def prediction_records(ranked: DataFrame, k: int = 100) -> DataFrame:
    """(h, r, t, value): the three-line record of each query from (h, r, t, direction, candidate, score, rank)."""
    def side(name: str):
        entries = F.sort_array(F.collect_list(F.when(F.col("direction") == name, F.struct("rank", "candidate", "score"))))
        return F.array_join(F.transform(entries, lambda e: F.concat_ws("\t", e["candidate"], e["score"].cast("string"))), "\t")

    rows = ranked.where(F.col("rank") <= k).groupBy("h", "r", "t").agg(side("head").alias("heads"), side("tail").alias("tails"))
    return rows.select("h", "r", "t", F.concat(F.concat_ws(" ", "h", "r", "t"), F.lit("\nHeads: "), "heads", F.lit("\nTails: "), "tails").alias("value"))


def write_partition_metrics(metrics: DataFrame, path: str) -> None:
    """A JSON object in a line for each row of a (small) table of figures."""
    metrics.coalesce(1).write.json(path)


def weighted_triples(ranked: DataFrame) -> DataFrame:
    """Predictions (h, r, t, direction, candidate, score) as triples with their score."""
    tail = F.col("direction") == "tail"
    return ranked.select(F.when(tail, F.col("h")).otherwise(F.col("candidate")).alias("h"), "r", F.when(tail, F.col("candidate")).otherwise(F.col("t")).alias("t"), "score")


def score_tree(ranked: DataFrame) -> DataFrame:
    """(query, direction, depth, confs, candidates) of every node of the tree that orders candidates by the confidences of their rules.

    A node is a prefix of confidence lists; its candidates are those whose list begins with it and isn't told apart before.
    """
    prefixes = F.transform(F.sequence(F.lit(1), F.size("confs")), lambda i: F.slice("confs", 1, i))
    rows = ranked.select("query", "direction", "candidate", F.explode(prefixes).alias("prefix"))
    nodes = rows.groupBy("query", "direction", "prefix").agg(F.array_sort(F.collect_list("candidate")).alias("candidates"))
    return nodes.select("query", "direction", F.size("prefix").alias("depth"), F.col("prefix").alias("confs"), "candidates")


def write_partitions(parts: DataFrame, path: str) -> None:
    """One folder of tab-separated triples for each part."""
    parts.select("part_id", "h", "r", "t").repartition("part_id").write.partitionBy("part_id").option("sep", "\t").csv(path)


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select("h", "r", "t").write.option("sep", "\t").csv(path)


def adjacency_json(edges: DataFrame) -> DataFrame:
    """(r, h, value): tails as a JSON list."""
    return edges.groupBy("r", "h").agg(F.to_json(F.array_sort(F.collect_set("t"))).alias("value"))


def explanation_lines(explained: DataFrame) -> DataFrame:
    """``h, t, groundings, nodes`` by tabs, from scoring.explanations()."""
    return explained.select(F.concat_ws("\t", "h", "t", F.col("groundings").cast("string"), F.array_join("nodes", " ")).alias("value"))


def write_table(table: DataFrame, path: str) -> None:
    """A comparison or statistics table as CSV with a header."""
    table.write.option("header", True).csv(path)


def trace_lines(kinds: list[str], trace: list[tuple[float, dict]]) -> list[str]:
    """A line for each record of walking.Dice: time, mean reward of every kind, then how often each was rewarded."""
    lines = []
    for at, scores in trace:
        pairs = [scores.get(k, (0.0, 0)) for k in kinds]
        lines.append("\t".join(map(str, [at, *[total / n if n else 0.0 for total, n in pairs], *[n for _, n in pairs]])))
    return lines


def heatmap_svg(cells: DataFrame, row: str, column: str, value: str, most: int = 200) -> str:
    """A picture of a small table of (row, column, value), such as a matrix of rule types; larger ones are refused."""
    found = cells.groupBy(row, column).agg(F.sum(value).cast("double").alias("v")).limit(most * most + 1).collect()
    names = [sorted({str(r[i]) for r in found}) for i in (0, 1)]
    if len(found) > most * most or max(map(len, names)) > most:
        raise ValueError(f"more than {most} rows or columns")
    high = max((abs(r.v or 0.0) for r in found), default=0.0) or 1.0
    text = lambda x, y, t: f'<text x="{x}" y="{y}" font-size="10">{escape(t)}</text>'
    parts = [text(4, 44 + 20 * i, n) for i, n in enumerate(names[0])] + [text(124 + 60 * j, 20, n) for j, n in enumerate(names[1])]
    for r in found:
        x, y = 120 + 60 * names[1].index(str(r[1])), 30 + 20 * names[0].index(str(r[0]))
        parts.append(f'<rect x="{x}" y="{y}" width="60" height="20" fill="#2060c0" fill-opacity="{abs(r.v or 0.0) / high:.3f}"/>' + text(x + 4, y + 14, f"{r.v or 0.0:g}"))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{130 + 60 * len(names[1])}" height="{40 + 20 * len(names[0])}">{"".join(parts)}</svg>'
