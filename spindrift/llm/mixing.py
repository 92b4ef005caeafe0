"""Mixing sources to target weights by min-cost flow over membership patterns.

``mix`` takes documents that may each belong to several sources. It aggregates their sizes by
membership pattern, routes each pattern's token capacity to its sources' quotas by min-cost flow,
and picks documents in a seeded order. Capacity comes in ``max_repeats`` layers of one copy each,
and the k-th copy costs k - 1 per token, so a document repeats only where fresh ones run out.

Selection: a pattern's documents lie on a line in the order of md5(seed:id:key), where the key tells
rows of one id apart (a digest of the text), so that reruns agree; the line is laid down
once per copy, and the first F tokens of it are taken, F being the pattern's flow. A copy is taken
when its middle lies before F, so a pattern misses its flow by half a document at most. The
sources that share a pattern own consecutive stretches of it.

Prefix sums are taken per (pattern, first three hex digits of the md5): 4096 slices a pattern, so
a source with a third of all rows, or rows that all lack an id, are cut like any other; slice offsets come from a table of 4096
rows a pattern. The driver sees one row per pattern (``max_patterns`` bounds them; more raise an
error) and never a document.

Defined results: a null source is a source of its own, last in order; a null or empty text has
size 0 and is taken 0 times; repeated rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import WORD, staged, table, text_or_empty

MAX_REPEATS = 3
SEED = 7


def level_targets(sizes: list[int], weights: list[int], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap * its size, the excess reshared by weight."""
    total = float(sum(sizes))
    order = sorted((i for i in range(len(sizes))), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, weight = total, sum(weights)
    level = 0.0
    for i in order:
        level = left / weight
        if level <= cap * sizes[i] / weights[i]:
            break
        left -= cap * sizes[i]
        weight -= weights[i]
    return [float(min(cap * s, level * w)) for s, w in zip(sizes, weights, strict=True)]


def min_cost_flow(patterns: list[tuple[int, list[int]]], quotas: list[int], layers: int) -> list[dict[int, int]]:
    """Tokens each pattern (capacity, its sources) gives each source: a maximal flow and, among
    those, one of least repetition cost. Primal and dual steps in turn: the distances of all nodes,
    then as much flow as goes along shortest paths, by whole blocking flows. Distances only grow
    and are few, since a copy costs at most ``layers`` - 1."""
    n, m = len(patterns), len(quotas)
    source, sink = n + m, n + m + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, c: int, w: int) -> None:
        for x, y, z in ((v, c, w), (u, 0, -w)):
            out[u if x == v else v].append(len(to))
            to.append(x)
            cap.append(y)
            cost.append(z)

    big = sum(quotas) + 1
    for p, (size, members) in enumerate(patterns):
        for k in range(layers):
            arc(source, p, size, k)
        for s in members:
            arc(p, n + s, big, 0)
    for s, q in enumerate(quotas):
        arc(n + s, sink, q, 0)
    nodes, far = n + m + 2, 1 << 60
    while True:
        dist = [far] * nodes
        dist[source] = 0
        queue, queued = deque([source]), [False] * nodes
        while queue:
            u = queue.popleft()
            queued[u] = False
            for e in out[u]:
                if cap[e] and dist[u] + cost[e] < dist[v := to[e]]:
                    dist[v] = dist[u] + cost[e]
                    if not queued[v]:
                        queue.append(v)
                        queued[v] = True
        if dist[sink] == far:
            break
        while True:  # blocking flows along shortest paths, of ever more arcs
            level = [-1] * nodes
            level[source] = 0
            queue = deque([source])
            while queue and level[sink] < 0:
                u = queue.popleft()
                for e in out[u]:
                    if cap[e] and level[v := to[e]] < 0 and dist[v] == dist[u] + cost[e]:
                        level[v] = level[u] + 1
                        queue.append(v)
            if level[sink] < 0:
                break
            nth, path, u = [0] * nodes, [], source
            while True:
                if u == sink:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    full = next(i for i, e in enumerate(path) if not cap[e])
                    u = to[path[full] ^ 1]
                    del path[full:]
                arcs = out[u]
                while nth[u] < len(arcs):
                    e = arcs[nth[u]]
                    v = to[e]
                    if cap[e] and level[v] == level[u] + 1 and dist[v] == dist[u] + cost[e]:
                        break
                    nth[u] += 1
                if nth[u] < len(arcs):
                    path.append(e)
                    u = v
                elif path:
                    u = to[path.pop() ^ 1]
                    nth[u] += 1
                else:
                    break
    flows: list[dict[int, int]] = []
    for p in range(n):
        flows.append({to[e] - n: cap[e ^ 1] for e in out[p] if n <= to[e] < n + m and e % 2 == 0 and cap[e ^ 1]})
    return flows


def _pattern():
    return F.to_json(F.sort_array(F.array_distinct("members")))


def mix(sized: DataFrame, quotas: dict[str | None, int], max_repeats: int = MAX_REPEATS, seed: int = SEED, max_patterns: int = 2_000_000, key_col: str | None = None) -> DataFrame:
    """``sized``: doc_id, size, members (array of source names), and ``key_col``, a text that tells
    rows of one id apart. Returns its rows with ``pattern``,
    ``copies``, ``taken`` (tokens) and ``taken_for`` (the source each copy counts for). The driver
    routes a row for each pattern; more than ``max_patterns`` of them raise an error, nothing is left out."""
    spark = sized.sparkSession
    rows = sized.withColumn("pattern", _pattern())
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).orderBy("pattern").limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    flows = min_cost_flow([(r["size"] or 0, sorted({place[s] for s in r["members"] if s in place})) for r in found], [quotas[s] for s in names], max_repeats)
    plan = []
    for r, flow in zip(found, flows, strict=True):
        cuts, owners, at = [], [], 0
        for s in sorted(flow):
            at += flow[s]
            cuts.append(at)
            owners.append(names[s])
        plan.append((r["pattern"], r["size"] or 0, at, cuts, owners))
    routed = spark.createDataFrame(plan, "pattern string, pattern_size long, flow long, cuts array<long>, owners array<string>")

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), *([F.col(key_col)] if key_col else [])))
    rows = rows.withColumn("order_key", key).withColumn("slice", F.substring("order_key", 1, 3))
    before = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("pattern", "slice").agg(F.sum("size").alias("slice_size")).select("pattern", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("slice_start"))
    within = Window.partitionBy("pattern", "slice").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, ["pattern", "slice"])
        .join(F.broadcast(routed), "pattern")  # max_patterns rows at most
        .withColumn("start", F.col("slice_start") + F.col("within"))
    )
    # twice the middle of copy c, so that all stays in whole numbers
    middle = lambda c: (F.col("start") + c * F.col("pattern_size")) * 2 + F.col("size")
    taken = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max_repeats - 1).cast("long")), lambda c: middle(c) < F.col("flow") * 2)
    placed = placed.withColumn("copy", F.when(F.col("size") > 0, taken).otherwise(F.array().cast("array<bigint>")))
    owner = F.transform("copy", lambda c: F.element_at("owners", F.size(F.filter("cuts", lambda x: x * 2 <= middle(c))) + 1))
    return placed.select(
        *[F.col(c) for c in sized.columns],
        "pattern",
        F.size("copy").alias("copies"),
        (F.size("copy") * F.col("size")).cast("long").alias("taken"),
        owner.alias("taken_for"),
    )


def source_targets(by_source: list[tuple[str | None, int]], cap: int = MAX_REPEATS) -> dict[str | None, float]:
    """Sources by code point, null last, weigh 1, 2, 3, 1, ...; targets by ``level_targets``."""
    ordered = sorted(by_source, key=lambda r: (r[0] is None, r[0] or ""))
    targets = level_targets([n for _, n in ordered], [i % 3 + 1 for i in range(len(ordered))], cap)
    return {s: t for (s, _), t in zip(ordered, targets, strict=True)}


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix of all rows at 100 % of their size: doc_id, size, source_size, target, taken,
    source, copies, and text_key, the md5 of the text."""
    sized = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            F.md5(text_or_empty().cast("binary")).alias("text_key"),
        ),
        "mix-sizes",
    )
    sizes = [(r[0], r[1] or 0) for r in sized.groupBy("source").agg(F.sum("size")).collect()]  # one row a source
    targets = source_targets(sizes)
    known = sized.sparkSession.createDataFrame(
        [(s, n, round(targets[s], 6)) for s, n in sizes],
        T.StructType([T.StructField("name", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]),
    )
    mixed = mix(sized.withColumn("members", F.array("source")), {s: int(targets[s] + 0.5) for s, _ in sizes}, key_col="text_key")
    return mixed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "text_key")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all its columns."""
    taken = mixed_documents(docs).where("copies > 0").groupBy(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key"), F.col("source").alias("mix_source")).agg(F.sum("copies").cast("int").alias("mix_copies"))
    mine = docs.withColumn("mix_hash", F.md5(text_or_empty().cast("binary")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("mix_id")) & (F.col("mix_hash") == F.col("mix_key")) & F.col("source").eqNullSafe(F.col("mix_source"))
    # rows alike in id, text and source are one by now; their copies were summed up
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text", "source") and not kind.startswith(("map", "variant"))]
    first = Window.partitionBy("doc_id", "mix_hash", "source").orderBy(*others, "mix_key")
    once = mine.join(taken, same).withColumn("mix_nth", F.row_number().over(first)).where("mix_nth = 1")
    return once.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents")).drop("text_key")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(text, '')) AS text_key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS ratio,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, (source IS NULL), encode(source)) AS k FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lvl FROM r
), f AS (SELECT min_by(lvl, k) AS lvl FROM l WHERE lvl <= ratio),
t AS (
  SELECT r.source, r.source_size, least(3.0::DOUBLE * r.source_size, f.lvl * r.w) AS target FROM r, f
), o AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS q,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.text_key), d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * ((2 * pos + size < 2 * q)::BIGINT + (2 * (pos + source_size) + size < 2 * q)::BIGINT
            + (2 * (pos + 2 * source_size) + size < 2 * q)::BIGINT) AS BIGINT) AS taken,
       source,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (2 * pos + size < 2 * q)::INT + (2 * (pos + source_size) + size < 2 * q)::INT
            + (2 * (pos + 2 * source_size) + size < 2 * q)::INT END AS INTEGER) AS copies
FROM o
"""
