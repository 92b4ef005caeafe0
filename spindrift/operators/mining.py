"""Lift of single factors, non-redundant factor combinations, and matching them to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.staging import unwritten, written

SEPARATOR = " & "


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of k successes in n trials; (0, 1) without a trial."""
    n_ = n.cast("double")
    p, zz = F.try_divide(k.cast("double"), n_), z * z
    scale = 1 + F.try_divide(F.lit(zz), n_)
    middle = (p + F.try_divide(F.lit(zz / 2), n_)) / scale
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n_) + F.try_divide(F.lit(zz / 4), n_ * n_)) / scale
    return F.coalesce(middle - spread, F.lit(0.0)), F.coalesce(middle + spread, F.lit(1.0))


def measured(df: DataFrame) -> DataFrame:
    """Adds rate, lift and the interval's bounds over the base rate, from k, n and base."""
    lo, hi = wilson(F.col("k"), F.col("n"))
    return df.withColumns({"rate": F.col("k") / F.col("n"), "lift": F.col("k") / F.col("n") / F.col("base"), "lift_lo": lo / F.col("base"), "lift_hi": hi / F.col("base")})


def _base(rows: DataFrame) -> DataFrame:
    """condition, base, labelled: the rate of rising of each condition that has any."""
    return rows.groupBy("condition").agg(F.avg("rising").alias("base"), F.count("*").alias("labelled")).where("base > 0")


def unpivoted(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(*keys, pair.alias("fv")).select(*keys, "fv.factor", "fv.value")


def factor_lift(factors: DataFrame, columns: list[str], min_support: int = 30) -> DataFrame:
    """Per condition, factor and value: n, k, rate, lift and its interval. Conditions are a few,
    so the base rates are joined by broadcast."""
    rows = factors.where(F.col("rising").isNotNull())
    per = unpivoted(rows, ["condition", "rising"], columns).groupBy("condition", "factor", "value").agg(F.count("*").alias("n"), F.sum("rising").alias("k"))
    kept = per.where((F.col("n") >= min_support) & ~(F.col("factor").startswith("kw_") & (F.col("value") == "no")))
    return measured(kept.join(F.broadcast(_base(rows)), "condition")).select("condition", "factor", "value", "n", "k", "base", "rate", "lift", "lift_lo", "lift_hi")


def items(factors: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long items: keys, factor, item ('factor=value'); unknown values and absent keywords are none."""
    long = unpivoted(factors, keys, columns)
    return long.where(F.col("value").isNotNull() & (F.col("value") != "unknown") & ~(F.col("factor").startswith("kw_") & (F.col("value") == "no"))).select(*keys, "factor", F.concat("factor", F.lit("="), "value").alias("item"))


def _grown(rows: DataFrame, base: DataFrame, min_count: int, max_len: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Frequent combinations by conditional tables, level by level: (all that were looked at,
    measured; per level the rows of each combination that is grown on: condition, items, row, rest,
    rising; tables to remove).

    ``rows``: condition, row (one column), rising, held (sorted items). The conditional table of a combination
    has a row for each row that holds it, with the items it may be grown by. Only combinations with lift 1 or more
    have one. Extensions are counted by (combination, item), summed up before the shuffle; a
    combination reached from several parts has the same count from each, and the first one's rows."""
    tables: list[DataFrame] = []
    level = rows.select("condition", F.array().cast("array<string>").alias("items"), "row", "rising", F.col("held").alias("rest"))
    reached, grown = [], []
    for size in range(1, max_len + 1):
        each = level.select("condition", "items", "row", "rising", "rest", F.explode("rest").alias("item"))
        counted = each.groupBy("condition", "items", "item").agg(F.count("*").alias("n"), F.sum("rising").alias("k")).where(F.col("n") >= min_count)
        whole = F.array_sort(F.array_append("items", F.col("item")))
        found = counted.groupBy("condition", whole.alias("whole")).agg(F.first("n").alias("n"), F.first("k").alias("k"), F.min(F.struct("items", "item")).alias("part"))
        kept = written(measured(found.join(F.broadcast(base), "condition")), "pattern-level")  # a row per condition
        tables.append(kept)
        reached.append(kept.select("condition", F.col("whole").alias("items"), *MEASURES))
        risen = kept.where("lift >= 1").select("condition", "part.items", "part.item", "whole")
        on = each.join(risen, ["condition", "items", "item"]).select("condition", F.col("whole").alias("items"), "row", "rising", F.array_except("rest", F.array("item")).alias("rest"))
        level = written(on, "pattern-rows")
        tables.append(level)
        grown.append(level)
        if size < max_len and not level.limit(1).count():
            break
    every = reached[0]
    for more in reached[1:]:
        every = every.unionByName(more)
    return every, grown, tables


MEASURES = ["n", "k", "base", "labelled", "rate", "lift", "lift_lo", "lift_hi"]


def _proper_parts(items: Column, size: int) -> Column:
    """All parts of an array of ``size`` items but the whole and the empty one, each in its order."""
    picks = [[i for i in range(size) if mask >> i & 1] for mask in range(1, (1 << size) - 1)]
    return F.array(*[F.array(*[F.get(items, i) for i in pick]) for pick in picks]) if picks else F.array().cast("array<array<string>>")


def mine_patterns(factors: DataFrame, columns: list[str], excess: str = "excess_36m", min_count: int = 30, max_len: int = 3, min_lift: float = 1.5, min_gain: float = 0.1, examples: int = 5) -> DataFrame:
    """Combinations of up to ``max_len`` items with a lift that no part of them explains.

    A combination is looked at if it is frequent and one of its parts with one item less was
    looked at and had lift 1 or more. A row has one item a factor at most, so a combination holds
    no factor twice."""
    labelled = factors.where(F.col("rising").isNotNull())
    item = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != "unknown") & ((F.col(c) != "no") if c.startswith("kw_") else F.lit(True)), F.concat(F.lit(f"{c}="), c))
    held = F.array_sort(F.array_compact(F.array(*[item(c) for c in columns])))
    rows = written(labelled.select("condition", F.struct("game_id", F.col(excess).alias("excess")).alias("row"), "rising", held.alias("held")), "pattern-rows")
    every, grown, tables = _grown(rows, _base(rows), min_count, max_len)
    looked_at = every.select("condition", "items", "lift")
    good = every.where(F.col("lift") >= min_lift)
    # a part that wasn't looked at counts 0, so it explains only what gains less than that
    sizes = range(2, max_len + 1)
    parts = F.array().cast("array<array<string>>")
    for size in sizes:
        parts = F.when(F.size("items") == size, _proper_parts(F.col("items"), size)).otherwise(parts)
    part = good.select("condition", F.col("items").alias("whole"), F.col("lift").alias("whole_lift"), F.explode(parts).alias("items"))
    explained = part.join(looked_at, ["condition", "items"], "left").where(F.col("whole_lift") < F.coalesce("lift", F.lit(0.0)) + min_gain).select("condition", F.col("whole").alias("items")).distinct()
    found = good.join(explained, ["condition", "items"], "left_anti")

    # the first rising rows of each: a combination with lift 1.5 has its own table
    order = F.struct(F.col("row.excess").isNull().alias("none"), (-F.col("row.excess")).alias("excess"), F.col("row.game_id").alias("game_id"))
    shown = None
    for level in grown:
        own = level.where("rising = 1").join(found.select("condition", "items"), ["condition", "items"], "left_semi")
        nth = F.row_number().over(Window.partitionBy("condition", "items").orderBy(order))
        best = own.withColumn("nth", nth).where(F.col("nth") <= examples).select("condition", "items", "nth", "row.game_id")
        shown = best if shown is None else shown.unionByName(best)
    ids = shown.groupBy("condition", "items").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "game_id"))), lambda x: x["game_id"]).alias("ids"))  # ``examples`` rows
    done = found.join(ids, ["condition", "items"], "left")
    out = done.select(
        "condition",
        F.array_join("items", SEPARATOR).alias("items"),
        F.size("items").alias("size"),
        "n",
        "k",
        (F.col("n") / F.col("labelled")).alias("support"),
        F.col("rate").alias("confidence"),
        "lift",
        "lift_lo",
        "lift_hi",
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("examples"),
    )
    out = written(out, "patterns")
    unwritten(rows, *tables)
    return out


def match_patterns(factors: DataFrame, patterns: DataFrame, keep: int = 3) -> DataFrame:
    """Per row: pattern_score, the sum of ln(lift_lo) over the rules of its condition (lift_lo over
    1) that hold for it, and ``matched``, the first of them. Rules: condition, items, lift_lo, nth."""
    row = ["condition", "game_id"]
    columns = [c for c in factors.columns if c not in (*row, "console", "rising") and dict(factors.dtypes)[c] == "string"]
    held = items(factors, row, columns).groupBy(*row).agg(F.collect_set("item").alias("held"))  # an item a factor
    long = written(held.select(*row, "held", F.explode("held").alias("item")), "held")  # read for the counts and for the rows
    # a rule is looked for where its rarest item is, and its other items there; no row meets a rule twice
    many = long.groupBy("condition", "item").agg(F.count("*").alias("many"))
    rules = patterns.where("lift_lo > 1").select("condition", "items", "lift_lo", "nth", F.split("items", SEPARATOR).alias("parts"))
    each = rules.select("*", F.explode("parts").alias("item")).join(many, ["condition", "item"], "left")
    rarest = F.min_by("item", F.struct(F.coalesce("many", F.lit(0)).alias("many"), "item"))
    keyed = each.groupBy("condition", "items", "lift_lo", "nth", "parts").agg(rarest.alias("item"))
    holds = long.join(keyed, ["condition", "item"]).where(F.size(F.array_except("parts", "held")) == 0)
    # summed up in the rules' order, so that rows of the same rules have the very same score
    held = F.array_sort(F.collect_list(F.struct("nth", "items", F.log("lift_lo").alias("gain"))))
    first = F.slice("held", 1, keep)
    score = F.aggregate("held", F.lit(0.0), lambda acc, x: acc + x["gain"])
    hits = holds.groupBy(*row).agg(held.alias("held")).select(*row, score.alias("pattern_score"), F.array_join(F.transform(first, lambda x: x["items"]), " | ").alias("matched"))
    return factors.select(row).join(hits, row, "left").select(*row, F.coalesce("pattern_score", F.lit(0.0)).alias("pattern_score"), F.coalesce("matched", F.lit("")).alias("matched"))
