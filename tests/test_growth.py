"""Work of the panel's shared steps: what is shuffled, and results against plain versions."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from spindrift.operators import curves, mining, series, signals


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _shuffled_rows(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _history(spark, games: int, months: int, seed: int = 3):
    rng = random.Random(seed)
    day = lambda k: dt.date(2015 + k // 12, k % 12 + 1, 1)
    rows = [(g, f"c{g % 2}", c, day(k), rng.randrange(500, 900)) for g in range(games) for c in ("loose", "cib", "new") for k in range(months) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "game_id long, console string, condition string, month date, price_cents long")


def test_kept_history_is_shuffled_no_more(spark):
    history = _history(spark, 12, 40)
    kept = series.by_title(history.repartition("game_id")).persist()
    n = kept.count()
    for made, most in ((series.monthly_returns, 0), (series.dense_panel, n // 4)):  # the calendars have a row a group and task
        before = _shuffled_rows(spark)
        rows = made(kept).collect()
        assert _shuffled_rows(spark) - before <= most
        assert sorted(map(str, rows)) == sorted(map(str, made(history).collect()))
    kept.unpersist()


def test_a_rule_meets_rows_of_its_rarest_item_alone(spark):
    rng = random.Random(5)
    facts = [(g, "loose", "nes", 1.0, "all", f"p{g % 40}", rng.choice("xyz")) for g in range(400)]
    rows = spark.createDataFrame(facts, "game_id long, condition string, console string, rising double, genre string, publisher string, era string")
    made = [("loose", mining.SEPARATOR.join(sorted(["genre=all", f"publisher=p{p}", f"era={e}"])), 1.5 + p / 100, 3 * p + k + 1) for p in range(40) for k, e in enumerate("xyz")]
    made += [("loose", "era=x & genre=none", 3.0, 500), ("cib", "genre=all", 2.0, 1), ("loose", "genre=all", 0.9, 501)]
    rules = spark.createDataFrame(made, "condition string, items string, lift_lo double, nth int")
    before = _shuffled_rows(spark)
    got = {r.game_id: r for r in mining.match_patterns(rows, rules).collect()}
    assert _shuffled_rows(spark) - before < 8_000  # 400 rows x 120 rules share an item
    for g, _, _, _, genre, publisher, era in facts:
        holds = [r for r in made if r[0] == "loose" and r[2] > 1 and set(r[1].split(mining.SEPARATOR)) <= {f"genre={genre}", f"publisher={publisher}", f"era={era}"}]
        assert len(holds) == 1 and got[g].matched == holds[0][1] and math.isclose(got[g].pattern_score, math.log(holds[0][2]))


def test_curves_make_their_panel_once(spark):
    history = _history(spark, 30, 70).persist()
    index = series.console_index(history).persist()
    n, _ = history.count(), index.count()
    before = _shuffled_rows(spark)
    assert curves.curve_matrix(history, index).count() == 90
    assert _shuffled_rows(spark) - before < 1.5 * n


def test_ratio_changes_need_no_dense_panel(spark):
    history = _history(spark, 6, 40).unionByName(spark.createDataFrame([(0, "c0", "cib", dt.date(2015, 1, 1), 5000)], "game_id long, console string, condition string, month date, price_cents long"))
    made = signals.cib_loose_change(history)
    assert "Generate explode" not in _plan(made)
    price = {}
    for r in history.collect():
        price[r.game_id, r.condition, r.month] = max(r.price_cents, price.get((r.game_id, r.condition, r.month), 0))
    gap = {(g, m): math.log(p) - math.log(price[g, "loose", m]) for (g, c, m), p in price.items() if c == "cib" and (g, "loose", m) in price}
    want = {(g, m): x - gap[g, m.replace(year=m.year - 1)] for (g, m), x in gap.items() if (g, m.replace(year=m.year - 1)) in gap}
    got = {(r.game_id, r.month): r.cib_loose_change_12m for r in made.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want) and len(want) > 50
