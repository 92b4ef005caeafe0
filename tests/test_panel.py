"""The panel operators against closed forms and planted effects; the registry against DuckDB."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import curves, factors, forecast, mining, series, signals
from spindrift.operators.watchlist import zscored
from spindrift.plans import analyze, report, serve, store
from spindrift.sources import model, parse
from spindrift.sources.synthetic import synthetic

D = dt.date


def month(k):
    return D(2010 + k // 12, k % 12 + 1, 1)


def hist(spark, rows):
    return spark.createDataFrame(rows, "game_id long, console string, condition string, month date, price_cents long")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][0]


def test_a_gap_breaks_the_chain(spark):
    h = hist(spark, [(1, "nes", "loose", D(2020, m, 1), p) for m, p in ((1, 100), (2, 110), (4, 121), (5, 121))])
    got = {r.month: r.ret for r in series.monthly_returns(h).collect()}
    assert got == {D(2020, 2, 1): pytest.approx(math.log(1.1)), D(2020, 5, 1): 0.0}


def test_index_takes_the_median_of_enough_titles(spark):
    rows = [(g, "nes", "loose", D(2020, m + 1, 1), round(1e6 * math.exp((0.9 if g == 5 else 0.01) * m))) for g in range(1, 6) for m in range(3)]
    got = [(r.n, r.level) for r in series.console_index(hist(spark, rows), 3).orderBy("month").collect()]
    assert [n for n, _ in got] == [0, 5, 5] and [x for _, x in got] == pytest.approx([0, 0.01, 0.02], abs=1e-5)
    thin = series.console_index(hist(spark, rows[:2]), 5).orderBy("month").collect()
    assert thin[-1].ret is None and thin[-1].level == 0


def test_metrics_closed_forms(spark):
    def price(g, k):
        return {1: 0.0, 2: 0.02 * k, 3: 1.0 if k == 30 else 0.0}.get(g, 0.005 * k)

    rows = [(g, "nes", "loose", month(k), round(1e9 * math.exp(price(g, k)))) for g in range(1, 9) for k in range(48)]
    h = hist(spark, rows)
    got = {r.game_id: r for r in series.series_metrics(h, series.console_index(h)).collect()}
    assert got[2].ret_36m == pytest.approx(0.72, abs=1e-6) and got[2].excess_36m == pytest.approx(0.54, abs=1e-6) and got[1].excess_36m == pytest.approx(-0.18, abs=1e-6)
    assert got[2].ret_60m is None and got[2].ret_all == pytest.approx(0.94, abs=1e-6) and got[2].slope_36m == pytest.approx(0.24, abs=1e-6) and got[2].vol_36m == pytest.approx(0, abs=1e-6)
    assert got[3].max_drawdown == pytest.approx(math.exp(-1) - 1, abs=1e-6) and got[3].jump_month == month(30) and got[3].jump_size == pytest.approx(1, abs=1e-6)
    assert got[1].obs_36m == 37 and got[1].n_months == 48
    past = {r.game_id: r for r in series.series_metrics(h, series.console_index(h), month(23)).collect()}
    assert past[2].ret_12m == pytest.approx(0.24, abs=1e-6) and past[2].ret_36m is None


def test_label_ties_and_small_groups(spark):
    def labels(values, n=30):
        rows = [(g, "nes", "loose", x, n) for g, x in enumerate(values)]
        df = spark.createDataFrame(rows, "game_id long, console string, condition string, excess_36m double, n_months int")
        return [r.rising for r in series.label_rising(df).orderBy("game_id").collect()]

    assert labels([float(k) for k in range(10)]) == [0.0] * 8 + [1.0] * 2
    assert labels([1.0] * 10) == [1.0] * 10 and labels([1.0] * 9) == [None] * 9 and labels([1.0] * 10, 5) == [None] * 10


def test_franchises_and_keywords(spark):
    names = ["Super Mario Bros", "Pokémon Red", "Probotector", "Kirby's Mega Man Limited", "Tetris", None, "StarFox", "4 in 1 Player's Choice"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    rows = df.select("i", factors.franchise(F.col("name")).alias("f"), *factors.keyword_flags(F.col("name"))).orderBy("i").collect()
    assert [r.f for r in rows] == ["mario", "pokemon", "contra", "kirby", "none", "none", "star fox", "none"]
    assert rows[3].kw_limited == "yes" and rows[7].kw_bundle == "yes" and rows[7].kw_budget_reprint == "yes" and rows[0].kw_demo == "no"


def test_top_n(spark):
    df = spark.createDataFrame([(x,) for x in ["A"] * 5 + ["B"] * 3 + ["C", None]], "p string")
    got = {r.p: r["count"] for r in factors.top_n(df, "p", 2).groupBy("p").count().collect()}
    assert got == {"A": 5, "B": 3, "other": 1, "unknown": 1}


def test_price_factors(spark):
    h = hist(spark, [(1, "nes", "loose", D(2022, 12, 1), 1000), (1, "nes", "cib", D(2023, 1, 1), 2000), (1, "nes", "new", D(2022, 1, 1), 9000), (2, "nes", "loose", D(2023, 1, 1), 50000)])
    got = {(r.game_id, r.condition): r for r in factors.price_factors(h, "2023-01-01").collect()}
    assert got[(1, "loose")].price_bucket == "<$20" and got[(1, "cib")].price_bucket == "$20-100" and (1, "new") not in got
    assert got[(1, "loose")].cib_loose == "1.5-3x" and got[(1, "loose")].new_cib == "unknown" and got[(2, "loose")].price_bucket == "$500+"


def test_wilson(spark):
    lo, hi = mining.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(20, 100), (0, 0)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert got[0].lo == pytest.approx(0.1334, abs=1e-4) and got[0].hi == pytest.approx(0.2888, abs=1e-4) and tuple(got[1]) == (0, 1)


def test_patterns_find_the_combination_alone(spark):
    rows = []
    for i in range(1200):
        g, r, kw = "RPG" if i % 3 == 0 else "Action", "pal" if i % 2 == 0 else "ntsc", "yes" if i % 7 == 0 else "no"
        hot = g == "RPG" and r == "pal"
        rows.append((i, "loose", g, r, kw, float((i // 6) % 10 < (6 if hot else 1)), float(i)))
    df = spark.createDataFrame(rows, "game_id long, condition string, genre string, region string, kw_limited string, rising double, excess_36m double")
    got = mining.mine_patterns(df, ["genre", "region", "kw_limited"]).orderBy(F.desc("lift_lo")).collect()
    assert got[0]["items"] == "genre=RPG & region=pal" and not any("kw_" in r["items"] and r["size"] == 3 for r in got)
    best = max(i for i, _, g, r, _, up, _ in rows if g == "RPG" and r == "pal" and up)
    assert got[0].examples.split(",")[0] == str(best)
    rules = spark.createDataFrame([("loose", "genre=RPG & region=pal", 3.0, 1), ("loose", "genre=RPG", 1.5, 2), ("cib", "genre=RPG", 9.0, 1)], "condition string, items string, lift_lo double, nth int")
    score = {r.game_id: (r.pattern_score, r.matched) for r in mining.match_patterns(df, rules).collect()}
    assert score[0] == (pytest.approx(math.log(3) + math.log(1.5)), "genre=RPG & region=pal | genre=RPG") and score[3][0] == pytest.approx(math.log(1.5)) and score[1] == (0.0, "")


def test_shapes(spark):
    n = 24
    shapes = {"flat": [0.0] * n, "steady climber": [k / 24 for k in range(n)], "decliner": [-k / 24 for k in range(n)], "late surge": [0.0] * 18 + [k / 5 for k in range(6)], "spike & fade": [1 - abs(k - 12) / 12 for k in range(n)]}
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(shapes.items())], "i int, want string, curve array<double>")
    assert all(r.want == r.got for r in df.select("want", curves.shape_of(F.col("curve")).alias("got")).collect())
    many = spark.createDataFrame([(i, [x * (i + 1) for x in shapes["steady climber"]]) for i in range(4)], "cluster int, centroid array<double>")
    assert {r.cluster: r["shape"] for r in curves.named_shapes(many).collect()} == {3: "strong steady climber", 2: "moderate steady climber", 1: "mild steady climber", 0: "steady climber #4"}


def test_thinning(spark):
    months = [D(2020, 1, 1), D(2020, 6, 1), D(2021, 1, 1), D(2021, 12, 1), D(2022, 5, 1)]
    df = spark.createDataFrame([(months,)], "m array<date>")
    assert one(df.select(signals.thinned(F.col("m")))) == [months[0], months[2], months[4]]


def test_mann_whitney(spark):
    rows = [("loose", 1, float(10 + k % 5)) for k in range(12)] + [("loose", 0, float(k % 8)) for k in range(24)]
    r = signals.compare(spark.createDataFrame(rows, "condition string, breakout int, x double"), ["x"]).first()
    assert r.u == 12 * 24 and r.d > 2 and text.unit_normal_two_sided(r.z) < 1e-5


def test_scalars(spark):
    df = spark.createDataFrame([("$39,600.51", " N/a ", "June 5, 1990", "3,1,3,x"), ("-", " a  b ", "1990", ""), (None, None, "May 1991", None), ("1.2.3", "none", "1990-02-03", "1,2,3,4,5,6,7")], "p string, c string, d string, i string")
    rows = df.select(text.price_cents(F.col("p")).alias("p"), text.clean_text(F.col("c")).alias("c"), text.iso_date(F.col("d")).alias("d"), text.split_ids(F.col("i")).alias("i")).collect()
    assert [r.p for r in rows] == [3960051, None, None, None] and [r.c for r in rows] == [None, "a b", None, None]
    assert [r.d for r in rows] == [D(1990, 6, 5), D(1990, 1, 1), D(1991, 5, 1), D(1990, 2, 3)] and rows[0].i == [3, 1] and rows[3].i == [1, 2, 3, 4, 5, 6]
    pct = spark.createDataFrame([(0.123,), (-0.03,), (0.001,)], "x double").select(text.signed_percent(F.col("x"))).collect()
    assert [r[0] for r in pct] == ["+12%", "−3%", "0%"]


def test_zscore(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "condition string, x double")
    assert sorted(r[0] for r in zscored(df, "x", "z").select("z").collect()) == [-1, 0, 0, 1]


def test_consoles():
    assert len(model.CONSOLES) == 48 and model.CONSOLES["famicom"] == ("nes", "ntsc-j") and "jp-wii" in model.CONSOLES
    assert model.resolve_consoles(["nes", "pal-wii", "nes"], ["ntsc-u"]) == ["nes", "pal-wii"]
    with pytest.raises(ValueError):
        model.resolve_consoles(["atari"])


def test_upserts_and_queue(spark):
    game = model.SCHEMAS["games"]
    at = dt.datetime(2024, 1, 1)
    row = lambda **x: tuple(x.get(f.name) for f in game)
    games = spark.createDataFrame([row(id=1, console="nes", slug="a", name="A", genre="RPG", image_url="i", first_seen_at=at, last_detail_at=at), row(id=2, console="nes", slug="b", name="B", list_rank=2)], game)
    listed = spark.createDataFrame([(1, "nes", "a", "A2", None, 5), (3, "pal-nes", "c", "C", None, 1)], "id long, console string, slug string, name string, image_url string, list_rank int")
    new = {r.id: r for r in store.upsert_games(games, listed, "2024-02-01 00:00:00").collect()}
    assert new[1].name == "A2" and new[1].genre == "RPG" and new[1].image_url is None and new[1].first_seen_at == at and new[3].region == "pal" and new[2].name == "B"
    due = [r.id for r in store.games_due(store.upsert_games(games, listed, "2024-02-01 00:00:00"), "2024-03-01 00:00:00").collect()]
    assert due == [3, 2, 1]
    old = spark.createDataFrame([(1, "loose", D(2020, 1, 1), 5)], model.SCHEMAS["price_history"])
    fresh = spark.createDataFrame([(1, "loose", D(2020, 1, 1), 7), (1, "loose", D(2020, 2, 1), 8)], model.SCHEMAS["price_history"])
    assert sorted(r.price_cents for r in store.upsert_rows("price_history", old, fresh).collect()) == [7, 8]
    assert {r.region for r in model.migrated(games.drop("platform", "region", "esrb")).collect()} == {"ntsc-u"}


def test_parsers(spark):
    html = """<table id="attribute"><tr><td class="title">Genre:</td><td class="details"> RPG </td></tr><tr><td class="title">Release Date:</td><td class="details">June 5, 1990</td></tr>
    <tr><td class="title">X ID:</td><td class="details">7</td></tr></table><td id="used_price"><span class="price">$12.50</span></td>
    <div class="completed-auctions-used"><table><tbody><tr id="ebay-1"><td class="date">2024-01-02</td><td class="title"><a href="/u">T</a> [eBay]</td><td class="numeric"><span class="js-price">$3.00</span></td></tr>
    <tr><td class="date">2024-01-03</td><td class="title">U [Shop]</td><td class="numeric"><span class="js-price">$4.00</span></td></tr></tbody></table></div>
    <script>V.chart_data = {"used":[[1577836800000,100],[1580515200000,0]],"cib":[],"new":[[1577836800000,900]]};</script>"""
    pages = spark.createDataFrame([(7, html), (8, None)], "game_id long, html string")
    details, sales = parse.detail_pages(pages)
    d = {r.game_id: r for r in details.collect()}
    assert d[7].genre == "RPG" and d[7].release_date == D(1990, 6, 5) and d[7].pc_id == 7 and d[7].loose_cents == 1250 and d[8].genre is None
    s = {r.sale_date: r for r in sales.collect()}
    assert s[D(2024, 1, 2)].sale_id == "ebay-1" and s[D(2024, 1, 2)].source == "ebay" and s[D(2024, 1, 3)].source == "shop" and s[D(2024, 1, 3)].sale_id.startswith("h-")
    assert sorted((r.condition, r.month, r.price_cents) for r in parse.chart_points(pages).collect()) == [("loose", D(2020, 1, 1), 100), ("new", D(2020, 1, 1), 900)]
    good, bad = store.checked_details(details)
    assert bad.count() == 0 and good.count() == 2
    p = spark.createDataFrame([('{"id":"5","consoleUri":"nes","productUri":"x","productName":"X","price1":"$1.00","price2":"$3.00","price3":"-"}',)], "json string")
    r = parse.list_products(p).first()
    assert (r.id, r.loose_cents, r.new_cents, r.cib_cents) == (5, 100, 300, None)


def test_the_whole_analysis_is_stored_and_reported(spark, tmp_path):
    """A small panel through every step, with a short model check: persisted, loaded, shown."""
    games, prices, sales = synthetic(spark, 10)
    h = model.scan_history(prices.where("month >= '2016-01-01'").cache(), games.cache())
    done = analyze.analyze(h, games, sales, model=True, rounds=2, repeats=1, clusters=2)
    st = store.Store(spark, str(tmp_path))
    assert analyze.load_stored(st, games) is None
    assert analyze.persist(st, done) == 1
    again = analyze.load_stored(st, games)
    assert again.params["n_series"] == done.params["n_series"] and again.model.keys() == done.model.keys()
    a, b = report.context(done), report.context(again)
    assert a["factors"] == b["factors"] and a["patterns"] == b["patterns"] and a["watch"] == b["watch"] and a["clusters"] == b["clusters"] and a["signals"] == b["signals"]
    assert sum(c["n"] for c in a["clusters"]) > 0 and a["index"] and "<script" in report.render(b)


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="takes minutes; set SLOW_TESTS")
def test_planted_effects_and_store(spark, tmp_path):
    games, prices, sales = synthetic(spark, 40)
    h = model.scan_history(prices.cache(), games.cache())
    done = analyze.analyze(h, games, sales, model=False, clusters=3)
    assert 0.15 < done.params["base_rate"] < 0.3
    lift = {(r.condition, r.factor, r.value): r for r in done.tables["factor_lift"].collect()}
    assert lift[("loose", "genre", "RPG")].lift > 1.2 > lift[("loose", "genre", "Sports")].lift
    st = store.Store(spark, str(tmp_path))
    assert analyze.load_stored(st, games) is None
    assert analyze.persist(st, done) == 1
    again = analyze.load_stored(st, games)
    a, b = report.context(done), report.context(again)
    assert a["factors"] == b["factors"] and a["watch"] == b["watch"] and "<script" in report.render(b)
    assert serve.search_games(games, prices, metrics=again.tables["series_metrics"], sort="excess").count() == 50
    train, test = forecast.split_by_time(forecast.build_samples(h, done.tables["console_index"], games))
    assert train.agg(F.max("t0")).first()[0] <= test.agg(F.min("t0")).first()[0].replace(year=test.agg(F.min("t0")).first()[0].year - 3)


def test_a_later_page_of_a_title_counts(spark):
    titles = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").withColumns({c: F.lit(None).cast(model.SCHEMAS["games"][c].dataType) for c in (*store.DETAIL_COLUMNS, "last_detail_at")})
    pages = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (3, "none", 1)], "game_id long, genre string, nth int").withColumns({c: F.lit(None).cast("string") for c in store.DETAIL_COLUMNS if c != "genre"})
    assert [(r.id, r.genre) for r in store.upsert_detail(titles, pages, "2020-01-01", "nth").orderBy("id").collect()] == [(1, "new"), (2, None)]


def test_the_version_before_stays_readable(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    st.replace("t", spark.range(3))
    held = st.read("t")
    st.replace("t", held.where("id < 2"))
    assert held.count() == 3 and st.read("t").count() == 2


def test_a_stream_of_sales_is_upserted_once(spark, tmp_path):
    from spindrift.streaming import ingest

    sale = lambda k, cents, at: (1, "loose", k, D(2020, 1, 1), "t", cents, "s", "u", dt.datetime(2020, 1, at))
    for n, rows in enumerate(([sale("x", 100, 1), sale("x", 100, 1), sale("y", 5, 1)], [sale("y", 7, 9), sale("z", 3, 9)])):
        spark.createDataFrame(rows, model.SCHEMAS["sales"]).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        st = store.Store(spark, str(tmp_path / "db"))
        stream = ingest.sale_stream(spark.readStream.schema(model.SCHEMAS["sales"]).json(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(ingest.upsert_batches(st, "sales")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        got = {r.sale_id: r.price_cents for r in st.read("sales").collect()}
        assert got == ({"x": 100, "y": 5} if n == 0 else {"x": 100, "y": 5, "z": 3})  # the watermark hasn't passed y's first sale yet


def test_clusters_and_their_profile_by_property(spark):
    """Two plain families of curves: each cluster holds one, and its trait marks it."""
    rows = [("nes", "loose", g, [(0.02 if g % 2 else -0.03) * k * (1 + g / 500) for k in range(24)]) for g in range(60)]
    data = spark.createDataFrame(rows, "console string, condition string, game_id long, curve array<double>")
    assigned, summary = curves.cluster_curves(data, 2)
    own = {r.game_id: r.cluster for r in assigned.collect()}
    assert len({own[g] for g in range(0, 60, 2)}) == 1 and len({own[g] for g in range(1, 60, 2)}) == 1 and own[0] != own[1]
    assert sorted(r.n for r in summary.collect()) == [30, 30]
    facts = spark.createDataFrame([(g, "loose", "nes", None, "odd" if g % 2 else "even", "no") for g in range(60)], "game_id long, condition string, console string, rising double, kind string, kw_x string")
    got = curves.profile_clusters(assigned, facts, ["kind", "kw_x"], 20).collect()
    assert {(r.cluster, r.value, r.n, r.k, r.lift) for r in got} == {(own[1], "odd", 30, 30, 2.0), (own[0], "even", 30, 30, 2.0)}


def samples_of(spark, target):
    rows = []
    for g in range(320):
        for year in (2010, 2013, 2016):
            x = (g * 37 % 100) / 100
            rows.append((g, "nes", "loose" if g % 2 else "cib", D(year, 1, 1), target(g, x), x, 0.1, 1.0 + g % 3, 5.0, 0.5, 2000, "us", "nes", "rpg" if g % 3 else "race", "p", None, "early", "f", "2000-2004", "no", "no", "no"))
    return spark.createDataFrame(rows, "game_id long, console string, condition string, t0 date, target double, log_price_t0 double, momentum_12m double, cib_loose_ratio double, age_years double, lifecycle_pos double, release_year long, region string, platform string, genre string, publisher string, esrb string, lifecycle string, franchise string, release_era string, kw_budget_reprint string, kw_limited string, kw_collector string")


def test_the_model_finds_a_planted_signal_and_none_in_noise(spark):
    """Constant features and a null one among them are left out."""
    good = forecast.fit_model(samples_of(spark, lambda g, x: x + 0.01 * (g % 7)), rounds=8, repeats=2, rate=0.3)
    assert good.summary["status"] == "ok" and good.summary["signal"] and good.summary["spearman"] > 0.9 and good.summary["r2"] > 0.8 and good.summary["top_quintile_precision"] > 0.8
    assert good.importance[0][0] == "log_price_t0" and good.importance[0][1] > 0.5 and "region" not in good.categorical and "momentum_12m" not in good.numeric
    noise = forecast.fit_model(samples_of(spark, lambda g, x: ((g * 7919 + 13) % 101) / 101), rounds=3, repeats=1, rate=0.3)
    assert noise.summary["r2"] < 0.3 and noise.summary["spearman"] < 0.5
    assert forecast.fit_model(samples_of(spark, lambda g, x: x).limit(30), rounds=2).summary["status"] == "insufficient data"


def test_index_traces_keep_the_sign_of_a_small_fall(spark):
    rows = [("A", "loose", dt.date(2000, m, 1), x) for m, x in enumerate((-1e-5, 0.0, 1e-5, -0.00125, 0.5), 1)]
    trace = report.index_traces(spark.createDataFrame(rows, "console string, condition string, month date, level double")).first()
    assert [str(y) for y in trace["y"]] == ["-0.0", "0.0", "0.0", "-0.1", "64.9"]


def test_usd_percent_as_its_sql_on_odd_balances(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    odd = [-0.0, 0.0, -0.003, 0.003, -0.005, 0.005, 1.005, -1.005, 50.0, -50.0, 150.0, 250.0, 1e6, -1234567.895, 0.29, 9999.99, None]
    spark.createDataFrame(list(enumerate(odd)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = c.execute(oracle_sql()["usd_percent"]).fetchall()
    assert sorted(tuple(r) for r in queries()["usd_percent"](spark, str(tmp_path)).collect()) == sorted(want)


def test_registry_matches_duckdb(spark):
    import duckdb

    from __spark_entry__ import entry, oracle_sql, queries

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    def values(names, rows, order):
        plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v.isoformat()[:10] if isinstance(v, dt.date) else v
        return sorted([str(plain(row[names.index(c)])) for c in order] for row in rows)

    some = "scan_history console_index dense_panel price_factors patterns match_patterns curve_matrix compare_signals upsert_games upsert_detail upsert_snapshots list_products chart_points sale_ids games_due run_log list_fresh quarantine q_latest_prices q_names q_history_table q_compare_index usd_percent zscore wilson"
    for name in some.split():
        df, sql = queries()[name](spark, d), c.execute(oracle_sql()[name])
        names = [x[0] for x in sql.description]
        assert sorted(df.columns) == sorted(names), name
        assert values(df.columns, [tuple(r) for r in df.collect()], sorted(names)) == values(names, sql.fetchall(), sorted(names)), name
    assert entry(spark).count() > 0 and set(oracle_sql()) <= set(queries())
