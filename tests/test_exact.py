"""Exact selection, ranks, samples and patterns against brute force; pages, SQLite files and the store."""

import collections
import contextlib
import datetime as dt
import hashlib
import itertools
import math
import random
import sqlite3
import threading
import time

import pytest
from pyspark.sql import functions as F

from spindrift.operators import mining, ranks
from spindrift.operators.watchlist import watchlist
from spindrift.plans import store
from spindrift.sources import model, pages, parse, sqlite

# ---------------------------------------------------------------------------- ranks


@pytest.mark.parametrize(("few", "bins"), [(10_000, 2_048), (5, 4), (1, 2)])
def test_quantiles_are_exact(spark, monkeypatch, few, bins):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "BINS", bins)
    rng = random.Random(few)
    groups = {"a": [rng.gauss(0, 1) for _ in range(301)], "b": [5.0] * 40, "c": [1.0] * 30 + [2.0] * 30 + [1e300, -1e300], None: [rng.choice([0.1, 0.2, 0.3]) for _ in range(50)], "d": [7.5], "e": []}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)]
    rng.shuffle(rows)
    shares = {"low": 0.05, "half": 0.5, "most": 0.8, "all": 1.0}
    got = {r.g: r for r in ranks.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(4), ["g"], "x", shares).collect()}
    assert set(got) == {"a", "b", "c", None, "d"}
    for g, r in got.items():
        xs = sorted(groups[g])
        assert r.n == len(xs)
        for name, share in shares.items():
            at = share * (len(xs) - 1)
            i = int(at)
            a, b = xs[i], xs[min(i + 1, len(xs) - 1)]
            assert r[name] == pytest.approx(a if at == i or a == b else (i + 1 - at) * a + (at - i) * b, rel=1e-12)
    assert ranks.quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", shares).count() == 0
    assert [r.half for r in ranks.quantiles(spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0)], "x double"), [], "x", {"half": 0.5}).collect()] == [2.0]


def test_numbers_and_ranks_over_ranges(spark):
    rng = random.Random(2)
    values = [(rng.choice("ab"), rng.randrange(50)) for _ in range(400)]
    df = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(values)], "i long, g string, x long").repartition(5)
    got = sorted((r.nr, r.x, r.i) for r in ranks.numbered(df, [F.col("x"), F.col("i")], "nr").collect())
    assert got == [(k, x, i) for k, (x, i) in enumerate(sorted((x, i) for i, (_, x) in enumerate(values)))]
    counted = df.groupBy("g", "x").agg(F.count("*").alias("t"))
    found = {(r.g, r.x): r.rank for r in ranks.average_ranks(counted, ["g"], "x", "t", "rank").collect()}
    for g in "ab":
        xs = sorted(x for h, x in values if h == g)
        assert {x: r for (h, x), r in found.items() if h == g} == {x: xs.index(x) + (xs.count(x) + 1) / 2 for x in set(xs)}


def test_a_sample_by_hash_is_the_first_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PREFIX", 1)
    rows = [(c, k, hashlib.md5(f"{c}{k % 90}".encode()).hexdigest()) for c in "xyz" for k in range(120)]
    pool = spark.createDataFrame(rows, "c string, k long, digest string").repartition(3)
    want = spark.createDataFrame([("x", 50), ("y", 500)], "c string, want long")
    got = collections.Counter((r.c, r.k) for r in ranks.first_by_hash(pool, "c", "digest", ["k"], want).collect())
    first = lambda c, n: [(c, k) for _, k in sorted((d, k) for g, k, d in rows if g == c)[:n]]
    assert got == collections.Counter(first("x", 50) + first("y", 500))


# ---------------------------------------------------------------------------- patterns


def mined(rows, columns, min_count, max_len, min_lift, min_gain, examples=5):
    """The definition, set by set."""
    out = set()
    for c in {r["condition"] for r in rows}:
        own = [(frozenset(f"{k}={r[k]}" for k in columns if r[k] not in (None, "unknown") and not (k.startswith("kw_") and r[k] == "no")), r) for r in rows if r["condition"] == c and r["rising"] is not None]
        base = sum(r["rising"] for _, r in own) / len(own)
        if not base:
            continue
        lift = {}
        level = {frozenset([i]) for have, _ in own for i in have}
        size = 1
        while level and size <= max_len:
            kept = set()
            for s in level:
                hit = [r for have, r in own if s <= have]
                if len(hit) >= min_count:
                    lift[s] = sum(r["rising"] for r in hit) / len(hit) / base
                    kept.add(s)
            singles = {i for s in lift if len(s) == 1 for i in s}
            level = {s | {i} for s in kept if lift[s] >= 1 for i in singles if i.split("=")[0] not in {x.split("=")[0] for x in s}}
            size += 1
        for s, x in lift.items():
            parts = [lift.get(frozenset(p), 0.0) for n in range(1, len(s)) for p in itertools.combinations(s, n)]
            if x >= min_lift and all(x >= p + min_gain for p in parts):
                hit = [r for have, r in own if s <= have]
                best = sorted((r for r in hit if r["rising"]), key=lambda r: (r["excess_36m"] is None, -(r["excess_36m"] or 0), r["game_id"]))[:examples]
                out.add((c, " & ".join(sorted(s)), len(hit), int(sum(r["rising"] for r in hit)), round(x, 9), ",".join(str(r["game_id"]) for r in best)))
    return out


@pytest.mark.parametrize("max_len", [1, 2, 3, 4, 5])
def test_patterns_of_any_length_equal_brute_force(spark, max_len):
    rng = random.Random(max_len)
    columns = ["genre", "era", "maker", "kw_x", "size"]
    rows = []
    for g in range(240):
        r = {"condition": "loose" if g % 3 else "cib", "game_id": g, "genre": rng.choice("ab"), "era": rng.choice(["90s", "00s", "unknown"]), "maker": rng.choice(["m", "n", None]), "kw_x": rng.choice(["yes", "no"]), "size": rng.choice("sl")}
        hot = (r["genre"] == "a") + (r["era"] == "90s") + (r["maker"] == "m") + (r["kw_x"] == "yes")
        r["rising"] = None if g % 11 == 0 else float(rng.random() < (0.9 if hot == 4 else 0.1 + 0.05 * hot))
        r["excess_36m"] = None if g % 17 == 0 else rng.choice([0.1, 0.2, rng.random()])
        rows.append(r)
    df = spark.createDataFrame([tuple(r[k] for k in ("condition", "game_id", *columns, "rising", "excess_36m")) for r in rows], "condition string, game_id long, genre string, era string, maker string, kw_x string, size string, rising double, excess_36m double")
    got = {(r.condition, r["items"], r.n, int(r.k), round(r.lift, 9), r.examples) for r in mining.mine_patterns(df, columns, min_count=3, max_len=max_len, min_lift=1.2, min_gain=0.05).collect()}
    want = mined(rows, columns, 3, max_len, 1.2, 0.05)
    assert got == want and (max_len < 4 or any(x[1].count("&") >= 3 for x in want))


# ---------------------------------------------------------------------------- pages


def test_a_page_may_nest_without_end():
    began = time.perf_counter()
    row = "<table id=attribute><tr><td class=title>Genre:</td><td class='details x'> RPG </td></tr></table>"
    assert pages.read_detail("<div>" * 100_000 + row + "</x>" * 1000)["fields"] == {"genre": " RPG "}
    for bad in ("<a <b", "<!--", "<a x='", "</", "</p ", "<table id=attribute><tr><td class=title>", "<script>", "&", "<"):
        pages.read_detail(bad * 20_000)
    assert time.perf_counter() - began < 60


def test_pages_are_read_as_a_browser_shows_them():
    page = """<!doctype html><TABLE id="attribute"><tr><td class="title"> Genre: </td><td class="details">A &amp; <b>B</b><br/>C<!-- <td class=details>no</td> --></td></tr>
    <tr><td class=title>UPC:</td><td class=details><script>var x = "</td>";</script>7</td></tr><tr><td class=title>Publisher:<td class=details>open</table>
    <tr><td class=title>Developer:</td><td class=details>outside</td></tr><table id=attribute><tr><td class=title>ASIN (Amazon):</td><td class=details>second</td></tr></table>
    <span id=used_price>x<i class="big price">$1</i><i class=price>$2</i></span><p id=new_price>none</p><i class=price>$9</i>
    <div class="tab completed-auctions-used"><tbody><tr><td class=date>d</td><td class=numeric><span class=js-price>$1</span></td></tr></tbody></div>
    <div class="completed-auctions-used"><table><tr><td class=date>no body</td><td class=numeric><span class=js-price>$1</span></td></tr><tbody>
    <tr id=ebay-1><td class=date> 2020-01-02 </td><td class=title>[Shop] <a href="/x?a=1&amp;b=2">T</a><a href=/y>U</a></td><td class=numeric><span class=js-price>$3</span><span class=js-price>$4</span></td></tr>
    <tr><td class=date>2020-01-03</td><td class=title>plain</td><td><span class=js-price>$5</span></td></tr>
    <tr><td class=title>no date</td><td class=numeric><span class=js-price>$5</span></td></tr>
    <tr><td class=date>2020-01-04</td><td class=title>V</td><td class=numeric><span class=js-price>$6</span></td></tr></tbody></table></div>"""
    d = pages.read_detail(page)
    assert d["fields"]["genre"] == "A & BC" and d["fields"]["upc"] == "7" and "developer" not in d["fields"] and "asin" not in d["fields"]
    assert d["prices"] == {"loose": "$1", "cib": None, "new": None}
    assert [(s["row_id"], s["sale_date"], s["title"], s["price"], s["url"]) for s in d["sales"]] == [("ebay-1", "2020-01-02", "T", "$3", "/x?a=1&b=2"), (None, "2020-01-04", "V", "$6", None)]
    for nothing in (None, "", "<", "plain text", "<table id=attribute>"):
        assert pages.read_detail(nothing) == {"fields": {}, "prices": {"loose": None, "cib": None, "new": None}, "own_id": None, "sales": []}


def test_one_bad_page_stops_nothing(spark):
    rows = [(1, "<div>" * 5_000), (2, None), (3, "<table id=attribute><tr><td class=title>X ID:</td><td class=details>3</td></tr></table>")]
    details = {r.game_id: r.pc_id for r in parse.page_details(parse.raw_pages(spark.createDataFrame(rows, "game_id long, html string"))).collect()}
    assert details == {1: None, 2: None, 3: 3}


# ---------------------------------------------------------------------------- SQLite


def made(path, *statements):
    with contextlib.closing(sqlite3.connect(path)) as conn:
        for s in statements:
            conn.execute(*s) if isinstance(s, tuple) else conn.execute(s)
        conn.commit()


def test_sqlite_files_are_read_in_ranges(spark, tmp_path):
    file = str(tmp_path / "old 100%.db")
    made(file, "CREATE TABLE price_history (game_id INTEGER, condition TEXT, month TEXT, price_cents)", "CREATE TABLE sales (game_id INTEGER, sale_id TEXT)", "CREATE TABLE games (id INTEGER PRIMARY KEY, console TEXT, name TEXT, upc)")
    with contextlib.closing(sqlite3.connect(file)) as conn:
        conn.executemany("INSERT INTO price_history VALUES (?, ?, ?, ?)", [(i, "loose", f"2020-{i % 12 + 1:02d}-01", i * 5 if i % 9 else "n/a") for i in range(1, 1001)])
        conn.execute("DELETE FROM price_history WHERE game_id BETWEEN 200 AND 700")
        conn.executemany("INSERT INTO games VALUES (?, ?, ?, ?)", [(1, "nes", "A", b"\xffx"), (10**12, "pal-wii", None, 4.5)])
        conn.commit()
    got = model.import_sqlite(spark, file, rangerows=100)
    assert set(got) == {"price_history", "sales", "games"} and got["sales"].count() == 0
    rows = got["price_history"].collect()
    assert {(r.game_id, r.condition, r.month, r.price_cents) for r in rows} == {(i, "loose", dt.date(2020, i % 12 + 1, 1), i * 5 if i % 9 else None) for i in [*range(1, 200), *range(701, 1001)]}
    assert got["price_history"].rdd.getNumPartitions() == 5 and [f.name for f in got["games"].schema] == [f.name for f in model.SCHEMAS["games"]]
    assert {(r.id, r.platform, r.region, r.name, r.upc) for r in got["games"].collect()} == {(1, "nes", "ntsc-u", "A", "�x"), (10**12, "wii", "pal", None, "4.5")}


def test_sqlite_odd_tables_folders_and_filters(spark, tmp_path):
    one, two = str(tmp_path / "a.db"), str(tmp_path / "b.sqlite")
    made(one, "CREATE TABLE t (k TEXT PRIMARY KEY, \"x \"\"y\" INTEGER) WITHOUT ROWID", "INSERT INTO t VALUES ('p', 1), ('q', NULL)", "CREATE VIEW v AS SELECT k FROM t", "CREATE TABLE empty (k)")
    made(two, "CREATE TABLE t (k TEXT, z TEXT)", "INSERT INTO t VALUES ('p', 'zz'), (NULL, 'yy')")
    both = sqlite.sqlite_table(spark, str(tmp_path), "t")
    want = {("p", "1", None), ("q", None, None), ("p", None, "zz"), (None, None, "yy")}
    assert both.columns == ["k", 'x "y', "z"] and {tuple(r) for r in both.collect()} == want
    assert {r.k for r in sqlite.sqlite_table(spark, one, "v").collect()} == {"p", "q"} and sqlite.sqlite_table(spark, one, "empty").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        t = sqlite.sqlite_table(spark, str(tmp_path), "t")
        for where in ("k = 'p'", "k IN ('q', 'r')", "k IS NULL", "z IS NOT NULL", "k = 'p' AND z = 'zz'", "k > 'p'"):
            assert {tuple(r) for r in t.where(where).collect()} == {tuple(r) for r in both.where(where).collect()}, where
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="no SQLite file"):
        sqlite.sqlite_table(spark, str(tmp_path / "none.db"), "t").count()


def test_sqlite_writes_show_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(100).selectExpr("id", "concat('n', id) as name", "id % 2 = 0 as even", "cast(null as string) as none", "date'2020-01-01' as day")
    sqlite.write_sqlite(df.repartition(3), out, "t")
    assert {(r.id, r.name, r.even, r.none, r.day) for r in sqlite.sqlite_table(spark, out, "t").collect()} == {(str(i), f"n{i}", str(int(i % 2 == 0)), None, "2020-01-01") for i in range(100)}
    assert sqlite.sqlite_table(spark, f"file://{out}", "t").count() == sqlite.sqlite_table(spark, f"file:{out}", "t").count() == 100
    sqlite.write_sqlite(df.limit(7), f"file:{out}", "t", mode="overwrite")
    assert sqlite.sqlite_table(spark, out, "t").count() == 7
    with pytest.raises(Exception):  # noqa: B017
        sqlite.write_sqlite(df.select(F.raise_error(F.lit("no")).cast("string").alias("x")), out, "t")
    assert sqlite.sqlite_table(spark, out, "t").count() == 7 and not list((tmp_path / "out").glob(".*"))


# ---------------------------------------------------------------------------- store


def test_a_small_batch_rewrites_its_buckets_alone(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    rows = spark.range(500).selectExpr("id as k", "0 as v")
    first = st.upsert("t", rows, ["k"], buckets=32)
    before = st.commit_of("t").folders
    second = st.upsert("t", spark.createDataFrame([(k, 9) for k in (*range(9), 1000)], "k long, v int"), ["k"])
    after = st.commit_of("t").folders
    assert (first, second) == (1, 2) and len(before) == 32 and 1 <= sum(after[b] != before.get(b) for b in after) <= 10
    assert {(r.k, r.v) for r in st.read("t").collect()} == {(k, 9 if k < 9 else 0) for k in range(500)} | {(1000, 9)}
    assert st.read("t", 1).agg(F.sum("v")).first()[0] == 0 and st.read("t", 7) is None
    # a batch that comes again, then an empty one
    more = spark.createDataFrame([(5, 50)], "k long, v int")
    for _ in range(2):
        st.upsert("t", more, ["k"], sink="s", batch_id=4)
    assert st.commit_of("t").number == 3 and st.commit_of("t").applied == {"s": 4}
    st.upsert("t", rows.limit(0), ["k"])
    assert st.read("t").count() == 501 and st.versions("t") == [3, 4]


def test_buckets_double_as_a_table_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_BYTES", 100)
    st = store.Store(spark, str(tmp_path))
    for k in range(3):
        st.upsert("t", spark.range(40 * k, 40 * k + 60).selectExpr("id as k", f"{k} as v"), ["k"], buckets=2)
    assert st.commit_of("t").buckets == 8 and {(r.k, r.v) for r in st.read("t").collect()} == {(i, min(2, i // 40)) for i in range(140)}


def _shuffled_rows(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_an_upsert_shuffles_its_rows_once(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    rows = spark.range(4000).selectExpr("id as k", "id % 7 as v")
    before = _shuffled_rows(spark)
    st.upsert("t", rows, ["k"], buckets=4)
    first = _shuffled_rows(spark)
    st.upsert("t", rows.where("k < 500").selectExpr("k", "-1L as v"), ["k"])
    assert first - before <= 4400 and _shuffled_rows(spark) - first <= 4950
    assert {(r.k, r.v) for r in st.read("t").collect()} == {(k, -1 if k < 500 else k % 7) for k in range(4000)}


def test_a_stored_upsert_equals_that_of_frames(spark, tmp_path):
    """Null keys, several new rows of a key, several old ones of a table that had no keys, kept, absent and further columns."""
    st = store.Store(spark, str(tmp_path))
    rng = random.Random(7)
    old = spark.createDataFrame([(rng.choice([None, *range(12)]), rng.choice(["a", None]), rng.randrange(5), rng.choice([None, 1, 2]), "o") for _ in range(60)], "k long, c string, v long, seen long, note string")
    st.replace("t", old)
    for turn in range(3):
        new = spark.createDataFrame([(rng.choice([None, *range(16)]), rng.choice(["a", "b", None]), rng.choice([None, *range(5)]), rng.choice([None, 7, 8]), rng.randrange(4)) for _ in range(40)], "k long, c string, v long, seen long, at long")
        want = store.upsert(old, new, ["k", "c"], keep=("seen",), order="at").collect()
        st.upsert("t", new, ["k", "c"], keep=("seen",), order="at", buckets=3 + turn)
        got = st.read("t")
        assert got.columns == old.columns and collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want))
        old = spark.createDataFrame(want, old.schema)


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_FOLDERS", 5)
    failed = []

    def work(who):
        try:
            st = store.Store(spark, str(tmp_path))
            for k in range(3):
                st.append_run("runs", {"who": who, "nth": k})
            st.upsert("rows", spark.createDataFrame([(who, 1), (99, who)], "k long, v long"), ["k"], buckets=2)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    st = store.Store(spark, str(tmp_path))
    runs = st.read("runs").collect()
    assert sorted(r.id for r in runs) == list(range(1, 10)) and {(r.who, r.nth) for r in runs} == {(w, k) for w in range(3) for k in range(3)}
    assert sorted(r.k for r in st.read("rows").collect()) == [0, 1, 2, 99]


def test_a_log_takes_new_columns(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    assert [st.append_run("runs", {"ok": 1}), st.append_run("runs", {"ok": 2, "error": "x"}), st.append_run("runs", {"ok": None})] == [1, 2, 3]
    assert sorted((r.id, r.ok, r.error) for r in st.read("runs").fillna({"ok": -1, "error": ""}).collect()) == [(1, 1, ""), (2, 2, "x"), (3, -1, "")]


# ---------------------------------------------------------------------------- watchlist with predictions


def test_a_watchlist_takes_predictions(spark):
    facts = [(g, "loose", "nes", "rpg" if g < 4 else "race", "p", "us", "nes") for g in range(8)]
    now = spark.createDataFrame(facts, "game_id long, condition string, console string, genre string, publisher string, region string, platform string")
    patterns = spark.createDataFrame([("loose", "genre=rpg", 2.0, 1)], "condition string, items string, lift_lo double, nth int")
    labeled = spark.createDataFrame([(0, "loose", 1.0), (1, "loose", None)], "game_id long, condition string, rising double")
    games = spark.createDataFrame([(g, f"g{g}") for g in range(8)], "id long, name string")
    history = spark.createDataFrame([(g, "loose", dt.date(2020, m, 1), 100 * g + m) for g in range(8) for m in (1, 2)], "game_id long, condition string, month date, price_cents long")
    predicted = {0: 0.5, 1: 0.9, 4: 0.1, 5: 0.3}
    predictions = spark.createDataFrame([(g, "loose", x) for g, x in predicted.items()], "game_id long, condition string, model_pred double")
    got = {r.game_id: r for r in watchlist(now, patterns, labeled, games, history, predictions).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    score = {g: math.log(2) if g < 4 else 0.0 for g in got}
    filled = {g: predicted.get(g, 0.4) for g in got}  # the median of those known

    def z(x):
        m = sum(x.values()) / len(x)
        sd = math.sqrt(sum((v - m) ** 2 for v in x.values()) / len(x))
        return {k: (v - m) / sd for k, v in x.items()}

    a, b = z(score), z(filled)
    assert all(got[g].score == pytest.approx(a[g] + b[g]) for g in got)
    assert got[0].already_rising and not got[1].already_rising and got[3].price_cents == 302 and got[2].model_pred is None


# ---------------------------------------------------------------------------- boosted trees


def plain_boosting(rows, categories, numbers, rounds, rate, depth, least, bins):
    """Split by split, with Python's integers: predictions in millionths."""
    half = lambda x: int(abs(x) + 0.5) * (1 if x >= 0 else -1)
    cuts = []
    for f in range(numbers):
        xs = sorted(r[2][f] for r in rows if r[2][f] is not None)
        cuts.append(sorted({x for x in (xs[j * (len(xs) - 1) // bins] for j in range(1, bins + 1)) if x < xs[-1]}) if xs else [])
    coded = [[("" if v is None else "=" + v) for v in r[1]] + [0 if x is None else 1 + sum(c < x for c in cuts[f]) for f, x in enumerate(r[2])] for r in rows]
    t = [half(r[0] * 1e6) for r in rows]
    pred = [half(sum(t) / len(t))] * len(rows)
    for _ in range(rounds):
        g = [a - b for a, b in zip(t, pred, strict=True)]
        node = [1] * len(rows)
        for _ in range(depth):
            for n in set(node):
                here = [i for i in range(len(rows)) if node[i] == n]
                whole, best = sum(g[i] for i in here), None
                for f in range(categories + numbers):
                    for code in sorted({coded[i][f] for i in here}):
                        left = [i for i in here if (coded[i][f] == code if f < categories else coded[i][f] <= code)]
                        if len(left) < least or len(here) - len(left) < least:
                            continue
                        s = sum(g[i] for i in left)
                        gain = float(s) * s / len(left) + float(whole - s) * (whole - s) / (len(here) - len(left)) - float(whole) * whole / len(here)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, set(left))
                if best:
                    for i in here:
                        node[i] = 2 * n if i in best[1] else 2 * n + 1
        for n in set(node) - {1}:
            here = [i for i in range(len(rows)) if node[i] == n]
            v = half(rate * (sum(g[i] for i in here) / len(here)))
            for i in here:
                pred[i] += v
    return pred


def test_boosting_equals_plain_trees(spark, monkeypatch):
    from spindrift.operators import boosting

    monkeypatch.setattr(boosting, "STEP", 2)
    rng = random.Random(6)
    rows = [(rng.choice([0.5, 1.25, -2.0]) + (i % 7) / 10, (rng.choice(["a", "b", "c", None]), rng.choice(["", "x"])), (rng.choice([None, 1.0, 2.0, 2.5, rng.random()]), round(rng.gauss(0, 3), 2), None)) for i in range(260)]
    df = spark.createDataFrame([(i, t, *c, *x) for i, (t, c, x) in enumerate(rows)], "i long, target double, c1 string, c2 string, x1 double, x2 double, x3 double").repartition(4)
    model_ = boosting.fit(df, "target", ["c1", "c2"], ["x1", "x2", "x3"], rounds=5, rate=0.4, depth=3, least=12, bins=6)
    got = [round(r.prediction * 1e6) for r in boosting.predict(model_, df).orderBy("i").collect()]
    assert got == plain_boosting(rows, 2, 3, 5, 0.4, 3, 12, 6) and len(model_.trees) == 5
    new = spark.createDataFrame([("never seen", None, 99.0, -99.0, None)], "c1 string, c2 string, x1 double, x2 double, x3 double")
    assert boosting.predict(model_, new).count() == 1 and boosting.predict(model_, new.limit(0)).count() == 0
    flat = boosting.fit(df.withColumn("target", F.lit(3.0)), "target", ["c1"], ["x1"], rounds=4, rate=0.4)
    assert flat.trees == [] and flat.base == 3_000_000


def test_importance_orders_a_planted_signal(spark):
    from spindrift.operators import boosting, forecast

    rng = random.Random(7)
    rows = [(k, "nes", "loose" if k % 2 else "cib", dt.date(2010 + k % 4, 1, 1), rng.choice("pqr"), rng.random(), rng.random()) for k in range(600)]
    df = spark.createDataFrame(rows, "game_id long, console string, condition string, t0 date, publisher string, strong double, none double")
    df = df.withColumn("target", F.col("strong") * 4 + (F.col("publisher") == "p").cast("double"))
    trees = boosting.fit(df, "target", ["publisher"], ["strong", "none"], rounds=12, rate=0.3)
    fitted = forecast.Fitted({}, trees, ["publisher"], ["strong", "none"])
    scored = forecast.predict(fitted, df)
    r2 = forecast.r_squared(scored, "target", F.col("prediction"))
    found = forecast.permutation_importance(fitted, scored, r2, 3, 0)
    assert [f for f, _, _ in found] == ["strong", "publisher", "none"] and found[0][1] > 0.5 > found[1][1] > 0.05 > abs(found[2][1])
    assert forecast.permutation_importance(fitted, scored.repartition(7), r2, 3, 0) == [(f, pytest.approx(m), pytest.approx(s)) for f, m, s in found]


def test_plain_rows_of_sales_are_read_as_the_stack_reads_them(monkeypatch):
    rng = random.Random(8)
    ids = ["", " id='ebay-1'", ' id="x"', " id=ebay-3", " id=''", " id='a&amp;b'", " id='used_price'", " id=x/", " class=price", " ID=y", " id='a<b'"]
    titles = ["Lot 1", "<a href=/lot/1>Lot &amp; 1</a> [Shop]", "<a href='/x'>A</a>", "<a href=/x/>A</a>b", "<a>Q</a>", "<b>x</b>", "", "<!-- c -->y", "<a href=1>A</a><a href=2>B</a>", "<a href=''>e</a>", "x <a href=3>late</a>"]

    def row():
        kind = rng.choice(["date", "'date'", '"date"', '"date x"'])
        end = rng.choice(["</td>"] * 9 + [""])
        return f"<tr{rng.choice(ids)}>{rng.choice(['', chr(10)])}<td class={kind}> 2000-01-0{rng.randrange(10)}&nbsp;{end}<td class=title>{rng.choice(titles)}</td><td class=numeric><span class=\"js-price\">${rng.randrange(99)}</span></td>{rng.choice(['</tr>'] * 9 + [''])}"

    def page():
        boxes = "".join(f"<div class='completed-auctions-{k}'><table{rng.choice(['', '', ' id=attribute'])}>{rng.choice(['<tbody>'] * 5 + ['', '<tr><td class=title>ID:<td class=details><table><tbody>'])}{''.join(row() for _ in range(rng.randrange(9)))}</table></div>" for k in ("used", "cib", "new", "new"))
        return f"<p id='new_price'>{rng.choice(['</p>', '<b>', '<i class=price>'])}{boxes}</p>"

    pages_ = [page() for _ in range(2_000)]
    got = [pages.read_detail(p) for p in pages_]
    details = [pages.read_page(p, sales=False) for p in pages_]
    monkeypatch.setattr(pages.DetailPage, "_plain", lambda self: False)
    want = [pages.read_detail(p) for p in pages_]
    assert got == want and sum(len(w["sales"]) for w in want) > 10_000
    assert [d | {"sales": None} for d in details] == [w | {"sales": None} for w in want] and not any(d["sales"] for d in details)


def test_plain_rows_of_sales_need_no_stack(monkeypatch):
    started, start = [], pages.DetailPage._start
    monkeypatch.setattr(pages.DetailPage, "_start", lambda self, *a: started.append(a) or start(self, *a))
    row = "<tr id='ebay-{0}'><td class=\"date\">2000-01-01</td><td class=\"title\"><a href=/lot/{0}>Lot {0}</a> [Shop]</td><td class=\"numeric\"><span class=js-price>$1</span></td></tr>"
    html = f"<div class='completed-auctions-used'><table><tbody>{''.join(map(row.format, range(500)))}</table></div>"
    assert len(pages.read_detail(html)["sales"]) == 500 and len(started) < 10


def test_model_metrics_derive_their_samples_once(spark, monkeypatch):
    from spindrift.operators import forecast
    from spindrift.queries import QUERIES

    seen = []
    for name in ("spearman", "r_squared", "top_quintile_precision"):
        monkeypatch.setattr(forecast, name, lambda df, *a: seen.append(df._jdf.queryExecution().toString()) or 0.0)
    QUERIES["model_metrics"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and not any("Window" in plan or "Join" in plan for plan in seen)


def test_sqlite_ranges_share_a_bounded_number_of_tasks(spark, tmp_path):
    file = str(tmp_path / "a.sqlite")
    odd = [7, 2**63 - 1, -3, 1.5, "text", "é", b"blob", b"\xff\xfe", None, "7"]
    with contextlib.closing(sqlite3.connect(file)) as conn:
        conn.execute("CREATE TABLE t (i, x)")
        conn.executemany("INSERT INTO t VALUES (?, ?)", [(i, odd[i // 100 % len(odd)]) for i in range(3_000)])
        conn.execute("INSERT INTO t VALUES (3000, CAST(x'ff41' AS TEXT))")
        conn.commit()
    df = sqlite.sqlite_table(spark, file, "t", rangerows=10)
    assert df.rdd.getNumPartitions() <= sqlite.TASKS_A_CORE * spark.sparkContext.defaultParallelism < 300
    got = {int(r.i): r.x for r in df.collect()}
    assert got == {i: sqlite.as_text(odd[i // 100 % len(odd)]) for i in range(3_000)} | {3000: "\ufffdA"}
    assert [len(p.ranges) for p in sqlite.dealt(list(range(7)), 3)] == [2, 2, 3] and sqlite.dealt([], 3) == []
