"""Null, tie and boundary rules on small tables."""

import collections
import math
import random
import shutil

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.functions import clean
from hearthway.operators import burden, flows, matching, nearest, positions, quality, reshape, scores, statistics
from hearthway.plans.tables import Tables
from hearthway.sources import readers
from hearthway.streaming import jobs


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_numbers(spark):
    rows = [("1,234.5",), ("",), ("-",), ("nan",), (None,), ("x",)]
    assert one(spark, clean.to_number(F.col("c")), rows, "c string") == [1234.5, None, None, None, None, None]
    assert one(spark, clean.strict_number(F.col("c")), rows[:5], "c string") == [1234.5, None, None, None, None]
    with pytest.raises(Exception, match="not a number"):
        one(spark, clean.strict_number(F.col("c")), rows, "c string")


def test_codes(spark):
    assert one(spark, clean.code8(F.col("c")), [("1111065000.0",), ("1111065000",), (None,)], "c string") == ["11110650", "11110650", None]
    assert one(spark, clean.code10(F.col("c")), [("11110650",), ("0011110650",), ("1111065000",), ("12",)], "c string") == ["1111065000", "1111065000", "1111065000", None]


def test_names(spark):
    assert one(spark, clean.repair_name(F.col("c")), [("서울 종로구 종로1?2?3?4가동",), ("상계3·4동",), ("a?b",)], "c string") == ["종로1.2.3.4가동", "상계3.4동", "a?b"]
    assert one(spark, clean.drop_ordinal(F.col("c")), [("창신제1동",), ("제기동",)], "c string") == ["창신1동", "제기동"]


def test_times(spark):
    assert one(spark, clean.minutes(F.col("c")), [("07:05",), ("24:00",), ("7:60",), ("x",), (None,)], "c string") == [425, None, None, None, None]
    assert one(spark, clean.time_code(F.col("c")), [(700,), (2460,), (5,), (None,)], "c int") == ["07:00", None, "00:05", None]
    rows = [(420, None), (419, 581), (None, 580), (None, None)]
    assert one(spark, clean.in_morning(F.col("a"), F.col("b")), rows, "a int, b int") == [True, False, True, False]


def test_least_keeps_null(spark):
    assert one(spark, clean.least_or_null(F.col("a"), F.col("b")), [(None, 1), (2, 1)], "a int, b int") == [None, 1]
    assert one(spark, burden.clip_upper(F.col("a"), 5), [(None,), (7,), (3,)], "a int") == [None, 5, 3]


def test_missing_fares_are_not_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", None, 30.0), ("b", None, 5.0)], "k string, x double, w double")
    out = {r.k: r for r in df.groupBy("k").agg(flows.available_mean("x", "w").alias("m"), flows.coverage("x", "w").alias("c")).collect()}
    assert out["a"].m == 1.0 and out["a"].c == 0.25 and out["b"].m is None and out["b"].c == 0.0


def test_threshold_keeps_the_crossing_row(spark):
    od = spark.createDataFrame([(1, 1, 50.0), (1, 2, 30.0), (1, 3, 20.0), (2, 1, 1.0)], "home int, work int, flow double")
    ranked = flows.running_share(od)
    assert sorted((r.home, r.work) for r in flows.select_to_threshold(ranked, 0.8).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted((r.home, r.work) for r in flows.select_to_threshold(ranked, 0.81).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_nearest_month_takes_the_earlier_of_two(spark):
    facts = spark.createDataFrame([("z", 202302), ("z", 202312), ("y", 202301), ("z", 202304)], "k string, ym int")
    rates = spark.createDataFrame([("z", 202301, 1.0), ("z", 202303, 3.0), ("z", 202404, 4.0)], "k string, ym int, rate double")
    out = {(r.k, r.ym): (r.rate_ym, r.exact) for r in burden.nearest_month(facts, rates, ["k"]).collect()}
    assert out == {("z", 202302): (202301, False), ("z", 202312): (202404, False), ("y", 202301): (None, None), ("z", 202304): (202303, False)}


def test_robust_z_fallbacks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 2.0), ("c", 4.0), ("c", None)], "g string, x double")
    out = {(r.g, r.x): r.z for r in scores.robust_z(df, ["g"], "x").collect()}
    assert out[("a", 5.0)] == 2.0 and out[("b", 2.0)] == 0.0 and abs(out[("c", 4.0)] - 2 / 1.4826) < 1e-12 and out[("c", None)] is None


def test_average_rank_and_global_rank(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "k int, v double")
    assert {r.k: r.r for r in scores.average_rank(df, "v", "r").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: None}
    assert {r.k: r.r for r in burden.global_rank(df, F.col("v"), "r", "k", parts=3).collect()} == {4: 1, 3: 2, 1: 3, 2: 3}
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, v double")
    assert {r.s for r in flat.withColumn("s", scores.minmax_good_low("v", [])).collect()} == {50.0}


def test_burden_rounds_halves_as_sql(spark):
    """42 * 20.4015 / 60 is 14.28105, stored as 14.281049999999999: SQL rounds it up."""
    df = spark.createDataFrame([(1, 250000.0, 20.4015, 2000.0, 1.0, 3)], "dong long, rent_cost double, oneway_min double, fare double, coverage double, tx long")
    r = burden.total_burden(df).first()
    assert (r.hours, r.total) == (14.2811, round(250000 + 84000 + 14.2811 * 10320, 2))


def test_grades(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, None)], "k int, c double")
    out = {r.k: (r.status, r.reasons) for r in quality.grade(df, [(F.col("c").isNull(), "no_data", "none"), (F.col("c") < 0.5, "unreliable", "low"), (F.col("k") > 1, "low_confidence", "late")]).collect()}
    assert out == {1: ("ok", []), 2: ("unreliable", ["low", "late"]), 3: ("no_data", ["none", "late"])}


def test_orphans_and_nulls(spark):
    df, dim = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    kept, lost = quality.split_orphans(df, dim, "k")
    assert [r.k for r in kept.collect()] == [1] and {r.k for r in lost.collect()} == {2, None}


def test_tails():
    assert abs(statistics.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9 and abs(statistics.chi2_tail(18.307, 10) - 0.05) < 1e-4
    assert statistics.chi2_tail(0, 3) == 1.0 and abs(statistics.normal_tail(1.6448536269514722) - 0.05) < 1e-12 and math.isclose(statistics.chi2_tail(60, 5), 1.2163e-11, rel_tol=1e-3)


def test_route_responses(spark):
    rows = [("{}",), (None,), ('{"metaData":{"plan":{"itineraries":[]}}}',), ('{"metaData":{"plan":{"itineraries":[{"totalTime":95,"legs":[{"mode":"BUS","route":"7"}]}]}}}',)]
    out = spark.createDataFrame(rows, "r string").select(*readers.first_route(F.col("r"))).collect()
    assert out[0].minutes is None and out[2].minutes is None and (out[3].minutes, out[3].fare, out[3].bus_legs, out[3].routes) == (1.6, None, 1, "7")


def test_key_map_skips_malformed(spark):
    df = spark.createDataFrame([('{"a|||b|||c":"x","a|||b":"y","d|||e|||f":null}',)], "j string")
    assert [tuple(r) for r in readers.key_map(df, "j").collect()] == [("a", "b", "c", "x")]


def test_korean_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름,수\n종로구,3\n".encode("cp949"))
    assert readers.csv_encoding(spark, str(tmp_path / "a.csv")) == "x-windows-949"
    assert readers.read_csv_any(spark, str(tmp_path / "a.csv")).first()["이름"] == "종로구"


def test_policies_against_every_pair(spark):
    """Nulls in every measure and target, equal and single values, rules that fit nobody, and no rules at all."""
    rng = random.Random(1)
    some = lambda top, p=0.3: None if rng.random() < p else rng.randint(0, top)
    users = [(i, some(70, 0.1), some(500, 0.1), some(9, 0.1), some(3, 0.2)) for i in range(150)]
    rules = [(i, some(70), some(70), some(500), some(9), some(4)) for i in range(120)] + [(200, None, None, None, None, None), (201, 60, 10, None, None, None)]
    for chosen in (rules, rules[:1], rules[-1:], []):
        u = spark.createDataFrame(users, "user long, age int, income int, rent int, target int")
        r = spark.createDataFrame(chosen, "rule long, age_min int, age_max int, income_max int, rent_max int, target int")
        got = {x.user: (x.rules, x.first) for x in matching.match_policies(u, r).collect()}
        want = {}
        for user, age, income, rent, target in users:
            under = lambda limit, value: limit is None or value is not None and value <= limit
            fit = [q[0] for q in chosen if (q[1] is None or age is not None and age >= q[1]) and under(q[2], age) and under(q[3], income) and under(q[4], rent) and (q[5] is None or q[5] == target)]
            if fit:
                want[user] = (len(fit), min(fit))
        assert got == want


def test_blocks_cover_each_range_once(spark):
    levels = 2
    ranges = [(lo, hi) for lo in [None, *range(0, 63, 7)] for hi in [None, *range(0, 63, 5)]]
    out = spark.createDataFrame(ranges, "lo long, hi long").select("lo", "hi", matching.cover(F.col("lo"), F.col("hi"), levels).alias("c")).collect()
    paths = [set(r.p) for r in spark.range(63).orderBy("id").select(matching.path(F.col("id"), levels).alias("p")).collect()]
    for r in out:
        inside = [len(p & set(r.c)) for p in paths]
        assert inside == [int((r.lo is None or i >= r.lo) and (r.hi is None or i < r.hi)) for i in range(63)]


def test_positions_ranks_and_tiles_against_windows(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice([None, *range(7)]), rng.random()) for i in range(203)], "k long, v int, x double").repartition(5)
    w = W.orderBy(F.col("v").asc_nulls_first(), "x")
    placed = positions.positions(df, [F.col("v").asc_nulls_first(), "x"]).withColumn("want", F.row_number().over(w) - 1)
    assert placed.filter("position <> want").count() == 0 and placed.count() == 203
    ranked = positions.ranks(df, F.col("v"), "r").withColumn("want", F.rank().over(W.orderBy(F.col("v").asc_nulls_first())))
    assert ranked.filter("r <> want").count() == 0 and ranked.count() == 203
    for n in (1, 4, 10, 203, 500):
        tiled = positions.ntiles(df, ["x"], n, "t").withColumn("want", F.ntile(n).over(W.orderBy("x")))
        assert tiled.filter("t <> want").count() == 0 and tiled.count() == 203
    assert positions.positions(df.limit(0), ["x"]).count() == 0


def test_nearest_and_within_against_every_pair(spark):
    """Clumps, equal points, a far outlier, groups of few, and points on the rim of cells."""
    rng = random.Random(4)
    spot = lambda: rng.choice([(rng.random(), rng.random()), (float(rng.randint(0, 3)), float(rng.randint(0, 3))), (5.0, 5.0)])
    left = [(i, i % 3, *spot()) for i in range(60)] + [(90, 0, 400.0, -300.0), (91, 7, 0.0, 0.0)]
    right = [(1000 + i, i % 5 // 2, *spot()) for i in range(150)] + [(2000, 0, 380.0, -300.0), (2001, 5, 0.0, 0.0)]
    a, b = spark.createDataFrame(left, "k long, g int, x double, y double"), spark.createDataFrame(right, "o long, g int, x double, y double")
    d2 = lambda p, q: round((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2, 9)
    for k in (1, 4):
        got = {(r.k0, r.o): r.k for r in nearest.nearest(a.withColumnRenamed("k", "k0"), b, "k0", ["g"], ["x", "y"], k, ["o"], "o").collect()}
        want = {}
        for p in left:
            order = sorted((d2(p, q), q[0]) for q in right if q[1] == p[1])[:k]
            want |= {(p[0], o): place for place, (_, o) in enumerate(order, 1)}
        assert got == want
    for radius in (0.1, 1.0, 7.5):
        got = {(r.k, r.o) for r in nearest.within(a, b, ["g"], ["x", "y"], radius, ["o"]).collect()}
        assert got == {(p[0], q[0]) for p in left for q in right if p[1] == q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= radius * radius}
    assert nearest.nearest(a, b.limit(0), "k", ["g"], ["x", "y"], 1, ["o"], "o").count() == 0


def test_hot_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(reshape, "BLOCK", 4)
    rows = [(n, v) for n in range(40) for v in (0, n % 5, 100 + n)]
    m = spark.createDataFrame(sorted(set(rows)), "n long, v long")
    got = {(r.n, r.neighbour): (r.shared, list(r.names)) for r in reshape.shared_neighbours(m, m, "n", "v").collect()}
    via = lambda n: {v for k, v in rows if k == n}
    want = {(a, b): sorted(via(a) & via(b)) for a in range(40) for b in range(40) if a != b and via(a) & via(b)}
    assert got == {p: (len(v), [str(x) for x in v]) for p, v in want.items()}
    first = {(r.n, r.neighbour): (r.shared, list(r.names)) for r in reshape.shared_neighbours(m, m, "n", "v", most_names=1).collect()}
    assert first == {p: (len(v), [str(x) for x in v[:1]]) for p, v in want.items()}


def test_weighted_median_of_one_group_and_of_many(spark):
    rng = random.Random(5)
    rows = [(i % 3, rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 5])) for i in range(700)] + [(9, 4, 0), (8, None, 1)]
    df = spark.createDataFrame(rows, "g int, v int, w int")
    for by in (["g"], []):
        groups = {}
        for g, v, w in rows:
            if v is not None and w is not None:
                groups.setdefault((g,) if by else (), []).append((v, w))
        want = {}
        for g, pairs in groups.items():
            total, upto = sum(w for _, w in pairs), 0
            for v in sorted({v for v, _ in pairs}):
                upto += sum(w for x, w in pairs if x == v)
                if upto >= total / 2:
                    want[g] = v
                    break
        got = {tuple(r[b] for b in by): r.v for r in scores.weighted_median(df, by, "v", "w", bits=2).collect()}
        assert got == want


def test_tails_of_distributions(spark):
    rows = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.228, 10, 0.05), (2.080, 21, 0.05), (0.0, 7, 1.0), (-2.228, 10, 0.05), (1.96, 10**6, 0.05)]
    out = spark.createDataFrame([(t, n, p) for t, n, p in rows], "t double, n long, p double").select("p", statistics.t_two_sided(F.col("t"), F.col("n")).alias("got")).collect()
    assert all(abs(r.p - r.got) < 1e-3 for r in out)
    z = spark.createDataFrame([(x / 10,) for x in range(-65, 66)], "z double").select("z", statistics.normal_upper(F.col("z")).alias("got")).collect()
    assert all(abs(r.got - statistics.normal_tail(r.z)) < 1e-9 for r in z)


def test_every_dot_of_a_name_is_mended(spark):
    rows = [(f"서울 종로1{chr(c)}2가동", "종로1.2가동") for c in clean.NUMBER_DOTS] + [("종로1?2?3가동", "종로1.2.3가동"), ("가·나동", "가·나동"), ("종로1•2가동", "종로1•2가동")]
    assert len(clean.NUMBER_DOTS) == 7
    out = spark.createDataFrame(rows, "a string, b string").select("b", clean.repair_name(F.col("a")).alias("got")).collect()
    assert all(r.b == r.got for r in out)


def test_encoding_is_judged_on_all_lines(spark, tmp_path):
    head = "".join(f"{i},plain\n" for i in range(30000))
    for name, codec, last in (("utf", "utf-8", "가나다"), ("ko", "cp949", "똠방각하")):
        (tmp_path / f"{name}.csv").write_bytes(("id,name\n" + head + f"1,{last}\n").encode(codec))
        back = readers.read_csv_any(spark, str(tmp_path / f"{name}.csv"), "id long, name string")
        assert back.filter(f"name = '{last}'").count() == 1 and back.count() == 30001


def test_preamble_of_a_file_in_several_splits(spark, tmp_path):
    body = "".join(f"{i},name {i}\n" for i in range(20000))
    (tmp_path / "a.csv").write_text("report\nabout NO\nNO,name\n" + body + "NO,again\n")
    (tmp_path / "b.csv").write_text("NO,name\r\n1,one\r\n\r\n2,two\r\n")
    (tmp_path / "c.csv").write_text("\n" * 40 + "NO,name\n9,far down\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.read_after_preamble(spark, str(tmp_path), ["no", "name"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source_file[-5:]].append((r.no, r.name))
    assert sorted(by["b.csv"]) == [("1", "one"), ("2", "two")] and "c.csv" not in by
    assert len(by["a.csv"]) == 20001 and ("19999", "name 19999") in by["a.csv"]


def test_load_order_and_publishing(spark, tmp_path):
    assert readers.load_order({"c": ["b"], "b": ["a"], "a": [], "d": []}) == ["a", "d", "b", "c"]
    with pytest.raises(ValueError):
        readers.load_order({"a": ["b"], "b": ["a"]})
    one = {"child": spark.range(3), "parent": spark.range(2)}
    folder = str(tmp_path / "store")
    assert readers.published(spark, folder) == {}
    for _ in range(3):
        assert readers.publish(one, folder, {"child": ["parent"]}) == ["parent", "child"]
    assert {n: d.count() for n, d in readers.published(spark, folder).items()} == {"parent": 2, "child": 3}
    assert len(list((tmp_path / "store" / "versions").iterdir())) == 2  # older ones are gone


def test_a_load_that_stops_half_way_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    readers.publish({"child": spark.range(3), "parent": spark.range(2)}, folder, {"child": ["parent"]})
    read = readers.published(spark, folder)
    broken = spark.range(9).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("stopped"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        readers.publish({"child": broken, "parent": spark.range(7)}, folder, {"child": ["parent"]})
    assert {n: d.count() for n, d in readers.published(spark, folder).items()} == {"parent": 2, "child": 3} and read["child"].count() == 3
    readers.publish({"child": spark.range(4), "parent": spark.range(7)}, folder, {"child": ["parent"]})
    assert {n: d.count() for n, d in readers.published(spark, folder).items()} == {"parent": 7, "child": 4}
    assert len(list((tmp_path / "versions").iterdir())) == 2  # what the stopped load had written went with the next
    with pytest.raises(RuntimeError):
        readers._Versions(spark, folder).commit(2, {"version": "late", "tables": []})


def test_streams_go_on_where_they_ended(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    write = lambda rows: spark.createDataFrame(rows, "k string, w double, v double").coalesce(1).write.mode("append").parquet(source)
    totals = lambda: {r.k: (r.flow, r.n_rows) for r in jobs.running_flows(jobs.stream_of(spark, source), ["k"], "w", "v", folder).collect()}
    write([("a", 1.0, 2.0), ("b", 1.0, 2.0)])
    write([("a", 2.0, 2.0)])
    assert totals() == {"a": (3.0, 2), "b": (1.0, 1)}
    batches = len(list((tmp_path / "job" / "out").glob("batch=*")))
    write([("c", 5.0, 1.0), ("a", 1.0, 1.0)])
    assert totals() == {"a": (4.0, 3), "b": (1.0, 1), "c": (5.0, 1)}
    assert len(list((tmp_path / "job" / "out").glob("batch=*"))) == batches + 1
    assert totals() == {"a": (4.0, 3), "b": (1.0, 1), "c": (5.0, 1)}


def test_running_state_is_compacted(spark, tmp_path, monkeypatch):
    """After any number of batches a reader opens one base and a few folders, and finds each key's last state."""
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 4)
    log = jobs.UpsertLog(spark, str(tmp_path / "log"), ["k"], spark.createDataFrame([], "k long, v long").schema)
    state = {}
    for batch in range(14):
        changes = {batch % 5: batch, batch % 3: batch}
        state |= changes
        log.add(spark.createDataFrame(list(changes.items()), "k long, v long"), batch)
        base, rest = log.parts()
        assert len(rest) < 4 and len(list((tmp_path / "log").iterdir())) <= 4
        assert batch < 3 or base == batch - (batch + 1) % 4
        if batch in (2, 3, 9, 13):
            assert {r.k: r.v for r in log.read().collect()} == state
    log.add(spark.createDataFrame([(0, 99), (1, 13), (3, 13)], "k long, v long"), 13)  # a batch that is run again replaces itself
    assert {r.k: r.v for r in log.read().collect()}[0] == 99
    (tmp_path / "log" / "making-stopped").mkdir()  # a compaction that stopped half-way is not read
    log.compact(13)
    assert log.parts() == (13, []) and {r.k: r.v for r in log.read().collect()} == state | {0: 99}


def test_late_events_leave_the_state(spark, tmp_path):
    source = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, "ts string, value double").selectExpr("timestamp(ts) AS ts", "value").coalesce(1).write.mode("append").parquet(source)

    def run():
        volumes, late = jobs.morning_volume(jobs.stream_of(spark, source), late="1 day", folder=str(tmp_path / "job"))
        return {str(r.hour): (r.n, r.final) for r in volumes.collect()}, sorted((str(r.ts), r.value) for r in late.collect())

    write([("2024-01-01 07:10:00", 1.0), ("2024-01-01 07:20:00", 1.0), ("2024-01-01 11:00:00", 1.0), (None, 1.0)])
    assert run() == ({"2024-01-01 07:00:00": (2, False)}, [])
    write([("2024-01-20 08:00:00", 1.0)])
    assert run() == ({"2024-01-01 07:00:00": (2, True), "2024-01-20 08:00:00": (1, False)}, [])  # the timer has ended the first hour
    write([("2024-01-01 07:30:00", 3.0), ("2024-01-20 08:30:00", None), ("2024-01-19 09:00:00", 1.0)])  # the first is too late
    first = {"2024-01-01 07:00:00": (2, True), "2024-01-20 08:00:00": (2, False), "2024-01-19 09:00:00": (1, False)}
    assert run() == (first, [("2024-01-01 07:30:00", 3.0)])
    write([("2024-01-01 07:40:00", 4.0)])  # and so is this, also after the job has started anew
    assert run() == (first, [("2024-01-01 07:30:00", 3.0), ("2024-01-01 07:40:00", 4.0)])


def test_base_views_are_written_once_and_again_after_a_change(spark, tmp_path):
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    for f in (tmp_path / "sf").glob("*.parquet"):
        f.chmod(0o644)
    (tmp_path / "sf").chmod(0o755)
    folder = str(tmp_path / "sf")
    one = Tables(spark, folder).od
    assert Tables(spark, folder).od is one
    some = spark.read.parquet(f"{folder}/lineitem.parquet").limit(100).toPandas()
    some.to_parquet(tmp_path / "sf" / "lineitem.parquet", coerce_timestamps="us")
    assert Tables(spark, folder).od is not one and Tables(spark, folder).od.count() <= 100


def test_base_views_deal_lines_by_their_number(spark, monkeypatch):
    """More lines are more tasks of the same size, and the views stay the same."""
    from hearthway.plans import tables

    # sums may differ in their last digits
    rows = lambda t, name: sorted(tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in getattr(t, name).collect())
    whole = {name: rows(Tables(spark, "/root/testdata/sf0.001"), name) for name in ("sales", "costs")}
    monkeypatch.setattr(tables, "LINES", 500)
    monkeypatch.setattr(tables, "_published", {})
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.parts == -(-t.lineitem.count() // 500) > 4
    assert {name: rows(t, name) for name in whole} == whole
    assert len(t.sales.inputFiles()) > 4


def test_neighbours_are_counted_without_pairs(spark, monkeypatch):
    """Small and large groups, nodes over several bitmaps, nulls, a node alone; nothing meets pair by pair."""
    monkeypatch.setattr(reshape, "meetings", None)
    monkeypatch.setattr(reshape, "ROWS", 7000)
    rows = [(n, v, "x") for n in range(0, 70000, 2) for v in (n % 3, 10 + n // 50)] + [(-5, 99999, "x"), (None, 1, "x"), (8, None, "x"), (8, 1, None)]
    got = {r.n: r.neighbours for r in reshape.neighbour_counts(spark.createDataFrame(rows, "n long, v long, g string"), "n", ["v", "g"]).collect()}
    thirds = collections.Counter(n % 3 for n in range(0, 70000, 2))
    near = {n: [o for o in range(n // 50 * 50, n // 50 * 50 + 50, 2)] for n in range(0, 70000, 2)}
    assert got == {n: thirds[n % 3] - 1 + sum(o % 3 != n % 3 for o in near[n]) for n in near}


def test_shared_neighbours_of_hot_values_and_hot_nodes_without_shuffled_pairs(spark, monkeypatch):
    from hearthway.operators import reshape

    # value 0 has 90 members, node 0 has every value; blocks of 8 and at most 50 pairs a task
    monkeypatch.setattr(reshape, "BLOCK", 8)
    monkeypatch.setattr(reshape, "PAIRS", 50)
    rows = sorted({(n, 0) for n in range(-5, 85)} | {(0, v) for v in range(40)} | {(n, n % 40) for n in range(85)} | {(2**40, 7)})
    m = spark.createDataFrame(rows, "n long, v long")
    members = collections.defaultdict(set)
    for n, v in rows:
        members[n].add(v)
    want = {(a, b): sorted(members[a] & members[b]) for a in members for b in members if a != b and members[a] & members[b]}
    other = m.filter("v % 2 = 0")
    for right, even in ((m, False), (other, True)):
        out = reshape.shared_neighbours(m, right, "n", "v")
        got = {(r.n, r.neighbour): (r.shared, list(r.names)) for r in out.collect()}
        kept = {p: [x for x in v if not even or x % 2 == 0] for p, v in want.items()}
        assert got == {p: (len(v), [str(x) for x in v]) for p, v in kept.items() if v} and out.count() == len(got)
    # no more rows leave the shuffle's sender than there are memberships, once a block of the other side
    assert reshape.meetings(m, m, "n", "v").count() == sum(len(v) for v in want.values()) // 2


def test_lots_are_sent_once_to_each_cell_of_their_members(spark, monkeypatch):
    from hearthway.operators import reshape

    # 6 districts of 30 nodes, of which each lot of the district has 25
    rows = [(d * 30 + n, d * 20 + v) for d in range(6) for v in range(20) for n in range(30) if (n + v) % 6]
    m = spark.createDataFrame(rows, "n long, v long")
    monkeypatch.setattr(reshape, "PAIRS", 5000)
    sent, dealt = [], type(m).repartition
    monkeypatch.setattr(type(m), "repartition", lambda self, *by: sent.append((self, by)) or dealt(self, *by))
    out = {(r.n, r.neighbour): r.shared for r in reshape.shared_neighbours(m, m, "n", "v").collect()}
    has = collections.defaultdict(set)
    for n, v in rows:
        has[n].add(v)
    assert out == {(a, b): len(has[a] & has[b]) for a in has for b in has if a != b and has[a] & has[b]}
    # at most two or three cells meet a lot; a list for each of its members held twelve others each
    lists = next(df for df, by in sent if "_h" in by).agg(F.sum(F.size("_others")), F.count(F.lit(1))).first()
    assert sum(lists) < 4 * len(rows)


def test_tops_of_a_work_put_null_costs_last_and_repeat_no_row(spark):
    from hearthway.operators import insight

    df = spark.createDataFrame([(1, 5, 2.0), (1, 4, None), (1, 3, 2.0), (2, 9, None), (2, 8, None), (3, 1, 7.0)], "work long, home long, x double")
    out = insight.tops(df, "p", [F.lit(1), F.lit(3)], lambda p: F.col("x") * p, ["x"], lambda p: F.col("work") * 1 <= p)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 3, 2.0), (3, 1, 3, 2.0), (3, 2, 8, None), (3, 3, 1, 7.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_equal_users_and_equal_rules_meet_once(spark, monkeypatch):
    from hearthway.operators import matching

    met = []
    users = [(i, 20 + i % 4, None if i % 5 == 0 else 1.0 * (i % 3), 10.0 if i % 2 else -0.0, i % 2) for i in range(400)]
    rules = [(j, 21 if j % 3 else None, 23 if j % 2 else None, 1.0 if j % 5 else None, 9.0 if j % 7 == 0 else None, j % 2 if j % 4 else None) for j in range(300)]
    u = spark.createDataFrame(users, "user long, age int, income double, rent double, target int")
    r = spark.createDataFrame(rules, "rule long, age_min int, age_max int, income_max double, rent_max double, target int")
    placed = matching._placed
    monkeypatch.setattr(matching, "_placed", lambda a, b, *more: met.append((a.count(), b.count())) or placed(a, b, *more))
    got = {x.user: (x.rules, x.first) for x in matching.match_policies(u, r).collect()}
    fits = lambda x, y: (y[1] is None or y[1] <= x[1]) and (y[2] is None or y[2] >= x[1]) and (y[3] is None or x[2] is not None and y[3] >= x[2]) and (y[4] is None or y[4] >= x[3]) and (y[5] is None or y[5] == x[4])
    want = {x[0]: [y[0] for y in rules if fits(x, y)] for x in users}
    assert got == {k: (len(v), min(v)) for k, v in want.items() if v}
    assert met[0][0] == len({x[1:] for x in users}) < 40 and met[0][1] == len({y[1:] for y in rules}) < 300


def test_undirected_edges_are_dealt_before_they_are_grouped(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (2, 1, 4.0), (3, 3, 5.0), (4, 1, 6.0)], "home long, work long, flow double")
    out = flows.undirected(df, 3)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 7.0), (1, 4, 6.0)]
    # one shuffle, by the number of parts, and nothing grouped below it
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "hashpartitioning(a" in line or "RepartitionByExpression" in line or "Exchange" in line)
    assert not any("Aggregate" in line for line in plan[dealt:])
