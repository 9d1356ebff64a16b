"""Golden hashes, oracle parity, metamorphic relations, invariants and parsers."""

import struct

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from flowloom import catalog, registry
from flowloom.functions.hashing import bswap32, mm3, mm3_byte, mm3_py, pow2_at_least, seed_key
from flowloom.functions.scalars import median4, radix_number, search_rate, send_period
from flowloom.operators import detect, evaluate, sketches, stateful
from flowloom.plans.packets import flows, packets, weighted
from flowloom.sources import config, reports, trace

PARITY = [n for n, q in catalog.Q.items() if q.sql]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", PARITY)
def test_parity(spark, duck, name):
    q = catalog.Q[name]
    got = q.build(spark, DATA)
    res = duck.execute(q.sql)
    cols = [c[0] for c in res.description]
    at = [cols.index(c) for c in sorted(cols)]
    assert sorted(cols) == sorted(got.columns)
    assert rows(got) == sorted(str(tuple(r[i] for i in at)) for r in res.fetchall())


def test_every_query_has_ids():
    assert all(q.ids for q in catalog.Q.values())
    assert len(catalog.Q) > 90


def test_golden_hashes(spark):
    # Published test values of the public algorithm.
    assert mm3_py(b"", 1) == 0x514E28B7
    assert mm3_py(b"test", 0) == 0xBA6BD213
    keys = [0, 1, 12345, 2**32 - 1]
    df = spark.createDataFrame([(a, b, a ^ 77, 3) for a in keys for b in keys], "a long, b long, c long, d long")
    for seed in (1, 42, 17093, 47262, 82926, 135990):
        out = df.select("*", *(mm3([F.col(c) for c in "abcd"[:n]], seed).alias(f"h{n}") for n in (1, 2, 3, 4)), mm3_byte(F.col("d"), seed).alias("hb")).collect()
        for r in out:
            assert [r[f"h{n}"] for n in (1, 2, 3, 4)] == [mm3_py(struct.pack(f"<{n}I", *(r.a, r.b, r.c, r.d)[:n]), seed) for n in (1, 2, 3, 4)]
            assert r.hb == mm3_py(b"\x03", seed)
    assert mm3_py(struct.pack("<i", seed_key(999)), 42) == 999


def test_scalars(spark):
    df = spark.createDataFrame([("0x1F", [-7, -1, -2, 5]), ("017", [1, 2, 4, 9]), ("42", [0, 0, 0, 0]), ("x", [3, 1, 2, 2])], "t string, v array<long>")
    got = df.select(radix_number(F.col("t")).alias("n"), median4(F.col("v")).alias("m")).collect()
    assert [r.n for r in got] == [31, 15, 42, None]
    assert [r.m for r in got] == [-1, 3, 0, 2]
    assert spark.range(1).select(bswap32(F.lit(0x01020304).cast("long"))).first()[0] == 0x04030201
    assert pow2_at_least(65537) == 131072 and pow2_at_least(1) == 1
    steps = search_rate(lambda r: 0 if r <= 5000 else 5000)
    assert all(ok == (rate <= 5000) for rate, _, ok in steps) and abs(steps[-1][0] - 5000) < 200
    assert send_period(32, 64, 10**9, 10_000) == pytest.approx(2150.4)


def test_sketches_merge(spark):
    """A sketch of packets equals that of flows, of shuffled packets, and the sum of those of two halves."""
    p = packets(spark, DATA)
    whole = rows(sketches.count_min(weighted(p), "pair", 64))
    assert whole == rows(sketches.count_min(flows(p, "pair"), "pair", 64))
    assert whole == rows(sketches.count_min(weighted(p.orderBy(F.rand(3))), "pair", 64))
    halves = [sketches.count_min(weighted(p.where(f"seq % 2 = {i}")), "pair", 64) for i in (0, 1)]
    assert whole == rows(halves[0].unionByName(halves[1]).groupBy("epoch", "row", "bucket").agg(F.sum("cnt").alias("cnt")))


def test_bounds(spark):
    p = packets(spark, DATA)
    est = sketches.count_min_point(flows(p, "pair"), sketches.count_min(flows(p, "pair"), "pair", 64), "pair", 64)
    assert est.where("est < w").count() == 0
    truth = p.groupBy("epoch", F.col("src_ip").alias("flow")).count()
    ss = stateful.space_saving(p, 16).join(truth, ["epoch", "flow"])
    n = p.count()
    assert ss.where(f"freq < count or freq > count + {n} / 16 or freq - error > count").count() == 0
    f = sketches.fm_estimate(sketches.fm(flows(p, "sip"), "sip")).first().est
    d = p.where("epoch = 0").select("src_ip").distinct().count()
    assert d / 4 < f < d * 4


def test_cache_conserves(spark):
    p = packets(spark, DATA)
    for policy in ("grr", "lru"):
        out = stateful.evict_cache(p, 2, 2, policy)
        assert rows(out.groupBy("epoch", "flow").agg(F.sum("cnt").alias("n"))) == rows(p.groupBy("epoch", F.col("src_ip").alias("flow")).agg(F.count("*").alias("n")))
        assert out.where("not flushed").count() > 0


def test_map_fixtures(spark):
    """Last value of a key wins; nothing leaks from an epoch into the next."""
    df = spark.createDataFrame([(0, i, i, i * 0xBEAF) for i in range(1024)] + [(1, 5000 + i, i, i * 0xDEAD) for i in range(1024)] + [(0, 9000, 12, 0xDEADBEEF)], "epoch long, seq long, k long, v long")
    last = {(r.epoch, r.k): r.v for r in df.groupBy("epoch", "k").agg(F.max_by("v", "seq").alias("v")).collect()}
    assert last[0, 12] == 0xDEADBEEF and last[1, 12] == 12 * 0xDEAD and len(last) == 2048


def test_trace_reader(spark, tmp_path):
    (tmp_path / "t.txt").write_text("anything at all\n167772161 167772162 1234 80 6\n167772161,167772163,1235,53,17\n1 2 3 4 1\n0x0a000001 0x0a000004 1236 443 6\nshort line\n")
    got = [tuple(r) for r in trace.read_trace(spark, str(tmp_path)).orderBy("seq").select("seq", "src_ip", "dst_ip", "dst_port", "proto").collect()]
    assert got == [(0, 167772161, 167772162, 80, 6), (1, 167772161, 167772163, 53, 17), (2, 167772161, 167772164, 443, 6)]
    assert trace.read_trace(spark, str(tmp_path), cap=2).count() == 2


def test_config_and_registry(spark, tmp_path):
    text = """
Experiment:
    name: demo
    ports:
        - port-id: 0
          modules:
              - name: simdbatch::cmsketch
                size: 0x40
                keysize: 1
                valsize: 1
        - port-id: 1
          modules:
              - name: HeavyHitter::Hashmaplinear
                size: 100
                keysize: 2
"""
    e = config.load(text)
    assert e.name == "demo" and sorted(e.ports) == [0, 1] and e.ports[0][0].number("SIZE") == 64
    assert "port 1" in config.explain(e)
    with pytest.raises(KeyError):
        e.ports[0][0].number("missing")
    with pytest.raises(KeyError):
        registry.lookup("No::Module")
    p = packets(spark, DATA)
    out = registry.run(e, p)
    assert out[0, 0, "simdbatch::cmsketch"].agg(F.sum("cnt")).first()[0] == 4 * p.where("port = 0").count()
    assert out[1, 0, "HeavyHitter::Hashmaplinear"].count() == 0


@pytest.mark.parametrize("name", registry.names())
def test_modules_run(spark, name):
    conf = config.ModuleConfig(name, {"size": "64", "keysize": "1"})
    assert registry.lookup(name)(packets(spark, DATA), conf).limit(1).collect() is not None


def test_reports(spark, tmp_path):
    lines = reports.report_lines(detect.heavy_hitters(packets(spark, DATA), "pair", 2), 2)
    for _ in range(2):  # a repeated batch leaves one copy
        reports.write_reports(lines, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == lines.count()
    assert lines.first().line.endswith(" 2")


def test_evaluation(spark):
    t = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "epoch long, k long")
    r = spark.createDataFrame([(0, 2), (0, 3), (0, 4), (0, 5)], "epoch long, k long")
    a = evaluate.accuracy(t, r, ["k"]).first()
    assert (a.tp, a.fp, a.fn, a.precision, a.recall) == (2, 2, 1, 50.0, 66.666)
    panel = spark.createDataFrame([("99", 1, 10.0), ("99", 2, 4096.0), ("99", 0, 7.0)], "name string, line_no int, value double")
    assert evaluate.last_panel(panel).first().value == 10.0


def test_empty(spark):
    p = packets(spark, DATA).where("false")
    for df in (detect.heavy_hitters(p, "pair", 2), sketches.count_min(weighted(p), "sip", 64), detect.changes(flows(p, "sip"), ["src_ip"], 1), stateful.space_saving(p, 4)):
        assert df.count() == 0
    assert trace.profile(p, ["src_ip"]).first().packets == 0


def plain_space_saving(packets_, capacity):
    freq, error = {}, {}
    for k in packets_:
        if k in freq:
            freq[k] += 1
        elif len(freq) < capacity:
            freq[k], error[k] = 1, 0
        else:
            out = min(freq, key=freq.get)
            error[k] = freq.pop(out)
            freq[k] = error[k] + 1
    return {k: (freq[k], error[k]) for k in freq}


def test_space_saving_matches_plain(spark):
    p = packets(spark, DATA, 300)
    want = {}
    for r in p.orderBy("seq").collect():
        want.setdefault(r.epoch, []).append(r.src_ip)
    for capacity in (3, 8):
        got = {}
        for r in stateful.space_saving(p, capacity).collect():
            got.setdefault(r.epoch, {})[r.flow] = (r.freq, r.error)
        assert got == {e: plain_space_saving(v, capacity) for e, v in want.items()}


def test_bounded_queue_by_hand(spark):
    # Two counters: 1,1,1 and 2,2; 3 takes 2's over (3), grows (4); 2 comes back over 1's (4).
    keys = [1, 1, 1, 2, 2, 3, 3, 2]
    df = spark.createDataFrame([(0, i, k) for i, k in enumerate(keys)], "epoch long, seq long, src_ip long")
    assert rows(stateful.bounded_queue(df, 2, 3)) == ["(4, 0, 2)", "(4, 0, 3)"]
    assert rows(stateful.bounded_queue(df, 2, 4)) == []


def plain_cache(packets_, buckets, slots, policy):
    """(key, count) sent on: slots by place, the LRU one by the time of last use."""
    table, cursor, sent = [[] for _ in range(buckets)], 0, []
    for now, (fp, key) in enumerate(packets_):
        row = table[fp % buckets]
        hit = next((x for x in row if x[0] == fp), None)
        if hit:
            if hit[1] == key:
                hit[2] += 1
            else:
                sent.append((hit[1], hit[2]))
                hit[1:3] = key, 1
            hit[3] = now
        elif len(row) < slots:
            row.append([fp, key, 1, now])
        else:
            if policy == "grr":
                cursor = (cursor + 1) % slots
                at = cursor
            else:
                at = min(range(slots), key=lambda i: row[i][3])
            sent.append((row[at][1], row[at][2]))
            row[at] = [fp, key, 1, now]
    return sent + [(x[1], x[2]) for row in table for x in row]


@pytest.mark.parametrize("policy", ["grr", "lru"])
def test_cache_with_clashing_fingerprints(spark, policy):
    p = packets(spark, DATA, 400)
    fp = F.col("src_ip").bitwiseXOR(F.col("dst_ip")) % 40
    per = {}
    for r in p.withColumn("fp", fp).orderBy("seq").collect():
        per.setdefault(r.epoch, []).append((r.fp, (r.src_ip, r.dst_ip)))
    got = stateful.evict_cache(p, 4, 3, policy, ["src_ip", "dst_ip"], fp)
    assert got.columns == ["epoch", "seq", "src_ip", "dst_ip", "cnt", "flushed"]
    have = sorted((r.epoch, (r.src_ip, r.dst_ip), r.cnt) for r in got.collect())
    assert have == sorted((e, k, n) for e, v in per.items() for k, n in plain_cache(v, 4, 3, policy))
    single = {}
    for r in p.orderBy("seq").collect():
        single.setdefault(r.epoch, []).append((r.src_ip, r.src_ip))
    ratio = {r.epoch: (r.packets, r.sent) for r in stateful.cache_ratio(stateful.evict_cache(p, 4, 3, policy)).collect()}
    assert ratio == {e: (len(v), len(plain_cache(v, 4, 3, policy))) for e, v in single.items()}


def test_flow_filter_has_false_positives(spark):
    """A small filter calls some flows old; cells equal a packet-by-packet fold."""
    size, cells, bits = 2, {}, set()
    p = packets(spark, DATA, 10_000)
    for r in p.orderBy("seq").collect():
        key = struct.pack("<II", r.src_ip, r.dst_ip)
        own = [mm3_py(key, s) % (32 * size) for s in sketches.ROWS]
        fresh = not all(b in bits for b in own)
        bits.update(own)
        for s in sketches.CELLS:
            c = cells.setdefault(mm3_py(key, s) % size, [0, 0, 0, 0])
            c[0] ^= r.src_ip * fresh
            c[1] ^= r.dst_ip * fresh
            c[2] += fresh
            c[3] += 1
    got = {r.cell: [r.x_src_ip, r.x_dst_ip, r.flowc, r.packetc] for r in sketches.flow_radar_bloom(weighted(p), "pair", size).collect()}
    assert got == cells
    flowc = {r.cell: r.flowc for r in sketches.flow_radar(flows(p, "pair"), "pair", size).collect()}
    assert sum(c[2] for c in cells.values()) < sum(flowc.values())


def test_zipf_has_no_cap(spark, monkeypatch):
    monkeypatch.setattr(trace.numbered, "__defaults__", (10,))
    p = packets(spark, DATA)
    assert trace.zipf(p, 0.0).count() == p.count() and trace.shuffled(p).count() == p.count()


def test_traces_of_several_files(spark, tmp_path):
    p = packets(spark, DATA).select("seq", "src_ip", "dst_ip", "src_port", "dst_port", "proto")
    trace.write_trace(p.repartitionByRange(5, "seq").sortWithinPartitions("seq"), str(tmp_path / "t"), header=True)
    got = trace.read_trace(spark, str(tmp_path / "t"))
    want = [tuple(r)[1:] for r in p.orderBy("seq").collect()]
    assert [(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.proto) for r in got.orderBy("seq").collect()] == want
    assert [r.seq for r in got.orderBy("seq").collect()] == list(range(len(want)))


def test_stream_state_over_batches(spark, tmp_path):
    """Three files, three batches: a flow's count goes on from batch to batch and starts again with the epoch."""
    from flowloom.streaming import replay

    events = spark.read.parquet(f"{DATA}/events.parquet")
    for i in range(3):
        events.where(F.col("event_id").between(i * 400, i * 400 + 399)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = replay.event_stream(spark, str(tmp_path / "in"), events.schema, 600)
    replay.run_once(replay.stream_crossing(stream, "src_ip", 5), str(tmp_path / "out"), str(tmp_path / "check"))
    want = detect.crossing(packets(spark, DATA, 600), F.col("src_ip"), "sip", 5)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(want) != []
    seen = {}
    replay.fan_out(replay.event_stream(spark, str(tmp_path / "in"), events.schema, 600), {"a": lambda b: b, "b": lambda b: b.where("port = 1")}, lambda n, b, i: seen.setdefault(n, []).append(b.count()), str(tmp_path / "check2")).awaitTermination()
    assert len(seen["a"]) == 3 and sum(seen["a"]) == packets(spark, DATA).count() > sum(seen["b"]) > 0


def test_paced_replay(spark, tmp_path):
    """Four micro-batches of 700 packets: the trace goes round, and nothing is lost between batches."""
    from flowloom.streaming import replay

    p = trace.shuffled(packets(spark, DATA)).select("seq", "src_ip", "dst_ip")
    made = replay.paced(spark, p, 700)
    for _ in range(4):
        replay.run_once(made, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out"))
    assert rows(got) == rows(trace.replay(p, 4).where("seq < 2800").withColumn("pass", F.col("pass").cast("long")))
    with pytest.raises(ValueError):
        replay.paced(spark, p.where("seq < 0"), 10)


def test_queues_and_shared_tables(spark):
    p = packets(spark, DATA)
    placed = trace.dealt(p, 4).withColumn("task", F.spark_partition_id())
    assert placed.where("task <> queue").count() == 0
    assert placed.groupBy("src_ip", "dst_ip").agg(F.countDistinct("queue").alias("n")).where("n > 1").count() == 0
    name, size = "HeavyHitter::Sharedmap", {"size": "64", "keysize": "1"}
    shared = config.Experiment("x", {0: [config.ModuleConfig(name, size)], 1: [config.ModuleConfig(name.lower(), size)]})
    one_flow = spark.range(3000).selectExpr("id AS seq", "7L AS src_ip", "9L AS dst_ip", "int(id % 2) AS port", "0L AS epoch")
    both = registry.run(shared, one_flow)  # 1500 packets at each port; the 2048th of both crosses
    assert [[r.seq for r in got.collect()] for got in both.values()] == [[2047], [2047]]
    assert [got.count() for got in registry.run(config.Experiment("y", {0: shared.ports[0]}), one_flow).values()] == [0]


def test_entry_without_a_package_of_the_corpus_part(monkeypatch):
    import importlib
    import sys

    for name in [n for n in sys.modules if n.startswith("flowloom.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.warns(UserWarning):
        entry = importlib.import_module("__spark_entry__")
    assert len(entry.queries()) > 100 and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_decode_of_overfull_tables(spark, duck, tmp_path):
    """Epochs of more flows than the table of 1024 cells can give back: all of them, one above the limit of peeling, one below it."""
    users = [n % 2048 if n < 2048 else n % 900 if n < 4096 else n % 300 for n in range(6000)]
    made = spark.createDataFrame([(n, u) for n, u in enumerate(users)], "event_id long, user_id long")
    made = made.selectExpr("*", "'view' AS event_type", "timestamp '2024-01-01' AS ts", "'{\"k\": 1}' AS props")
    made.write.parquet(f"{tmp_path}/events.parquet")
    con = duck.cursor()
    con.execute(f"CREATE SCHEMA overfull; USE overfull; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.queries()["flowradar_decode"](spark, str(tmp_path)).collect()
    want = con.execute(catalog.oracle_sql()["flowradar_decode"]).fetchall()
    con.execute("USE main; DROP SCHEMA overfull CASCADE")
    assert sorted((r.epoch, r.flow, r.packets) for r in got) == sorted(want) and len(want) > 2000
