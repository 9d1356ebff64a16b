"""The named queries over the driver's tables, with their inventory numbers and oracle SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import scalars
from flowloom.functions.hashing import bswap32, ctz32, mm3, second_hash
from flowloom.operators import detect, evaluate, sketches, stateful
from flowloom.operators.sketches import CELLS, DIGITS, ROWS, SH, SIGNS
from flowloom.plans.oracle import hashed_sql, key_words_sql, packets_sql, union_rows, with_packets
from flowloom.plans.packets import KEYS, TEST_EPOCH, flows, packets, weighted
from flowloom.sources import reports, trace
from flowloom.streaming import replay

SIZE, SMALL, TOP = 1024, 256, 16
T_SIP, T_PAIR, T_SPREAD, T_CHANGE, T_EST = 20, 2, 10, 10, 6


@dataclass
class Query:
    ids: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


Q: dict[str, Query] = {}


def add(name: str, ids: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the packets that events give."""
    Q[name] = Query(ids, lambda spark, d: build(packets(spark, d)), sql)


# Exact detectors and relational parts ---------------------------------------------------------------------------------

add("hh_exact_pair", "D15-D18,D20,B7,I1", lambda p: detect.heavy_hitters(p, "pair", T_PAIR), with_packets(f"SELECT epoch, src_ip, dst_ip, count(*) AS cnt FROM p GROUP BY ALL HAVING count(*) >= {T_PAIR}"))
add("hh_exact_sip", "D15,B4", lambda p: detect.heavy_hitters(p, "sip", T_SIP), with_packets(f"SELECT epoch, src_ip, count(*) AS cnt FROM p GROUP BY ALL HAVING count(*) >= {T_SIP}"))
add("hh_double_count", "D19", lambda p: detect.heavy_hitters(p, "sip", T_SIP, per_packet=2), with_packets(f"SELECT epoch, src_ip, count(*) AS cnt FROM p GROUP BY ALL HAVING 2 * count(*) >= {T_SIP}"))
add("hh_strict_gt", "D21,B8", lambda p: detect.heavy_hitters(p, "sip", T_SIP, strict=True), with_packets(f"SELECT epoch, src_ip, count(*) AS cnt FROM p GROUP BY ALL HAVING count(*) > {T_SIP}"))
add("hh_crossing_exact", "E1,E2,I5", lambda p: detect.crossing(p, F.col("src_ip"), "sip", T_SIP), with_packets(f"SELECT epoch, seq, src_ip FROM (SELECT *, row_number() OVER (PARTITION BY epoch, src_ip ORDER BY seq) AS n FROM p) WHERE n = {T_SIP}"))
add("hh_last_payload", "B6,D14,E3", lambda p: detect.last_payload(p, "pair"), with_packets("SELECT epoch, src_ip, dst_ip, count(*) AS cnt, arg_max(src_port, seq) AS last_sport, arg_max(dst_port, seq) AS last_dport, arg_max(proto, seq) AS last_proto FROM p GROUP BY epoch, src_ip, dst_ip"))


def _crossing_sql(mode: str, seed: int, size: int, t: int, source: str = "p") -> str:
    keys = ", ".join(KEYS[mode])
    h = hashed_sql(source, key_words_sql(mode), [seed])
    return with_packets(f"SELECT epoch, seq, {keys} FROM (SELECT *, row_number() OVER (PARTITION BY epoch, h0 & {size - 1} ORDER BY seq) AS n FROM {h}) WHERE n = {t}")


add("hh_count_array", "D13,E1,E2", lambda p: detect.count_array(p, "pair", SMALL, T_CHANGE), _crossing_sql("pair", detect.ARRAY_SEED, SMALL, T_CHANGE))
add("hh_hashmap_lossy", "D14", lambda p: detect.lossy_store(p, "pair", SMALL, T_CHANGE), _crossing_sql("pair", 1, SMALL, T_CHANGE))
add("hh_sharedmap", "D22,G2,I10", lambda p: detect.lossy_store(trace.queues(p, 3).where("queue in (0, 2)"), "pair", SMALL, T_CHANGE), _crossing_sql("pair", 1, SMALL, T_CHANGE, f"(SELECT * FROM {hashed_sql('p', ['src_ip', 'dst_ip'], [1], 'q')} WHERE q0 % 3 IN (0, 2))"))
add("rss_queues", "A9", lambda p: trace.dealt(p, 4).groupBy("queue").agg(F.count("*").alias("packets"), F.countDistinct("src_ip", "dst_ip").alias("flows")), with_packets(f"SELECT q0 % 4 AS queue, count(*) AS packets, count(DISTINCT (src_ip, dst_ip)) AS flows FROM {hashed_sql('p', ['src_ip', 'dst_ip'], [1], 'q')} GROUP BY q0 % 4"))
_cm3 = hashed_sql("p", key_words_sql("sip"), detect.CM3)
_running = ", ".join(f"count(*) OVER (PARTITION BY epoch, h{i} & {SMALL - 1} ORDER BY seq) AS c{i}" for i in range(3))
add("hh_cm_crossing", "D12,E6,H18", lambda p: detect.count_min_crossing(p, "sip", SMALL, T_SIP), with_packets(f"SELECT epoch, seq, src_ip FROM (SELECT *, {_running} FROM {_cm3}) WHERE least(c0, c1, c2) = {T_SIP}"))
add("report_limit", "F5", lambda p: detect.report_limit(p.select("epoch", "seq", "src_ip", "dst_ip"), 100), with_packets("SELECT epoch, seq, src_ip, dst_ip FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY seq) AS n FROM p) WHERE n <= 100"))
add("topk_exact", "F2,F4", lambda p: detect.top_k(p, "sip", TOP), with_packets(f"SELECT * FROM (SELECT epoch, src_ip, w, CAST(row_number() OVER (PARTITION BY epoch ORDER BY w DESC, src_ip) AS INTEGER) AS rank FROM (SELECT epoch, src_ip, count(*) AS w FROM p GROUP BY ALL)) WHERE rank <= {TOP}"))
add("ss_exact", "D23-D26,B9", lambda p: detect.super_spreaders(p, T_SPREAD), with_packets(f"SELECT epoch, src_ip, count(DISTINCT dst_ip) AS n_dst FROM p GROUP BY ALL HAVING count(DISTINCT dst_ip) >= {T_SPREAD}"))
_b = hashed_sql("(SELECT DISTINCT epoch, src_ip, dst_ip FROM p)", ["dst_ip"], [1])
add("ss_bloom_bits", "D23,H12,C4", detect.bloom_spreaders, with_packets(f", b AS (SELECT * FROM {_b}) SELECT epoch, src_ip, count(DISTINCT bit) AS bits FROM (SELECT epoch, src_ip, h0 & 1023 AS bit FROM b UNION ALL SELECT epoch, src_ip, (h0 >> 10) & 1023 FROM b UNION ALL SELECT epoch, src_ip, (h0 >> 20) & 1023 FROM b) GROUP BY epoch, src_ip"))
_x = "xor(xor(dst_ip & 255, (dst_ip >> 8) & 255), xor((dst_ip >> 16) & 255, (dst_ip >> 24) & 255))"
_l = hashed_sql("p", ["src_ip"], [1])
add("ss_legacy_bits", "D27,B10,H13", lambda p: detect.folded_spreaders(p, 16, 8), with_packets(f"SELECT epoch, h0 & 15 AS bucket, count(DISTINCT xor({_x}, ({_x}) >> 2) & 63) AS bits FROM {_l} GROUP BY ALL HAVING count(DISTINCT xor({_x}, ({_x}) >> 2) & 63) > 8"))


def _flow_sql(mode: str) -> str:
    return f"(SELECT epoch, {', '.join(KEYS[mode])}, count(*) AS w FROM p GROUP BY ALL)"


def _change_sql(key: list[str], t: int) -> str:
    k = ", ".join(key)
    return with_packets(f""", f AS (SELECT epoch, {k}, count(*) AS w FROM p GROUP BY ALL), d AS (SELECT epoch, {k}, w AS s FROM f UNION ALL SELECT epoch + 1, {k}, -w FROM f WHERE epoch < (SELECT max(epoch) FROM f))
        SELECT epoch, {k}, CAST(sum(s) AS BIGINT) AS delta FROM d GROUP BY ALL HAVING abs(sum(s)) > {t}""")


add("hc_exact", "C1,E4,B11,I4", lambda p: detect.changes(flows(p, "sip"), ["src_ip"], T_CHANGE), _change_sql(["src_ip"], T_CHANGE))
_hb = hashed_sql("p", key_words_sql("pair"), [SH[0]])
add("hc_bucket", "D30,E3,E4", lambda p: detect.bucket_change(p, SMALL, T_CHANGE), with_packets(f""", h AS (SELECT epoch, seq, src_ip, dst_ip, h0 & {SMALL - 1} AS bucket FROM {_hb}),
    r AS (SELECT *, count(*) OVER (PARTITION BY epoch, bucket ORDER BY seq) AS n, row_number() OVER (PARTITION BY epoch, src_ip, dst_ip ORDER BY seq DESC) AS back FROM h),
    l AS (SELECT epoch + 1 AS epoch, bucket, count(*) AS c FROM h GROUP BY ALL)
    SELECT r.epoch, src_ip, dst_ip FROM r LEFT JOIN l ON r.epoch = l.epoch AND r.bucket = l.bucket WHERE back = 1 AND abs(n - coalesce(c, 0)) > {T_CHANGE}"""))
_hm = hashed_sql("p", key_words_sql("pair"), [1])
add("hc_minhash_table", "D29,A17,E3", lambda p: detect.last_key_table(p, SMALL), with_packets(f"SELECT epoch, h0 & {SMALL - 1} AS bucket, count(*) AS cnt, arg_max(src_ip, seq) AS src_ip, arg_max(dst_ip, seq) AS dst_ip FROM {_hm} GROUP BY epoch, h0 & {SMALL - 1}"))
add("pkt_collect", "D32", lambda p: p.select("epoch", "seq", "src_ip", "dst_ip"), with_packets("SELECT epoch, seq, src_ip, dst_ip FROM p"))
add("noop_count", "D34", lambda p: p.groupBy("epoch").agg(F.count("*").alias("packets")), with_packets("SELECT epoch, count(*) AS packets FROM p GROUP BY epoch"))


# Sketches ---------------------------------------------------------------------------------------------------------------


def _sketch(name: str, ids: str, ids_agg: str, build: Callable[[DataFrame], DataFrame], mode: str, sql: str) -> None:
    """Two queries: fed packet by packet, and from pre-aggregated flows. One oracle."""
    add(name, ids, lambda p: build(weighted(p)), sql)
    add(f"{name}_agg", ids_agg, lambda p: build(flows(p, mode)), sql)


def _rows_sql(mode: str, seeds: list[int], mask: int, columns: str = "epoch, w") -> str:
    h = f"(SELECT * FROM {hashed_sql(_flow_sql(mode), key_words_sql(mode), seeds)})"
    return union_rows("h", columns, [f"h{i} & {mask}" for i in range(len(seeds))]), h


def _counter_sql(mode: str, seeds: list[int], size: int) -> str:
    rows, h = _rows_sql(mode, seeds, size - 1)
    return with_packets(f", h AS {h} SELECT epoch, row, bucket, CAST(sum(w) AS BIGINT) AS cnt FROM {rows} GROUP BY ALL")


for _mode, _suffix in (("sip", ""), ("pair", "_pair")):
    _sketch(f"cm_counters{_suffix}", "D1", "D35,J7", lambda df, m=_mode: sketches.count_min(df, m, SIZE), _mode, _counter_sql(_mode, ROWS, SIZE))
_pr, _ph = _rows_sql("pair", ROWS, SMALL - 1, "epoch, src_ip, dst_ip, w")
_point_sql = with_packets(f", h AS {_ph}, r AS {_pr}, c AS (SELECT epoch, row, bucket, sum(w) AS cnt FROM r GROUP BY ALL) SELECT epoch, src_ip, dst_ip, w, CAST(min(cnt) AS BIGINT) AS est FROM r JOIN c USING (epoch, row, bucket) GROUP BY epoch, src_ip, dst_ip, w")
add("cm_point", "C2,J3", lambda p: sketches.count_min_point(flows(p, "pair"), sketches.count_min(flows(p, "pair"), "pair", SMALL), "pair", SMALL), _point_sql)

_ctz = "CASE WHEN {h} = 0 THEN 31 ELSE bit_count(({h} & -{h}) - 1) END"
_fh = hashed_sql(_flow_sql("sip"), ["src_ip"], ROWS)
_fr = union_rows("h", "epoch", [_ctz.format(h=f"h{i}") for i in range(4)], value="z")
_sketch("fm_bitmaps", "D2,A15,G4,H8", "D36", lambda df: sketches.fm(df, "sip"), "sip", with_packets(f", h AS {_fh} SELECT epoch, row, bit_or(1::BIGINT << z) AS bitmap FROM {_fr} GROUP BY epoch, row"))
_low = "bit_count((~bitmap & -(~bitmap)) - 1)"
add("fm_estimate", "D2", lambda p: sketches.fm_estimate(sketches.fm(flows(p, "sip"), "sip")), with_packets(f", h AS {_fh}, b AS (SELECT epoch, row, bit_or(1::BIGINT << z) AS bitmap FROM {_fr} GROUP BY epoch, row) SELECT epoch, round(pow(2.0::DOUBLE, avg(least({_low}, 31))) / 0.77351::DOUBLE, 6) AS est FROM b GROUP BY epoch"))
_lr, _lh = _rows_sql("pair", ROWS, 32 * SMALL - 1, "epoch")
_sketch("lc_bits", "D3,H11", "D37", lambda df: sketches.linear_counting(df, "pair", SMALL), "pair", with_packets(f", h AS {_lh} SELECT epoch, row, count(DISTINCT bucket) AS ones FROM {_lr} GROUP BY epoch, row"))
add("lc_estimate", "D3", lambda p: sketches.linear_estimate(sketches.linear_counting(flows(p, "pair"), "pair", SMALL), SMALL), with_packets(f", h AS {_lh} SELECT epoch, row, round(-{32.0 * SMALL} * ln(1 - count(DISTINCT bucket) / {32.0 * SMALL}), 6) AS est FROM {_lr} GROUP BY epoch, row"))
_mh = hashed_sql(_flow_sql("pair"), key_words_sql("pair"), [SH[0]])
_m = 8 * SMALL
_mrac = f"SELECT epoch, CASE WHEN hv < {_m // 2} THEN 1 WHEN hv < {_m * 3 // 4} THEN 2 WHEN hv < {_m * 7 // 8} THEN 3 ELSE 4 END AS arr, hv & {SMALL - 1} AS bucket, CAST(sum(w) AS BIGINT) AS cnt FROM (SELECT epoch, w, h0 & {_m - 1} AS hv FROM {_mh}) GROUP BY ALL"
_sketch("mrac_counters", "D4", "D38", lambda df: sketches.mrac(df, "pair", SMALL), "pair", with_packets(_mrac))
add("mrac_histogram", "D4", lambda p: sketches.mrac_histogram(sketches.mrac(flows(p, "pair"), "pair", SMALL)), with_packets(f"SELECT epoch, arr, cnt, count(*) AS n FROM ({_mrac}) GROUP BY ALL"))

for _mode in KEYS:
    _cols = ", ".join(KEYS[_mode])
    _xh = hashed_sql(_flow_sql(_mode), key_words_sql(_mode), CELLS)
    _xr = union_rows("h", f"epoch, {_cols}, w", [f"h{i} & {SMALL - 1}" for i in range(4)], value="cell")
    _xs = ", ".join(f"bit_xor({c}::BIGINT) AS x_{c}" for c in KEYS[_mode])
    add(f"flowradar_cells_{_mode}", "D5,D6,B3,G5", lambda p, m=_mode: sketches.flow_radar(flows(p, m), m, SMALL), with_packets(f", h AS {_xh} SELECT epoch, cell, {_xs}, count(*) AS flowc, CAST(sum(w) AS BIGINT) AS packetc FROM {_xr} GROUP BY epoch, cell"))
    add(f"flows_{_mode}", "B3,D15", lambda p, m=_mode: flows(p, m), with_packets(f"SELECT epoch, {_cols}, count(*) AS w FROM p GROUP BY ALL"))
_bh = hashed_sql(_flow_sql("pair"), key_words_sql("pair"), ROWS)
add("flowradar_filter", "D5", lambda p: sketches.bloom_bits(flows(p, "pair"), "pair", SMALL), with_packets(f", h AS {_bh} SELECT epoch, count(DISTINCT bit) AS ones FROM {union_rows('h', 'epoch', [f'h{i} & {32 * SMALL - 1}' for i in range(4)], value='bit')} GROUP BY epoch"))
for _mode in ("sip", "pair", "five"):
    _keys = ", ".join(KEYS[_mode])
    _bits = hashed_sql(f"(SELECT epoch, {_keys}, min(seq) AS first, count(*) AS w FROM p GROUP BY ALL)", key_words_sql(_mode), ROWS)
    _cells = hashed_sql("n", key_words_sql(_mode), CELLS)
    _bloom_sql = with_packets(f""", b AS (SELECT *, first = min(first) OVER (PARTITION BY epoch, bit) AS sets FROM {union_rows(_bits, f"epoch, {_keys}, first, w", [f"h{i} & {32 * 16 - 1}" for i in range(4)], value="bit")}),
    n AS (SELECT epoch, {_keys}, w, bool_or(sets) AS fresh FROM b GROUP BY epoch, {_keys}, w), c AS {_cells}
    SELECT epoch, cell, {", ".join(f"CAST(bit_xor(CASE WHEN fresh THEN {c}::BIGINT ELSE 0 END) AS BIGINT) AS x_{c}" for c in KEYS[_mode])}, count(*) FILTER (fresh) AS flowc, CAST(sum(w) AS BIGINT) AS packetc
    FROM {union_rows("c", f"epoch, {_keys}, w, fresh", [f"h{i} & 15" for i in range(4)], value="cell")} GROUP BY epoch, cell""")
    add(f"flowradar_bloom_{_mode}", "D5,D6", lambda p, m=_mode: sketches.flow_radar_bloom(weighted(p), m, 16), _bloom_sql)
    add(f"flowradar_bloom_{_mode}_agg", "D39-D41", lambda p, m=_mode: sketches.flow_radar_bloom(p.groupBy("epoch", *KEYS[m]).agg(F.min("seq").alias("seq"), F.count("*").alias("w")), m, 16), _bloom_sql)
add("flowradar_decode", "D5", lambda p: stateful.decode_cells(sketches.flow_radar(flows(p, "sip"), "sip", SIZE), flows(p, "sip"), SIZE, CELLS), with_packets("SELECT epoch, src_ip AS flow, count(*) AS packets FROM p GROUP BY ALL"))

_ch = hashed_sql(_flow_sql("pair"), key_words_sql("pair"), ROWS + SIGNS)
_signed = "(" + " UNION ALL ".join(f"SELECT epoch, src_ip, dst_ip, w, {i} AS row, h{i} & {SMALL - 1} AS bucket, 2 * (h{i + 4} & 1) - 1 AS sign FROM h" for i in range(4)) + ")"
_sketch("countsketch_counters", "D8", "D8", lambda df: sketches.count_sketch(df, "pair", SMALL), "pair", with_packets(f", h AS {_ch} SELECT epoch, row, bucket, CAST(sum(sign * w) AS BIGINT) AS cnt FROM {_signed} GROUP BY ALL"))
_top_sql = with_packets(f""", h AS {_ch}, s AS {_signed}, c AS (SELECT epoch, row, bucket, sum(sign * w)::BIGINT AS cnt FROM s GROUP BY ALL),
    e AS (SELECT epoch, src_ip, dst_ip, (CAST(sum(sign * cnt) - min(sign * cnt) - max(sign * cnt) AS BIGINT)) // 2 AS est FROM s JOIN c USING (epoch, row, bucket) GROUP BY epoch, src_ip, dst_ip)
    SELECT * FROM (SELECT epoch, src_ip, dst_ip, est, CAST(row_number() OVER (PARTITION BY epoch ORDER BY est DESC, src_ip, dst_ip) AS INTEGER) AS rank FROM e) WHERE rank <= {TOP}""")
add("univmon_topk", "D8,D31,F1,F3,H18", lambda p: sketches.count_sketch_top(flows(p, "pair"), sketches.count_sketch(flows(p, "pair"), "pair", SMALL), "pair", SMALL, TOP), _top_sql)
_lv = f"SELECT *, CASE WHEN h0 & 1 = 1 THEN 2 WHEN h1 & 1 = 1 THEN 3 WHEN h2 & 1 = 1 THEN 4 ELSE 0 END AS x FROM {_ch}"
_uni = "(" + " UNION ALL ".join(f"SELECT epoch, {lv} AS level, {i} AS row, h{i} & {(SMALL >> lv - 1) - 1} AS bucket, (2 * (h{i + 4} & 1) - 1) * w AS v FROM h WHERE {f'x = {lv}' if lv > 1 else 'true'}" for lv in (1, 2, 3, 4) for i in range(4)) + ")"
_sketch("univmon_counters", "D9,B14", "D43", lambda df: sketches.univmon(df, "pair", SMALL), "pair", with_packets(f", h AS ({_lv}) SELECT epoch, level, row, bucket, CAST(sum(v) AS BIGINT) AS cnt FROM {_uni} GROUP BY ALL"))
_dseeds = [s for row in DIGITS for s in row]
_dig = lambda r, bits: " | ".join(f"((h{4 * r + i} & {(1 << bits) - 1}) << {bits * (3 - i)})" for i in range(4))
_rh = hashed_sql(_flow_sql("sip"), ["src_ip"], _dseeds)
_sketch("revsketch_counters", "D10,H3", "D44", lambda df: sketches.rev_sketch(df, "sip"), "sip", with_packets(f", h AS {_rh} SELECT epoch, row, bucket, CAST(sum(w) AS BIGINT) AS cnt FROM {union_rows('h', 'epoch, w', [_dig(r, 4) for r in range(4)])} GROUP BY ALL"))
_r1 = hashed_sql(_flow_sql("sip"), ["(src_ip >> 24) & 255"], _dseeds, length=1)
add("revsketch_one_byte", "D10,H3", lambda p: sketches.rev_sketch(flows(p, "sip"), "sip", one_byte=True), with_packets(f", h AS {_r1} SELECT epoch, row, bucket, CAST(sum(w) AS BIGINT) AS cnt FROM {union_rows('h', 'epoch, w', [_dig(r, 4) for r in range(4)])} GROUP BY ALL"))
_th = hashed_sql(hashed_sql(_flow_sql("pair"), ["src_ip"], _dseeds), ["dst_ip"], [SH[4]], name="d")
_t1 = union_rows("h", "epoch, d0 % 96 AS bit, 1 AS level", [_dig(r, 3) for r in range(4)], value="cell")
_t2 = union_rows("h", "epoch, d0 % 96 AS bit, 2 AS level", [f"h{i} & {SMALL - 1}" for i in range(4)], value="cell")
_sketch("twolevel_bits", "D11,C4", "D45,B5", lambda df: sketches.two_level(df, SMALL), "pair", with_packets(f", h AS {_th} SELECT epoch, level, row, cell, count(DISTINCT bit) AS bits FROM (SELECT * FROM {_t1} UNION ALL SELECT * FROM {_t2}) GROUP BY epoch, level, row, cell"))
_c3r, _c3h = _rows_sql("pair", ROWS[:3], SMALL - 1)
add("hc_cm3_counters", "D31", lambda p: detect.count_min3(p, "pair", SMALL), with_packets(f", h AS {_c3h} SELECT epoch, row, bucket, CAST(sum(w) AS BIGINT) AS cnt FROM {_c3r} GROUP BY ALL"))
_c3k, _ = _rows_sql("pair", ROWS[:3], SMALL - 1, "epoch, src_ip, dst_ip, w")
add("hc_cm3_top", "D31,F3", lambda p: detect.count_min3_top(p, "pair", SMALL, TOP), with_packets(f", h AS {_c3h}, r AS {_c3k}, c AS (SELECT epoch, row, bucket, sum(w) AS cnt FROM r GROUP BY ALL), e AS (SELECT epoch, src_ip, dst_ip, CAST(min(cnt) AS BIGINT) AS est FROM r JOIN c USING (epoch, row, bucket) GROUP BY epoch, src_ip, dst_ip) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY epoch ORDER BY est DESC, src_ip, dst_ip) AS INTEGER) AS rank FROM e) WHERE rank <= {TOP}"))
for _name, _ids, _words, _seed, _times in (("legacy_count_array", "D28,H2", "pair", 1, 1), ("ring_consumer", "A22,A23", "pair", 1, 3)):
    _ah = hashed_sql("p", key_words_sql(_words), [_seed])
    add(_name, _ids, lambda p, w=_words, s=_seed, t=_times: detect.bucket_counts(p, [F.col(c) for c in KEYS[w]], s, SMALL, t), with_packets(f"SELECT epoch, h0 & {SMALL - 1} AS bucket, {_times} * count(*) AS cnt FROM {_ah} GROUP BY ALL"))
add("rand_mod", "D33", lambda p: detect.bucket_counts(p, [F.col("seq")], 1, SMALL), with_packets(f"SELECT epoch, h0 & {SMALL - 1} AS bucket, count(*) AS cnt FROM {hashed_sql('p', ['seq'], [1])} GROUP BY ALL"))

# Order-dependent summaries: rows only, invariants in the tests ------------------------------------------------------------

add("spacesaving", "D7,A16,F2", lambda p: stateful.space_saving(p, TOP))
add("spacesaving_agg", "D42", lambda p: stateful.space_saving(stateful.evict_cache(p, 64, 4).withColumnsRenamed({"flow": "src_ip", "cnt": "w"}), TOP))
add("bounded_queue", "D21", lambda p: stateful.bounded_queue(p, 64, 4))
for _policy in ("grr", "lru"):
    add(f"cache_hit_ratio_{_policy}", "D35-D45,J7", lambda p, c=_policy: stateful.cache_ratio(stateful.evict_cache(p, 16, 4, c)))
    add(f"cache_sums_{_policy}", "D35-D45,J7", lambda p, c=_policy: stateful.evict_cache(p, 16, 4, c).groupBy("epoch", F.col("flow").alias("src_ip")).agg(F.sum("cnt").alias("w")), with_packets("SELECT epoch, src_ip, count(*) AS w FROM p GROUP BY ALL"))
    for _mode, _fp in (("pair", ["src_ip", "dst_ip"]), ("five", ["src_ip", "dst_ip", "proto"])):
        add(
            f"cache_sums_{_policy}_{_mode}", "D41,D45,B5",
            lambda p, c=_policy, m=_mode, f=_fp: stateful.evict_cache(p, 16, 4, c, KEYS[m], functools.reduce(lambda a, b: a.bitwiseXOR(b), (F.col(x).cast("long") for x in f))).groupBy("epoch", *KEYS[m]).agg(F.sum("cnt").alias("w")),
            with_packets(f"SELECT epoch, {', '.join(f'{x}::BIGINT AS {x}' for x in KEYS[_mode])}, count(*) AS w FROM p GROUP BY ALL"),
        )

# Sources, sinks, scalars --------------------------------------------------------------------------------------------------


def _trace_lines(spark: SparkSession, d: str) -> DataFrame:
    """The events as trace lines with all separators, radixes and protocols; a line of four fields after each hundredth."""
    p = spark.read.parquet(f"{d}/events.parquet")
    from flowloom.plans.packets import from_events

    q = from_events(p, valid_only=False)
    sep = F.when(F.col("seq") % 3 == 0, " ").when(F.col("seq") % 3 == 1, ",").otherwise(" \t")
    src = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("0x"), F.lower(F.hex("src_ip")))).when((F.col("seq") % 4 == 1) & (F.col("src_ip") > 0), F.concat(F.lit("0"), F.conv(F.col("src_ip").cast("string"), 10, 8))).otherwise(F.col("src_ip").cast("string"))
    line = F.concat(src, sep, F.col("dst_ip").cast("string"), sep, F.col("src_port").cast("string"), sep, F.col("dst_port").cast("string"), F.when(F.col("seq") % 100 == 50, F.lit("")).otherwise(F.concat(sep, F.col("proto").cast("string"))))
    return q.select(F.expr("seq div 4096").alias("part"), F.col("seq").alias("at"), line.alias("value"))


Q["trace_parse"] = Query("A1,A2,B1,H16,F6", lambda spark, d: trace.numbered(trace.parse_lines(_trace_lines(spark, d))), f"SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, src_ip, dst_ip, src_port, dst_port, proto FROM ({packets_sql()}) WHERE seq % 100 <> 50")


def _trace_file(spark: SparkSession, d: str) -> DataFrame:
    from flowloom.plans.packets import from_events
    from flowloom.sources.files import shared_path

    path = shared_path(spark, "trace")
    body = from_events(spark.read.parquet(f"{d}/events.parquet"), valid_only=False)
    trace.write_trace(body.orderBy("seq"), path, header=True)
    return trace.read_trace(spark, path)


Q["trace_file"] = Query("A1,B2", _trace_file, f"SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, src_ip, dst_ip, src_port, dst_port, proto FROM ({packets_sql()})")
add("trace_profile", "A7", lambda p: trace.profile(p, ["src_ip", "dst_ip"]), with_packets("SELECT CAST(sum(n) AS BIGINT) AS packets, count(*) AS flows, max(n) AS most FROM (SELECT count(*) AS n FROM p GROUP BY src_ip, dst_ip)"))
add("replay_passes", "A4,A5,I1", lambda p: trace.replay(p, 3).groupBy("pass", F.expr(f"seq div {TEST_EPOCH}").alias("pass_epoch")).agg(F.count("*").alias("packets"), F.min("seq").alias("first")), with_packets(f"SELECT CAST(pass AS INTEGER) AS pass, s // {TEST_EPOCH} AS pass_epoch, count(*) AS packets, min(s) AS first FROM (SELECT r.pass, r.pass * (SELECT max(seq) + 1 FROM p) + seq AS s FROM p, range(3) r(pass)) GROUP BY ALL"))
add("send_bursts", "A4,A8", trace.bursts, with_packets("SELECT seq // 32 AS burst, min(seq) AS first, count(*) AS packets FROM p GROUP BY burst"))


_zh = hashed_sql("p", ["seq"], [17093])
_zipf_sql = with_packets(f""", k AS (SELECT src_ip, row_number() OVER (ORDER BY src_ip) AS rank FROM (SELECT DISTINCT src_ip FROM p)), n AS (SELECT count(*) AS n FROM k),
    u AS (SELECT (h0 + 0.5::DOUBLE) / 4294967296::DOUBLE AS u, n FROM {_zh}, n), s AS (SELECT CAST(i AS DOUBLE) * 3 / 10 AS skew FROM range(11) r(i)),
    z AS (SELECT skew, CASE WHEN skew = 0 THEN CAST(floor(u * n) AS BIGINT) + 1 ELSE least(greatest(n + 1 - CAST(floor(pow((n + 1)::DOUBLE, pow(u, skew))) AS BIGINT), 1), n) END AS rank FROM u, s)
    SELECT skew, src_ip, count(*) AS packets FROM z JOIN k USING (rank) GROUP BY skew, src_ip""")
add("zipf_ranks", "A6,H17,C5", lambda p: trace.zipf_counts(p, trace.SKEWS, "src_ip"), _zipf_sql)
add("zipf_trace", "A6,F7", lambda p: trace.zipf(p, 1.2), _zipf_sql.replace("FROM range(11) r(i))", "FROM range(4, 5) r(i))").replace("u AS (SELECT (h0", "u AS (SELECT seq, (h0").replace("z AS (SELECT skew,", "z AS (SELECT seq,").replace("SELECT skew, src_ip, count(*) AS packets FROM z JOIN k USING (rank) GROUP BY skew, src_ip", "SELECT seq, src_ip FROM z JOIN k USING (rank)"))
add("trace_shuffled", "F7", lambda p: trace.shuffled(p.select("seq", "src_ip", "dst_ip")), with_packets(f", h AS {hashed_sql('p', ['seq'], [17093])} SELECT row_number() OVER (ORDER BY h0, seq) - 1 AS seq, src_ip, dst_ip FROM h"))
add("report_lines", "A11,A20,H15,J5", lambda p: reports.report_lines(detect.heavy_hitters(p, "pair", T_PAIR), T_PAIR), with_packets(f"SELECT epoch, concat_ws('.', src_ip >> 24, (src_ip >> 16) & 255, (src_ip >> 8) & 255, src_ip & 255) || '/' || concat_ws('.', dst_ip >> 24, (dst_ip >> 16) & 255, (dst_ip >> 8) & 255, dst_ip & 255) || ' {T_PAIR}' AS line FROM p GROUP BY epoch, src_ip, dst_ip HAVING count(*) >= {T_PAIR}"))
add("search_load", "A12,L6", lambda p: reports.search_load(p, "SimdBatch::CMSketch"), with_packets("SELECT 'SimdBatch::CMSketch' AS module, 'SearchLoad' AS metric, count(*) AS value FROM p"))
add("epoch_ticks", "A18,I1,I3", lambda p: reports.ticks(p, TEST_EPOCH), with_packets(f"SELECT epoch, seq FROM p WHERE seq % {TEST_EPOCH} = 0"))
add("hex_dump", "A20", reports.hex_dump, with_packets("SELECT seq, lpad(lower(hex(src_ip)), 8, '0') || ' -> ' || lpad(lower(hex(dst_ip)), 8, '0') AS text FROM p"))
add("fingerprints", "B5", lambda p: p.select("seq", F.col("src_ip").bitwiseXOR(F.col("dst_ip")).alias("pair_fp"), F.col("src_ip").bitwiseXOR(F.col("dst_ip")).bitwiseXOR(F.col("proto").cast("long")).alias("type_fp")), with_packets("SELECT seq, xor(src_ip, dst_ip) AS pair_fp, xor(xor(src_ip, dst_ip), proto::BIGINT) AS type_fp FROM p"))
add("port_filter", "B13,A9,A10", lambda p: p.where("port = 1").groupBy("epoch").agg(F.count("*").alias("packets")), with_packets("SELECT epoch, count(*) AS packets FROM p WHERE port = 1 GROUP BY epoch"))
_h2 = hashed_sql("p", ["src_ip"], [1])
_alt = lambda s, c: f"xor(h0, (((h0 >> {s}) + 1)::UBIGINT * {c}::UBIGINT & 4294967295::UBIGINT)::BIGINT)"
add("scalar_hashes", "H1,H2,H4,H5,H6,H9,H10,H21", lambda p: p.select("seq", mm3([F.col("src_ip")], 1).alias("h")).select("seq", "h", second_hash(F.col("h"), 13, 0x5BD1E995).alias("h2"), second_hash(F.col("h"), 10, 0xC6A4A793).alias("h3"), second_hash(F.col("h"), 12, 0x5BD1E995).alias("h4"), (F.col("h") % 96).alias("m96"), (F.col("h") % 2000).alias("m2000"), ctz32(F.col("h")).alias("tz")), with_packets(f"SELECT seq, h0 AS h, {_alt(13, 0x5BD1E995)} AS h2, {_alt(10, 0xC6A4A793)} AS h3, {_alt(12, 0x5BD1E995)} AS h4, h0 % 96 AS m96, h0 % 2000 AS m2000, CAST({_ctz.format(h='h0')} AS INTEGER) AS tz FROM {_h2}"))
add("byte_order", "H14", lambda p: p.select("seq", bswap32(F.col("src_ip")).alias("net")), with_packets("SELECT seq, ((src_ip & 255) << 24) | ((src_ip & 65280) << 8) | ((src_ip >> 8) & 65280) | ((src_ip >> 24) & 255) AS net FROM p"))

_hist = "SELECT least(CAST(floor((300 + h0 % 3000) / (2.0 * (1 + h1 % 32))) AS BIGINT), 2047) AS bucket, 1 + h1 % 32 AS len FROM " + hashed_sql("p", ["seq"], [11, 12])


def _batches(p: DataFrame) -> DataFrame:
    """Made-up processing times: cycles of a batch and its packets."""
    return p.select((mm3([F.col("seq")], 11) % 3000 + 300).alias("cycles"), (mm3([F.col("seq")], 12) % 32 + 1).alias("len"))


add("latency_histogram", "H24", lambda p: evaluate.histogram(_batches(p)), with_packets(f"SELECT bucket, CAST(sum(len) AS BIGINT) AS packets FROM ({_hist}) GROUP BY bucket"))
_ps = ", ".join(f"({x})" for x in evaluate.PERCENTILES)
add("latency_percentiles", "H22,A14", lambda p: evaluate.percentiles(evaluate.histogram(_batches(p))), with_packets(f""", g AS (SELECT bucket, sum(len)::BIGINT AS n FROM ({_hist}) GROUP BY bucket), c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS cum, sum(n) OVER () AS total FROM g)
    SELECT q.p::DOUBLE AS p, CAST(coalesce(min(CASE WHEN cum::DOUBLE > total::DOUBLE * q.p::DOUBLE / 100 THEN bucket * 2 END), 4096) AS BIGINT) AS cycles FROM c, (VALUES {_ps}) q(p) GROUP BY q.p"""))
add("latency_mean", "H23,H25", lambda p: evaluate.mean_latency(evaluate.histogram(_batches(p))).select(F.round("mean", 6).alias("mean"), F.round(scalars.cycles_to_ns(F.col("mean")), 6).alias("ns")), with_packets(f", m AS (SELECT sum(len * bucket * 2)::DOUBLE / sum(len) + 1 AS mean FROM ({_hist})) SELECT round(mean, 6) AS mean, round(mean / 2.2, 6) AS ns FROM m"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), (F.col("event_id") % 2).alias("port"))
    from pyspark.sql import Window

    hourly = ev.groupBy("port", "t").agg(F.count("*").alias("n"))
    total = hourly.select("port", "t", F.sum("n").over(Window.partitionBy("port").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)).alias("packets"))
    return evaluate.rates(total, "t", "packets", ["port"])


_snap_sql = "WITH e AS (SELECT event_id % 2 AS port, date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT port, t, sum(n) OVER (PARTITION BY port ORDER BY t) AS packets FROM e), d AS (SELECT port, t, packets, packets - lag(packets) OVER w AS delta, epoch(t) - epoch(lag(t) OVER w) AS seconds FROM r WINDOW w AS (PARTITION BY port ORDER BY t))"
Q["rate_delta"] = Query("E5,H26", lambda spark, d: _snapshots(spark, d).select("port", F.unix_seconds(F.col("t").cast("timestamp")).alias("t"), "packets", "delta", F.col("seconds").cast("long").alias("seconds"), F.round(scalars.link_rate(F.col("delta"), F.col("seconds"), 64), 9).alias("mbps")), _snap_sql + " SELECT port, CAST(epoch(t) AS BIGINT) AS t, CAST(packets AS BIGINT) AS packets, CAST(delta AS BIGINT) AS delta, CAST(seconds AS BIGINT) AS seconds, round(delta::DOUBLE * 672 / seconds / 1000000.0::DOUBLE, 9) AS mbps FROM d")
Q["steady_rate"] = Query("L5", lambda spark, d: evaluate.steady_mean(_snapshots(spark, d).withColumn("x", F.col("delta") * 1000), ["port"], "t", "x"), _snap_sql + ", s AS (SELECT port, delta * 1000 AS x, row_number() OVER (PARTITION BY port ORDER BY t DESC) AS n FROM d WHERE delta * 1000 >= 1000) SELECT port, round(avg(x), 6) AS mean FROM s WHERE n BETWEEN 3 AND 10 GROUP BY port")

# Evaluation ----------------------------------------------------------------------------------------------------------------


def _truth_and_report(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    est = sketches.count_min_point(flows(p, "pair"), sketches.count_min(flows(p, "pair"), "pair", SMALL), "pair", SMALL)
    return detect.heavy_hitters(p, "pair", T_PAIR), est.where(F.col("est") >= T_EST)


_acc_ctes = _point_sql.replace("SELECT epoch, src_ip, dst_ip, w, CAST(min(cnt)", ", m AS (SELECT epoch, src_ip, dst_ip, w, CAST(min(cnt)", 1) + f"), t AS (SELECT epoch, src_ip, dst_ip FROM m WHERE w >= {T_PAIR}), q AS (SELECT epoch, src_ip, dst_ip FROM m WHERE est >= {T_EST})"
_cut = lambda a, b: f"CASE WHEN {b} > 0 THEN floor(100.0::DOUBLE * {a} / ({b}) * 1000 + 1e-9) / 1000 ELSE 0 END"
_both = "(SELECT coalesce(t.epoch, q.epoch) AS epoch, t.src_ip IS NOT NULL AS a, q.src_ip IS NOT NULL AS b FROM t FULL JOIN q ON t.epoch = q.epoch AND t.src_ip = q.src_ip AND t.dst_ip = q.dst_ip)"
_acc_sql = f"{_acc_ctes}, x AS (SELECT epoch, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a) AS fp, count(*) FILTER (NOT b) AS fn FROM {_both} GROUP BY epoch) SELECT epoch, tp, fp, fn, {_cut('tp', 'tp + fp')} AS precision, {_cut('tp', 'tp + fn')} AS recall, {_cut('2 * tp', '2 * tp + fp + fn')} AS f1 FROM x"
add("accuracy_by_epoch", "L2,L3,L7,C3", lambda p: evaluate.accuracy(*_truth_and_report(p), ["src_ip", "dst_ip"]), _acc_sql)
add("true_positives", "L1,C3,G1", lambda p: (lambda t, r: t.select("epoch", "src_ip", "dst_ip").intersect(r.select("epoch", "src_ip", "dst_ip")))(*_truth_and_report(p)), f"{_acc_ctes} SELECT * FROM t INTERSECT SELECT * FROM q")
add("false_positives", "G6", lambda p: (lambda t, r: r.select("epoch", "src_ip", "dst_ip").exceptAll(t.select("epoch", "src_ip", "dst_ip")))(*_truth_and_report(p)), f"{_acc_ctes} SELECT * FROM q EXCEPT SELECT * FROM t")
add("relative_error", "L12", lambda p: evaluate.relative_error(sketches.count_min_point(flows(p, "pair"), sketches.count_min(flows(p, "pair"), "pair", SMALL), "pair", SMALL)), f"{_acc_ctes} SELECT epoch, round(avg(abs(est - w)), 6) AS aae, round(avg(abs(est - w)::DOUBLE / w), 6) AS are FROM m GROUP BY epoch")
add("result_rows", "L7", lambda p: evaluate.result_rows(evaluate.accuracy(*_truth_and_report(p), ["src_ip", "dst_ip"]), "countmin", "def", SMALL, 1), _acc_sql.replace("SELECT epoch, tp, fp, fn,", f"SELECT 'countmin' AS exp, {SMALL}::BIGINT AS size, 'def' AS dist, 1::BIGINT AS val_size, 'countmin-def' AS label, epoch,").replace(f", {_cut('2 * tp', '2 * tp + fp + fn')} AS f1", ""))
add("union_epochs", "G2,G3,F8", lambda p: p.where("epoch = 0").select("src_ip").unionByName(p.where("epoch > 0").select("src_ip")).distinct().orderBy("src_ip"), with_packets("SELECT DISTINCT src_ip FROM p"))
add("key_existence", "C4", lambda p: p.select("src_ip", "dst_ip").distinct().join(p.where("epoch = 0").select("src_ip", "dst_ip").distinct(), ["src_ip", "dst_ip"], "left_anti"), with_packets("SELECT DISTINCT src_ip, dst_ip FROM p WHERE (src_ip, dst_ip) NOT IN (SELECT (src_ip, dst_ip) FROM p WHERE epoch = 0)"))
add("grouping_sets", "B3", lambda p: p.cube("src_ip", "proto").agg(F.count("*").alias("w"), F.grouping_id().cast("long").alias("gid")), with_packets("SELECT src_ip, proto, count(*) AS w, CAST(grouping(src_ip, proto) AS BIGINT) AS gid FROM p GROUP BY CUBE (src_ip, proto)"))

_SIZES = [128 << i for i in range(0, 17, 4)]
#: The published sizes of an entry, by (k, e) words of key and value.
_entry_sql = """CASE WHEN name LIKE '%pqueue%' THEN 8 + (keysize + valsize + 1) WHEN name LIKE '%cuckoo-bucket%' OR name LIKE '%cuckoo-ptr%' OR name LIKE '%cuckoo-local%' THEN 4 * (keysize + valsize + 1) * 2
    WHEN name LIKE '%countmin%' THEN 4 * valsize * 3 ELSE 4 * (keysize + valsize + 1) END"""


def _axes(spark: SparkSession, done: list[tuple], schema: str, **axes: list) -> DataFrame:
    left = evaluate.sweep(spark, spark.createDataFrame(done, schema), **axes)
    return left.withColumns({c: F.col(c).cast("long") for c in ("size", "keysize", "valsize") if c in axes})


Q["memory_model"] = Query(
    "H27,L11", lambda spark, d: evaluate.memory_model(_axes(spark, [("01-hh-hm-linear", 128, 1, 1)], "name string, size long, keysize long, valsize long", name=[*evaluate.TITLES.values()], size=_SIZES, keysize=[1, 2, 4], valsize=[1, 3])),
    f"SELECT name, size, keysize, valsize, CAST(size * {_entry_sql} AS BIGINT) AS bytes FROM (SELECT unnest({[*evaluate.TITLES.values()]!r}) AS name) a, (SELECT unnest({_SIZES})::BIGINT AS size) b, (SELECT unnest([1, 2, 4])::BIGINT AS keysize) c, (SELECT unnest([1, 3])::BIGINT AS valsize) d WHERE NOT (name = '01-hh-hm-linear' AND size = 128 AND keysize = 1 AND valsize = 1)",
)
_ARRAYS = ["cmsketch", "countheap", "countarray", "fmsketch", "linearcounting", "mrac", "flowradar", "spacesaving"]
Q["array_bytes"] = Query(
    "H27", lambda spark, d: evaluate.array_bytes(_axes(spark, [("mrac", 128, 1)], "module string, size long, keysize long", module=_ARRAYS, size=_SIZES, keysize=[1, 2, 4])),
    f"SELECT module, size, keysize, CAST(CASE WHEN module IN ('cmsketch', 'countheap', 'linearcounting', 'mrac') THEN size * 16 WHEN module = 'countarray' THEN size * 4 WHEN module = 'fmsketch' THEN 16 WHEN module = 'flowradar' THEN size * 4 + size * (keysize + 2) * 4 ELSE size * (keysize + 1) * 4 END AS BIGINT) AS bytes FROM (SELECT unnest({_ARRAYS!r}) AS module) a, (SELECT unnest({_SIZES})::BIGINT AS size) b, (SELECT unnest([1, 2, 4])::BIGINT AS keysize) c WHERE NOT (module = 'mrac' AND size = 128 AND keysize = 1)",
)
_titles = ", ".join(f"('{t}', '{n}')" for t, n in evaluate.TITLES.items())
Q["store_titles"] = Query(
    "L8", lambda spark, d: spark.createDataFrame([(t,) for t in [*evaluate.TITLES, "Other"]], "title string").withColumn("name", evaluate.name_of(F.col("title"))).withColumn("back", evaluate.title_of(F.concat(F.lit("run-"), "name"))),
    f"SELECT title, name, title AS back FROM (VALUES {_titles}) t(title, name) UNION ALL SELECT 'Other', 'Other', NULL",
)
add("accuracy_total", "L1,L2,L3", lambda p: evaluate.offset_totals(*(lambda t, r: (t, r.withColumn("epoch", F.col("epoch") + 1)))(*_truth_and_report(p)), ["src_ip", "dst_ip"], epochs=3), f"""{_acc_ctes}, n AS (SELECT (SELECT count(*) FROM (SELECT * FROM t WHERE epoch < 3 INTERSECT SELECT * FROM q)) AS tp, (SELECT count(*) FROM t) AS relevant, (SELECT count(*) FROM q) AS selected)
    SELECT tp, relevant, selected, {_cut("tp", "relevant")} AS of_relevant, {_cut("tp", "selected")} AS of_selected FROM n""")
add("accuracy_unlimited", "L10", lambda p: evaluate.unlimited(evaluate.accuracy(*_truth_and_report(p), ["src_ip", "dst_ip"])), f"SELECT epoch, tp, fp, fn, 100.0::DOUBLE AS precision, 100.0::DOUBLE AS recall, f1 FROM ({_acc_sql})")
_panel = "seq AS line_no, CASE src_port WHEN 0 THEN 'p50' WHEN 1 THEN 'p95' WHEN 2 THEN 'p99' ELSE 'avg' END AS name"
add("last_panel", "L4", lambda p: evaluate.last_panel(p.selectExpr(*_panel.split(", ", 1), "CASE WHEN src_port > 2 AND seq % 3 > 0 THEN double('NaN') WHEN seq % 7 > 0 THEN 4096D ELSE double(seq % 500) END AS value")),
    with_packets(f"SELECT name, arg_max(value, line_no) AS value FROM (SELECT {_panel}, CASE WHEN src_port > 2 AND seq % 3 > 0 THEN 'NaN'::DOUBLE WHEN seq % 7 > 0 THEN 4096::DOUBLE ELSE (seq % 500)::DOUBLE END AS value FROM p) WHERE value <> 4096 AND NOT isnan(value) GROUP BY name"))
_occ = hashed_sql("p", ["seq"], [21])
add("occupancy", "L9", lambda p: evaluate.occupancy(p.select((F.col("seq") % 8).cast("int").alias("core"), F.col("seq").alias("t"), (mm3([F.col("seq")], 21) % 30000).alias("kb")), 0b10110), with_packets(f", s AS (SELECT CAST(seq % 8 AS INTEGER) AS core, h0 % 30000 AS kb, row_number() OVER (PARTITION BY seq % 8 ORDER BY seq DESC) AS n FROM {_occ}) SELECT round(sum(kb), 6) AS total FROM (SELECT core, avg(kb) AS kb FROM s WHERE n BETWEEN 6 AND 10 AND (22 & (1 << core)) <> 0 GROUP BY core)"))

# Streaming --------------------------------------------------------------------------------------------------------------------


def _streamed(then: Callable[[DataFrame], DataFrame] | None, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from flowloom.sources.files import shared_path

        path = f"{d}/events.parquet"
        schema = spark.read.parquet(path).schema
        out = shared_path(spark, f"stream-{uuid.uuid4().hex}")
        made = build(replay.timed(replay.event_stream(spark, f"{d}/event[s].parquet", schema, TEST_EPOCH)))
        replay.run_once(made, f"{out}/rows", f"{out}/check", then)
        return spark.read.schema(made.schema if then is None else then(made).schema).parquet(f"{out}/rows")

    return run


Q["stream_hh_exact"] = Query("I1,I2,I3,I5,I6", _streamed(lambda c: c.where(F.col("cnt") >= T_PAIR), lambda df: replay.stream_counts(df, "pair")), Q["hh_exact_pair"].sql)


def _stream_cm(df: DataFrame) -> DataFrame:
    hashed = sketches.rows_of(df, *(sketches.low_bits(mm3([F.col("src_ip")], s), SIZE) for s in ROWS))
    return hashed.groupBy("closes", "epoch", "row", F.col("h").alias("bucket")).agg(F.count("*").alias("cnt")).drop("closes")


Q["stream_cm_counters"] = Query("I1,I2", _streamed(None, _stream_cm), Q["cm_counters"].sql)



def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return replay.event_stream(spark, f"{d}/event[s].parquet", spark.read.parquet(path).schema, TEST_EPOCH)


def _stream_crossing(spark: SparkSession, d: str) -> DataFrame:
    from flowloom.sources.files import shared_path

    out = shared_path(spark, "stream-crossing")
    made = replay.stream_crossing(_stream(spark, d), "src_ip", T_SIP)
    replay.run_once(made, f"{out}/rows", f"{out}/check")
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


Q["stream_crossing"] = Query("I4,I5,E1", _stream_crossing, Q["hh_crossing_exact"].sql)


def _stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Two modules look at each batch of one stream; what they add to running totals is summed over the batches."""
    from flowloom.sources.files import shared_path

    out = shared_path(spark, "stream-modules")
    modules = {"packets": lambda b: b.groupBy("port").agg(F.count("*").alias("n")), "spread": lambda b: b.groupBy("port").agg(F.sum("dst_ip").alias("n"))}
    replay.fan_out(_stream(spark, d), modules, lambda name, rows, number: rows.write.mode("overwrite").parquet(f"{out}/rows/module={name}/batch={number}"), f"{out}/check").awaitTermination()
    return spark.read.schema("port int, n long, module string, batch long").parquet(f"{out}/rows").groupBy("module", "port").agg(F.sum("n").alias("n"))


Q["stream_modules"] = Query("I8,I11", _stream_totals, with_packets("SELECT 'packets' AS module, port, count(*) AS n FROM p GROUP BY port UNION ALL SELECT 'spread', port, CAST(sum(dst_ip) AS BIGINT) FROM p GROUP BY port"))

# Larger feeds, for the bench: one flow key of few values and one of many ------------------------------------------------------


def lineitem_packets(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.lit(0).cast("long").alias("epoch"), F.col("l_suppkey").alias("src_ip"), F.col("l_partkey").alias("dst_ip"))


_LI = "WITH p AS (SELECT 0::BIGINT AS epoch, l_suppkey AS src_ip, l_partkey AS dst_ip FROM lineitem)"
for _mode in ("sip", "pair"):
    _li_sql = _counter_sql(_mode, ROWS, SIZE)
    _li_sql = _LI + _li_sql[_li_sql.index(", h AS") :]
    Q[f"lineitem_cm_{_mode}"] = Query("D1", lambda spark, d, m=_mode: sketches.count_min(weighted(lineitem_packets(spark, d)), m, SIZE), _li_sql)
    Q[f"lineitem_cm_{_mode}_agg"] = Query("D35", lambda spark, d, m=_mode: sketches.count_min(flows(lineitem_packets(spark, d), m), m, SIZE), _li_sql)
Q["lineitem_spreaders"] = Query("D23", lambda spark, d: detect.super_spreaders(lineitem_packets(spark, d), 50), _LI + " SELECT epoch, src_ip, count(DISTINCT dst_ip) AS n_dst FROM p GROUP BY ALL HAVING count(DISTINCT dst_ip) >= 50")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q.build for n, q in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q.sql for n, q in Q.items() if q.sql}
