"""Module names to operators; names are looked up without regard to case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from flowloom.functions.hashing import pow2_at_least
from flowloom.operators import detect, sketches, stateful
from flowloom.plans.packets import KEYS, flows, weighted
from flowloom.sources.config import Experiment, ModuleConfig

_REGISTRY: dict[str, Callable[[DataFrame, ModuleConfig], DataFrame]] = {}
#: Default thresholds in packets, distinct destinations and change.
HH, SPREAD, CHANGE = 2048, 128, 1000
#: Modules whose ports share one table.
SHARED = {"heavyhitter::sharedmap"}


def register(*names: str):
    def add(build: Callable[[DataFrame, ModuleConfig], DataFrame]):
        for n in names:
            _REGISTRY[n.lower()] = build
        return build

    return add


def lookup(name: str) -> Callable[[DataFrame, ModuleConfig], DataFrame]:
    if name.lower() not in _REGISTRY:
        raise KeyError(f"no module named {name}; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name.lower()]


def names() -> list[str]:
    return sorted(_REGISTRY)


def run(experiment: Experiment, packets: DataFrame) -> dict[tuple[int, int, str], DataFrame]:
    """(port, place, module): its result over the packets of that port; of a shared module, over those of all ports that have it."""

    def seen(name: str, port: int) -> list[int]:
        same = [p for p, modules in experiment.ports.items() if any(m.name.lower() == name.lower() for m in modules)]
        return same if name.lower() in SHARED else [port]

    return {(port, i, m.name): lookup(m.name)(packets.where(packets.port.isin(seen(m.name, port))), m) for port, modules in experiment.ports.items() for i, m in enumerate(modules)}


def _size(c: ModuleConfig) -> int:
    return pow2_at_least(c.number("size"))


def _mode(c: ModuleConfig) -> str:
    return {1: "sip", 2: "pair", 3: "four", 4: "five"}[c.number("keysize")]


def _first_flows(df: DataFrame, mode: str) -> DataFrame:
    """Pre-aggregated flows, each with the place of its first packet."""
    from pyspark.sql import functions as F

    return df.groupBy("epoch", *KEYS[mode]).agg(F.min("seq").alias("seq"), F.count("*").alias("w"))


def _sketch(name: str, build: Callable[[DataFrame, str, int], DataFrame], needs_flows: bool = False) -> None:
    plain = (lambda df, c: build(flows(df, _mode(c)), _mode(c), _size(c))) if needs_flows else (lambda df, c: build(weighted(df), _mode(c), _size(c)))
    register(f"SimdBatch::{name}")(plain)
    register(f"SimdBatch::{name}Simd")(lambda df, c: build(flows(df, _mode(c)), _mode(c), _size(c)))


_sketch("CMSketch", sketches.count_min)
_sketch("FMSketch", lambda df, m, s: sketches.fm(df, m))
_sketch("LinearCounting", sketches.linear_counting)
_sketch("MRAC", sketches.mrac)
register("SimdBatch::FlowRadar")(lambda df, c: sketches.flow_radar_bloom(weighted(df), _mode(c), _size(c)))
register("SimdBatch::FlowRadarSimd")(lambda df, c: sketches.flow_radar_bloom(_first_flows(df, _mode(c)), _mode(c), _size(c)))
_sketch("UnivMon", sketches.univmon)
_sketch("RevSketch", lambda df, m, s: sketches.rev_sketch(df, m))
register("SimdBatch::FlowRadarNoSimd", "SimdBatch::FlowRadarSimdV")(lambda df, c: sketches.flow_radar_bloom(_first_flows(df, _mode(c)), _mode(c), _size(c)))
register("SimdBatch::FlowRadarV")(lambda df, c: sketches.flow_radar_bloom(weighted(df), _mode(c), _size(c)))
register("SimdBatch::TwoLevel")(lambda df, c: sketches.two_level(df, _size(c)))
register("SimdBatch::TwoLevelSimd")(lambda df, c: sketches.two_level(flows(df, "pair"), _size(c)))
register("SimdBatch::SpaceSaving")(lambda df, c: stateful.space_saving(df, c.number("size")))
register("SimdBatch::SpaceSavingSimd")(lambda df, c: stateful.space_saving(stateful.evict_cache(df).withColumnsRenamed({"flow": "src_ip", "cnt": "w"}), c.number("size")))
register("HeavyHitter::CountMin")(lambda df, c: detect.count_min_crossing(df, _mode(c), _size(c), HH))
register("HeavyHitter::CountArray")(lambda df, c: detect.count_array(df, _mode(c), _size(c), HH))
register("HeavyHitter::Hashmap", "HeavyHitter::Sharedmap")(lambda df, c: detect.lossy_store(df, _mode(c), _size(c), HH))
register("HeavyHitter::HashmapLinear", "HeavyHitter::HashmapLinearPointer", "HeavyHitter::Cuckoo", "HeavyHitter::CuckooLocal", "HeavyHitter::CuckooLocalPointer", "HeavyHitter::CuckooBucket")(lambda df, c: detect.heavy_hitters(df, _mode(c), HH))
register("HeavyHitter::PQueue")(lambda df, c: detect.heavy_hitters(df, _mode(c), HH, strict=True))
register("SuperSpreader::Hashmap", "SuperSpreader::HashmapLinear", "SuperSpreader::CuckooLocal", "SuperSpreader::CuckooBucket")(lambda df, c: detect.super_spreaders(df, SPREAD))
register("HeavyChange::MinHash")(lambda df, c: detect.last_key_table(df, _size(c)))
register("HeavyChange::RevSketch")(lambda df, c: detect.bucket_change(df, _size(c), CHANGE))
register("HeavyChange::UnivMon")(lambda df, c: detect.count_min3_top(df, "pair", _size(c), c.number("size")))
register("HeavyChange::PktTest")(lambda df, c: df.select("epoch", "seq", "src_ip", "dst_ip"))


@register("Generic::RandMod")
def _rand_mod(df: DataFrame, c: ModuleConfig) -> DataFrame:
    from pyspark.sql import functions as F

    return detect.bucket_counts(df, [F.col("seq")], 1, _size(c))
