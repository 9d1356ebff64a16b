"""DuckDB texts of the packet relation and of MurmurHash3, for the oracle queries."""

from __future__ import annotations

from flowloom.functions.hashing import C1, C2, C3, F1, F2, M32
from flowloom.plans.packets import EVENT_TYPES, KEYS, TEST_EPOCH


def packets_sql(length: int = TEST_EPOCH, valid_only: bool = True) -> str:
    kinds = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(EVENT_TYPES))
    inner = f"""SELECT event_id AS seq, user_id AS src_ip, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst_ip,
      CAST(CASE event_type {kinds} END AS INTEGER) AS src_port, CAST(hour(ts) AS INTEGER) AS dst_port,
      CASE WHEN event_id % 10 = 9 THEN 1 WHEN event_id % 2 = 0 THEN 6 ELSE 17 END AS proto, CAST(event_id % 2 AS INTEGER) AS port,
      event_id // {length} AS epoch FROM events"""
    return f"SELECT * FROM ({inner})" + (" WHERE proto IN (6, 17)" if valid_only else "")


def with_packets(rest: str, length: int = TEST_EPOCH) -> str:
    return f"WITH p AS ({packets_sql(length)}) {rest}" if not rest.startswith(",") else f"WITH p AS ({packets_sql(length)}){rest}"


SWAP = "((({c} & 255) << 8) | ({c} >> 8))"


def key_words_sql(mode: str) -> list[str]:
    ports = f"({SWAP.format(c='src_port::BIGINT')} | ({SWAP.format(c='dst_port::BIGINT')} << 16))"
    words = {"src_ip": ["src_ip"], "dst_ip": ["dst_ip"], "src_port": [ports], "dst_port": [], "proto": ["proto"]}
    return [w for c in KEYS[mode] for w in words[c]]


def _u(n: int) -> str:
    return f"{n}::UBIGINT"


def hashed_sql(source: str, words: list[str], seeds: list[int], name: str = "h", length: int | None = None) -> str:
    """A subquery: source with BIGINT columns h0, h1, ... for the seeds. One step a layer, so the text stays small."""
    m, n = _u(M32), len(words)
    length = 4 * n if length is None else length
    q = f"(SELECT *, {', '.join(f'(({w})::UBIGINT * {_u(C1)}) & {m} AS _k{i}' for i, w in enumerate(words))} FROM {source})"
    step = lambda q, made: f"(SELECT * REPLACE ({', '.join(made)}) FROM {q})"
    q = step(q, [f"((_k{i} << 15) | (_k{i} >> 17)) & {m} AS _k{i}" for i in range(n)])
    q = step(q, [f"(_k{i} * {_u(C2)}) & {m} AS _k{i}" for i in range(n)])
    q = f"(SELECT *, {', '.join(f'{_u(s)} AS {name}{j}' for j, s in enumerate(seeds))} FROM {q})"
    each = lambda q, f: step(q, [f"{f(f'{name}{j}')} AS {name}{j}" for j in range(len(seeds))])
    for i in range(n):
        q = each(q, lambda h, i=i: f"xor({h}, _k{i})")
        if length >= 4:
            q = each(q, lambda h: f"((({h} << 13) | ({h} >> 19)) & {m})")
            q = each(q, lambda h: f"(({h} * {_u(5)} + {_u(C3)}) & {m})")
    q = each(q, lambda h: f"xor({h}, {_u(length)})")
    for shift, factor in ((16, F1), (13, F2)):
        q = each(q, lambda h, s=shift: f"xor({h}, {h} >> {s})")
        q = each(q, lambda h, c=factor: f"(({h} * {_u(c)}) & {m})")
    q = each(q, lambda h: f"(xor({h}, {h} >> 16))::BIGINT")
    return f"(SELECT * EXCLUDE ({', '.join(f'_k{i}' for i in range(n))}) FROM {q})"


def union_rows(source: str, columns: str, values: list[str], name: str = "row", value: str = "bucket", first: int = 0) -> str:
    """columns, row, value for each of the values."""
    return "(" + " UNION ALL ".join(f"SELECT {columns}, {i + first} AS {name}, {v} AS {value} FROM {source}" for i, v in enumerate(values)) + ")"
