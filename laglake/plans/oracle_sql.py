"""DuckDB twins of the registered queries (the correctness oracle).

Helpers below only assemble SQL text; every statement runs inside DuckDB on the driver's
parquet views. Floats are rounded to 6 decimals on both sides (see ``plans.queries.R``)."""

from __future__ import annotations

def windows_cte(view: str, keys: list[str], ts: str, channels: list[str], targets: list[str],
                lag: int, ahead: int, offset: int, minutes: int) -> str:
    """SELECT producing keys, ts, x, y for complete windows, written as a self-join (each anchor row
    joined to the rows of its time span, then grouped) - a formulation independent of the
    window-frame plans on the Spark side."""
    offset = max(offset, ahead)
    span = lag + offset - 1
    nn_x = " AND ".join(f"b.{c} IS NOT NULL" for c in channels)
    nn_y = " AND ".join(f"b.{c} IS NOT NULL" for c in targets)
    step = (f"CAST(b.{channels[0]} AS DOUBLE)" if len(channels) == 1
            else "[" + ", ".join(f"CAST(b.{c} AS DOUBLE)" for c in channels) + "]")
    tstep = "[" + ", ".join(f"CAST(b.{c} AS DOUBLE)" for c in targets) + "]"
    in_x = f"b.{ts} <= a.{ts} - INTERVAL ({offset * minutes}) MINUTE"
    in_y = f"b.{ts} >= a.{ts} - INTERVAL ({(ahead - 1) * minutes}) MINUTE"
    on = " AND ".join([*(f"a.{k} = b.{k}" for k in keys),
                       f"b.{ts} BETWEEN a.{ts} - INTERVAL ({span * minutes}) MINUTE AND a.{ts}"])
    ka = "".join(f"a.{k} AS {k}, " for k in keys)
    kg = "".join(f"a.{k}, " for k in keys)
    return (f"SELECT {ka}a.{ts} AS {ts}, "
            f"list({step} ORDER BY b.{ts}) FILTER (WHERE {in_x} AND {nn_x}) AS x, "
            f"flatten(list({tstep} ORDER BY b.{ts}) FILTER (WHERE {in_y} AND {nn_y})) AS y "
            f"FROM {view} a JOIN {view} b ON {on} GROUP BY {kg}a.{ts} "
            f"HAVING count(*) FILTER (WHERE {in_x} AND {nn_x}) = {lag} "
            f"AND count(*) FILTER (WHERE {in_y} AND {nn_y}) = {ahead}")


def split_cte(src: str, keys: list[str], ts: str, ratios=(0.7, 0.1, 0.2)) -> str:
    """Adds rn, n, split to the windows of ``src`` and keeps accepted segments only."""
    r0, r1 = float(ratios[0]), float(ratios[1])
    r2 = float(ratios[2]) if len(ratios) > 2 else 0.0
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    tr = f"CAST(ceil(n * CAST({r0!r} AS DOUBLE)) AS BIGINT)"
    va = f"CAST(floor(n * (CAST({r0!r} AS DOUBLE) + CAST({r1!r} AS DOUBLE))) AS BIGINT)"
    acc = (f"least({tr}, n) > 0"
           + (f" AND greatest(least({va}, n) - {tr}, 0) > 0" if r1 != 0 else "")
           + (f" AND n - least(greatest({tr}, {va}), n) > 0" if r2 != 0 else ""))
    return (f"SELECT *, CASE WHEN rn < {tr} THEN 'train' WHEN rn < {va} THEN 'val' ELSE 'test' END AS split "
            f"FROM (SELECT *, row_number() OVER ({part}ORDER BY {ts}) - 1 AS rn, "
            f"count(*) OVER ({part.strip()}) AS n FROM ({src})) WHERE {acc}")


def d6_split(lag=8, ahead=2, offset=3, ratios=(0.7, 0.1, 0.2)) -> str:
    return split_cte(windows_cte("D6", ["segment"], "ts", ["qty"], ["qty"], lag, ahead, offset, 1440),
                     ["segment"], "ts", ratios)
