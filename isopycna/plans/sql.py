"""SQL of the canonical tables, for the twins that DuckDB runs."""

from __future__ import annotations

from ..functions import eos

VIEWS = {
    "surface_cells": """select concat('M', cast(l_suppkey % 8 as varchar)) model, cast(year(l_shipdate)*12+month(l_shipdate)-1 as int) ym, l_partkey cell_id,
 avg(case when l_linenumber=7 then null else sqrt(cast(cast(round(l_extendedprice*1E2) as bigint) % 3999 as double) + 0.5E0)/2E0 end) tos,
 avg(30E0 + l_quantity*0.1E0 + l_discount*10E0) sos, avg((l_tax-0.04E0)*5E3) hfds, avg(case when l_linenumber=6 then null else (l_discount-0.05E0)*1E-3 end) wfo
from lineitem where ((year(l_shipdate)*12+month(l_shipdate)-1)*7 + l_suppkey % 8) % 29 <> 0 group by 1,2,3""",
    "cells": """select p_partkey cell_id, cast(floor(p_partkey/50E0) as bigint) j, p_partkey % 50 i, ((p_partkey*37) % 1800)/1E1 - 9E1 + 0.05E0 lat,
 ((p_partkey*91) % 3600)/1E1 lon, (p_partkey % 97 + 1)*1E9 area from part""",
    "overturning": """select concat('M', cast(o_custkey % 8 as varchar)) model, cast(year(o_orderdate)*12+month(o_orderdate)-1 as int) ym,
 case when o_orderkey % 3 = 0 then 'atlantic_arctic_ocean ' when o_orderkey % 3 = 1 then 'indian_pacific_ocean' else 'global_ocean' end basin,
 ((o_orderkey * 7) % 20) * 250E0 lev, ((o_orderkey * 13) % 180) - 90E0 + 0.5E0 lat, (o_totalprice - 1.5E5) * 1E5 msftmz from orders""",
    "file_catalog": """select concat('M', cast(o_custkey % 40 as varchar)) model,
 case o_orderkey % 5 when 0 then 'tos' when 1 then 'sos' when 2 then 'hfds' when 3 then 'wfo' else 'msftmz' end variable,
 case when o_orderkey % 4 = 0 then 'gr' else 'gn' end grid, cast(year(o_orderdate)*12+month(o_orderdate)-1 as int) start_ym,
 (year(o_orderdate))*12+month(o_orderdate)-1 + 5 + (o_orderkey % 60) end_ym, o_orderkey % 9 version, o_orderkey seq from orders where o_orderkey % 6 = 0""",
    "files": """select *, concat(variable, '_Omon_', model, '_piControl_r1i1p1f1_', grid, '_', cast((start_ym // 12) * 100 + start_ym % 12 + 1 as varchar), '-',
 cast((end_ym // 12) * 100 + end_ym % 12 + 1 as varchar), '.nc') filename from file_catalog""",
}
NEEDS = {"files": ("file_catalog",), "derived": ("surface_cells", "cells"), "atlantic": ("derived",), "binned": ("derived",)}


def _terms(terms: list[str], at: str) -> str:
    out = terms[-1]
    for t in reversed(terms[:-1]):
        out = f"({at}*{out}+{t})"
    return out


def _number(x: float) -> str:
    text = repr(x)
    return text if "e" in text else f"{text}e0"


_rows = [_terms([*map(_number, r)], "y") for r in eos.VOLUME]
_by_x = [_terms([_number(i * c) for c in r], "y") for i, r in enumerate(eos.VOLUME) if i]
_by_y = [_terms([_number(j * c) for j, c in enumerate(r) if j], "y") for r in eos.VOLUME if len(r) > 1]
#: The polynomial of specific volume in the scaled x and y, and its derivatives.
VOLUME_SQL = f"{_terms(_rows, 'x')} v, {_terms(_by_x, 'x')} vx, {_terms(_by_y, 'x')} vy"
VIEWS["derived"] = f"""select *, a / 3990e0 * hfds heat, 1027e0 / 1000e0 * b * 35e0 * wfo fw, a / 3990e0 * hfds + 1027e0 / 1000e0 * b * 35e0 * wfo fsurf, a alpha, b beta from (
 select *, 1e0 / v rho, 0.025e0 * vy / v a, -(0.0248826675584615e0 * 0.5e0) * vx / (x * v) b from (
 select *, {_terms(_rows, "x")} v, {_terms(_by_x, "x")} vx, {_terms(_by_y, "x")} vy from (
 select s.*, c.j, c.i, c.lat, c.lon, c.area, ((lon + 180e0) % 360e0) - 180e0 nlon, sqrt(0.0248826675584615e0 * sos + 0.5971840214030754e0) x, 0.025e0 * tos y
 from surface_cells s join cells c using (cell_id))))"""
VIEWS["atlantic"] = "select * from derived where lat > 45 and nlon >= -90 and nlon <= 60"
#: Target grid of ten degrees.
VIEWS["binned"] = "select *, cast(floor((lat + 90e0) / 10e0) as int) lat_bin, cast(floor((nlon + 180e0) / 10e0) as int) lon_bin from derived where lat >= -90 and lat < 90"


def given(*names: str, recursive: bool = False, **more: str) -> str:
    """A WITH clause of the views and all that they need, then ``more``."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} as ({VIEWS[n]})" for n in order] + [f"{n} as ({q})" for n, q in more.items()]
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"
