"""SQL of the merchants and bank texts that the adapters write."""

from __future__ import annotations

from tallyspark.sources import adapters

#: Merchants in the order of their numbers, as SQL.
_NAMES = "[" + ", ".join("'" + m + "'" for m in adapters.MERCHANTS) + "]"
_UPPER = "[" + ", ".join("'" + m.upper() + "'" for m in adapters.MERCHANTS) + "]"
SAID = f""", said AS (SELECT o_orderkey + 1000000000 AS t_id, CASE o_orderkey % 4 WHEN 0 THEN 'POS ' || name || ' 2391' WHEN 1 THEN 'SQ *' || name WHEN 2 THEN name || ' #' || CAST(o_orderkey % 50 AS VARCHAR) ELSE substr(name, 2) END AS description
    FROM (SELECT o_orderkey, {_UPPER}[CAST(o_custkey % {len(adapters.MERCHANTS)} AS INTEGER) + 1] AS name FROM orders))"""
NAMED = f""", named AS (SELECT o_orderkey AS r_id, {_NAMES}[CAST(o_custkey % {len(adapters.MERCHANTS)} AS INTEGER) + 1] AS merchant_raw FROM orders)"""
