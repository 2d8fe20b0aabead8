"""The network of all orders in SQL: lines ``ln``, both directions ``e`` and node values ``nv``."""

LINES_SQL = """oo AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 AND o_custkey >= 8 THEN o_custkey // 8 ELSE o_custkey + 1 + o_orderkey % 3 END AS other FROM orders),
 oe AS (SELECT *, CASE WHEN o_custkey % 25 <> 24 THEN other + (CASE WHEN other % 25 = 24 THEN 1 ELSE 0 END) WHEN o_custkey // 25 % 2 = 0 THEN o_custkey + 25 ELSE o_custkey - 25 END AS fin FROM oo),
 ln AS (SELECT least(o_custkey, fin) AS src, greatest(o_custkey, fin) AS dst, min(0.2e0 + (o_orderkey % 50) / 25e0) AS impedance, sum(o_totalprice / 100000) AS s_nom,
   sum(o_totalprice / 100000 * CASE WHEN (o_orderkey % 2 = 0) = (o_custkey < fin) THEN 1 ELSE -1 END) AS flow, max(CASE WHEN o_orderkey % 5 = 0 THEN 400 ELSE 225 END) AS voltage
   FROM oe WHERE fin IN (SELECT c_custkey FROM customer) GROUP BY 1, 2),
 e AS (SELECT src, dst, impedance, 1 / impedance AS admittance, s_nom, voltage FROM ln UNION ALL SELECT dst, src, impedance, 1 / impedance, s_nom, voltage FROM ln),
 nv AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN 0e0 ELSE (20 + c_custkey * 31 % 380)::DOUBLE END AS value FROM customer)"""
