-- @type revenue bigint
SELECT r.r_name, CAST(sum(CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100) AS bigint)) AS bigint) AS revenue
FROM region r
JOIN nation n ON n.n_regionkey = r.r_regionkey
JOIN customer c ON c.c_nationkey = n.n_nationkey
JOIN orders o ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY r.r_name
ORDER BY revenue DESC, r.r_name
LIMIT 3
