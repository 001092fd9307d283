-- @type total_spend bigint
SELECT c.c_custkey, c.c_name, CAST(sum(CAST(round(o.o_totalprice * 100) AS bigint)) AS bigint) AS total_spend
FROM customer c
JOIN orders o ON o.o_custkey = c.c_custkey
WHERE o.o_totalprice > @MinPrice
GROUP BY c.c_custkey, c.c_name
ORDER BY total_spend DESC, c.c_custkey
LIMIT 5
