SELECT c_custkey, c_name, c_acctbal
FROM customer
WHERE c_mktsegment = @Segment
ORDER BY c_custkey
LIMIT @Take OFFSET @Skip
