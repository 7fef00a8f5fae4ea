"""Generic relational coverage on the star schema."""

from inkstone.plans.catalogue import query

query("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE @DAYS(l_shipdate)@ <= '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
query("revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name""")
query("segment_rollup", "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
query("customers_without_orders", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders}) x WHERE k <= 3")
query("status_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
