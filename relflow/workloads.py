"""Queries over the driver's tables: one or more per operator, the end-to-end workloads, and their SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import relation
from .functions.registry import Registry
from .sources.catalog import Catalog, save, types_of
from .vertex import OUTNUM, vertex_program
from .workflow import Workflow, query

#: relation name -> (table, scalar columns in order)
TABLES = {
    "li": ("lineitem", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus"),
    "o": ("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority"),
    "c": ("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
    "p": ("part", "p_partkey p_name p_brand p_type p_size p_retailprice"),
    "s": ("supplier", "s_suppkey s_name s_nationkey s_acctbal"),
    "n": ("nation", "n_nationkey n_name n_regionkey"),
    "r": ("region", "r_regionkey r_name"),
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, columns = TABLES[name]
    return lambda spark, d: _read(spark, d, source).select(*columns.split())


def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(0,)], "i int")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select("l_suppkey", (F.col("l_partkey") % 100 + 1).alias("target")).distinct()


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey", (F.col("l_partkey") % 100 + 1).alias("target")).agg(F.min(F.col("l_quantity").cast("long")).alias("cost"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select("s_suppkey", F.lit(1.0).alias("rank"))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") == 1, 0).otherwise(100_000_000).cast("long").alias("distance"))


def _shop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select("o_custkey", F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3).alias("country"), "o_orderkey", "o_totalprice")


EXTRA = {"it": _zero, "edges": _edges, "costs": _costs, "pr": _ranks, "dist": _distances, "log": _shop_log}


@dataclass
class Work:
    program: str
    result: str
    labels: str
    sql: str
    uses: str
    rounding: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {name: (EXTRA.get(name) or _table(name))(spark, sf_dir) for name in self.uses.split()}
        head = [f"CREATE RELATION {name} WITH COLUMNS ({', '.join(types_of(df))})" for name, df in tables.items()]
        out = query(spark, ",\n".join([*head, self.program]), tables, self.result, self.labels.split(), **self.options)
        return out.withColumns({c: F.round(c, k) for c, k in self.rounding.items()}) if self.rounding else out


WORK: dict[str, Work] = {}


def work(name, uses, program, result, labels, sql, rounding=None, **options):
    WORK[name] = Work(program, result, labels, sql, uses, rounding or {}, options)


# -- selection and projection ------------------------------------------------------------------
work("select_where", "o", "SELECT [o_0, o_1, o_3] FROM (o) WHERE [(o_3 > 150000.0)] AS x", "x", "okey ckey price", "SELECT o_orderkey AS okey, o_custkey AS ckey, o_totalprice AS price FROM orders WHERE o_totalprice > 150000.0")
work("project_reorder", "p", "PROJECT [p_4, p_0, p_4] FROM (p) AS x", "x", "size pkey size2", "SELECT p_size AS size, p_partkey AS pkey, p_size AS size2 FROM part")
work("project_where", "c", "PROJECT [c_0, c_3] FROM (c) WHERE [(c_3 < 0)] AS x", "x", "ckey bal", "SELECT c_custkey AS ckey, c_acctbal AS bal FROM customer WHERE c_acctbal < 0")
work("cond_and", "li", "SELECT [li_0, li_3] FROM (li) WHERE [(li_4 < 10 AND (li_6 > 0.05))] AS x", "x", "okey line", "SELECT l_orderkey AS okey, l_linenumber AS line FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05")
work("cond_or", "li", "SELECT [li_0, li_3] FROM (li) WHERE [(li_4 < 3 OR (li_4 > 48))] AS x", "x", "okey line", "SELECT l_orderkey AS okey, l_linenumber AS line FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48")
work("cond_not", "li", "SELECT [li_0, li_3] FROM (li) WHERE [NOT (li_8 = 'N' OR (li_4 <= 40))] AS x", "x", "okey line", "SELECT l_orderkey AS okey, l_linenumber AS line FROM lineitem WHERE NOT (l_returnflag = 'N' OR l_quantity <= 40)")
work("cond_nested", "li", "SELECT [li_0, li_3] FROM (li) WHERE [(li_8 = 'R' AND (li_4 < 5 OR (li_4 > 45)))] AS x", "x", "okey line", "SELECT l_orderkey AS okey, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R' AND (l_quantity < 5 OR l_quantity > 45)")
work("cond_columns", "li", "SELECT [li_0, li_3] FROM (li) WHERE [(li_1 = li_2)] AS x", "x", "okey line", "SELECT l_orderkey AS okey, l_linenumber AS line FROM lineitem WHERE l_partkey = l_suppkey")
for _name, _op in (("lt", "<"), ("le", "<="), ("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">=")):
    work(f"cmp_{_name}", "p", f"SELECT [p_0, p_4] FROM (p) WHERE [(p_4 {_op} 25)] AS x", "x", "pkey size", f"SELECT p_partkey AS pkey, p_size AS size FROM part WHERE p_size {_op} 25")
work("cond_string_eq", "c", "SELECT [c_0, c_4] FROM (c) WHERE [(c_4 = 'BUILDING')] AS x", "x", "ckey segment", "SELECT c_custkey AS ckey, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'")

# -- row arithmetic ----------------------------------------------------------------------------
_li3 = "SELECT l_orderkey AS okey, l_linenumber AS line, "
work("sum_cols", "li", "PROJECT [li_0, li_3, li_6, li_7] FROM (li) AS t, SUM [t_2, t_3] FROM (t) AS x", "x", "okey line both tax", _li3 + "l_discount + l_tax AS both, l_tax AS tax FROM lineitem")
work("sum_const", "p", "PROJECT [p_0, p_4] FROM (p) AS t, SUM [t_1, 7] FROM (t) AS x", "x", "pkey size", "SELECT p_partkey AS pkey, p_size + 7 AS size FROM part")
work("sum_const_left", "p", "PROJECT [p_0, p_5] FROM (p) AS t, SUM [0.5, t_1] FROM (t) AS x", "x", "pkey price", "SELECT p_partkey AS pkey, 0.5::DOUBLE + p_retailprice AS price FROM part")
work("sum_where", "p", "PROJECT [p_0, p_4] FROM (p) AS t, SUM [t_1, t_1] FROM (t) WHERE [(t_1 > 40)] AS x", "x", "pkey size", "SELECT p_partkey AS pkey, p_size + p_size AS size FROM part WHERE p_size > 40")
work("sub_cols", "li", "PROJECT [li_0, li_3, li_1, li_2] FROM (li) AS t, SUB [t_2, t_3] FROM (t) AS x", "x", "okey line gap supp", _li3 + "l_partkey - l_suppkey AS gap, l_suppkey AS supp FROM lineitem")
work("sub_const_left", "p", "PROJECT [p_0, p_4] FROM (p) AS t, SUB [100, t_1] FROM (t) AS x", "x", "pkey size", "SELECT p_partkey AS pkey, 100 - p_size AS size FROM part")
work("sub_legacy_swap", "p", "PROJECT [p_0, p_4] FROM (p) AS t, SUB [100, t_1] FROM (t) AS x", "x", "pkey size", "SELECT p_partkey AS pkey, p_size - 100 AS size FROM part", legacy_const_swap=True)
work("mul_cols", "li", "PROJECT [li_0, li_3, li_5, li_6] FROM (li) AS t, MUL [t_2, t_3] FROM (t) AS x", "x", "okey line off discount", _li3 + "l_extendedprice * l_discount AS off, l_discount AS discount FROM lineitem")
work("mul_const", "p", "PROJECT [p_0, p_4] FROM (p) AS t, MUL [0.85, t_1] FROM (t) AS x", "x", "pkey size", "SELECT p_partkey AS pkey, 0.85::DOUBLE * p_size AS size FROM part")
work("div_double", "li", "PROJECT [li_0, li_3, li_5, li_4] FROM (li) AS t, DIV [t_2, t_3] FROM (t) AS x", "x", "okey line unit qty", _li3 + "l_extendedprice / l_quantity AS unit, l_quantity AS qty FROM lineitem")
work("div_int", "p", "PROJECT [p_0, p_4] FROM (p) AS t, DIV [t_0, 7] FROM (t) AS x", "x", "pkey size", "SELECT p_partkey // 7 AS pkey, p_size AS size FROM part")
work("div_const_left", "p", "PROJECT [p_0, p_4] FROM (p) AS t, DIV [100, t_1] FROM (t) AS x", "x", "pkey size", "SELECT p_partkey AS pkey, 100 // p_size AS size FROM part")

# -- aggregates --------------------------------------------------------------------------------
work("agg_plus_grouped", "li", "AGG [li_4, +] FROM (li) GROUP BY [li_8, li_9] AS x", "x", "flag status qty", "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL")
work("agg_plus_multi", "li", "AGG [li_3, li_4, +] FROM (li) WHERE [(li_4 > 25)] GROUP BY [li_2] AS x", "x", "supp lines qty", "SELECT l_suppkey AS supp, CAST(sum(l_linenumber) AS BIGINT) AS lines, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity > 25 GROUP BY ALL")
work("agg_mul", "li", "AGG [li_3, *] FROM (li) GROUP BY [li_0] AS x", "x", "okey prod", "SELECT l_orderkey AS okey, CAST(product(l_linenumber) AS BIGINT) AS prod FROM lineitem GROUP BY ALL")
work("agg_minus", "li", "AGG [li_3, -] FROM (li) GROUP BY [li_1] AS x", "x", "pkey neg", "SELECT l_partkey AS pkey, CAST(-sum(l_linenumber) AS BIGINT) AS neg FROM lineitem GROUP BY ALL")
work("agg_div", "li", "AGG [li_4, /] FROM (li) GROUP BY [li_0] AS x", "x", "okey inv", "SELECT l_orderkey AS okey, 1.0::DOUBLE / product(l_quantity) AS inv FROM lineitem GROUP BY ALL")
work("agg_global", "li", "AGG [li_3, li_4, +] FROM (li) AS x", "x", "k lines qty", "SELECT 'ALL' AS k, CAST(sum(l_linenumber) AS BIGINT) AS lines, sum(l_quantity) AS qty FROM lineitem")
work("agg_global_empty", "li", "AGG [li_4, +] FROM (li) WHERE [(li_4 < 0)] AS x", "x", "k qty", "SELECT 'ALL' AS k, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
work("count_grouped", "o", "COUNT [o_0] FROM (o) GROUP BY [o_1] AS x", "x", "ckey n", "SELECT o_custkey AS ckey, count(*) AS n FROM orders GROUP BY ALL")
work("count_global", "o", "COUNT [o_0] FROM (o) WHERE [(o_2 = 'F')] AS x", "x", "k n", "SELECT 'ALL' AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
work("max_grouped", "o", "MAXIMUM [o_3] FROM (o) GROUP BY [o_1] AS x", "x", "ckey price", "SELECT o_custkey AS ckey, max(o_totalprice) AS price FROM orders GROUP BY ALL")
work("max_carried", "li", "MAXIMUM [li_4, li_5, li_0] FROM (li) GROUP BY [li_2] AS x", "x", "supp qty price okey", "SELECT l_suppkey AS supp, m.a AS qty, m.b AS price, m.c AS okey FROM (SELECT l_suppkey, max({'a': l_quantity, 'b': l_extendedprice, 'c': l_orderkey}) AS m FROM lineitem GROUP BY 1)")
work("max_global", "c", "MAXIMUM [c_3, c_0] FROM (c) AS x", "x", "k bal ckey", "SELECT 'ALL' AS k, m.a AS bal, m.b AS ckey FROM (SELECT max({'a': c_acctbal, 'b': c_custkey}) AS m FROM customer)")
work("min_grouped", "p", "MINIMUM [p_5] FROM (p) WHERE [(p_4 > 10)] GROUP BY [p_2] AS x", "x", "brand price", "SELECT p_brand AS brand, min(p_retailprice) AS price FROM part WHERE p_size > 10 GROUP BY ALL")
work("min_carried", "li", "MINIMUM [li_4, li_5, li_0] FROM (li) GROUP BY [li_2] AS x", "x", "supp qty price okey", "SELECT l_suppkey AS supp, m.a AS qty, m.b AS price, m.c AS okey FROM (SELECT l_suppkey, min({'a': l_quantity, 'b': l_extendedprice, 'c': l_orderkey}) AS m FROM lineitem GROUP BY 1)")
work("min_global", "c", "MINIMUM [c_3] FROM (c) AS x", "x", "k bal", "SELECT 'ALL' AS k, min(c_acctbal) AS bal FROM customer")

# -- joins and set operations ------------------------------------------------------------------
work("join_single", "o c", "(o) JOIN (c) ON o_1 AND c_0 AS x", "x", "okey ckey status price prio cname nation bal segment", "SELECT o_orderkey AS okey, o_custkey AS ckey, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS prio, c_name AS cname, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
work("join_multi", "li", "PROJECT [li_0, li_2, li_4] FROM (li) AS a, PROJECT [li_2, li_0, li_5] FROM (li) AS b, (a) JOIN (b) ON a_0, a_1 AND b_1, b_0 AS x", "x", "okey supp qty price", "SELECT a.l_orderkey AS okey, a.l_suppkey AS supp, a.l_quantity AS qty, b.l_extendedprice AS price FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
work("join_self", "s", "(s) JOIN (s) ON s_2 AND s_2 AS x", "x", "k1 n1 nation b1 k2 n2 b2", "SELECT a.s_suppkey AS k1, a.s_name AS n1, a.s_nationkey AS nation, a.s_acctbal AS b1, b.s_suppkey AS k2, b.s_name AS n2, b.s_acctbal AS b2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
work("cross_join", "n r", "(n) CROSS JOIN (r) AS x", "x", "nkey nname rk rkey rname", "SELECT n_nationkey AS nkey, n_name AS nname, n_regionkey AS rk, r_regionkey AS rkey, r_name AS rname FROM nation CROSS JOIN region")
work("theta_join", "n r", "(n) CROSS JOIN (r) AS t, SELECT [t_0, t_3] FROM (t) WHERE [(t_2 < t_3)] AS x", "x", "nkey rkey", "SELECT n_nationkey AS nkey, r_regionkey AS rkey FROM nation, region WHERE n_regionkey < r_regionkey")
_ab = "PROJECT [c_2] FROM (c) AS a, PROJECT [s_2] FROM (s) WHERE [(s_2 < 12)] AS b, "
work("union_bag", "c s", _ab + "(a) UNION (b) AS x", "x", "nation", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_nationkey < 12")
work("union_distinct", "c s", _ab + "(a) UNION (b) AS u, DISTINCT FROM (u) AS x", "x", "nation", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_nationkey < 12")
work("intersect_dups", "c s", _ab + "(a) INTERSECT (b) AS x", "x", "nation", "SELECT c_nationkey AS nation FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey < 12 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
work("difference_dups", "c s", _ab + "(a) DIFFERENCE (b) AS x", "x", "nation", "SELECT c_nationkey AS nation FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey < 12 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
work("distinct", "li", "PROJECT [li_2, li_8] FROM (li) AS t, DISTINCT FROM (t) AS x", "x", "supp flag", "SELECT DISTINCT l_suppkey AS supp, l_returnflag AS flag FROM lineitem")
work("sort_inc", "o", "PROJECT [o_3, o_0] FROM (o) AS t, SORT INC ON [t_0] FROM (t) AS x", "x", "price okey", "SELECT o_totalprice AS price, o_orderkey AS okey FROM orders ORDER BY 1")
work("sort_dec", "o", "PROJECT [o_3, o_0] FROM (o) AS t, SORT DEC ON [t_0] FROM (t) WHERE [(t_0 > 100000)] AS x", "x", "price okey", "SELECT o_totalprice AS price, o_orderkey AS okey FROM orders WHERE o_totalprice > 100000 ORDER BY 1 DESC")

# -- language forms ----------------------------------------------------------------------------
work("nested_expr", "o c", "AGG [j_3, +] FROM ((SELECT [o_0, o_1, o_2, o_3] FROM (o) WHERE [(o_2 = 'O')] AS f) JOIN (PROJECT [c_0, c_4] FROM (c) AS g) ON f_1 AND g_0 AS j) GROUP BY [j_4] AS x", "x", "segment price", "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1", {"price": 2})
work("rebind", "p", "PROJECT [p_0, p_4] FROM (p) AS t, SUM [t_1, 1] FROM (t) AS t, MUL [t_1, 3] FROM (t) AS t", "t", "pkey size", "SELECT p_partkey AS pkey, (p_size + 1) * 3 AS size FROM part")
work("rename", "r", "RENAME [key, label] (r), PROJECT [r_1, r_0] FROM (r) AS x", "x", "label key", "SELECT r_name AS label, r_regionkey AS key FROM region")
work("while_counter", "n it", "PROJECT [n_0, n_2] FROM (n) AS v, WHILE [(it_0 < 5)] DO (SUM [v_1, v_0] FROM (v) AS v, SUM [it_0, 1] FROM (it) AS it)", "v", "nkey total", "SELECT n_nationkey AS nkey, n_regionkey + 5 * n_nationkey AS total FROM nation")
work(
    "while_data", "n",
    "PROJECT [n_0, n_2] FROM (n) AS v, AGG [v_1, +] FROM (v) AS tot, WHILE [(tot_1 < 1000)] DO (MUL [v_1, 2] FROM (v) AS v, AGG [v_1, +] FROM (v) AS tot)",
    "v", "nkey amount",
    "WITH RECURSIVE t(f, s) AS (SELECT 1, sum(n_regionkey) FROM nation UNION ALL SELECT f * 2, s * 2 FROM t WHERE s < 1000) SELECT n_nationkey AS nkey, CAST(n_regionkey * (SELECT max(f) FROM t) AS INTEGER) AS amount FROM nation",
)

# -- workloads ---------------------------------------------------------------------------------
work("shoppers", "log", "PROJECT [spend_0, spend_1] FROM (AGG [log_3, +] FROM (log) WHERE [(log_1 = 1)] GROUP BY [log_0] AS spend) WHERE [(spend_1 > 250000)] AS x", "x", "ckey spent", "SELECT o_custkey AS ckey, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING sum(o_totalprice) > 250000", {"spent": 2})
# what else to offer a customer: parts bought together with theirs, weighed by how often and how much
work(
    "recommender", "li o p",
    """(PROJECT [p_0] FROM (p) WHERE [(p_4 < 3)] AS small) JOIN (li) ON small_0 AND li_1 AS line,
    AGG [sale_4, +] FROM ((line) JOIN (o) ON line_1 AND o_0 AS sale) GROUP BY [sale_10, sale_0] AS basket,
    COUNT [both_0] FROM ((basket) JOIN (PROJECT [basket_0, basket_1] FROM (basket) AS other) ON basket_0 AND other_0 AS both) GROUP BY [both_1, both_3] AS together,
    AGG [weight_2, +] FROM (MUL [offer_2, offer_4] FROM ((basket) JOIN (together) ON basket_1 AND together_0 AS offer) AS weight) GROUP BY [weight_0, weight_3] AS score,
    MAXIMUM [score_2, score_1] FROM (score) GROUP BY [score_0] AS best""",
    "best", "ckey score pkey",
    """WITH basket AS (SELECT o_custkey AS u, l_partkey AS m, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size < 3 GROUP BY 1, 2),
    together AS (SELECT a.m AS m, b.m AS m2, count(*) AS n FROM basket a JOIN basket b ON a.u = b.u GROUP BY 1, 2),
    score AS (SELECT u, m2, sum(q * n) AS s FROM basket JOIN together USING (m) GROUP BY 1, 2)
    SELECT u AS ckey, x.s AS score, x.m2 AS pkey FROM (SELECT u, max({'s': s, 'm2': m2}) AS x FROM score GROUP BY 1)""",
)
work(
    "tpch17_like", "li p",
    """PROJECT [li_1, li_4, li_5] FROM (li) AS l, AGG [l_1, +] FROM (l) GROUP BY [l_0] AS total, COUNT [l_0] FROM (l) GROUP BY [l_0] AS many,
    (total) JOIN (many) ON total_0 AND many_0 AS tm, DIV [tm_1, tm_2] FROM (tm) AS mean, MUL [0.2, mean_1] FROM (mean) AS fifth,
    SELECT [p_0, p_2] FROM (p) WHERE [(p_2 = 'Brand#13')] AS brand,
    (l) JOIN (fifth) ON l_0 AND fifth_0 AS lf, (lf) JOIN (brand) ON lf_0 AND brand_0 AS all, SELECT [all_0, all_1, all_2] FROM (all) WHERE [(all_1 > all_3)] AS x""",
    "x", "pkey qty price",
    """WITH f AS (SELECT l_partkey AS k, 0.2::DOUBLE * (sum(l_quantity) / count(*)) AS lim FROM lineitem GROUP BY 1)
    SELECT l_partkey AS pkey, l_quantity AS qty, l_extendedprice AS price FROM lineitem JOIN f ON l_partkey = k JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#13' AND l_quantity > lim""",
)
#: Each edge's share of its source's rank is worked out once; a pass moves ranks along the edges.
_PAGERANK = """DIV [0.85, linked_2] FROM ((edges) JOIN (COUNT [edges_1] FROM (edges) GROUP BY [edges_0] AS fan) ON edges_0 AND fan_0 AS linked) AS flow,
    WHILE [(it_0 < 4)] DO (SUM [0.15, inflow_1] FROM (AGG [moved_2, +] FROM (MUL [carry_2, carry_3] FROM ((flow) JOIN (pr) ON flow_0 AND pr_0 AS carry) AS moved) GROUP BY [moved_1] AS inflow) AS pr, SUM [it_0, 1] FROM (it) AS it)"""


def _unrolled(passes: int) -> str:
    out = ["WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 100 + 1 AS t FROM lineitem), d AS (SELECT s, 0.85::DOUBLE / count(*) AS w FROM e GROUP BY 1), p0 AS (SELECT s_suppkey AS v, 1.0::DOUBLE AS x FROM supplier)"]
    out += [f"p{i + 1} AS (SELECT e.t AS v, 0.15 + sum(p{i}.x * d.w) AS x FROM e JOIN d ON e.s = d.s JOIN p{i} ON p{i}.v = e.s GROUP BY 1)" for i in range(passes)]
    return ", ".join(out) + f" SELECT v AS vertex, round(x, 6) AS rank FROM p{passes}"


work("pagerank", "edges pr it", _PAGERANK, "pr", "vertex rank", _unrolled(4), {"rank": 6})
work(
    "sssp", "costs dist it",
    """WHILE [(it_0 < 4)] DO ((costs) JOIN (dist) ON costs_0 AND dist_0 AS ev, SUM [ev_3, ev_2] FROM (ev) AS far, PROJECT [far_1, far_3] FROM (far) AS cand, (cand) UNION (dist) AS either,
    MINIMUM [either_1] FROM (either) GROUP BY [either_0] AS dist, SUM [it_0, 1] FROM (it) AS it)""",
    "dist", "vertex distance",
    "WITH e AS (SELECT l_suppkey AS s, l_partkey % 100 + 1 AS t, min(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2), v0 AS (SELECT s_suppkey AS v, CASE WHEN s_suppkey = 1 THEN 0 ELSE 100000000 END AS x FROM supplier), "
    + ", ".join(f"v{i + 1} AS (SELECT v, min(x) AS x FROM (SELECT t AS v, x + w AS x FROM e JOIN v{i} ON s = v UNION ALL SELECT v, x FROM v{i}) GROUP BY 1)" for i in range(4))
    + " SELECT v AS vertex, CAST(x AS BIGINT) AS distance FROM v4",
)
work("udf_rowsum", "li", "PROJECT [li_0, li_1, li_2] FROM (li) AS t, UDF /functions/row RowSum ON t AS x WITH COLUMNS (INTEGER)", "x", "total", "SELECT l_orderkey + l_partkey + l_suppkey AS total FROM lineitem", registry=Registry().column_function("RowSum", lambda *columns: functools.reduce(pc.add, columns)))
work("udf_rowsum_rows", "n", "PROJECT [n_0, n_2] FROM (n) AS t, UDF /functions/row RowSum ON t AS x WITH COLUMNS (INTEGER)", "x", "total", "SELECT n_nationkey + n_regionkey AS total FROM nation", registry=Registry().row_function("RowSum", sum))


# -- the other front ends ----------------------------------------------------------------------
def linq_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _table("o")(spark, sf_dir), _table("c")(spark, sf_dir)
    orders, customers = relation("o", *types_of(o)), relation("c", *types_of(c))
    q = orders.where((orders[3] > 50_000) & ~(orders[2] == "P")).join(customers, [1], [0]).group_by([8], "PLUS", [3])
    return q.where(q[1] > 0).to(spark, o=o, c=c).toDF("segment", "price").withColumn("price", F.round("price", 2))


def linq_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _table("c")(spark, sf_dir), _table("s")(spark, sf_dir)
    a, b = relation("c", *types_of(c)).select(2), relation("s", *types_of(s)).select(2)
    q = a.intersect(b.where(b[0] < 12)).union(b.where(b[0] > 20)).except_(b.where(b[0] == 3)).order_by(0)
    return q.to(spark, c=c, s=s).toDF("nation")


def vertex_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = relation("edges", "INTEGER", "INTEGER"), relation("pr", "INTEGER", "DOUBLE")
    q = vertex_program(e, v, 5, "+", ("DIV", OUTNUM), [("MUL", 0.85), ("SUM", 0.15)])
    return q.to(spark, edges=_edges(spark, sf_dir), pr=_ranks(spark, sf_dir)).toDF("vertex", "rank").withColumn("rank", F.round("rank", 6))


def vertex_sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = relation("costs", "INTEGER", "INTEGER", "INTEGER"), relation("dist", "INTEGER", "INTEGER")
    q = vertex_program(e, v, 4, "min", ("SUM", "EDGEVAL"), keep=True)
    return q.to(spark, costs=_costs(spark, sf_dir), dist=_distances(spark, sf_dir)).toDF("vertex", "distance")


def black_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry().source("/jobs/nations", lambda s: _read(s, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    program = "BLACK BOX spark /jobs/nations AS g WITH COLUMNS (INTEGER, INTEGER), COUNT [g_0] FROM (g) GROUP BY [g_1] AS x"
    return query(spark, program, {}, "x", ["region", "n"], registry)


def linq_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table("o")(spark, sf_dir)
    q = relation("o", *types_of(o))
    return q.where(q[2] == "F").select_many().count().to(spark, o=o).toDF("n")


def linq_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table("c")(spark, sf_dir)
    q = relation("c", *types_of(c))
    return q.min(3, 0).concat(q.max(3, 0)).to(spark, c=c).toDF("k", "bal", "ckey")


def _stored(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/relflow-{name}-{uuid.uuid4().hex}"


def _leaf(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """A workflow's inputs from stored files and its leaf to stored files, read again."""
    root, s = _stored(spark, form), _table("s")(spark, sf_dir)
    save(s.select("s_suppkey", "s_nationkey", "s_acctbal"), f"{root}/in", form)
    catalog = Catalog(spark)
    kinds = ["INTEGER", "INTEGER", "DOUBLE"]
    catalog.text("s", f"{root}/in", kinds) if form == "text" else catalog.parquet("s", f"{root}/in")
    program = "CREATE RELATION s WITH COLUMNS (INTEGER, INTEGER, DOUBLE), AGG [s_2, +] FROM (s) WHERE [(s_2 > 0)] GROUP BY [s_1] AS x"
    Workflow(program).save(catalog, f"{root}/out", form)
    back = Catalog(spark)
    got = back.text("x", f"{root}/out/x", ["INTEGER", "DOUBLE"]) if form == "text" else back.parquet("x", f"{root}/out/x")
    return got.frames["x"].toDF("nation", "bal").withColumn("bal", F.round("bal", 2))


_LEAF = "SELECT CAST(s_nationkey AS BIGINT) AS nation, round(sum(s_acctbal), 2) AS bal FROM supplier WHERE s_acctbal > 0 GROUP BY 1"


API = {
    "linq_pipeline": (linq_pipeline, "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 AND NOT o_orderstatus = 'P' GROUP BY 1"),
    "linq_sets": (linq_sets, "SELECT DISTINCT nation FROM (SELECT c_nationkey AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 12) UNION ALL SELECT s_nationkey FROM supplier WHERE s_nationkey > 20) WHERE nation NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey = 3) ORDER BY 1"),
    "linq_count": (linq_count, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "linq_min_max": (linq_min_max, "SELECT 'ALL' AS k, m.a AS bal, m.b AS ckey FROM (SELECT min({'a': c_acctbal, 'b': c_custkey}) AS m FROM customer UNION ALL SELECT max({'a': c_acctbal, 'b': c_custkey}) FROM customer)"),
    "leaf_text": (lambda spark, sf_dir: _leaf(spark, sf_dir, "text"), _LEAF),
    "leaf_parquet": (lambda spark, sf_dir: _leaf(spark, sf_dir, "parquet"), _LEAF),
    "vertex_pagerank": (vertex_pagerank, _unrolled(5)),
    "vertex_sssp": (vertex_sssp, WORK["sssp"].sql),
    "black_box": (black_box, "SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM nation GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**WORK, **{k: f for k, (f, _) in API.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: w.sql for k, w in WORK.items()}, **{k: sql for k, (_, sql) in API.items()}}
