"""One registered query, with the equivalent SQL, for each operator of the engine."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CatalogError, LockedError
from .functions import keys
from .operators import aggregate as agg
from .operators import cascade, index, join, paging, ranges, write
from .plans.predicate import Pred, Where
from .plans.scan import Scan, project
from .sources.catalog import Catalog, FamilySpec, IndexDef, TableSpec, column_summary, parquet_reader
from .sources.shared import scratch_folder
from .sources.store import Store
from .streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DAY = dt.datetime(1998, 9, 2)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet_reader(spark, sf_dir)(name)


def shop(spark: SparkSession, sf_dir: str) -> Catalog:
    """customer -> orders -> lineitem, and the events."""
    catalog = Catalog(parquet_reader(spark, sf_dir))
    catalog.create_table(TableSpec("shop", "customer", {
        "customer": FamilySpec("customer", "customer", "c_custkey", ("c_custkey", "c_mktsegment"), ("c_mktsegment", "c_nationkey")),
        "orders": FamilySpec("orders", "orders", "o_orderkey", ("o_orderkey",), ("o_orderstatus", "o_orderpriority"), "customer", "o_custkey"),
        "lineitem": FamilySpec("lineitem", "lineitem", "l_linenumber", ("l_orderkey", "l_linenumber"), ("l_returnflag",), "orders", "l_orderkey"),
    }))
    catalog.create_table(TableSpec("log", "events", {"events": FamilySpec("events", "events", "event_id", ("event_id",), ("event_type", "user_id"))}))
    catalog.add_index("shop", "orders", IndexDef("by_status_date", ("o_orderstatus",), (("o_orderdate", "desc"),)))
    catalog.add_index("shop", "orders", IndexDef("by_priority", ("o_orderpriority", "o_totalprice")))
    return catalog


_STORES: dict[tuple[str, str], Store] = {}


def empty_store(spark: SparkSession, sf_dir: str) -> Store:
    """The shop in a store of its own, its rows read where they are."""
    store = Store(spark, scratch_folder(spark, "store"))
    for spec in shop(spark, sf_dir).tables.values():
        store.create_table(spec, {n: f"{sf_dir}/{f.source}.parquet" for n, f in spec.families.items()})
    return store


def indexed_store(spark: SparkSession, sf_dir: str) -> Store:
    """The shop with its indexes built, once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = empty_store(spark, sf_dir)
        for i in (IndexDef("by_priority", ("o_orderpriority",)), IndexDef("by_priority_price", ("o_orderpriority", "o_totalprice"))):
            store.create_index("shop", "orders", i)
        _STORES[key] = store
    return _STORES[key]


# ---- scans

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query("SELECT * FROM orders")
def scan_full(spark, sf_dir):
    return Scan().run(rows(spark, sf_dir, "orders"))


@query("SELECT * FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000")
def scan_range(spark, sf_dir):
    return Scan(key="o_orderkey", start=1000, stop=2000).run(rows(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def scan_reverse(spark, sf_dir):
    return Scan(key="o_orderkey", reverse=True, limit=100, columns=["o_orderkey", "o_totalprice"]).run(rows(spark, sf_dir, "orders"))


@query(f"SELECT {_ORDERS} FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 9000 AND o_totalprice > 1000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
def scan_pushdown(spark, sf_dir):
    where = Where(all_of=[Pred("o_totalprice", ">", 1000.0), Pred("o_orderstatus", "=", "F")])
    return Scan(where, _ORDERS.split(", "), "o_orderkey", 500, 9000, limit=50).run(rows(spark, sf_dir, "orders"))


@query("SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000")
def scan_index_multi(spark, sf_dir):
    """Conditions on two columns, pushed to the files of a stored index; its keys restrict the rows."""
    where = Where(all_of=[Pred("o_orderpriority", "=", "1-URGENT"), Pred("o_totalprice", ">", 450000.0)])
    return indexed_store(spark, sf_dir).scan("shop", "orders", Scan(where))


@query("SELECT * FROM orders WHERE o_orderkey = 1234")
def scan_main_id(spark, sf_dir):
    return Scan(Where(all_of=[Pred("o_orderkey", "=", 1234)])).run(rows(spark, sf_dir, "orders"))


@query("SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def scan_inlist(spark, sf_dir):
    return Scan(Where(in_list={"o_orderpriority": ["1-URGENT", "2-HIGH"]})).run(rows(spark, sf_dir, "orders"))


@query("""WITH k AS (SELECT DISTINCT o_custkey % 7 AS salt, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT *, CASE WHEN o_orderkey - lag(o_orderkey) OVER (PARTITION BY salt ORDER BY o_orderkey) <= 20 THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY salt ORDER BY o_orderkey) AS run FROM n)
SELECT salt, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n_keys FROM r GROUP BY salt, run""")
def scan_coalesce(spark, sf_dir):
    some = rows(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 7).alias("salt"), "o_orderkey")
    return ranges.coalesce_ranges(some, ["salt"], "o_orderkey", 20)


@query("SELECT * FROM orders WHERE o_custkey = 77")
def scan_by_parent(spark, sf_dir):
    return Scan(parent=("o_custkey", [77])).run(rows(spark, sf_dir, "orders"))


@query("SELECT * FROM orders WHERE o_custkey IN (7, 77, 777)")
def scan_by_parents(spark, sf_dir):
    return Scan(parent=("o_custkey", [7, 77, 777])).run(rows(spark, sf_dir, "orders"))


@query("""SELECT o.o_orderkey, o.o_orderstatus, coalesce(string_agg(cast(l.l_partkey AS VARCHAR), ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS parts
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL""")
def scan_multi_family(spark, sf_dir):
    """All orders with their children, no condition on the key."""
    request = cascade.Cascade("orders", columns=["o_orderstatus"], children=[cascade.Cascade("lineitem", columns=["l_partkey"])])
    nested = cascade.read_nested(shop(spark, sf_dir), "shop", request)
    return nested.select("o_orderkey", "o_orderstatus", F.concat_ws(",", F.transform("lineitem", lambda x: x["l_partkey"].cast("string"))).alias("parts"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def scan_index_inregion(spark, sf_dir):
    """The index has all that is asked for, so the rows aren't read."""
    where = Where(all_of=[Pred("o_orderpriority", "=", "1-URGENT")])
    return indexed_store(spark, sf_dir).scan("shop", "orders", Scan(where, ["o_orderkey", "o_orderpriority"]))


@query("SELECT 'o_orderpriority' AS column_name, o_orderpriority AS idx_value, 'orders' AS family_name, cast(o_orderkey AS VARCHAR) AS row_id FROM orders WHERE o_orderpriority >= '1' AND o_orderpriority < '3'")
def scan_index_range_emit(spark, sf_dir):
    found = index.entries(rows(spark, sf_dir, "orders"), shop(spark, sf_dir).table("shop").family("orders"))
    return index.emit_range(found, "o_orderpriority", "1", "3")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def get_row(spark, sf_dir):
    return rows(spark, sf_dir, "customer").where("c_custkey = 42").limit(1)


@query("""SELECT * FROM (VALUES ('shop', 'customer', true, 'c_custkey', 12, NULL, 'c_custkey,c_mktsegment', 'c_mktsegment,c_nationkey'),
('shop', 'orders', false, 'o_orderkey', 12, 'customer', 'o_orderkey', 'o_orderstatus,o_orderpriority'),
('shop', 'lineitem', false, 'l_linenumber', 12, 'orders', 'l_orderkey,l_linenumber', 'l_returnflag')) t(table_name, family, is_main, pk, pk_width, parent, key_columns, indexed)""")
def meta_get_table(spark, sf_dir):
    return shop(spark, sf_dir).describe(spark, "shop")


@query("SELECT * FROM (VALUES ('shop', 'customer', 3), ('log', 'events', 1)) t(table_name, main_family, families)")
def meta_list(spark, sf_dir):
    return shop(spark, sf_dir).list_tables(spark)


@query("SELECT * FROM (VALUES ('by_priority', 'o_orderpriority,o_totalprice', ''), ('by_status_date', 'o_orderstatus', 'o_orderdate desc')) t(index_name, columns, order_by)")
def meta_get_idx(spark, sf_dir):
    return shop(spark, sf_dir).list_indexes(spark, "shop", "orders")


# ---- projection


@query("SELECT c_custkey, c_name FROM customer")
def project_cols(spark, sf_dir):
    return project(rows(spark, sf_dir, "customer"), ["c_custkey", "c_name"])


@query("SELECT count(*) AS n FROM lineitem")
def project_keyonly(spark, sf_dir):
    return rows(spark, sf_dir, "lineitem").select().agg(F.count(F.lit(1)).alias("n"))


_KEYED = "concat('p_t_00001##c-custkey::', c_custkey, '_c-mktsegment::', c_mktsegment, '_c-nationkey::')"


@query("SELECT cast(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, 'NULL' AS nation FROM customer")
def project_key_decode(spark, sf_dir):
    m = keys.key_map(F.expr(_KEYED))
    return rows(spark, sf_dir, "customer").select(m["c-custkey"].alias("id"), m["c-mktsegment"].alias("segment"), m["c-nationkey"].alias("nation"))


@query("SELECT c_custkey, replace(replace(replace(replace(replace(replace(c_name, '#', '$-$'), '$-$', '_'), ';;', '::'), '!!', '|'), '$', '#'), '_', '_') AS name FROM customer")
def result_flatten(spark, sf_dir):
    return rows(spark, sf_dir, "customer").select("c_custkey", keys.unformat_value(F.replace("c_name", F.lit("#"), F.lit("$-$"))).alias("name"))


# ---- filters


def _filter(where: Where, source: str):
    return lambda spark, sf_dir: Scan(where).run(rows(spark, sf_dir, source))


_FILTERS: dict[str, tuple[Where, str, str]] = {
    "filter_conj": (Where(all_of=[Pred("l_quantity", ">=", 10.0), Pred("l_discount", "<", 0.05), Pred("l_returnflag", "!=", "N"), Pred("l_shipdate", "<=", DAY)]), "lineitem", "l_quantity >= 10 AND l_discount < 0.05::DOUBLE AND l_returnflag != 'N' AND l_shipdate <= TIMESTAMP '1998-09-02'"),
    "filter_text": (Where(all_of=[Pred("o_orderkey", ">", "9")], compare="text"), "orders", "cast(o_orderkey AS VARCHAR) > '9'"),
    "filter_dnf": (Where(any_of=[{"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, {"o_orderstatus": "O", "o_orderpriority": "5-LOW"}]), "orders", "(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')"),
    "filter_dnf_single": (Where(any_of=[{"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}]), "orders", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "filter_and_or": (Where(all_of=[Pred("o_totalprice", ">", 5000.0)], any_of=[{"o_orderstatus": "F"}, {"o_orderstatus": "O"}], contains={"o_orderpriority": "URG"}), "orders", "o_totalprice > 5000 AND o_orderstatus IN ('F', 'O') AND contains(o_orderpriority, 'URG')"),
    "filter_substring": (Where(contains={"p_name": "a"}), "part", "contains(p_name, 'a')"),
    "filter_regex": (Where(matches={"p_brand": "#[12][0-9]?$"}), "part", "regexp_matches(p_brand, '#[12][0-9]?$', 's')"),
    "filter_prefix": (Where(starts={"o_orderpriority": "1-"}), "orders", "starts_with(o_orderpriority, '1-')"),
    "filter_between_idx": (Where(between={"o_totalprice": (1000.0, 2000.0)}), "orders", "o_totalprice BETWEEN 1000 AND 2000"),
    "filter_range_infer": (Where(all_of=[Pred("o_orderkey", "<", 500), Pred("o_orderkey", "<", 300), Pred("o_orderkey", ">=", 20)]), "orders", "o_orderkey < 300 AND o_orderkey >= 20"),
    "filter_range_contradiction": (Where(all_of=[Pred("o_orderkey", "<", 5), Pred("o_orderkey", ">", 7)]), "orders", "o_orderkey < 5 AND o_orderkey > 7"),
    "filter_rowcmp": (Where(all_of=[Pred("c_acctbal", ">", 0.0)], in_list={"c_mktsegment": ["BUILDING", "MACHINERY"]}), "customer", "c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_list": (Where(all_of=[Pred("p_size", ">", 10), Pred("p_size", "<=", 30)], contains={"p_type": "A"}), "part", "p_size > 10 AND p_size <= 30 AND contains(p_type, 'A')"),
}
for _name, (_where, _source, _condition) in _FILTERS.items():
    _QUERIES[_name], _SQL[_name] = _filter(_where, _source), f"SELECT * FROM {_source} WHERE {_condition}"


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 10 AND 20 OR o_orderkey BETWEEN 100 AND 120")
def filter_multi_range(spark, sf_dir):
    spans = [(10, 20), (100, 120)]
    condition = F.lit(False)
    for lo, hi in spans:
        condition = condition | F.col("o_orderkey").between(lo, hi)
    return rows(spark, sf_dir, "orders").where(condition)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE (c_nationkey & 5) = 5")
def filter_bits(spark, sf_dir):
    return rows(spark, sf_dir, "customer").where(F.col("c_nationkey").bitwiseAND(5) == 5).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^.....')  AND c_name >= 'C' AND c_name <= 'Customer#000000500'")
def filter_inclusive_stop(spark, sf_dir):
    """A fuzzy row (five characters of any kind) up to and including a stop key."""
    where = Where(all_of=[Pred("c_name", ">=", "C"), Pred("c_name", "<=", "Customer#000000500")], matches={"c_name": "^....."})
    return Scan(where, ["c_custkey"]).run(rows(spark, sf_dir, "customer"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < (SELECT min(n_nationkey) FROM nation WHERE NOT (n_regionkey < 4))")
def filter_while_match(spark, sf_dir):
    """Rows in key order up to the first that fails; one small aggregate finds it."""
    nation = rows(spark, sf_dir, "nation")
    stop = nation.where(~(F.col("n_regionkey") < 4)).agg(F.min("n_nationkey").alias("stop"))
    return nation.join(stop, (F.col("n_nationkey") < F.col("stop")) | F.col("stop").isNull()).select("n_nationkey", "n_name")


_GAPS = "SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority FROM orders"


def _with_gaps(spark, sf_dir) -> DataFrame:
    """Orders whose middle priority is missing."""
    return rows(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("o_orderpriority"))


@query(f"SELECT * FROM ({_GAPS}) WHERE o_orderpriority != '1-URGENT'")
def filter_missing(spark, sf_dir):
    return Scan(Where(all_of=[Pred("o_orderpriority", "!=", "1-URGENT")])).run(_with_gaps(spark, sf_dir))


@query(f"SELECT * FROM ({_GAPS}) WHERE o_orderpriority IS NULL OR o_orderpriority = '5-LOW'")
def filter_null(spark, sf_dir):
    found = _with_gaps(spark, sf_dir)
    return found.where(F.col("o_orderpriority").isNull() | (F.col("o_orderpriority") == "5-LOW"))


@query("SELECT o_custkey, o_orderstatus FROM orders")
def filter_column_page(spark, sf_dir):
    """Columns by place: two after the first."""
    orders = rows(spark, sf_dir, "orders")
    return project(orders, orders.columns[1:3])


# ---- joins


def _tree(spark, sf_dir) -> join.JoinNode:
    t = lambda name: rows(spark, sf_dir, name)
    nation = join.JoinNode(t("nation"), "sn", ["n_name"]).join("n_regionkey", "r_regionkey", join.JoinNode(t("region"), "sr", ["r_name"]))
    supplier = join.JoinNode(t("supplier"), "s", ["s_name"]).join("s_nationkey", "n_nationkey", nation)
    customer = join.JoinNode(t("customer"), "c", ["c_name"], Where(all_of=[Pred("c_acctbal", ">", 0.0)])).join("c_nationkey", "n_nationkey", join.JoinNode(t("nation"), "cn", ["n_name"]))
    orders = join.JoinNode(t("orders"), "o", ["o_orderdate"]).join("o_custkey", "c_custkey", customer)
    root = join.JoinNode(t("lineitem"), "l", ["l_linenumber", "l_quantity"], Where(all_of=[Pred("l_quantity", ">", 40.0)]))
    return root.join("l_partkey", "p_partkey", join.JoinNode(t("part"), "p", ["p_name"])).join("l_suppkey", "s_suppkey", supplier).join("l_orderkey", "o_orderkey", orders)


@query("""SELECT l_linenumber AS l_l_linenumber, l_quantity AS l_l_quantity, l_partkey AS l_l_partkey, l_suppkey AS l_l_suppkey, l_orderkey AS l_l_orderkey,
p_partkey AS p_p_partkey, p_name AS p_p_name, s_suppkey AS s_s_suppkey, s_name AS s_s_name, s_nationkey AS s_s_nationkey, sn.n_nationkey AS sn_n_nationkey, sn.n_name AS sn_n_name, sn.n_regionkey AS sn_n_regionkey,
r_regionkey AS sr_r_regionkey, r_name AS sr_r_name, o_orderkey AS o_o_orderkey, o_orderdate AS o_o_orderdate, o_custkey AS o_o_custkey, c_custkey AS c_c_custkey, c_name AS c_c_name, c_nationkey AS c_c_nationkey,
cn.n_nationkey AS cn_n_nationkey, cn.n_name AS cn_n_name
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region ON sn.n_regionkey = r_regionkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE l_quantity > 40 AND c_acctbal > 0""")
def join_tree(spark, sf_dir):
    return join.join_tree(_tree(spark, sf_dir))


@query("SELECT o_orderkey AS o_o_orderkey, o_custkey AS o_o_custkey, c_custkey AS c_c_custkey, c_name AS c_c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_build(spark, sf_dir):
    customer = join.JoinNode(rows(spark, sf_dir, "customer"), "c", ["c_name"])
    return join.join_tree(join.JoinNode(rows(spark, sf_dir, "orders"), "o", ["o_orderkey"]).join("o_custkey", "c_custkey", customer))


@query("SELECT l_orderkey AS l_l_orderkey, l_linenumber AS l_l_linenumber, o_orderkey AS o_o_orderkey, o_orderstatus AS o_o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def join_probe(spark, sf_dir):
    orders = join.JoinNode(rows(spark, sf_dir, "orders"), "o", ["o_orderstatus"], Where(all_of=[Pred("o_orderstatus", "=", "F")]))
    return join.join_tree(join.JoinNode(rows(spark, sf_dir, "lineitem"), "l", ["l_linenumber"]).join("l_orderkey", "o_orderkey", orders)).select("l_l_orderkey", "l_l_linenumber", "o_o_orderkey", "o_o_orderstatus")


@query("SELECT s_suppkey AS s_s_suppkey, s_nationkey AS s_s_nationkey, n_nationkey AS n_n_nationkey, n_regionkey AS n_n_regionkey, r_regionkey AS r_r_regionkey, r_name AS r_r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_nested(spark, sf_dir):
    nation = join.JoinNode(rows(spark, sf_dir, "nation"), "n").join("n_regionkey", "r_regionkey", join.JoinNode(rows(spark, sf_dir, "region"), "r", ["r_name"]))
    return join.join_tree(join.JoinNode(rows(spark, sf_dir, "supplier"), "s", ["s_suppkey"]).join("s_nationkey", "n_nationkey", nation))


@query("""SELECT n_nationkey AS n_n_nationkey, s_suppkey AS s_s_suppkey, count(*) AS n_pairs, sum(c_custkey)::BIGINT AS custkeys
FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def join_product(spark, sf_dir):
    """The product of all customers and suppliers of a nation, counted for each supplier."""
    root = join.JoinNode(rows(spark, sf_dir, "nation"), "n").join("n_nationkey", "s_nationkey", join.JoinNode(rows(spark, sf_dir, "supplier"), "s", ["s_suppkey"]))
    found = join.join_tree(root.join("n_nationkey", "c_nationkey", join.JoinNode(rows(spark, sf_dir, "customer"), "c", ["c_custkey"])))
    return found.groupBy("n_n_nationkey", "s_s_suppkey").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("c_c_custkey").alias("custkeys"))


@query("SELECT l_partkey AS l_l_partkey, p_partkey AS p_p_partkey, p_brand AS p_p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_project(spark, sf_dir):
    return join.join_tree(join.JoinNode(rows(spark, sf_dir, "lineitem"), "l").join("l_partkey", "p_partkey", join.JoinNode(rows(spark, sf_dir, "part"), "p", ["p_brand"])))


@query("SELECT l_orderkey AS l_l_orderkey, l_suppkey AS l_l_suppkey, s_suppkey AS s_s_suppkey, s_acctbal AS s_s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND s_acctbal > 1000")
def join_filter(spark, sf_dir):
    supplier = join.JoinNode(rows(spark, sf_dir, "supplier"), "s", ["s_acctbal"], Where(all_of=[Pred("s_acctbal", ">", 1000.0)]))
    return join.join_tree(join.JoinNode(rows(spark, sf_dir, "lineitem"), "l", ["l_orderkey"], Where(all_of=[Pred("l_returnflag", "=", "R")])).join("l_suppkey", "s_suppkey", supplier))


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def join_cascade(spark, sf_dir):
    nested = cascade.read_nested(shop(spark, sf_dir), "shop", cascade.Cascade("orders", children=[cascade.Cascade("lineitem", columns=["l_quantity"])]))
    return nested.select("o_orderkey", F.size("lineitem").cast("bigint").alias("n_lines"))


@query("SELECT s_suppkey AS s_s_suppkey, s_nationkey AS s_s_nationkey, n_nationkey AS n_n_nationkey, n_name AS n_n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_cleanup(spark, sf_dir):
    """Nothing is shared between runs: a join's state ends with its stages."""
    nation = join.JoinNode(rows(spark, sf_dir, "nation"), "n", ["n_name"])
    return join.join_tree(join.JoinNode(rows(spark, sf_dir, "supplier"), "s", ["s_suppkey"]).join("s_nationkey", "n_nationkey", nation))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_index_semi(spark, sf_dir):
    return join.restrict_to(rows(spark, sf_dir, "documents").select("doc_id", "lang"), rows(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_exist_anti(spark, sf_dir):
    return join.not_present(rows(spark, sf_dir, "orders").select("o_orderkey"), rows(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


# ---- aggregates


def _avg_sql(x: str) -> str:
    """Average rounded half up to two places, for non-negative amounts of two places."""
    return f"((2 * cast(sum(cast({x} AS DECIMAL(18,2))) * 100 AS BIGINT) + count({x})) // (2 * count({x}))) / 100.0::DOUBLE"


def _sum_sql(x: str) -> str:
    return f"cast(sum(cast({x} AS DECIMAL(18,2))) AS DOUBLE)"


_AGGREGATES: dict[str, tuple[str, str, str, str]] = {
    # name: kind, source, column, SQL
    "agg_max": ("max", "orders", "o_totalprice", "max(o_totalprice)"),
    "agg_max_date": ("max", "orders", "o_orderdate", "max(o_orderdate)"),
    "agg_max_text": ("max", "customer", "c_name", "max(c_name)"),
    "agg_min": ("min", "orders", "o_totalprice", "min(o_totalprice)"),
    "agg_min_date": ("min", "lineitem", "l_shipdate", "min(l_shipdate)"),
    "agg_sum": ("sum", "lineitem", "l_extendedprice", _sum_sql("l_extendedprice")),
    "agg_count": ("count", "lineitem", "l_orderkey", "count(*)"),
    "agg_avg": ("avg", "lineitem", "l_extendedprice", _avg_sql("l_extendedprice")),
    "agg_median": ("median", "lineitem", "l_quantity", "median(l_quantity)"),
}
for _name, (_kind, _source, _column, _sql) in _AGGREGATES.items():
    _QUERIES[_name] = lambda spark, sf_dir, k=_kind, s=_source, c=_column: agg.aggregate(rows(spark, sf_dir, s), k, c, name="result")
    _SQL[_name] = f"SELECT {_sql} AS result FROM {_source}"

_GROUPS: dict[str, tuple[str, str, list[str], str, str]] = {
    "group_max": ("max", "orders", ["o_orderpriority"], "o_totalprice", "max(o_totalprice)"),
    "group_max_date": ("max", "orders", ["o_custkey"], "o_orderdate", "max(o_orderdate)"),
    "group_min": ("min", "orders", ["o_orderpriority"], "o_orderdate", "min(o_orderdate)"),
    "group_min_text": ("min", "customer", ["c_nationkey"], "c_name", "min(c_name)"),
    "group_count": ("count", "lineitem", ["l_suppkey"], "l_orderkey", "count(*)"),
    "group_avg": ("avg", "lineitem", ["l_orderkey"], "l_extendedprice", _avg_sql("l_extendedprice")),
}
for _name, (_kind, _source, _by, _column, _sql) in _GROUPS.items():
    _QUERIES[_name] = lambda spark, sf_dir, k=_kind, s=_source, b=_by, c=_column: agg.group_aggregate(rows(spark, sf_dir, s), b, k, c, name="result")
    _SQL[_name] = f"SELECT {', '.join(_by)}, {_sql} AS result FROM {_source} GROUP BY ALL"


@query(f"SELECT l_returnflag, l_linestatus, {_sum_sql('l_extendedprice')} AS sum_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def group_sum(spark, sf_dir):
    """The flagship: pushed-down filter, pruned columns, partial aggregates, one small shuffle."""
    some = Scan(Where(all_of=[Pred("l_shipdate", "<=", DAY)])).run(rows(spark, sf_dir, "lineitem"))
    return agg.group_aggregate(some, ["l_returnflag", "l_linestatus"], "sum", "l_extendedprice", name="sum_price")


@query(f"SELECT {_sum_sql('o_totalprice')} AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def agg_filtered(spark, sf_dir):
    where = Where(all_of=[Pred("o_orderstatus", "=", "F"), Pred("o_totalprice", ">", 1000.0)])
    return agg.aggregate(Scan(where).run(rows(spark, sf_dir, "orders")), "sum", "o_totalprice", name="total")


@query("SELECT max(l_quantity) AS most FROM lineitem WHERE l_suppkey IN (1, 5, 9)")
def agg_ranges(spark, sf_dir):
    return agg.aggregate(agg.in_ranges(rows(spark, sf_dir, "lineitem"), "l_suppkey", [1, 5, 9]), "max", "l_quantity", name="most")


@query(f"SELECT kind, result FROM (SELECT 'sum' AS kind, {_sum_sql('o_totalprice')} AS result FROM orders UNION ALL SELECT 'avg', {_avg_sql('o_totalprice')} FROM orders UNION ALL SELECT 'min', min(o_totalprice) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders)")
def agg_dispatch(spark, sf_dir):
    orders = rows(spark, sf_dir, "orders")
    one = orders.agg(*[agg.AGGREGATES[k](F.col("o_totalprice"), orders.schema["o_totalprice"].dataType).alias(k) for k in ("sum", "avg", "min", "max")])
    return one.unpivot([], ["sum", "avg", "min", "max"], "kind", "result")


@query("SELECT round(stddev_pop(l_quantity), 6) AS result FROM lineitem")
def agg_std(spark, sf_dir):
    return agg.aggregate(rows(spark, sf_dir, "lineitem"), "std", "l_quantity", name="result").select(F.round("result", 6).alias("result"))


@query("SELECT concat_ws(',', l_returnflag, l_linestatus) AS group_key, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_multi(spark, sf_dir):
    by = ["l_returnflag", "l_linestatus"]
    return agg.group_aggregate(rows(spark, sf_dir, "lineitem"), by, "count", name="n").select(agg.group_label(by), *by, "n")


@query(f"SELECT o_orderstatus, {_avg_sql('o_totalprice')} AS mean FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def group_filtered(spark, sf_dir):
    some = Scan(Where(all_of=[Pred("o_totalprice", ">", 1000.0)])).run(rows(spark, sf_dir, "orders"))
    return agg.group_aggregate(some, ["o_orderstatus"], "avg", "o_totalprice", name="mean")


@query(f"SELECT l_returnflag, {_sum_sql('l_quantity')} AS total FROM lineitem WHERE l_suppkey IN (2, 3) GROUP BY l_returnflag")
def group_ranges(spark, sf_dir):
    return agg.group_aggregate(agg.in_ranges(rows(spark, sf_dir, "lineitem"), "l_suppkey", [2, 3]), ["l_returnflag"], "sum", "l_quantity", name="total")


# ---- order and pages

_NEWEST = [("o_orderdate", "desc"), ("o_orderkey", "asc")]


@query("SELECT * FROM nation ORDER BY n_nationkey")
def sort_key(spark, sf_dir):
    return Scan(order=[("n_nationkey", "asc")]).run(rows(spark, sf_dir, "nation"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def sort_index(spark, sf_dir):
    return Scan(Where(all_of=[Pred("o_orderstatus", "=", "F")]), ["o_orderkey", "o_orderdate"], order=_NEWEST, limit=200).run(rows(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, o_orderdate FROM orders")
def sort_rowkey_clustered(spark, sf_dir):
    return rows(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartitionByRange("o_orderdate", "o_orderkey").sortWithinPartitions("o_orderdate", "o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def sort_missing_idx_error(spark, sf_dir):
    """No index is needed for an order here."""
    return Scan(columns=["c_custkey", "c_acctbal"], order=[("c_acctbal", "asc"), ("c_custkey", "asc")], limit=20).run(rows(spark, sf_dir, "customer"))


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) > 25 AS has_more FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def limit_page(spark, sf_dir):
    return paging.page_with_more(rows(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), _NEWEST, 25)


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey > 100) ORDER BY o_orderdate DESC, o_orderkey LIMIT 30""")
def page_cursor(spark, sf_dir):
    cursor = {"o_orderdate": dt.datetime(1998, 1, 1), "o_orderkey": 100}
    return paging.page_after(rows(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), _NEWEST, cursor, 30)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderpriority, o_orderkey LIMIT 40 OFFSET 60")
def page_offset(spark, sf_dir):
    some = Scan(Where(in_list={"o_orderpriority": ["1-URGENT", "2-HIGH"]}), ["o_orderkey", "o_orderpriority"]).run(rows(spark, sf_dir, "orders"))
    return paging.page_by_offset(some, [("o_orderpriority", "asc"), ("o_orderkey", "asc")], 60, 40)


@query("SELECT o_orderkey, lpad(lower(to_base(o_orderkey, 36)), 8, '0') AS up, lpad(lower(to_base(2147483647 - o_orderkey, 36)), 8, '0') AS down FROM orders")
def order_encode(spark, sf_dir):
    return rows(spark, sf_dir, "orders").select("o_orderkey", keys.order_code(F.col("o_orderkey")).alias("up"), keys.order_code(F.col("o_orderkey"), True).alias("down"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def union_all(spark, sf_dir):
    orders = rows(spark, sf_dir, "orders")
    return write.insert(orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), orders.where("o_orderstatus = 'F'").select("o_orderkey"))


# ---- hierarchies


def _flat(nested: DataFrame) -> DataFrame:
    order = lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit(":"), F.concat_ws("/", F.transform(o["lineitem"], lambda x: x["l_partkey"].cast("string"))))
    return nested.select("c_custkey", F.concat_ws(",", F.transform("orders", order)).alias("orders"))


def _cascade_sql(orders: str = "true", lines: str = "true", customers: str = "true") -> str:
    return f"""WITH l AS (SELECT l_orderkey, string_agg(cast(l_partkey AS VARCHAR), '/' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem WHERE {lines} GROUP BY l_orderkey),
o AS (SELECT o_custkey, string_agg(concat(o_orderkey, ':', coalesce(parts, '')), ',' ORDER BY o_orderkey) AS orders FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE {orders} GROUP BY o_custkey)
SELECT c_custkey, coalesce(orders, '') AS orders FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE {customers}"""


@query(_cascade_sql())
def cascade_read(spark, sf_dir):
    request = cascade.Cascade("customer", columns=["c_name"], children=[cascade.Cascade("orders", columns=["o_orderstatus"], children=[cascade.Cascade("lineitem", columns=["l_partkey"])])])
    return _flat(cascade.read_nested(shop(spark, sf_dir), "shop", request))


@query(_cascade_sql("o_orderstatus = 'F'", "l_quantity > 25", "c_acctbal > 0"))
def cascade_filter(spark, sf_dir):
    lines = cascade.Cascade("lineitem", Where(all_of=[Pred("l_quantity", ">", 25.0)]), ["l_partkey"])
    orders = cascade.Cascade("orders", Where(all_of=[Pred("o_orderstatus", "=", "F")]), ["o_totalprice"], [lines])
    return _flat(cascade.read_nested(shop(spark, sf_dir), "shop", cascade.Cascade("customer", Where(all_of=[Pred("c_acctbal", ">", 0.0)]), ["c_name"], [orders])))


@query("SELECT o_custkey AS c_custkey, l_orderkey AS o_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def cascade_parent_key(spark, sf_dir):
    request = cascade.Cascade("customer", columns=["c_name"], children=[cascade.Cascade("orders", columns=["o_orderstatus"], children=[cascade.Cascade("lineitem", columns=["l_partkey"])])])
    nested = cascade.read_nested(shop(spark, sf_dir), "shop", request)
    orders = nested.select("c_custkey", F.explode("orders").alias("o"))
    return orders.select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"), F.explode("o.lineitem").alias("l")).select("c_custkey", "o_orderkey", "l.l_linenumber", "l.l_partkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey")
def cascade_put(spark, sf_dir):
    nested = cascade.read_nested(shop(spark, sf_dir), "shop", cascade.Cascade("customer", columns=["c_name"], children=[cascade.Cascade("orders", columns=["o_orderstatus"])]))
    return cascade.split_nested(nested, "c_custkey", {"orders": "o_custkey"})["orders"]


@query("""SELECT 'customer' AS family, count(*) AS n FROM customer WHERE NOT (c_custkey % 10 = 0) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0))""")
def cascade_delete(spark, sf_dir):
    ids = rows(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey")
    left = cascade.delete_cascade(shop(spark, sf_dir), "shop", ids)
    parts = [left[f].agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("family"), "n") for f in ("customer", "orders", "lineitem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- writes, indexes, DDL


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, NULL FROM supplier")
def put_insert(spark, sf_dir):
    new = rows(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return write.insert(rows(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), new)


_CHANGES = "SELECT user_id AS c_custkey, 'SEG-' || event_type AS c_mktsegment, ts, event_id FROM events"


def _changes(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.concat(F.lit("SEG-"), "event_type").alias("c_mktsegment"), "ts", "event_id")


@query(f"SELECT c.c_custkey, c.c_name, coalesce(x.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey, arg_max(c_mktsegment, (ts, event_id)) AS c_mktsegment FROM ({_CHANGES}) GROUP BY c_custkey) x ON x.c_custkey = c.c_custkey")
def put_update(spark, sf_dir):
    return write.update(rows(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), _changes(spark, sf_dir), "c_custkey", ["ts", "event_id"])


@query("SELECT p_partkey, p_code FROM (SELECT *, p_type || CASE p_size % 7 WHEN 0 THEN '_x' WHEN 1 THEN '::y' WHEN 2 THEN '#z' ELSE '' END AS p_code FROM part) WHERE regexp_matches(p_brand, '_|::|\\||##') OR regexp_matches(p_code, '_|::|\\||##')")
def put_validate(spark, sf_dir):
    ends = F.when(F.col("p_size") % 7 == 0, "_x").when(F.col("p_size") % 7 == 1, "::y").when(F.col("p_size") % 7 == 2, "#z").otherwise("")
    return write.invalid_rows(rows(spark, sf_dir, "part").withColumn("p_code", F.concat("p_type", ends)), ["p_brand", "p_code"]).select("p_partkey", "p_code")


@query(f"SELECT c_custkey, event_id FROM ({_CHANGES}) WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def put_missing_row(spark, sf_dir):
    base = rows(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return write.unknown_keys(base, _changes(spark, sf_dir), "c_custkey").select("c_custkey", "event_id")


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def delete_row(spark, sf_dir):
    return write.delete(rows(spark, sf_dir, "customer"), rows(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderdate, o_orderstatus, o_orderkey FROM orders")
def index_build(spark, sf_dir):
    path = scratch_folder(spark, "index")
    index.write_index(rows(spark, sf_dir, "orders"), IndexDef("by_status_date", ("o_orderstatus",), (("o_orderdate", "desc"),)), "o_orderkey", path)
    return spark.read.parquet(path)


@query("SELECT count(*) AS rows_dropped, true AS files_deleted FROM orders")
def index_drop(spark, sf_dir):
    """A stored index is dropped: its files go with the next change."""
    store = empty_store(spark, sf_dir)
    store.create_index("shop", "orders", IndexDef("by_priority", ("o_orderpriority",)))
    path = store.paths["shop/orders/by_priority"]
    n = store.drop_index("shop", "orders", "by_priority")
    store.drop_table("log")
    return spark.createDataFrame([(n, not store.files.exists(path))], "rows_dropped long, files_deleted boolean")


_ENTRIES = "SELECT 'o_orderstatus' AS column_name, o_orderstatus AS idx_value, 'orders' AS family_name, cast(o_orderkey AS VARCHAR) AS row_id FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, 'orders', cast(o_orderkey AS VARCHAR) FROM orders"


def _entries(spark, sf_dir) -> DataFrame:
    return index.entries(rows(spark, sf_dir, "orders"), shop(spark, sf_dir).table("shop").family("orders"))


@query(_ENTRIES)
def index_build_ext(spark, sf_dir):
    return _entries(spark, sf_dir)


@query(f"SELECT * FROM ({_ENTRIES}) WHERE column_name != 'o_orderstatus'")
def index_drop_ext(spark, sf_dir):
    return index.drop_entries(_entries(spark, sf_dir), "orders", "o_orderstatus")


@query(f"SELECT * FROM ({_ENTRIES}) WHERE idx_value != 'F' OR row_id IN (SELECT cast(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice > 3000)")
def index_repair(spark, sf_dir):
    damaged = _entries(spark, sf_dir).where("idx_value != 'F'")
    return index.repair(damaged, rows(spark, sf_dir, "orders"), shop(spark, sf_dir).table("shop").family("orders"), Where(all_of=[Pred("o_totalprice", ">", 3000.0)]))


@query("SELECT * FROM (VALUES ('key only', NULL), ('status by date', 'by_status_date'), ('priority and key', 'by_priority')) t(request, layout)")
def index_select(spark, sf_dir):
    catalog = shop(spark, sf_dir)
    known, key = catalog.indexes_of("shop", "orders"), catalog.table("shop").family("orders").key_columns
    asked = {
        "key only": (Where(all_of=[Pred("o_orderkey", "=", 1)]), ()),
        "status by date": (Where(all_of=[Pred("o_orderstatus", "=", "F")]), (("o_orderdate", "desc"),)),
        "priority and key": (Where(all_of=[Pred("o_orderpriority", "=", "5-LOW"), Pred("o_orderkey", "<", 9)]), ()),
    }
    return spark.createDataFrame([(k, index.choose_layout(key, known, w, o)) for k, (w, o) in asked.items()], "request string, layout string")


@query("SELECT * FROM (VALUES ('orders', true), ('customer', false)) t(family, refused)")
def index_lock(spark, sf_dir):
    """A write to a locked family is refused, also by another user of the store."""
    store = empty_store(spark, sf_dir)
    store.lock("shop", "orders")
    other, found = Store(spark, store.folder), []
    for family in ("orders", "customer"):
        try:
            other.delete("shop", family, other.rows("shop", family).limit(0))
            found.append((family, False))
        except LockedError:
            found.append((family, True))
    return spark.createDataFrame(found, "family string, refused boolean")


_PARTS = {"op": "ADDTB", "spec": TableSpec("parts", "part", {"part": FamilySpec("part", "part", "p_partkey")})}


@query("SELECT * FROM (VALUES ('shop', 'customer', 3), ('log', 'events', 1), ('parts', 'part', 1)) t(table_name, main_family, families)")
def ddl_create(spark, sf_dir):
    """Creating a table twice changes nothing; another user of the store sees it."""
    store = empty_store(spark, sf_dir)
    for _ in range(2):
        store.create_table(_PARTS["spec"], {"part": f"{sf_dir}/part.parquet"})
    return Store(spark, store.folder).catalog.list_tables(spark)


@query("SELECT * FROM (VALUES ('log', 'events', 1)) t(table_name, main_family, families)")
def ddl_drop(spark, sf_dir):
    store = empty_store(spark, sf_dir)
    store.drop_table("shop")
    return Store(spark, store.folder).catalog.list_tables(spark)


@query("SELECT * FROM (VALUES ('part'), ('supplier')) t(family)")
def ddl_alter_family(spark, sf_dir):
    store = empty_store(spark, sf_dir)
    store.create_table(_PARTS["spec"], {"part": f"{sf_dir}/part.parquet"})
    for name, pk in (("supplier", "s_suppkey"), ("nation", "n_nationkey")):
        store.add_family("parts", FamilySpec(name, name, pk), f"{sf_dir}/{name}.parquet")
    store.drop_family("parts", "nation")
    return Store(spark, store.folder).catalog.describe(spark, "parts").select("family")


@query("SELECT true AS refused, count(*) AS n FROM orders")
def ddl_no_truncate(spark, sf_dir):
    catalog = shop(spark, sf_dir)
    try:
        catalog.truncate_table("shop")
        refused = False
    except CatalogError:
        refused = True
    return catalog.family_rows("shop", "orders").agg(F.count(F.lit(1)).alias("n")).select(F.lit(refused).alias("refused"), "n")


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int'), (1, 'r_name', 'string')) t(position, column_name, column_type)")
def ddl_rest(spark, sf_dir):
    """Descriptions are frames; there is no server."""
    return column_summary(rows(spark, sf_dir, "region"))


@query("SELECT concat('7_t_c_custkey::', lpad(cast(c_custkey AS VARCHAR), 12, '0'), '_c_mktsegment::', c_mktsegment) AS row_key FROM customer")
def key_build(spark, sf_dir):
    return rows(spark, sf_dir, "customer").select(keys.build_key(F.lit("7"), ["c_mktsegment", "c_custkey"], "c_custkey", 12).alias("row_key"))


_HASH = "list_reduce(list_transform(string_split({0}, ''), lambda c: cast(unicode(c) AS BIGINT)), lambda h, x: (h * 31 + x) % 4294967296)"
_SIGNED = "(CASE WHEN {0} >= 2147483648 THEN {0} - 4294967296 ELSE {0} END)"


def _hash_sql(x: str) -> str:
    return _SIGNED.format(_HASH.format(x))


@query(f"SELECT c_name, lower(to_base(abs(h % 36), 36)) || lower(to_base(abs(h), 36)) AS salt FROM (SELECT c_name, {_hash_sql('c_name')} AS h FROM customer)")
def key_salt(spark, sf_dir):
    return rows(spark, sf_dir, "customer").select("c_name", keys.hash_prefix(F.col("c_name")).alias("salt"))


# ---- functions

_RAW = "concat('a_', {0}, '::B|#', {0})"


def _column():
    return F.concat(F.lit("a_"), "p_brand", F.lit("::B|#"), "p_brand")



_SWAP = "replace(replace(replace(replace({0}, '_', '{1}'), '::', ';;'), '|', '{2}'), '#', '$')"
_FUNCTIONS: dict[str, tuple[Callable[[], object], str]] = {
    "fn_format": (lambda: keys.format_name(_column()), f"lower({_SWAP.format(_RAW.format('p_brand'), '-', '!')})"),
    "fn_format_orig": (lambda: keys.format_name_keep_case(_column()), _SWAP.format(_RAW.format("p_brand"), "-", "!")),
    "fn_format_val": (lambda: keys.format_value(_column()), _SWAP.format(_RAW.format("p_brand"), "$-$", "!!")),
    "fn_unformat_val": (lambda: keys.unformat_value(keys.format_value(_column())), f"replace({_RAW.format('p_brand')}, '$', '#')"),
    "fn_zero_pad": (lambda: keys.zero_pad(F.col("p_partkey").cast("string"), 3), "CASE WHEN length(cast(p_partkey AS VARCHAR)) < 3 THEN lpad(cast(p_partkey AS VARCHAR), 3, '0') ELSE cast(p_partkey AS VARCHAR) END"),
    "fn_fixed_num": (lambda: keys.fixed_number(F.col("p_partkey").cast("string"), 3), "right(lpad(cast(p_partkey AS VARCHAR), 20, '0'), 3)"),
    "fn_java_hash_prefix": (lambda: keys.hash_prefix(F.col("p_name")), f"lower(to_base(abs({_hash_sql('p_name')} % 36), 36)) || lower(to_base(abs({_hash_sql('p_name')}), 36))"),
    "fn_es_id": (lambda: keys.index_doc_id(F.lit("x1"), F.lit("part"), F.lit("p_brand"), F.col("p_partkey").cast("string")), "concat('x1_part_p_brand_', p_partkey)"),
    "fn_shard": (lambda: keys.shard(F.col("p_name"), 14), f"abs({_hash_sql('p_name')}) % 14"),
    "fn_idx_name": (lambda: keys.index_name(F.lit("shop"), F.lit("part"), F.col("p_brand"), F.when(F.col("p_size") > 25, "2020")), "concat('idx-shop-part-', p_brand, '-', CASE WHEN p_size > 25 THEN '2020' ELSE '2017' END)"),
    "fn_key_map": (lambda: keys.key_map(F.concat(F.lit("k::"), F.col("p_partkey").cast("string"), F.lit("_b::")))["k"], "cast(p_partkey AS VARCHAR)"),
    "fn_parse_date": (lambda: keys.parse_date(F.concat(F.lit("2017-01-0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(" 12:30:00"))), "cast(concat('2017-01-0', p_partkey % 9 + 1, ' 12:30:00') AS TIMESTAMP)"),
    "fn_sanitized_set": (lambda: F.concat_ws(",", keys.sanitized_set(F.array(F.lit("B_x"), F.lit("b-x"), "p_brand"))), "array_to_string(list_sort(list_distinct(['b-x', lower(replace(p_brand, '#', '$'))])), ',')"),
}
for _name, (_make, _sql) in _FUNCTIONS.items():
    _QUERIES[_name] = lambda spark, sf_dir, m=_make: rows(spark, sf_dir, "part").select("p_partkey", m().alias("result"))
    _SQL[_name] = f"SELECT p_partkey, {_sql} AS result FROM part"


@query("SELECT o_orderkey, 4284145807000 - epoch_ms(o_orderdate) AS result FROM orders")
def fn_date_rev(spark, sf_dir):
    return rows(spark, sf_dir, "orders").select("o_orderkey", keys.date_countdown(F.col("o_orderdate")).alias("result"))


# ---- streaming

_EVENTS = "SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Update' END AS op FROM events"


def _change_stream(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.when(F.col("event_type") == "error", "Delete").otherwise("Update").alias("op"))


@query(f"SELECT * FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND op != 'Delete'")
def stream_index_upsert(spark, sf_dir):
    """The events as files of a stream, folded into an index in four micro-batches."""
    folder = scratch_folder(spark, "stream")
    changes = _change_stream(spark, sf_dir)
    changes.repartition(4, "event_id").write.parquet(f"{folder}/in")
    target = upsert.VersionedIndex(spark, f"{folder}/index", "user_id", ["ts", "event_id"])
    target.start(upsert.read_changes(spark, f"{folder}/in", changes.schema), f"{folder}/progress").awaitTermination()
    return upsert.visible(target.state())


@query(f"SELECT * FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_batching(spark, sf_dir):
    """Three files a batch; the state with its tombstones."""
    folder = scratch_folder(spark, "stream")
    changes = _change_stream(spark, sf_dir)
    changes.repartition(6, "event_id").write.parquet(f"{folder}/in")
    target = upsert.VersionedIndex(spark, f"{folder}/index", "user_id", ["ts", "event_id"])
    target.start(upsert.read_changes(spark, f"{folder}/in", changes.schema, files_per_batch=3), f"{folder}/progress").awaitTermination()
    return target.state()


@query("SELECT * FROM (VALUES ('shop', 'customer', 3), ('parts', 'part', 2)) t(table_name, main_family, families)")
def stream_ddl(spark, sf_dir):
    more = {"op": "ADDCF", "table": "parts", "spec": FamilySpec("supplier", "supplier", "s_suppkey")}
    return upsert.apply_metadata(shop(spark, sf_dir), [_PARTS, more, {"op": "DROPTB", "table": "log"}]).list_tables(spark)


@query("SELECT * FROM (VALUES ('by_segment', 'c_mktsegment', '')) t(index_name, columns, order_by)")
def stream_meta(spark, sf_dir):
    catalog = upsert.apply_metadata(shop(spark, sf_dir), [
        {"op": "ADDIDX", "table": "shop", "family": "customer", "index": IndexDef("by_segment", ("c_mktsegment",))},
        {"op": "ADDIDX", "table": "shop", "family": "customer", "index": IndexDef("by_nation", ("c_nationkey",))},
        {"op": "DROPIDX", "table": "shop", "family": "customer", "name": "by_nation"},
    ])
    return catalog.list_indexes(spark, "shop", "customer")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
