"""Small frames: missing values, text against typed, hierarchies, joins, pages, changes, plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.errors import AggregateError, CatalogError, LockedError, PredicateError, WriteError
from sparkloom.functions import keys
from sparkloom.operators import aggregate as agg
from sparkloom.operators import cascade, index, join, paging, ranges, write
from sparkloom.plans.predicate import Pred, Where
from sparkloom.plans.scan import Scan, project
from sparkloom.queries import queries, rows
from sparkloom.sources.catalog import Catalog, FamilySpec, IndexDef, TableSpec
from sparkloom.streaming import upsert


def plan(df):
    return df._jdf.queryExecution().toString()


def ids(df, column="k"):
    return sorted(r[column] for r in df.select(column).collect())


def test_missing_value_satisfies_no_comparison(spark):
    df = spark.createDataFrame([(1, "x", "1"), (2, "x", None), (3, None, "2")], "k int, a string, b string")
    assert ids(Scan(Where(all_of=[Pred("b", "!=", "1")])).run(df)) == [3]
    assert ids(Scan(Where(all_of=[Pred("a", "=", "x"), Pred("b", "<=", "1")])).run(df)) == [1]


def test_text_against_typed(spark):
    df = spark.createDataFrame([(9,), (10,), (100,)], "k int")
    assert ids(Scan(Where(all_of=[Pred("k", ">", 9)])).run(df)) == [10, 100]
    assert ids(Scan(Where(all_of=[Pred("k", ">", 1)], compare="text")).run(df)) == [9, 10, 100]
    assert ids(Scan(Where(all_of=[Pred("k", ">", "2")], compare="text")).run(df)) == [9]


def test_alternatives_are_exact_and_checked(spark):
    df = spark.createDataFrame([(1, "1"), (2, "12")], "k int, v string")
    assert ids(Scan(Where(any_of=[{"v": "1"}])).run(df)) == [1]
    with pytest.raises(PredicateError):
        Where(any_of=[{"v": "1"}, {"w": "1"}]).to_column()
    with pytest.raises(PredicateError):
        Pred("v", "~", 1).to_column()
    with pytest.raises(PredicateError):
        project(df, [])
    with pytest.raises(PredicateError):
        Scan(columns=["zz"]).run(df)


def test_contradictions_are_empty(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert ids(Scan(Where(all_of=[Pred("k", "<", 5), Pred("k", ">", 7)])).run(df)) == []
    assert ids(Scan(Where(all_of=[Pred("k", "=", 4), Pred("k", "<", 3)])).run(df)) == []
    assert ids(Scan(Where(in_list={"k": []})).run(df)) == []


def test_average_rounds_half_up(spark):
    for values, want in (([10.0, 3.0, 7.0], 6.67), ([0.01, 0.02], 0.02), ([], None), ([None, 2.0], 2.0)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert agg.aggregate(df, "avg", "v", name="r").first()["r"] == want


def test_sums_and_averages_are_exact(spark):
    from decimal import Decimal

    one = lambda values, kind, agg_kind="sum", **more: agg.aggregate(spark.createDataFrame([(v,) for v in values], f"v {kind}"), agg_kind, "v", name="r", **more).first()["r"]
    assert one([0.004] * 1000, "double") == 4.0
    assert one([1e17, 0.25, -1e17], "double") == 0.25 and one([2e16] * 3, "double") == 6e16
    assert one([0.1] * 10, "double") == 1.0 and one([0.004, 0.006], "double", "avg") == 0.01
    big = Decimal("12345678901234567.0000000001")
    assert one([big, big], "decimal(38,10)") == 2 * big and one([Decimal("0.005"), Decimal("0.005")], "decimal(38,10)", "avg") == Decimal("0.01")
    assert one([2**62] * 4, "long") == 2**64 and one([1, 2], "int", "avg") == 1.5
    assert one([1e-9] * 5, "double", scale=3) == 0.0 and one([], "double") is None
    with pytest.raises(Exception, match="OUT_OF_RANGE"):
        one([1e30], "double")


def test_aggregate_errors(spark):
    df = spark.createDataFrame([("1", None), ("abc", "x")], "v string, w string")
    with pytest.raises(AggregateError):
        agg.aggregate(df, "mode", "v")
    with pytest.raises(AggregateError):
        agg.aggregate(df, "sum", "zz")
    with pytest.raises(AggregateError):
        agg.group_aggregate(df, ["zz"], "count")
    with pytest.raises(Exception, match="missing"):
        agg.aggregate(df, "max", "w", strict=True).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        agg.aggregate(df, "max", "v", "double").collect()


def test_group_columns_stay_apart(spark):
    df = spark.createDataFrame([("a,b", "c"), ("a", "b,c"), ("a", None)], "g1 string, g2 string")
    out = agg.group_aggregate(df, ["g1", "g2"], "count", name="n").withColumn("label", agg.group_label(["g1", "g2"]))
    assert sorted(r["label"] for r in out.collect()) == ["a", "a,b,c", "a,b,c"]


def test_noon(spark):
    df = spark.createDataFrame([("2017-01-01 12:30:00",), ("2017-01-01 13:00:00",)], "s string")
    got = [r[0] for r in df.select(keys.parse_date(F.col("s"))).collect()]
    assert got == [dt.datetime(2017, 1, 1, 12, 30), dt.datetime(2017, 1, 1, 13)]


def _trips(spark, with_dock):
    """Ferries that must have both a crew (which has a captain) and a dock, beside free lists of days and fares."""
    f = lambda data, names: spark.createDataFrame(data, ", ".join(f"{n} string" for n in names.split()))
    ferries = f([("alba", "north", "p1"), ("brio", "south", "p2"), ("brio", "south", "p3"), ("cora", "east", "p4")], "ferry route pier")
    crews = f([("brio", "ines"), ("brio", "tove"), ("dora", "lars")], "ship person")
    captains = f([("ines", "gold")], "name badge")
    docks = f([("p1", "deep"), *([("p3", "wide")] if with_dock else [])], "place depth")
    crew = join.JoinNode(crews, "crew", ["person"]).join("person", "name", join.JoinNode(captains, "cap", ["badge"]))
    root = join.JoinNode(ferries, "f", ["route"]).join("ferry", "ship", crew).join("pier", "place", join.JoinNode(docks, "dock", ["depth"]))
    return join.join_tree(root)


def test_join_tree_needs_every_branch(spark):
    assert _trips(spark, False).count() == 0  # the one ferry with a captain has no dock, the one with a dock no crew
    assert [(r["f_ferry"], r["crew_person"], r["cap_badge"], r["dock_depth"]) for r in _trips(spark, True).collect()] == [("brio", "ines", "gold", "wide")]


def test_join_missing_key_and_aliases(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, x int")
    right = spark.createDataFrame([(5, "v")], "x int, v string")
    node = lambda: join.JoinNode(left, "l", ["k"]).join("x", "x", join.JoinNode(right, "r", ["v"]))
    assert ids(join.join_tree(node()), "l_k") == [1]
    assert ids(join.join_tree(node(), missing_key="keep"), "l_k") == [1, 2]
    with pytest.raises(PredicateError):
        join.join_tree(join.JoinNode(left, "l").join("x", "x", join.JoinNode(right, "l")))


def test_whole_product_of_branches(spark, tmp_path):
    tables = {"nation": ([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "n_nationkey int, n_name string, n_regionkey int"), "supplier": ([(1, 1), (2, 1), (3, 2), (4, 9)], "s_suppkey long, s_nationkey int")}
    tables["customer"] = ([(k, k % 4) for k in range(150, 450)], "c_custkey long, c_nationkey int")
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    of = lambda n: [k for k in range(150, 450) if k % 4 == n]
    want = {(n, s, len(of(n)), sum(of(n))) for s, n in ((1, 1), (2, 1), (3, 2))}
    assert {tuple(r) for r in queries()["join_product"](spark, str(tmp_path)).collect()} == want


@pytest.fixture(scope="module")
def family(spark):
    frames = {
        "root": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string"),
        "line": spark.createDataFrame([(10, 2, "x"), (11, 3, "y"), (12, 3, "z")], "line_id int, root_id int, w string"),
        "note": spark.createDataFrame([(7, 3), (8, 3)], "note_id int, root_id int"),
        "leaf": spark.createDataFrame([(100, 12)], "leaf_id int, line_id int"),
    }
    c = Catalog(frames.__getitem__)
    c.create_table(TableSpec("t", "root", {
        "root": FamilySpec("root", "root", "id"), "line": FamilySpec("line", "line", "line_id", parent="root", parent_key="root_id"),
        "note": FamilySpec("note", "note", "note_id", parent="root", parent_key="root_id"), "leaf": FamilySpec("leaf", "leaf", "leaf_id", parent="line", parent_key="line_id"),
    }))
    return c


def test_nested_read_has_no_fan_out(family):
    request = cascade.Cascade("root", children=[cascade.Cascade("line", children=[cascade.Cascade("leaf")]), cascade.Cascade("note")])
    got = {r["id"]: r.asDict(recursive=True) for r in cascade.read_nested(family, "t", request).collect()}
    assert got[1]["line"] == [] and got[1]["note"] == []
    assert [x["line_id"] for x in got[3]["line"]] == [11, 12] and [x["note_id"] for x in got[3]["note"]] == [7, 8]
    assert got[3]["line"][1]["leaf"] == [{"leaf_id": 100}] and got[3]["line"][0]["leaf"] == []


def test_whole_multi_family_read(spark, tmp_path):
    orders = [(k, 1, "O") for k in (1, 1999, 2000, 2001, 70000)]
    lines = [(k, n, 10 * n + k % 10) for k, _, _ in orders[:-1] for n in (2, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["o_orderkey"]: r["parts"] for r in queries()["scan_multi_family"](spark, str(tmp_path)).collect()}
    assert got == {k: "" if k == 70000 else f"{10 + k % 10},{20 + k % 10}" for k, _, _ in orders}


def test_cascade_delete(spark, family):
    left = cascade.delete_cascade(family, "t", spark.createDataFrame([(3,)], "id int"))
    assert {k: v.count() for k, v in left.items()} == {"root": 2, "line": 1, "note": 0, "leaf": 0}


def test_text_functions(spark):
    df = spark.createDataFrame([("a_b::c|d#e$",), (None,)], "s string")
    got = df.select(keys.format_name(F.upper("s")), keys.format_value(F.col("s")), keys.unformat_value(keys.format_value(F.col("s")))).collect()
    assert tuple(got[0]) == ("a-b;;c!d$e$", "a$-$b;;c!!d$e$", "a_b::c|d#e#") and tuple(got[1]) == (None, None, None)
    df = spark.createDataFrame([("7",), ("123456",), ("x1",)], "s string")
    assert [tuple(r) for r in df.select(keys.zero_pad(F.col("s"), 5), keys.fixed_number(F.col("s"), 5)).collect()] == [("00007", "00007"), ("123456", "23456"), ("000x1", "000x1")]
    h = spark.createDataFrame([("u1021224",)], "s string").select(keys.string_hash(F.col("s"))).first()[0]
    assert h == -289728895
    assert [r[0] for r in spark.createDataFrame([("\U0001f600",), ("a\U0001f600é",), ("",)], "s string").select(keys.string_hash(F.col("s"))).collect()] == [1772899, ((97 * 31 + 0xD83D) * 31 + 0xDE00) * 31 + 0xE9, 0]
    m = spark.createDataFrame([("p_t_x##k::1_n::_zz",)], "s string").select(keys.key_map(F.col("s"))).first()[0]
    assert m == {"k": "1", "n": "NULL"}


def test_pages(spark):
    df = spark.createDataFrame([(k, k // 2) for k in range(10)], "k int, o int")
    order = [("o", "desc"), ("k", "asc")]
    first = paging.page_with_more(df, order, 4).collect()
    assert [r["k"] for r in first] == [8, 9, 6, 7] and all(r["has_more"] for r in first)
    assert not paging.page_with_more(df, order, 10).first()["has_more"]
    seen, cursor = [], None
    while page := paging.page_after(df, order, cursor, 3).collect():
        seen += [r["k"] for r in page]
        cursor = page[-1].asDict()
    assert seen == [8, 9, 6, 7, 4, 5, 2, 3, 0, 1]
    assert [r["k"] for r in paging.page_by_offset(df, order, 3, 2).collect()] == [7, 4]


def test_ranges(spark):
    df = spark.createDataFrame([("a", k) for k in (1, 2, 2, 50, 160, 300)], "g string, k int")
    got = sorted((r["lo"], r["hi"], r["n_keys"]) for r in ranges.coalesce_ranges(df, ["g"], "k", 100).collect())
    assert got == [(1, 50, 3), (160, 160, 1), (300, 300, 1)]
    keys_ = [3, 9, 10, 11, 19, 20, 21, 45, 46, 59, 60, 61, 100, -5, -1, None]
    df = spark.createDataFrame([(g, k) for g in ("a", None) for k in keys_[: 16 if g else 5]], "g string, k int")
    for block in (1, 7, 10, 1000):  # runs over the edges of blocks, and over blocks without a start
        got = sorted((r["g"] or "", r["lo"], r["hi"], r["n_keys"]) for r in ranges.coalesce_ranges(df.dropna(subset=["k"]), ["g"], "k", 15, block).collect())
        assert got == [("", 3, 19, 5), ("a", -5, 21, 9), ("a", 45, 61, 5), ("a", 100, 100, 1)]


def test_update_upsert_and_unknown(spark):
    base = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, v string, w string")
    changes = spark.createDataFrame([(1, "new", None, 2), (1, "old", "r", 1), (9, "x", "y", 3)], "k int, v string, w string, t int")
    got = {r["k"]: (r["v"], r["w"]) for r in write.update(base, changes, "k", ["t"]).collect()}
    assert got == {1: ("new", "p"), 2: ("b", "q")}
    assert ids(write.unknown_keys(base, changes, "k")) == [9]
    assert ids(write.upsert(base, changes, "k", ["t"])) == [1, 2, 9]
    assert ids(write.delete(base, spark.createDataFrame([(1,)], "k int"), "k")) == [2]
    assert ids(write.invalid_rows(spark.createDataFrame([(1, "a_b"), (2, "ok"), (3, None), (4, "x|y")], "k int, v string"), ["v"])) == [1, 4]
    with pytest.raises(WriteError):
        write.check_names(["ok", "0ai"])


def test_change_stream_with_late_changes(spark, tmp_path):
    batches = [[(1, 1, "Update"), (2, 1, "Update")], [(1, 5, "Delete"), (3, 1, "Update")], [(1, 3, "Update"), (2, 9, "Update")], [(3, 7, "Delete"), (3, 8, "Update")]]
    for n, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, "id int, ts int, op string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    target = upsert.VersionedIndex(spark, f"{tmp_path}/index", "id", ["ts"])
    changes = upsert.read_changes(spark, f"{tmp_path}/in", "id int, ts int, op string")
    target.start(changes, f"{tmp_path}/progress").awaitTermination()
    assert {(r["id"], r["ts"]) for r in upsert.visible(target.state()).collect()} == {(2, 9), (3, 8)}
    target.start(changes, f"{tmp_path}/progress").awaitTermination()  # nothing new
    assert upsert.visible(target.state()).count() == 2


def test_stream_state_rewrites_only_touched_buckets(spark, tmp_path):
    target = upsert.VersionedIndex(spark, f"{tmp_path}/index", "id", ["ts"], buckets=8)
    frame = lambda rows_: spark.createDataFrame(rows_, "id int, ts int, op string")
    assert target.state() is None
    target.write_batch(frame([(k, 1, "Update") for k in range(100)]), 0)
    before = target.manifest(0)
    assert len(before) == 8
    target.write_batch(frame([(5, 2, "Delete")]), 1)
    target.write_batch(frame([(5, 2, "Delete")]), 1)  # a batch that is run again
    after = target.manifest(1)
    assert sum(before[b] != after[b] for b in before) == 1
    assert {(r["id"], r["ts"]) for r in target.state().collect()} == {(k, 2 if k == 5 else 1) for k in range(100)}
    assert target.state(before=1).where("id = 5").first()["ts"] == 1
    target.write_batch(frame([(k, 3, "Update") for k in range(100, 200)]), 2)
    target.write_batch(frame([]), 3)
    assert target.state().count() == 200 and target.state().columns == ["id", "ts", "op"]
    for k in range(4, 8):
        target.write_batch(frame([(k, 9, "Update")]), k)
    used = {v for m in (6, 7) for v in target.manifest(m).values()}
    assert set(target.files.names(f"{tmp_path}/index/data")) == {f"v={v:012d}" for v in used}  # no more than the last two versions need


def test_catalog_rules(spark, family):
    with pytest.raises(CatalogError):
        family.truncate_table("t")
    with pytest.raises(CatalogError):
        family.drop_family("t", "root")
    with pytest.raises(CatalogError):
        family.table("zz")
    family.lock("t", "line")
    with pytest.raises(LockedError):
        family.lock("t", "line")
    family.unlock("t", "line")
    family.check_unlocked("t", "line")


def test_build_and_repair_index(spark, family, tmp_path):
    n = index.build_index(family, "t", "line", IndexDef("by_w", ("w",), (("root_id", "desc"),)), f"{tmp_path}/by_w").first()[0]
    assert n == 3 and [i.name for i in family.indexes_of("t", "line")] == ["by_w"]
    spec, lines = family.table("t").family("line"), family.family_rows("t", "line")
    full = index.entries(lines, spec, ["w"])
    assert index.repair(full.where("idx_value = 'x'"), lines, spec, columns=["w"]).count() == 3
    assert index.repair(full.where("idx_value = 'x'"), lines, spec, Where(all_of=[Pred("w", "=", "y")]), ["w"]).count() == 2


def test_store(spark, tmp_path):
    from sparkloom.sources.store import Store

    orders = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "id int, state string, price int")
    lines = spark.createDataFrame([(10, 1, "x"), (11, 1, "y"), (12, 3, "z")], "line int, order_id int, item string")
    spec = TableSpec("t", "order", {"order": FamilySpec("order", "", "id", ("id",)), "line": FamilySpec("line", "", "line", parent="order", parent_key="order_id")})
    store = Store(spark, f"{tmp_path}/store")
    store.create_table(spec, {"order": orders, "line": lines})
    assert store.create_index("t", "order", IndexDef("by_state", ("state",))).first()[0] == 2
    urgent = Scan(Where(all_of=[Pred("state", "=", "b"), Pred("id", "<", 50)]))
    other = Store(spark, f"{tmp_path}/store")  # another user of the same folder
    for s in (store, other):
        assert s.layout("t", "order", urgent) == "by_state" and [tuple(r) for r in s.scan("t", "order", urgent).collect()] == [(2, "b", 6)]
    p, used = plan(store.scan("t", "order", urgent)), lambda df: {part for f in df.inputFiles() for part in f.split("/")}
    assert "by_state" in used(store.scan("t", "order", urgent)) and "EqualTo(state,b), LessThan(id,50)], ReadSchema: struct<state:string,id:int>" in p
    assert "rows" not in used(store.scan("t", "order", Scan(Where(all_of=[Pred("state", "=", "b")]), ["id", "state"])))
    assert store.layout("t", "order", Scan(Where(all_of=[Pred("price", "=", 5)]))) is None
    # writes keep the index current, and a write based on an old description is refused
    changes = spark.createDataFrame([(2, "c", 8, 1), (4, "b", 9, 1)], "id int, state string, price int, at int")
    store.upsert("t", "order", changes, ["at"])
    assert sorted(r["id"] for r in store.scan("t", "order", urgent).collect()) == [4]
    with pytest.raises(CatalogError):
        other.delete("t", "order", changes.select("id"))
    other.refresh()
    other.put_nested("t", spark.createDataFrame([(9, "b", 1, [(90, "n"), (91, "m")])], "id int, state string, price int, line array<struct<line:int,item:string>>"))
    assert sorted(r["id"] for r in other.scan("t", "order", urgent).collect()) == [4, 9] and other.rows("t", "line").count() == 5
    other.delete_cascade("t", spark.createDataFrame([(1,), (9,)], "id int"))
    assert [r["line"] for r in other.rows("t", "line").collect()] == [12]
    # a lock binds all users until it is taken off
    other.lock("t", "order")
    store.refresh()
    for act in (lambda: store.insert("t", "order", orders), lambda: store.drop_index("t", "order", "by_state"), lambda: store.create_index("t", "order", IndexDef("z", ("price",))), lambda: store.drop_table("t"), lambda: store.delete_cascade("t", orders)):
        with pytest.raises(LockedError):
            act()
    other.unlock("t", "order")
    store.refresh()
    path = store.paths["t/order/by_state"]
    assert store.drop_index("t", "order", "by_state") == 2 and store.layout("t", "order", urgent) is None
    store.drop_table("t")
    assert not store.files.exists(path) and Store(spark, f"{tmp_path}/store").catalog.tables == {}


def test_stored_index_in_plans(spark, sf_dir):
    found = queries()["scan_index_multi"](spark, sf_dir)
    p = plan(found).split("== Physical Plan ==")[1]
    assert any("by_priority_price" in f for f in found.inputFiles()) and "EqualTo(o_orderpriority,1-URGENT)" in p and "Expand" not in p
    assert not any("orders.parquet" in f for f in queries()["scan_index_inregion"](spark, sf_dir).inputFiles())


def test_layout_choice():
    known = [IndexDef("b", ("x", "y")), IndexDef("a", ("x", "y")), IndexDef("o", ("x",), (("d", "desc"), ("e", "asc")))]
    choose = lambda where, order=(): index.choose_layout(["k"], known, where, order)
    assert choose(Where(all_of=[Pred("k", "=", 1)])) is None
    assert choose(Where(all_of=[Pred("x", "=", 1)])) == "a"
    assert choose(Where(all_of=[Pred("x", "=", 1)]), [("e", "asc")]) == "o"
    assert choose(Where(all_of=[Pred("k", "=", 1), Pred("y", "=", 1)])) == "a"
    with pytest.raises(CatalogError):
        choose(Where(any_of=[{"k": 1, "y": 2}]))
    with pytest.raises(CatalogError):
        choose(Where(all_of=[Pred("zz", "=", 1)]))


def test_plans(spark, sf_dir):
    p = plan(queries()["group_sum"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in p and "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_linestatus:string,l_shipdate" in p
    assert p.count("Exchange hashpartitioning") >= 1 and "partial_sum" in p
    p = plan(queries()["page_offset"](spark, sf_dir))
    assert "TakeOrderedAndProject" in p
    assert "CartesianProduct" not in plan(queries()["join_tree"](spark, sf_dir))
    assert "BatchEvalPython" not in plan(queries()["key_salt"](spark, sf_dir))
    assert rows(spark, sf_dir, "region").count() == 5


def test_bucketed_families_join_without_shuffle(spark, sf_dir):
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows(spark, sf_dir, name).write.mode("overwrite").bucketBy(4, key).sortBy(key).saveAsTable(f"b_{name}")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = Catalog(spark.table)
        c.create_table(TableSpec("s", "o", {"o": FamilySpec("o", "b_orders", "o_orderkey"), "l": FamilySpec("l", "b_lineitem", "l_linenumber", parent="o", parent_key="l_orderkey")}))
        nested = cascade.read_nested(c, "s", cascade.Cascade("o", children=[cascade.Cascade("l")]))
        assert "Exchange" not in plan(nested).split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("orders", "lineitem"):
            spark.sql(f"DROP TABLE b_{name}")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
