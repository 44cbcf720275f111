from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from ledgerline.plans import regional_revenue
from ledgerline.sources import load
from tests.builders import at, columns_read, duck, final_plan, table

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")
PERIOD = {"first_day": date(1996, 1, 1), "end_day": date(1999, 1, 1)}
REGION = [{"r_regionkey": 0, "r_name": "ASIA"}, {"r_regionkey": 1, "r_name": "EUROPE"}]
NATION = [
    {"n_nationkey": 0, "n_name": "JAPAN", "n_regionkey": 0},
    {"n_nationkey": 1, "n_name": "INDIA", "n_regionkey": 0},
    {"n_nationkey": 2, "n_name": "SPAIN", "n_regionkey": 1},
]


@pytest.fixture(params=[True, False], ids=["sellers first", "orders first"])
def sellers_first(request):
    return request.param


def run(spark, customer, supplier, orders, lineitem, slices=1, sellers_first=True):
    return regional_revenue(
        table(spark, "region", REGION),
        table(spark, "nation", NATION),
        table(spark, "customer", [{"c_custkey": k, "c_nationkey": n} for k, n in customer]),
        table(spark, "supplier", [{"s_suppkey": k, "s_nationkey": n} for k, n in supplier]),
        table(
            spark,
            "orders",
            [{"o_orderkey": k, "o_custkey": c, "o_orderdate": at(d)} for k, c, d in orders],
            slices,
        ),
        table(
            spark,
            "lineitem",
            [
                {
                    "l_orderkey": o,
                    "l_suppkey": s,
                    "l_extendedprice": cents / 100,
                    "l_discount": percent / 100,
                }
                for o, s, cents, percent in lineitem
            ],
            slices,
        ),
        region_name="ASIA",
        **PERIOD,
        sellers_first=sellers_first,
    )


def revenue(df):
    return {r.n_name: r.revenue for r in df.collect()}


def brute_force(customer, supplier, orders, lineitem):
    nation = {n["n_nationkey"]: n for n in NATION}
    total = Counter()
    for order, seller, cents, percent in lineitem:
        for key, buyer, placed in orders:
            if key != order or not "1996-01-01" <= placed < "1999-01-01":
                continue
            home = dict(customer).get(buyer)
            if home is None or home != dict(supplier).get(seller):
                continue
            if nation[home]["n_regionkey"] == 0:
                total[nation[home]["n_name"]] += Decimal(cents * (100 - percent)) / 10_000
    return dict(total)


def test_small_tables(spark, sellers_first):
    got = run(
        spark,
        sellers_first=sellers_first,
        customer=[(1, 0), (2, 1), (3, 2)],
        supplier=[(10, 0), (11, 1), (12, 2)],
        orders=[
            (100, 1, "1996-01-01"),
            (101, 1, "1998-12-31T23:59:59"),
            (102, 1, "1999-01-01"),
            (103, 1, "1995-12-31T23:59:59"),
            (104, 2, "1997-06-01"),
            (105, 3, "1997-06-01"),
            (106, 99, "1997-06-01"),
        ],
        lineitem=[
            (100, 10, 10_000, 10),  # 90.0000
            (100, 10, 10_000, 10),  # the same line twice counts twice
            (100, 11, 50_000, 0),  # seller elsewhere
            (101, 10, 1, 5),  # 0.0095
            (102, 10, 70_000, 0),  # too late
            (103, 10, 70_000, 0),  # too early
            (104, 11, 12_345, 7),  # 114.8085
            (105, 12, 99_999, 0),  # another region
            (106, 10, 99_999, 0),  # unknown customer
            (107, 10, 99_999, 0),  # unknown order
            (100, 98, 99_999, 0),  # unknown supplier
        ],
    )
    assert revenue(got) == {"JAPAN": Decimal("180.0095"), "INDIA": Decimal("114.8085")}


def test_no_matching_rows(spark):
    assert revenue(run(spark, [(1, 2)], [(10, 2)], [(100, 1, "1997-01-01")], [(100, 10, 5, 0)])) == {}


def test_null_keys_match_nothing(spark, sellers_first):
    got = run(
        spark,
        sellers_first=sellers_first,
        customer=[(1, 0), (2, None), (None, 0)],
        supplier=[(10, 0), (11, None), (None, 0)],
        orders=[
            (100, 1, "1997-01-01"),
            (101, 2, "1997-01-01"),
            (102, None, "1997-01-01"),
            (None, 1, "1997-01-01"),
        ],
        lineitem=[
            (100, 10, 100, 0),
            (100, 11, 100, 0),
            (100, None, 100, 0),
            (101, 11, 100, 0),
            (102, 10, 100, 0),
            (None, 10, 100, 0),
        ],
    )
    assert revenue(got) == {"JAPAN": Decimal("1.0000")}


KEYS = st.integers(0, 5)
NATION_KEYS = st.integers(0, 2)


@hypothesis_settings(max_examples=12, deadline=None)
@given(
    customer=st.dictionaries(KEYS, NATION_KEYS, max_size=6),
    supplier=st.dictionaries(KEYS, NATION_KEYS, max_size=6),
    orders=st.dictionaries(
        KEYS,
        st.tuples(KEYS, st.sampled_from(["1995-12-31", "1996-01-01", "1998-12-31", "1999-01-01"])),
        max_size=6,
    ),
    lineitem=st.lists(
        st.tuples(KEYS, KEYS, st.integers(1, 10**7), st.integers(0, 10)), max_size=40
    ),
    slices=st.integers(1, 7),
)
def test_equals_nested_loops_in_any_partitioning(
    spark, customer, supplier, orders, lineitem, slices
):
    given_tables = (
        list(customer.items()),
        list(supplier.items()),
        [(key, buyer, placed) for key, (buyer, placed) in orders.items()],
        lineitem,
    )
    want = brute_force(*given_tables)
    for first in (True, False):
        assert revenue(run(spark, *given_tables, slices, first)) == want


def asia(spark, source, sellers_first):
    tables = {name: load(spark, source, name) for name in TABLES}
    return regional_revenue(**tables, region_name="ASIA", **PERIOD, sellers_first=sellers_first)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_same_rows_without_any_broadcast(spark, settings, sf, sellers_first):
    want = revenue(contract.queries()["regional_revenue"](spark, f"/root/testdata/sf{sf}"))
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    df = asia(spark, f"/root/testdata/sf{sf}", sellers_first)
    plan = final_plan(df)
    assert "Broadcast" not in plan and "Cartesian" not in plan
    assert revenue(df) == want


def test_plan_shuffles_lines_once_and_reads_few_columns(spark, settings):
    # Above the size of region and nation, below that of the other tables.
    settings(
        spark__sql__autoBroadcastJoinThreshold="6000",
        spark__sql__maxMetadataStringLength="10000",
    )
    plan = final_plan(asia(spark, "/root/testdata/sf0.1", sellers_first=False))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    # The shuffle by supplier carries partial sums.
    before, after = plan.split("Exchange hashpartitioning(l_suppkey")
    assert after.split("+- ")[1].lstrip("*(0123456789) ").startswith("HashAggregate(keys=[l_suppkey")
    assert columns_read(plan) == {
        "region": {"r_regionkey", "r_name"},
        "nation": {"n_nationkey", "n_name", "n_regionkey"},
        "customer": {"c_custkey", "c_nationkey"},
        "supplier": {"s_suppkey", "s_nationkey"},
        "orders": {"o_orderkey", "o_custkey", "o_orderdate"},
        "lineitem": {"l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"},
    }


def records_shuffled(df, key):
    """Rows that the shuffles by a key wrote, after running the query."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange" and f"hashpartitioning({key}" in node.simpleString(1000):
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return total


def test_sellers_first_shuffles_the_lines_of_the_region_only(spark, settings):
    # Suppliers fit a broadcast; customers and orders do not.
    settings(spark__sql__autoBroadcastJoinThreshold="100000")
    source = "/root/testdata/sf0.1"
    lines = load(spark, source, "lineitem").count()
    assert records_shuffled(asia(spark, source, False), "l_orderkey") == lines
    assert records_shuffled(asia(spark, source, True), "l_orderkey") < 0.3 * lines
    assert records_shuffled(asia(spark, source, True), "l_suppkey") == 0


def skewed_tables(spark, source):
    """A third of the orders on one customer, and of the lines on one order.

    Half of the lines have one supplier. The hot rows are of one nation in
    the region and inside the period, so all of them count.
    """
    tables = {name: load(spark, source, name) for name in TABLES}
    home = (
        tables["nation"]
        .join(tables["region"].where(F.col("r_name") == "ASIA"), F.expr("n_regionkey = r_regionkey"))
        .agg(F.min("n_nationkey"))
        .first()[0]
    )
    buyer, seller, order = 7, 3, 100_003

    def put(name, column, condition, value):
        value = F.lit(value).cast(tables[name].schema[column].dataType)
        tables[name] = tables[name].withColumn(
            column, F.when(F.expr(condition), value).otherwise(F.col(column))
        )

    put("customer", "c_nationkey", f"c_custkey = {buyer}", home)
    put("supplier", "s_nationkey", f"s_suppkey = {seller}", home)
    put("orders", "o_custkey", f"o_orderkey % 3 = 0 OR o_orderkey = {order}", buyer)
    put("orders", "o_orderdate", f"o_orderkey = {order}", "1997-01-01")
    columns = tables["lineitem"].columns
    tables["lineitem"] = tables["lineitem"].withColumn(
        "slot", F.expr("pmod(xxhash64(l_orderkey, l_partkey, l_extendedprice), 6)")
    )
    put("lineitem", "l_orderkey", "slot < 2", order)
    put("lineitem", "l_suppkey", "slot % 2 = 0", seller)
    tables["lineitem"] = tables["lineitem"].select(*columns)
    return tables


def test_hot_customer_order_and_supplier(spark, settings, tmp_path, sellers_first):
    for name, df in skewed_tables(spark, "/root/testdata/sf0.1").items():
        df.repartition(16).write.parquet(str(tmp_path / f"{name}.parquet"))
    settings(
        # At 6000 the region's suppliers, hot one included, would be broadcast.
        spark__sql__autoBroadcastJoinThreshold="-1" if sellers_first else "6000",
        spark__sql__shuffle__partitions="32",
        spark__sql__files__maxPartitionBytes="512KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32KB",
    )
    df = asia(spark, str(tmp_path), sellers_first)
    # The joins on customer and on order are split, and on supplier where it has a shuffle of its own.
    assert final_plan(df).count("SortMergeJoin(skew=true)") == (3 if sellers_first else 2)
    _, rows = duck(tmp_path, contract.oracle_sql()["regional_revenue"])
    assert sorted(tuple(r) for r in df.collect()) == rows


def test_lines_stored_by_order_are_not_shuffled(spark, settings, tmp_path):
    """Bucketed tables go in as they are: the plan takes DataFrames, not paths."""
    source = "/root/testdata/sf0.01"
    tables = {name: load(spark, source, name) for name in TABLES}
    want = revenue(regional_revenue(**tables, region_name="ASIA", **PERIOD))
    tables["lineitem"].write.bucketBy(8, "l_orderkey").sortBy("l_orderkey").option(
        "path", str(tmp_path / "lines")
    ).saveAsTable("lines_by_order")
    try:
        tables["lineitem"] = spark.table("lines_by_order")
        settings(spark__sql__autoBroadcastJoinThreshold="6000")
        df = regional_revenue(**tables, region_name="ASIA", **PERIOD, sellers_first=False)
        plan = final_plan(df)
        assert "Exchange hashpartitioning(l_orderkey" not in plan
        assert "Exchange hashpartitioning(o_orderkey" in plan
        assert revenue(df) == want
    finally:
        spark.sql("DROP TABLE lines_by_order")
