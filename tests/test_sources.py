"""Reading, writing, exporting and the SQL surface."""

from decimal import Decimal as D

from fixture import AS_OF, rows
from pyspark.sql import functions as F

from depotwise.operators import purchasing, tables
from depotwise.plans import sqlviews
from depotwise.schema import TABLES
from depotwise.session import work_path
from depotwise.sources import domain


def text_of(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_written_tables_load_with_their_contract(spark, seed):
    root = work_path(spark, "tables")
    for name in TABLES:
        domain.append(seed[name], root, name)
    domain.append(seed["click"].limit(1).withColumn("click_id", F.lit(99)), root, "click")
    loaded = domain.load(spark, root)
    assert loaded["click"].count() == 15
    assert rows(loaded["product"]) == rows(seed["product"])
    assert [f.dataType for f in loaded["order"].schema] == [f.dataType for f in TABLES["order"].struct]


def test_a_repeated_snapshot_version_replaces_itself(spark, seed):
    root = work_path(spark, "snapshots")
    for version in (1, 2, 2):
        path = domain.write_snapshot(seed["inventory"], root, "inventory", version)
    assert spark.read.parquet(path).count() == 12
    assert path.endswith("inventory/v=2")


def test_csv_quotes_only_where_needed(spark):
    df = spark.createDataFrame([(1, 'say "hi", twice', None), (2, "plain", "x")], "id int, `a b` string, c string")
    path = work_path(spark, "csv")
    tables.write_csv(df, path, ["Id", "Text", "Note"], single_file=True)
    assert text_of(spark, path) == sorted(["Id,Text,Note", '1,"say ""hi"", twice",', "2,plain,x"])
    path = work_path(spark, "csv")
    tables.write_csv(df, path, quote_all=True, single_file=True)
    assert text_of(spark, path) == sorted(['"id","a b","c"', '"1","say ""hi"", twice",""', '"2","plain","x"'])


def test_purchase_export(spark, seed):
    path = work_path(spark, "purchases")
    purchasing.purchase_export(purchasing.purchase_history_search(seed, AS_OF, "product 4", 60), path)
    assert '"Apr' not in "".join(text_of(spark, path))
    assert text_of(spark, path)[0] == '"Jun 12, 2026",Supplier 2,Hub Two,Product 4,12,1000.00,12000.00'


def test_sql_surface(spark, seed):
    sqlviews.register(spark, seed, AS_OF)
    assert rows(spark.sql("SELECT storage_age_multiplier(75), storage_age_band(75)")) == [(D("2.0"), "Stale")]
    assert spark.sql("SELECT * FROM low_stock_products()").count() == 2
    assert rows(spark.sql("SELECT shipment_id, days_pending FROM pending_shipment_report()"))[0] == (2, 3)
    assert rows(spark.sql("SELECT campaign_revenue(1), campaign_revenue(77)")) == [(D("5697.00"), D("0.00"))]
    assert rows(spark.sql("SELECT pick_source_warehouse(1, 3), pick_source_warehouse(1, 50)")) == [(2, None)]
    preview = spark.sql("SELECT warehouse_id, is_chosen FROM hub_routing_preview(1, 3)")
    assert rows(preview) == [(1, False), (2, True)]
    assert spark.sql("SELECT * FROM warehouse_overview WHERE capacity_status = 'HIGH'").count() == 1
