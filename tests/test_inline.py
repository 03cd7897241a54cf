"""Frames that stand for small outputs: inline results with a notice, proposed tables, advice tagged once."""
import __spark_entry__ as entry
import pytest

from shelfwise.operators.ingest import ddl_frame, ddl_text
from shelfwise.operators.topn import inline_or_notice
from shelfwise.plans.text_reports import run_request_sql
from shelfwise.session import checkpoint_dir
from shelfwise.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_inline_up_to_the_cap_else_notice(spark):
    assert inline_or_notice(spark.range(5), 5).filter("notice IS NULL").count() == 5
    over = inline_or_notice(spark.range(6), 5).collect()
    assert [(r.id, r.notice) for r in over] == [(None, "more than 5 rows")]
    assert inline_or_notice(spark.range(0), 5).count() == 0


def test_proposed_table_text_is_the_frame(spark):
    rows = [(1, "asin", "char", 13, True), (2, "n", "int", None, False), (3, "note", "varchar", 9, False)]
    schema = "position long, column_name string, inferred_type string, length long, is_key boolean"
    for keyed in (rows, [(*r[:4], False) for r in rows]):
        df = spark.createDataFrame(keyed, schema).repartition(3)
        assert ddl_frame(df, "shop.items").first().ddl == ddl_text([r.asDict() for r in df.collect()], "shop.items")


def test_request_may_name_statement_words_in_literals(spark):
    t = Tables(spark, SF)
    assert run_request_sql(t, "please: select 'drop, update' as v, count(*) as n from region; thanks").first().v == "drop, update"
    with pytest.raises(ValueError):
        run_request_sql(t, "no statement here")


def test_shared_folder_is_demanded_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


@pytest.mark.parametrize("name, scans", [("advice_history", 6), ("upstream_uplift", 12), ("not_launched_rank", 15)])
def test_shared_frames_are_built_once(spark, name, scans):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= scans, plan


def test_request_parameters_reach_the_scan(spark, tmp_dir):
    from shelfwise.operators.params import Parameter, restricted
    from shelfwise.plans import requests

    t = Tables(spark, SF)
    entry.queries()
    whole = requests.REPORTS["product_daily_performance"].build(t)
    requested = requests.requested(t, "product_daily_performance", "data of B000000007 and B000000008, B000000007; BABCDEFGHI")
    names = {"B000000007", "B000000008"}
    assert requested.columns == whole.columns
    assert sorted(map(str, requested.collect())) == sorted(str(r) for r in whole.collect() if r["product"] in names)
    scan = requested._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(user_id, [7,8])" in scan or "In(user_id, [7,8])" in scan
    # Nothing named: not run. Only codes that no product can have: no rows.
    assert requests.requested(t, "product_daily_performance", "please send the data") is None
    assert requests.requested(t, "product_daily_performance", "BABCDEFGHI").count() == 0
    assert requests.requested(t, "due_publishers", "no parameters declared").count() >= 0
    # Several fields are OR-ed, and belong to one table.
    two = (Parameter("part.p_partkey", r"#(\d+)", int), Parameter("part.p_brand", r"(Brand#\d+)"))
    both = restricted(t, "#3 and Brand#7", two).part
    assert both.count() == t.part.filter("p_partkey = 3 OR p_brand = 'Brand#7' OR p_partkey = 7").count()
    with pytest.raises(ValueError, match="one table"):
        restricted(t, "x", (Parameter("part.p_brand", "(x)"), Parameter("events.user_id", "(x)")))
    answer = requests.answer(t, "product_daily_performance", "B000000007", tmp_dir, "r1")
    assert spark.read.option("header", True).csv(answer.path).count() == requests.requested(t, "product_daily_performance", "B000000007").count()
    assert requests.answer(t, "product_daily_performance", "hello", tmp_dir, "r2").notice == requests.NO_PARAMETERS
    assert requests.routed("Price of the day") == "price_down_candidates" and requests.routed("xyz") == "help"
