from decimal import Decimal

from pyspark.sql import functions as F


def test_three_models_fixture(spark):
    # price 10, discount -2, tax 0, cost 6, rate 0.5
    lines = spark.createDataFrame([(Decimal("10.00"), Decimal("-2.00"), Decimal("0.00"), Decimal("6.00"), 0),
                                   (Decimal("10.00"), Decimal("-2.00"), Decimal("0.00"), Decimal("6.00"), 1),
                                   (Decimal("0.00"), Decimal("0.00"), Decimal("0.00"), Decimal("1.00"), 0)],
                                  "price decimal(18,2), discount decimal(18,2), discount_tax decimal(18,2), "
                                  "cost decimal(18,2), is_return int")
    from shelfwise.plans.billing import _cost_share
    gross = (F.col("price") + F.col("discount") + F.col("discount_tax")).cast("decimal(20,2)")
    rate = F.lit(0.5).cast("decimal(10,6)")
    out = lines.select(
        (F.col("cost") + F.col("discount") + F.col("discount_tax")).alias("vf_pay"),
        (F.lit(0) - F.col("discount") - F.col("discount_tax")).alias("vf_adj"),
        F.round(rate * gross, 2).alias("fx_pay"), F.round(F.col("cost") - rate * gross, 2).alias("fx_adj"),
        F.round(_cost_share() * gross, 2).alias("or_pay"), F.round(F.col("cost") - _cost_share() * gross, 2).alias("or_adj"),
        "is_return").collect()
    r = out[0]
    assert (float(r.vf_pay), float(r.vf_adj)) == (4.0, 2.0)
    assert (float(r.fx_pay), float(r.fx_adj)) == (4.0, 2.0)
    assert (float(r.or_pay), float(r.or_adj)) == (4.8, 1.2)
    assert out[2].or_pay is None                       # price 0 -> NULL payable, no error
