"""Baskets of ordinary prices."""

from datetime import date

from shelfcast.operators import basket
from shelfcast.params import DEFAULT

COLUMNS = "invoice_id string, sku string, unit_price double, cat_l3 string, sale_date date, txn_channel string, " \
          "is_return boolean, is_zero_price boolean, is_opening_promo boolean"


def test_discounted_lines_are_left_out_by_one_join(spark):
    from shelfcast.params import RETAIL
    line = lambda invoice, sku, price, day=date(2024, 3, 4): (invoice, sku, price, f"c-{sku}", day, RETAIL, False, False, False)
    lines = [line("A", "tea", 37.0), line("A", "mug", 9.0), line("B", "tea", 20.0), line("B", "mug", 9.0), line("B", "cup", 4.0),
             line("C", "tea", None), line("C", "mug", 5.0), line("C", "cup", 4.0), line("D", None, 1.0), line("D", "tea", 36.0),
             line("E", "tea", 20.0, date(2024, 4, 4)), line("E", "mug", 5.0, date(2024, 4, 4))]
    prices = spark.createDataFrame(
        [("tea", date(2024, 3, 1), 37.0), ("mug", date(2024, 3, 1), 9.0)], "sku string, month date, usual_price double")
    sets = basket.baskets(spark.createDataFrame(lines, COLUMNS), prices, DEFAULT.scaled(basket_level="cat_l3"))
    # B loses its tea and C its mug; D keeps a line of no article, E a month without a usual price.
    got = sorted(sorted(str(i) for i in r["items"]) for r in sets.collect())
    assert got == [["c-None", "c-tea"], ["c-cup", "c-mug"], ["c-cup", "c-tea"], ["c-mug", "c-tea"], ["c-mug", "c-tea"]]
    assert "LeftAnti" not in sets._jdf.queryExecution().toString()
