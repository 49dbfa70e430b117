"""EAV lookups in one pass (operators.eav)."""

import pytest

from ledgerline.operators import attribute_ids, eav_values
from ledgerline.plans.catalogue import category_base, category_levels

WANTED = {"title": ("name", 3), "on": ("is_active", 3), "gone": ("absent", 3)}


@pytest.fixture()
def attributes(spark):
    return spark.createDataFrame([(1, "name", 3), (2, "name", 4), (3, "is_active", 3), (4, "include_in_menu", 3), (5, None, 3)],
                                 "attribute_id int, attribute_code string, entity_type_id int")


@pytest.fixture()
def values(spark):
    rows = [(10, 1, 0, "a"), (10, 1, 1, "other store"), (10, 2, 0, "other type"), (10, 3, 0, "1"), (11, 3, 0, "0"), (12, 2, 0, "x"), (13, 1, 0, None), (None, 1, 0, "n")]
    return spark.createDataFrame(rows, "row_id int, attribute_id int, store_id int, value string")


def test_all_attributes_from_one_scan(attributes, values):
    got = eav_values(values, attribute_ids(attributes, WANTED), ["title", "on", "gone"])
    assert {r.row_id: tuple(r)[1:] for r in got.collect()} == {10: ("a", "1", None), 11: (None, "0", None), 13: (None, None, None), None: ("n", None, None)}
    assert [tuple(r)[1:] for r in eav_values(values, attribute_ids(attributes, WANTED), ["title"], store=1).collect()] == [("other store",)]


def test_two_attributes_of_one_code_and_type_are_an_error(spark, attributes, values):
    twice = attributes.union(spark.createDataFrame([(9, "name", 3)], attributes.schema))
    with pytest.raises(Exception, match="more than one attribute for title"):
        eav_values(values, attribute_ids(twice, WANTED), ["title"]).collect()
    assert eav_values(values, attribute_ids(twice, {"on": ("is_active", 3)}), ["on"]).count() == 2


def test_category_flags_and_levels(spark, attributes):
    categories = spark.createDataFrame([(1, 10, "1", 0), (2, 11, "1/2", 1), (3, 12, "1/2/3", 2), (4, 13, "1/2/3/4", 3), (5, 14, "1/2/x", 2)],
                                       "entity_id int, row_id int, path string, level int")
    names = spark.createDataFrame([(12, 1, 0, "shoes"), (13, 1, 0, "boots")], "row_id int, attribute_id int, store_id int, value string")
    flags = spark.createDataFrame([(12, 3, 0, 0), (13, 4, 0, 0)], "row_id int, attribute_id int, store_id int, value int")
    base = {r.entity_id: (r.name, r.is_active, r.include_in_menu) for r in category_base(categories, names, flags, attributes).collect()}
    assert base == {1: (None, 1, 1), 2: (None, 1, 1), 3: ("shoes", 0, 1), 4: ("boots", 1, 0), 5: (None, 1, 1)}
    ids = attribute_ids(attributes, {"category_name": ("name", 3)})
    got = {r.category_id: tuple(r)[1:] for r in category_levels(categories, eav_values(names, ids, ["category_name"])).collect()}
    none = (None,) * 5
    assert got == {1: none, 2: none, 3: none, 4: (None, "shoes", None, None, None), 5: none}       # piece 2 of 1/2/3/4 is the unnamed category 2
