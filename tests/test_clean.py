import pytest

from conftest import rows
from tallymart.schema import RAW_COLUMNS
from tallymart.sources.raw_csv import standard_name
from tallymart.operators import clean


def test_strip_removes_spaces_tabs_and_no_break_spaces(raw_of):
    raw = raw_of({"customer_name": " \tAnn Lee\xa0 "}, {"customer_name": "In side"})
    assert rows(clean.strip_strings(raw), "customer_name") == [("Ann Lee",), ("In side",)]


def test_duplicates_ignore_row_id_and_keep_the_lowest(raw_of):
    got = clean.drop_duplicates(raw_of({"row_id": "10"}, {"row_id": "9"}, {"sales": "5"}))
    assert sorted(rows(got, "row_id", "extra_copies")) == [(3, 0), (9, 1)]


def test_duplicates_with_nulls_are_equal(raw_of):
    got = clean.drop_duplicates(raw_of({"postal_code": None}, {"postal_code": None}))
    assert got.count() == 1


@pytest.mark.parametrize("text,expected", [
    ("1/5/2020", "2020-01-05"), ("01/05/2020", "2020-01-05"), ("13/45/2020", None),
    ("2020-01-05", None), (None, None)])
def test_dates(raw_of, text, expected):
    [(got,)] = rows(clean.cast_types(raw_of({"order_date": text})), "order_date")
    assert (str(got) if got else None) == expected


@pytest.mark.parametrize("text,expected", [
    ("2", 2), ("2.0", 2), ("2.5", None), ("two", None), ("1e99", None), ("-3", -3)])
def test_quantity_must_be_whole(raw_of, text, expected):
    assert rows(clean.cast_types(raw_of({"quantity": text})), "quantity") == [(expected,)]


@pytest.mark.parametrize("column", clean.CRITICAL)
def test_missing_critical_field_drops_the_row(raw_of, column):
    assert clean.clean(raw_of({column: None}, {})).count() == 1


def test_missing_postal_code_is_filled(raw_of):
    assert rows(clean.clean(raw_of({"postal_code": None})), "postal_code") == [("UNKNOWN",)]


@pytest.mark.parametrize("change", [
    {"ship_date": "12/31/2022"}, {"discount": "1.5"}, {"discount": "-0.1"}, {"discount": None},
    {"quantity": "0"}, {"quantity": "-1"}, {"sales": "much"}])
def test_rules_drop_rows(raw_of, change):
    assert clean.clean(raw_of(change, {"row_id": "7"})).count() == 1


def test_limits_are_kept(raw_of):
    got = clean.clean(raw_of({"discount": "0"}, {"discount": "1"}, {"ship_date": "01/01/2023"}))
    assert got.count() == 3


def test_report_counts_each_row_under_its_first_rule(raw_of):
    raw = raw_of({}, {}, {}, {"sales": None}, {"ship_date": "12/31/2022", "quantity": "0"},
                 {"discount": "2"}, {"quantity": "0"})
    assert dict(rows(clean.drop_report(clean.tag_rows(raw)))) == {
        "duplicate row": 2, "missing critical field": 1, "ship_date < order_date": 1,
        "discount outside [0, 1]": 1, "quantity not positive": 1}


def test_numbers_too_large_for_their_type_are_out_of_range_not_missing(raw_of):
    raw = raw_of({"sales": "100000000.00"}, {"profit": "1e9"}, {"quantity": "3000000000"},
                 {"sales": "99999999.99"})
    assert dict(rows(clean.drop_report(clean.tag_rows(raw)))) == {"out of range": 3}


def test_discount_is_judged_before_it_is_rounded(raw_of):
    got = dict(rows(clean.drop_report(clean.tag_rows(raw_of({"discount": "1.00004"})))))
    assert got == {"discount outside [0, 1]": 1}


@pytest.mark.parametrize("text,expected", [("7", 7), ("7.0", 7), ("7.5", None), ("x", None), ("", None)])
def test_row_ids(raw_of, text, expected):
    assert rows(clean.clean(raw_of({"row_id": text})), "row_id") == [(expected,)]


@pytest.mark.parametrize("text", ["12d", "2f", "0x1p2", "1_000", "1,000", "nan", "1e", "."])
def test_only_plain_decimal_notation_is_a_number(raw_of, text):
    for column in ("sales", "quantity"):
        got = dict(rows(clean.drop_report(clean.tag_rows(raw_of({column: text})))))
        assert got == {"missing critical field": 1}
    assert dict(rows(clean.drop_report(clean.tag_rows(raw_of({"discount": text}))))) == {
        "discount outside [0, 1]": 1}
    assert rows(clean.clean(raw_of({"profit": text, "row_id": text})), "profit", "row_id") == [(None, None)]


@pytest.mark.parametrize("text,value", [("1e2", 100), ("+.5e1", 5), ("7.", 7), ("0007", 7)])
def test_plain_notations(raw_of, text, value):
    [(sales, quantity)] = rows(clean.clean(raw_of({"sales": text, "quantity": text})), "sales", "quantity")
    assert (float(sales), quantity) == (value, value)


def test_malformed_rows_are_counted_whole(raw_of):
    from pyspark.sql import functions as F
    raw = raw_of({}, {}, {"sales": None}, {"quantity": "0"}).withColumn(
        "malformed_record", F.when(F.col("row_id") <= 2, "a,b"))
    tagged = clean.tag_rows(raw)
    assert dict(rows(clean.drop_report(tagged))) == {
        "malformed row": 2, "missing critical field": 1, "quantity not positive": 1}
    assert "malformed_record" not in clean.good_rows(tagged).columns


def test_a_filter_on_the_rule_reads_no_text_again(spark):
    raw = spark.createDataFrame([tuple("1" for _ in RAW_COLUMNS)], [standard_name(c) for c in RAW_COLUMNS])
    plan = clean.good_rows(clean.tag_rows(raw))._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert conditions and not any("RLIKE" in line or "gettimestamp" in line for line in conditions)


def test_trimming_goes_by_the_characters_at_both_ends(spark):
    texts = ["ab", " a", "a ", " a ", "é", "\x7f", "\x1fa b\t", "", None, " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in clean.strip_strings(df).collect()]
    assert got == ["ab", "a", "a", "a", "é", "\x7f", "a b", "", None, ""]
