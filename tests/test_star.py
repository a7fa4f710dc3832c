import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ratelantern.operators import star
from ratelantern.operators.charges import as_charges
from ratelantern.plans import compare, detail, listings, search
from ratelantern.session import write_stage
from ratelantern.sinks.writers import write_charges, write_star
from ratelantern.sources.charges import read_charges
from ratelantern.sources.lookups import (
    read_code_descriptions,
    read_employer_eins,
    read_hospital_profiles,
    read_issuer_aliases,
    read_plan_attributes,
)
from ratelantern.operators.profiles import metric_history, metric_range

BASE = {
    "hospital_name": "General", "last_updated_on": "07/01/2024", "version": "2.0.0",
    "hospital_location": "Main", "hospital_address": "1 Main St", "affirmation": True,
    "source_file": "file-1",
}
FOUR = [
    {"description": "Visit", "setting": "outpatient", "cpt_code": "99213", "rc_code": "0510", "gross_charge": 100.0,
     "discounted_cash": 80.0, "payer_name": "Aetna", "plan_name": "PPO", "negotiated_dollar": 60.0, "methodology": "fee schedule", "estimated_amount": 50.0},
    {"description": "Visit", "setting": "outpatient", "cpt_code": "99213", "rc_code": "0510", "gross_charge": 100.0,
     "discounted_cash": 80.0, "payer_name": "Cigna", "plan_name": "HMO", "negotiated_dollar": 70.0, "methodology": "case rate", "estimated_amount": 40.0},
    {"description": "Drug", "setting": "inpatient", "ndc_code": "N1", "gross_charge": 10.0, "drug_unit_of_measurement": 0.5,
     "drug_type_of_measurement": "ML", "payer_name": "Blue", "plan_name": None, "additional_generic_notes": "generic", "additional_payer_notes": "payer", "modifiers": "26|TC"},
    {"description": "Room", "setting": "inpatient", "rc_code": "0120", "gross_charge": 5.0},
]
SCHEMA = ", ".join(
    f"{c} {t}"
    for c, t in {
        **{c: "string" for c in ("description", "setting", "cpt_code", "rc_code", "ndc_code", "payer_name", "plan_name",
                                 "methodology", "drug_type_of_measurement", "additional_generic_notes", "additional_payer_notes", "modifiers",
                                 "hospital_name", "last_updated_on", "version", "hospital_location", "hospital_address", "source_file")},
        **{c: "double" for c in ("gross_charge", "discounted_cash", "negotiated_dollar", "estimated_amount", "drug_unit_of_measurement")},
        "affirmation": "boolean", "row_ord": "bigint", "row_chunk": "bigint",
    }.items()
)


def charges(spark, dicts):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    filled = [{**BASE, "row_ord": i, "row_chunk": i // 2, **d} for i, d in enumerate(dicts)]
    return as_charges(spark.createDataFrame([tuple(d.get(c) for c in columns) for d in filled], SCHEMA))


def counts(tables):
    return {r.table_name: r.row_count for r in listings.table_counts(tables).collect()}


def sizes(tables):
    return tables["standard_charge_items"].count(), tables["standard_charges"].count()


def stored(spark, tables, path):
    """Work on a star as queries do: from its files."""
    write_star(tables, path)
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows_ = write_stage(star.with_ids(charges(spark, FOUR)), "four")
    built = star.build_star(rows_, skip_payer_charges=False)
    return stored(spark, built, str(tmp_path_factory.mktemp("star")))


def test_counts(tables):
    assert counts(tables) == {"items": 3, "codes": 4, "item_codes": 4, "charges": 3, "payer_charges": 3, "plans": 3, "payers": 3}
    assert rows(listings.load_summary(tables)) == [(1, 4, 3, 3, 3)]


def test_payer_tables_can_be_skipped(spark):
    tables = star.build_star(charges(spark, FOUR))
    assert counts(tables) == {"items": 3, "codes": 4, "item_codes": 4, "charges": 3, "payer_charges": 0, "plans": 0, "payers": 0}


def test_hospital(tables):
    row = tables["hospitals"].first()
    assert (row.name, row.addresses, row.location_names) == ("General", ["1 Main St"], ["Main"])
    assert (row.last_updated_on, row.license_number) == (datetime.date(2024, 7, 1), None)


def test_listings(tables):
    assert [r[0] for r in listings.item_descriptions(tables).collect()] == ["Drug", "Room", "Visit"]
    assert [tuple(r) for r in listings.charge_values(tables).collect()] == [("Drug", 10.0), ("Room", 5.0), ("Visit", 100.0)]
    assert [tuple(r) for r in listings.payer_details(tables).collect()] == [
        ("Aetna", "PPO", 60.0, "fee schedule"), ("Blue", "", None, ""), ("Cigna", "HMO", 70.0, "case rate"),
    ]
    assert rows(listings.item_drug_info(tables, "Drug")) == [(0.5, "ML")]
    assert rows(listings.item_notes(tables, "Drug")) == [("generic", "payer")]
    assert rows(listings.first_hospital(tables)) == [("General", "2.0.0", "1 Main St")]
    assert rows(listings.hospital_load_summary(tables), "name", "items", "charges") == [("General", 3, 3)]
    assert rows(tables["standard_charges"].where("gross_charge = 10"), "modifier_codes") == [(["26", "TC"],)]


def test_search(tables):
    assert rows(search.search(tables, "99")) == [("99213", "CPT", "Visit", 1)]
    assert rows(search.search(tables, "ISI"), "code") == [("0510",), ("99213",)]
    assert search.search(tables, "v").count() == 0
    assert search.search(tables, "9%3").count() == 0
    assert search.search(tables, "9%3", wildcards=True).count() == 1
    assert rows(search.code_exists(tables, "99213", "CPT")) == [(True,)]
    assert rows(search.code_exists(tables, "99213", "RC")) == [(False,)]
    assert rows(search.service_info(tables, "99213")) == [("99213", "CPT", "Visit")]
    hospital_id = tables["hospitals"].first().hospital_id
    assert rows(search.hospital_code_info(tables, hospital_id, "0120", "RC")) == [("0120", "RC", "Room")]


def test_compare_and_detail(spark, tables):
    row = compare.compare_prices(tables, "99213", "CPT").first()
    assert (row.discounted_cash, row.payer_name, row.median_estimate, row.plan_count) == (80.0, "Aetna", 45.0, 2)
    hospital_id = tables["hospitals"].first().hospital_id
    price_rows = detail.price_rows(tables, hospital_id, "99213", "CPT")
    quantiles = detail.payer_percentiles(price_rows).first()
    assert (quantiles.percentile_10th, quantiles.percentile_50th) == (pytest.approx(61), 65.0)
    assert detail.standard_charge_list(price_rows).count() == 1
    assert [r.payer_name for r in detail.payer_charge_list(price_rows).collect()] == ["Aetna", "Cigna"]
    assert rows(detail.headline_price(price_rows), "headline_price") == [(80.0,)]
    assert rows(detail.hospital_summary(tables, hospital_id), "has_inpatient", "has_outpatient") == [(True, True)]


def test_best_price_is_numeric_and_nulls_come_last(spark, tmp_path):
    def visit(source, **more):
        return {"description": "Visit", "setting": "both", "cpt_code": "1", "source_file": source, "hospital_name": source, **more}

    tables = star.build_star(
        charges(spark, [
            visit("a", discounted_cash=100.0), visit("a", discounted_cash=9.0), visit("a"),
            visit("b", gross_charge=50.0), visit("b", gross_charge=40.0),
            visit("c"),
        ]),
        skip_payer_charges=False,
    )
    tables = stored(spark, tables, str(tmp_path / "star"))
    prices = compare.compare_prices(tables, "1")
    assert [r.hospital_name for r in compare.by_price(prices).collect()] == ["a", "b", "c"]
    assert rows(prices, "hospital_name", "discounted_cash", "gross_charge", "plan_count") == [
        ("a", 9.0, None, 0), ("b", None, 40.0, 0), ("c", None, None, 0),
    ]
    assert rows(compare.price_summary(prices)) == [(9.0, 40.0, 3)]
    assert rows(compare.flag_lowest(prices), "hospital_name", "is_lowest") == [("a", True), ("b", False), ("c", False)]
    assert [r.hospital_name for r in compare.sorted_prices(prices, "gross").collect()][0] == "b"


def test_grouping_modes(spark):
    repeated = [FOUR[0], FOUR[3], FOUR[0], FOUR[0]]
    assert sizes(star.build_star(charges(spark, repeated))) == (2, 2)
    assert sizes(star.build_star(charges(spark, repeated), grouping="adjacent")) == (3, 3)


def test_keys_round_numbers_and_ignore_empty_modifiers(spark):
    near = {**FOUR[2], "drug_unit_of_measurement": 0.50001, "gross_charge": 10.0000001, "modifiers": ""}
    tables = star.build_star(charges(spark, [{**FOUR[2], "modifiers": None}, near]))
    assert sizes(tables) == (1, 1)
    assert rows(tables["standard_charge_items"], "drug_unit") == [(0.5,)]


def test_files_round_trip(spark, tables, tmp_path):
    rows_in = charges(spark, FOUR)
    write_charges(rows_in, str(tmp_path / "c"))
    back = read_charges(spark, str(tmp_path / "c"))
    assert rows(back) == rows(rows_in)
    write_star(tables, str(tmp_path / "star"))
    assert spark.read.parquet(str(tmp_path / "star" / "codes")).count() == 4

    bare = rows_in.drop("source_file", "row_ord", "row_chunk")
    bare.coalesce(1).write.parquet(str(tmp_path / "bare"))
    read = read_charges(spark, str(tmp_path / "bare"))
    assert [r.row_ord for r in read.orderBy("row_ord").collect()] == [0, 1, 2, 3]


def test_corrupt_file_is_skipped_when_tolerated(spark, tmp_path):
    charges(spark, FOUR).coalesce(1).write.parquet(str(tmp_path / "d"))
    (tmp_path / "d" / "zz.parquet").write_bytes(b"PAR1 not really PAR1")
    assert read_charges(spark, str(tmp_path / "d"), tolerate_corrupt_files=True).count() == 4


def test_reload_replaces(spark):
    old = star.build_star(charges(spark, FOUR))
    new = star.build_star(charges(spark, FOUR[:2]))
    merged = star.replace_sources(old["standard_charge_items"], new["standard_charge_items"], "hospital_id")
    assert rows(merged, "description") == [("Visit",)]
    codes = star.upsert_dimension(old["codes"], new["codes"], "code_id")
    assert codes.count() == 4


def test_payer_names_move_to_their_own_table(spark):
    charges_ = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "id int, payer_name string")
    info = spark.createDataFrame([(1, "B"), (2, "C")], "id int, payer_name string")
    dim = star.payers_from(charges_, info)
    assert rows(dim, "name") == [("A",), ("B",), ("C",)]
    assert rows(star.missing_payers(info, star.payers_from(charges_))) == [("C",)]
    moved = star.names_to_ids(charges_, dim)
    assert moved.columns == ["id", "payer_id"] and moved.count() == 3
    assert rows(star.ids_to_names(moved, dim), "id", "payer_name") == rows(charges_)


def test_descriptions(spark, write, tables):
    path = write(
        "d.csv",
        'code_type,code,consumer_description\ncpt, 99213 ,"First, quoted"\nCPT,99213,Second\nRC,,x\nRC,0510,\n',
    )
    descriptions = read_code_descriptions(spark, path)
    assert rows(descriptions) == [("CPT", "99213", "Second")]
    described = search.with_consumer_description(search.service_info(tables, "99213"), descriptions)
    assert rows(described, "description") == [("Second",)]
    plain = search.with_consumer_description(search.service_info(tables, "0510"), descriptions)
    assert rows(plain, "description") == [("Visit",)]
    with pytest.raises(ValueError):
        read_code_descriptions(spark, write("bad.csv", "code,code_type\n1,2\n"))


def test_small_inputs(spark, write):
    aliases = read_issuer_aliases(spark, write("a.json", '{"12345": ["Empire", "BCBS"],\n "5": []}'))
    assert rows(aliases) == [("12345", "BCBS"), ("12345", "Empire")]
    eins = read_employer_eins(spark, write("e.json", '{"Acme": "12-3456789"}'))
    assert rows(eins) == [("Acme", "12-3456789")]
    puf = read_plan_attributes(spark, write("p.csv", "StandardComponentId,PlanMarketingName,StateCode,MetalLevel\n1,Gold,NY,Gold\n"))
    assert rows(puf, "plan_id", "plan_name", "state", "metal_level", "issuer_name") == [("1", "Gold", "NY", "Gold", None)]


def test_profiles(spark, write):
    path = write("p.jsonl", '{"name":"A","beds":{"2023":5,"2024":7},"revenue":{"2024":null}}\n')
    history = metric_history(read_hospital_profiles(spark, path), 2024, "name")
    assert history.count() == 4 * 5
    assert rows(history.where("value is not null"), "metric", "year", "value") == [("beds", 2023, 5), ("beds", 2024, 7)]
    assert ("A", "beds", 5, 7) in rows(metric_range(history, "name"))
