import json

import pytest
from helpers import rows

from ratelantern.operators import rates
from ratelantern.sinks.writers import write_rates
from ratelantern.sources.in_network import (
    items,
    read_in_network,
    read_large_in_network,
    references,
)
from ratelantern.sources.lookups import read_npi_allow_list


def group(npis, value="12-3456789", kind="ein", name="Clinic"):
    return {"npi": npis, "tin": {"type": kind, "value": value, **({"business_name": name} if name else {})}}


def price(rate, **more):
    return {"negotiated_type": "negotiated", "negotiated_rate": rate, "billing_class": "professional",
            "setting": "inpatient", "expiration_date": "9999-12-31", "service_code": ["11"], **more}


def item(code, negotiated, **more):
    return {"negotiation_arrangement": "ffs", "name": code, "billing_code_type": "CPT",
            "billing_code_type_version": "2024", "billing_code": code, "description": code,
            "negotiated_rates": negotiated, **more}


HEADER = {"reporting_entity_name": "Payer", "reporting_entity_type": "issuer",
          "last_updated_on": "2024-07-01", "version": "2.0.0", "plan_name": "Gold"}
REFERENCES = [
    {"provider_group_id": 1, "network_name": ["N1"],
     "provider_groups": [group([1111111111, 2222222222]), group([3333333333], name="")]},
    {"provider_group_id": 5_000_000_000, "network_name": ["N2"], "provider_groups": [group([4444444444])]},
]
CODES = [{"billing_code_type": "CPT", "billing_code": "1", "description": "a < b & c > d"}]
ITEMS = [
    item("A", [{"provider_references": [1, 5_000_000_000], "negotiated_prices": [price(1.5), price(2.5, additional_information="x")]}],
         bundled_codes=CODES),
    item("B", [{"provider_references": [5_000_000_000], "negotiated_prices": [price(3.0)]},
               {"provider_groups": [group([2222222222]), group([])], "provider_references": [1], "negotiated_prices": [price(4.0)]}],
         covered_services=[]),
    item("C", [{"provider_groups": [group([5555555555])], "negotiated_prices": [price(5.0)]}]),
]


def load(spark, path):
    documents = read_in_network(spark, path)
    return items(documents), references(documents)


@pytest.fixture(params=["header first", "header last"])
def parsed(request, spark, write):
    body = {"in_network": ITEMS, "provider_references": REFERENCES}
    document = {**HEADER, **body} if request.param == "header first" else {**body, **HEADER}
    return load(spark, write("rates.json", json.dumps(document)))


def allow(spark, *npis):
    return spark.createDataFrame([(n,) for n in npis], "npi bigint")


def test_rate_rows(parsed):
    got = rates.rates(parsed[0])
    assert rows(got, "billing_code", "negotiated_rate", "group_kind", "provider_group_ids") == [
        ("A", 1.5, "referenced", [1, 5_000_000_000]),
        ("A", 2.5, "referenced", [1, 5_000_000_000]),
        ("B", 3.0, "referenced", [5_000_000_000]),
        ("B", 4.0, "embedded", [1]),
        ("C", 5.0, "embedded", [3]),
    ]
    first = got.where("negotiated_rate = 1.5").first()
    assert json.loads(first.bundled_codes_json) == [{**CODES[0], "billing_code_type_version": ""}]
    assert "\\u003c" in first.bundled_codes_json and "\\u0026" in first.bundled_codes_json
    assert first.covered_services_json is None and first.additional_information is None
    assert (first.plan_name, first.issuer_name, first.reporting_entity_name) == ("Gold", None, "Payer")
    assert got.where("billing_code = 'B' and covered_services_json is not null").count() == 0


def test_provider_rows(parsed):
    got = rates.providers(*parsed)
    assert rows(got, "group_kind", "provider_group_id", "npi", "business_name", "network_names") == [
        ("embedded", 1, 2222222222, "Clinic", None),
        ("embedded", 3, 5555555555, "Clinic", None),
        ("referenced", 1, 1111111111, "Clinic", ["N1"]),
        ("referenced", 1, 2222222222, "Clinic", ["N1"]),
        ("referenced", 1, 3333333333, None, ["N1"]),
        ("referenced", 5_000_000_000, 4444444444, "Clinic", ["N2"]),
    ]


@pytest.mark.parametrize(
    ("npis", "expected"),
    [
        ([9999999999], []),
        ([4444444444], [("A", 1.5, [5_000_000_000]), ("A", 2.5, [5_000_000_000]), ("B", 3.0, [5_000_000_000])]),
        ([1111111111], [("A", 1.5, [1]), ("A", 2.5, [1])]),
        ([2222222222], [("A", 1.5, [1]), ("A", 2.5, [1]), ("B", 4.0, [1])]),
    ],
)
def test_allow_list(spark, parsed, npis, expected):
    got = rates.rates(*parsed, allowed_npis=allow(spark, *npis))
    assert rows(got, "billing_code", "negotiated_rate", "provider_group_ids") == expected
    kept = rates.providers(*parsed, allowed_npis=allow(spark, *npis))
    assert {r.npi for r in kept.collect()} <= set(npis)


def test_join_is_the_same_with_and_without_salting(parsed):
    rate_rows, provider_rows = rates.rates(parsed[0]), rates.providers(*parsed)
    columns = ["billing_code", "negotiated_rate", "npi"]
    plain = rows(rates.rates_with_providers(rate_rows, provider_rows), *columns)
    salted = rows(rates.rates_with_providers(rate_rows, provider_rows, hot_rows=0), *columns)
    assert plain == salted
    assert len(plain) == 2 * 4 + 1 + 1 + 1


def test_stats(parsed):
    assert rows(rates.conversion_stats(*parsed).drop("source_file")) == [(3, 5, 6)]


def test_large_files_give_the_same_rows(spark, write):
    path = write("rates.json", json.dumps({**HEADER, "in_network": ITEMS, "provider_references": REFERENCES}))
    small, large = load(spark, path), read_large_in_network(spark, path)
    for operator in (lambda p: rates.rates(p[0]), lambda p: rates.providers(*p)):
        a, b = operator(small).drop("source_file"), operator(large).drop("source_file")
        assert rows(a) == rows(b)


def test_sinks(spark, parsed, tmp_path):
    write_rates(rates.rates(parsed[0]), rates.providers(*parsed), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x_rates")).count() == 5
    assert spark.read.parquet(str(tmp_path / "x_providers")).count() == 6


def test_allow_list_file(spark, write):
    good = write("npis.json", json.dumps([{"npi": "1", "name": "x"}, {"npi": "2"}, {"npi": "1"}]))
    assert rows(read_npi_allow_list(spark, good)) == [(1,), (2,)]
    bad = write("bad.json", json.dumps([{"npi": "not-a-number"}]))
    with pytest.raises(Exception, match="invalid NPI"):
        read_npi_allow_list(spark, bad).collect()
