import gzip
import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ratelantern.functions.predicates import PlanFilter, plan_description, plan_matches
from ratelantern.operators import toc
from ratelantern.sinks import writers
from ratelantern.sources.toc import read_large_structures, read_toc, structures

NEW_YORK = PlanFilter(state="NY")


def plan(name="Plan", issuer="Issuer", kind="hios", plan_id="12345CA0010001", sponsor=None, market="group"):
    fields = {
        "plan_name": name, "issuer_name": issuer, "plan_id_type": kind, "plan_id": plan_id,
        "plan_market_type": market,
    }
    return {**fields, "plan_sponsor_name": sponsor} if sponsor else fields


def url(n):
    return {"description": f"file {n}", "location": f"https://rates.test/{n}.json"}


DOCUMENT = {
    "reporting_entity_name": "Payer",
    "reporting_entity_type": "issuer",
    "something_new": {"deep": [1, 2, {"x": "]"}]},
    "reporting_structure": [
        {"reporting_plans": [plan("Gold", plan_id="11111NY0010001")], "in_network_files": [url(1)]},
        {"reporting_plans": [plan("Sunshine")], "in_network_files": [url(2)]},
        {
            # Files may precede plans, and a structure may list a file twice.
            "in_network_files": [url(3), url(3)],
            "reporting_plans": [plan("Other"), plan("Silver", issuer="Empire Blue", kind="ein", plan_id="99", sponsor="Shop")],
        },
        {"reporting_plans": [plan("No files", plan_id="22222ny001")]},
    ],
    "last_updated_on": "2024-07-01",
    "version": "2.0.0",
}


def matches(spark, p, wanted):
    schema = ", ".join(f"{k} string" for k in [
        "plan_name", "issuer_name", "plan_id_type", "plan_id", "plan_sponsor_name", "plan_market_type",
    ])
    df = spark.createDataFrame([p], schema)
    return df.select(plan_matches(F.col, wanted)).first()[0]


@pytest.mark.parametrize(
    ("p", "expected"),
    [
        (plan(plan_id="12345NY0010001"), True),
        (plan(plan_id="12345ny001"), True),
        (plan(plan_id="12345CA0010001"), False),
        (plan(plan_id="12345N"), False),
        (plan(kind="ein", plan_id="12345NY0010001"), False),
        (plan(name="New York Gold"), True),
        (plan(name="Plan NY Gold"), True),
        (plan(name="Sunny Gold"), True),  # the keyword is "ny "
        (plan(name="Sunshine Gold"), False),
        (plan(name="Brooklyn Gold"), False),
        (plan(issuer="Fidelis Care"), True),
        (plan(kind="ein", plan_id="1", sponsor="City of N.Y."), True),
    ],
)
def test_state_filter(spark, p, expected):
    assert matches(spark, p, NEW_YORK) is expected


def test_filter_switches(spark):
    hios, named = plan(plan_id="12345NY001", market="individual"), plan(name="Empire")
    assert matches(spark, named, PlanFilter())
    assert matches(spark, hios, PlanFilter(market="individual"))
    assert not matches(spark, named, PlanFilter(market="individual"))
    assert not matches(spark, named, PlanFilter(state="NY", use_keywords=False))
    assert not matches(spark, hios, PlanFilter(state="NY", use_hios=False))
    assert matches(spark, plan(), PlanFilter(state="NY", use_hios=False, use_keywords=False))
    assert not matches(spark, named, PlanFilter(state="NY", market="individual"))
    assert matches(spark, plan("Upstate"), PlanFilter(state="NY", extra_keywords=[" UPSTATE ", ""]))
    assert matches(spark, plan("Upstate"), PlanFilter(extra_keywords=["nothing"]))


def test_description(spark):
    schema = "plan_name string, issuer_name string, plan_id_type string, plan_id string, plan_sponsor_name string, plan_market_type string"
    df = spark.createDataFrame(
        [plan("Gold", "Acme", "hios", "1", None, "individual"), plan("Silver", "Acme", "other", "2", "Shop", "x")],
        schema,
    )
    assert [r[0] for r in df.select(plan_description(F.col)).collect()] == [
        "Gold individual market plan from Acme (HIOS: 1)",
        "Silver group market plan from Acme (EIN: 2), sponsored by Shop",
    ]


@pytest.fixture
def document(spark, write):
    return structures(read_toc(spark, write("toc.json", json.dumps(DOCUMENT, indent=1))))


def test_plans_and_urls(document):
    assert rows(toc.plans(document, NEW_YORK), "structure_id", "plan_name", "url_count") == [
        (1, "Gold", 1), (3, "Silver", 2), (4, "No files", 0),
    ]
    assert rows(toc.plan_urls(document, NEW_YORK), "reporting_structure_id", "url") == [
        (1, "https://rates.test/1.json"),
        (3, "https://rates.test/3.json"),
        (3, "https://rates.test/3.json"),
    ]
    everything = toc.normalised_plans(document)
    assert everything.count() == 5
    assert rows(toc.normalised_plans(document, NEW_YORK), "reporting_structure_id") == [(1,), (3,), (4,)]


def test_stats(document):
    assert rows(toc.toc_stats(document, NEW_YORK).drop("source_file")) == [(4, 5, 3, 3)]
    assert rows(toc.toc_stats(document).drop("source_file")) == [(4, 5, 4, 5)]


def test_large_files_give_the_same_rows(spark, write, document, tmp_path):
    packed = tmp_path / "big.json.gz"
    packed.write_bytes(gzip.compress(json.dumps(DOCUMENT).encode()))
    large = read_large_structures(spark, str(packed))
    columns = [c for c in document.columns if c != "source_file"]
    assert rows(large, *columns) == rows(document, *columns)
    small = structures(read_toc(spark, str(packed)))
    assert rows(small, *columns) == rows(document, *columns)


def test_malformed_file_fails(spark, write):
    path = write("bad.json", '{"reporting_structure": [{]}')
    with pytest.raises(Exception, match="(?i)malformed"):
        structures(read_toc(spark, path)).collect()
    with pytest.raises(Exception):
        read_large_structures(spark, path).collect()


def test_sinks(spark, document, tmp_path):
    base = str(tmp_path / "out")
    writers.write_plans(document, f"{base}/plans", NEW_YORK)
    written = spark.read.parquet(f"{base}/plans")
    assert rows(written, "plan_name", "url_count", "in_network_urls")[0] == ("Gold", 1, ["https://rates.test/1.json"])

    writers.write_normalised_plans(document, f"{base}/x.parquet")
    assert spark.read.parquet(f"{base}/x.parquet").count() == 5
    assert spark.read.parquet(f"{base}/x_urls.parquet").count() == 4

    writers.write_plan_json(document, f"{base}/json", NEW_YORK)
    assert spark.read.json(f"{base}/json/plans").count() == 3
    manifest = spark.read.json(f"{base}/json/manifest").first()
    assert (manifest.total_plans_extracted, manifest.reporting_entity_name) == (3, "Payer")
