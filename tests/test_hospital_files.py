import json

import pytest
from helpers import rows

from ratelantern.operators.charges import conversion_stats, csv_charges, json_charges
from ratelantern.operators import quality
from ratelantern.operators.star import modifier_tables
from ratelantern.sources import hospital_json
from ratelantern.sources.hospital_csv import layouts, read_headers, read_records

META = (
    "hospital_name,last_updated_on,version,hospital_location,hospital_address,license_number|NY,"
    '"To the best of its knowledge and belief, this is complete",financial_aid_policy\n'
    "Test Hospital,2024-07-01,2.0.0,Main,\"1 Main St, Town\",L-1,TRUE,\n"
)
TALL = META + (
    "description,setting,code|1,code|1| type,code|2,code|2|type,standard_charge|gross,"
    "standard_charge|discounted_cash,payer_name,plan_name,standard_charge|negotiated_dollar,"
    "standard_charge|methodology,modifiers,drug_unit_of_measurement,drug_type_of_measurement\n"
    "Office visit,outpatient,99213,cpt,0510,RC,\"$1,234.50\",1000,Aetna,PPO,900,fee schedule,,,\n"
    "Office visit,outpatient,99213,CPT,0510,RC,\"$1,234.50\",1000,Cigna,HMO,N/A,case rate,26|TC,,\n"
    "\n"
    ",,,,,,,,,,,,,,\n"
    "\"Drug, 5 mg\",inpatient,X1,NDC,Y1,ndc,10,,,,,,,0.5,ML\n"
    "Short row,both,,CPT\n"
)
WIDE = META + (
    "code|1,code|1|type,description,setting,standard_charge|gross,"
    "standard_charge|United_Health|Choice_Plus|negotiated_dollar,standard_charge|United_Health|Choice_Plus|methodology,"
    "estimated_amount|United_Health|Choice_Plus,standard_charge|Aetna|A|B|negotiated_percentage,additional_payer_notes|Aetna|A|B\n"
    "99213,CPT,Visit,outpatient,100,90,case rate,,50,note\n"
    "99214,CPT,Visit 2,outpatient,200,,,75.5,,\n"
    "99215,CPT,Visit 3,outpatient,300,,,,,\n"
)
PERCENT_ONLY = META + (
    "description,setting,code|1,code|1|type,standard_charge|Aetna|PPO|negotiated_percentage\n"
    "Visit,both,1,CPT,40\n"
)


def charges(spark, path, **options):
    return csv_charges(read_records(spark, path, **options))


def test_tall(spark, write):
    got = charges(spark, write("tall.csv", "﻿" + TALL))
    assert got.count() == 4
    columns = ["description", "cpt_code", "rc_code", "ndc_code", "gross_charge", "discounted_cash",
               "payer_name", "negotiated_dollar", "modifiers"]
    assert rows(got, *columns) == [
        ("Drug, 5 mg", None, None, "Y1", 10.0, None, None, None, None),
        ("Office visit", "99213", "0510", None, 1234.5, 1000.0, "Aetna", 900.0, None),
        ("Office visit", "99213", "0510", None, 1234.5, 1000.0, "Cigna", None, "26|TC"),
        ("Short row", None, None, None, None, None, None, None, None),
    ]
    meta = got.select("hospital_name", "hospital_address", "license_number", "license_state",
                      "affirmation", "financial_aid_policy").distinct()
    assert rows(meta) == [("Test Hospital", "1 Main St, Town", "L-1", "NY", True, None)]
    in_order = [r.payer_name for r in got.orderBy("row_ord").collect()]
    assert in_order == ["Aetna", "Cigna", None, None]


def test_wide(spark, write):
    got = charges(spark, write("wide.csv", WIDE))
    columns = ["description", "payer_name", "plan_name", "negotiated_dollar", "negotiated_percentage",
               "estimated_amount", "methodology", "additional_payer_notes"]
    assert rows(got, *columns) == [
        ("Visit 2", "United Health", "Choice Plus", None, None, 75.5, None, None),
        ("Visit 3", None, None, None, None, None, None, None),
        ("Visit", "Aetna", "A|B", None, 50.0, None, None, "note"),
        ("Visit", "United Health", "Choice Plus", 90.0, None, None, "case rate", None),
    ]
    assert rows(conversion_stats(got).drop("source_file")) == [(4, 3, 2)]


def test_percentages_alone_make_a_file_wide(spark, write):
    got = charges(spark, write("pct.csv", PERCENT_ONLY))
    assert rows(got, "payer_name", "plan_name", "negotiated_percentage") == [("Aetna", "PPO", 40.0)]


def test_files_with_different_headers_are_read_together(spark, write, tmp_path):
    for name, text in (("a.csv", TALL), ("b.csv", WIDE), ("c d.csv", PERCENT_ONLY)):
        write(name, text)
    got = charges(spark, str(tmp_path))
    assert got.count() == 4 + 4 + 1
    assert got.select("source_file").distinct().count() == 3


def test_split_reading_gives_the_same_rows(spark, write, tmp_path):
    quoted = TALL + '"Two\nlines",both,1,CPT,,,5,,,,,,,,\n'
    many = TALL + "".join(f"Item {i},both,{i},CPT,,,{i},,,,,,,,\n" for i in range(5000))
    write("quoted.csv", quoted)
    write("many.csv", many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 15)
    try:
        split = charges(spark, str(tmp_path), split_above_bytes=0)
        whole = charges(spark, str(tmp_path))
        columns = ["source_file", "description", "gross_charge", "payer_name"]
        assert rows(split, *columns) == rows(whole, *columns)
        assert split.where("description = 'Two\nlines'").count() == 1
        ordered = split.where("source_file like '%many%'").orderBy("row_ord").select("description").collect()
        assert [r[0] for r in ordered[4:]] == [f"Item {i}" for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_splits_share_tasks(spark, write, tmp_path, monkeypatch):
    """Tasks that read split files follow from their bytes and not from the number of splits."""
    from ratelantern.sources import hospital_csv

    write("many.csv", TALL + "".join(f"Item {i},both,{i},CPT,,,{i},,,,,,,,\n" for i in range(3000)))
    tasks, store = {}, hospital_csv.write_stage

    def stored(df, name, *folders):
        tasks[name] = df.rdd.getNumPartitions()
        return store(df, name, *folders)

    monkeypatch.setattr(hospital_csv, "write_stage", stored)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 10)
    try:
        records = hospital_csv.read_records(spark, str(tmp_path), split_above_bytes=0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks["csv-records"] <= 2 * spark.sparkContext.defaultParallelism
    found = [tuple(r) for r in records.orderBy("row_ord").select("row_ord", records.cells[0]).collect()]
    assert [name for _, name in found[-3000:]] == [f"Item {i}" for i in range(3000)]
    assert [at - found[0][0] for at, _ in found] == list(range(len(found)))


def test_layout_lookup_beyond_the_broadcast_limit(spark, write, monkeypatch):
    from ratelantern.operators import joins
    from ratelantern.sources import hospital_csv

    path = write("tall.csv", TALL)
    expected = rows(charges(spark, path), "description", "payer_name")
    monkeypatch.setattr(
        hospital_csv, "lookup_join", lambda *a, **k: joins.lookup_join(*a, **{**k, "limit": 0})
    )
    assert rows(charges(spark, path), "description", "payer_name") == expected


def test_code_rules_look_at_raw_records(spark, write):
    broken = TALL + "Half,both,123,,,,5,,,,,,,,\nOdd,both,123,XYZ,,,5,,,,,,,,\n"
    report = quality.report(read_records(spark, write("x.csv", broken)), quality.csv_code_rules())
    assert rows(report, "rule", "violations") == [
        ("code and code type come together", 2), ("code type is known", 1),
    ]


# --- JSON ------------------------------------------------------------------------------------

V2 = {
    "hospital_name": "Two", "last_updated_on": "2024-07-01", "version": "2.2.0",
    "hospital_location": ["East", "West"], "hospital_address": ["1 St", "2 St"],
    "license_information": {"license_number": "L", "state": "NY"},
    "affirmation": {"affirmation": "text", "confirm_affirmation": True},
    "standard_charge_information": [
        {"description": "MRI", "code_information": [{"code": "1", "type": "cpt"}, {"code": "2", "type": "CPT"}, {"code": "0610", "type": "RC"}, {"code": "9", "type": "CMG"}],
         "standard_charges": [{"setting": "outpatient", "gross_charges": "24,945.00", "discounted_cash": 100.5, "modifier_code": ["26", "TC"],
                               "payers_information": [{"payer_name": "Aetna", "plan_name": "PPO", "methodology": "case rate", "standard_charge_dollar": 5},
                                                      {"payer_name": "Cigna", "plan_name": "HMO", "methodology": "", "standard_charge_percentage": 50}]}]},
        {"description": "Drug", "code_information": [{"code": "N", "type": "NDC"}], "drug_information": {"unit": "1", "type": "ML"},
         "standard_charges": [{"setting": "both", "gross_charges": 12.5}]},
        {"description": "Nothing", "code_information": []},
        {"description": "Empty", "code_information": [], "standard_charges": [{"setting": "inpatient", "gross_charges": "", "payers_information": []}]},
    ],
}
V3 = {
    **{k: V2[k] for k in ("hospital_name", "last_updated_on", "hospital_address")},
    "version": "3.0.0", "location_name": ["North"], "type_2_npi": ["123"],
    "attestation": {"confirm_attestation": True, "attester_name": "Dr A"},
    "standard_charge_information": [
        {"description": "MRI", "code_information": [{"code": "1", "type": "CPT"}],
         "standard_charges": [{"setting": "outpatient", "gross_charge": 7, "gross_charges": 9,
                               "payers_information": [{"payer_name": "", "plan_name": "P", "methodology": "other", "standard_charge_algorithm": "x",
                                                       "median_amount": 3, "10th_percentile": 1, "90th_percentile": 9, "count": "11"}]}]},
    ],
    "modifier_information": [{"description": "assistant", "code": "AS", "setting": "both",
                              "modifier_payer_information": [{"payer_name": "Aetna", "plan_name": "PPO", "description": "85%"}]}],
}


def test_json_version_2(spark, write):
    got = json_charges(hospital_json.items(hospital_json.read_hospital_json(spark, write("v2.json", "﻿" + json.dumps(V2)))))
    assert rows(got, "description", "cpt_code", "rc_code", "gross_charge", "payer_name", "methodology", "modifiers") == [
        ("Drug", None, None, 12.5, None, None, None),
        ("Empty", None, None, None, None, None, None),
        ("MRI", "2", "0610", 24945.0, "Aetna", "case rate", "26|TC"),
        ("MRI", "2", "0610", 24945.0, "Cigna", None, "26|TC"),
    ]
    assert rows(got.select("hospital_location", "hospital_address", "license_state", "affirmation").distinct()) == [
        ("East; West", "1 St; 2 St", "NY", True)
    ]
    drug = got.where("description = 'Drug'").first()
    assert (drug.drug_unit_of_measurement, drug.drug_type_of_measurement) == (1.0, "ML")
    assert [r.payer_name for r in got.orderBy("row_ord").collect()][:2] == ["Aetna", "Cigna"]


def test_json_version_3(spark, write):
    path = write("v3.json", json.dumps(V3))
    documents = hospital_json.read_hospital_json(spark, path)
    row = json_charges(hospital_json.items(documents)).first()
    assert (row.gross_charge, row.payer_name, row.plan_name) == (7.0, "", "P")
    assert (row.median_amount, row.percentile_10th, row.percentile_90th, row["count"]) == (3.0, 1.0, 9.0, "11")
    assert (row.hospital_location, row.npis, row.attester_name, row.affirmation) == ("North", ["123"], "Dr A", True)
    tables = modifier_tables(hospital_json.modifiers(documents))
    assert rows(tables["modifiers"], "code", "description", "setting") == [("AS", "assistant", "both")]
    assert rows(tables["modifier_payer_info"], "payer_name", "description") == [("Aetna", "85%")]
    assert documents.select(hospital_json.file_format()).first()[0] == "json-v3"


@pytest.mark.parametrize("document", [V2, V3])
def test_large_json_gives_the_same_rows(spark, write, document):
    path = write("x.json", json.dumps(document))
    small = hospital_json.items(hospital_json.read_hospital_json(spark, path))
    large, modifiers = hospital_json.read_large_hospital_json(spark, path)
    assert rows(json_charges(small).drop("source_file")) == rows(json_charges(large).drop("source_file"))
    assert modifiers.count() == len(document.get("modifier_information", []))


def test_headers_are_normalised(spark, write):
    layout = layouts(read_headers(spark, write("t.csv", TALL.replace("payer_name", " Payer_Name "))))
    row = layout.select("layout.*").first()
    assert (row.kind, row.payer_name, [s.code for s in row.code_slots]) == ("tall", 8, [2, 4])
