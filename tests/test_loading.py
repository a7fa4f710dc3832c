"""Positions of records, ledgers of loads, and dimensions loaded in batches."""

import shutil

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_hospital_files import META, TALL, WIDE
from test_star import FOUR, charges

from ratelantern import adapters, driver_queries
from ratelantern.fixed_values import CODE_COLUMNS
from ratelantern.operators import star
from ratelantern.operators.charges import conversion_stats, csv_charges, input_counts
from ratelantern.schemas import CHARGE_COLUMNS, CHARGE_EXTRAS
from ratelantern.session import write_stage
from ratelantern.sources.charges import ledger_summary, load_directory
from ratelantern.sources.hospital_csv import read_records
from ratelantern.streaming import ingest

MANY = TALL + "".join(f"Item {i},both,{i},CPT,,,{i},,P{i % 3},,,,,,\n" + "\n" * (i % 3) for i in range(3000))
TWICE = META + (
    "description,setting,code|1,code|1|type,standard_charge|A_B|PPO|negotiated_dollar,standard_charge|A B|PPO|negotiated_dollar\n"
    "Visit,both,1,CPT,40,50\nVisit,both,1,CPT,40,50\n"
)


def keys(spark, path, **options):
    found = write_stage(star.with_ids(csv_charges(read_records(spark, path, **options))), "keyed")
    ids = {r.payer_charge_id for r in star.payer_charges(found).select("payer_charge_id").collect()}
    places = found.select("source_file", "description", "row_ord", "payer_ord").collect()
    return ids, {(r.source_file.split("/")[-1], *r[1:]) for r in places}


def test_positions_do_not_depend_on_splits_or_neighbours(spark, write, tmp_path):
    many = write("many.csv", MANY)
    for name, text in (("a.csv", TALL), ("b.csv", WIDE), ("c.csv", TWICE)):
        write(name, text)
    whole = keys(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 14)
    try:
        assert keys(spark, str(tmp_path), split_above_bytes=0) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    alone = keys(spark, many)
    assert alone[0] < whole[0] and alone[1] < whole[1]
    at = {d: n for f, d, n, _ in alone[1] if d.startswith("Item")}
    assert [at[f"Item {i}"] for i in range(3000)] == list(range(7, 3007))


def test_payer_columns_with_equal_names_have_ids_of_their_own(spark, write):
    ids, _ = keys(spark, write("twice.csv", TWICE))
    assert len(ids) == 4


def test_input_counts(spark, write, tmp_path):
    for name, text in (("a.csv", TALL), ("b.csv", WIDE), ("none.csv", META + "description,setting,code|1,code|1|type\n")):
        write(name, text)
    records = read_records(spark, str(tmp_path))
    stats = conversion_stats(csv_charges(records), input_counts(records))
    name = F.substring_index("source_file", "/", -1).alias("file")
    assert rows(stats, name, "input_records", "charge_rows", "payer_rows", "payer_plan_pairs") == [("a.csv", 4, 4, 2, 2), ("b.csv", 3, 4, 3, 2)]


@pytest.fixture
def folder(spark, tmp_path):
    """Four good files of which one is empty, one truncated, one that never was Parquet."""
    path = tmp_path / "in"
    bare = charges(spark, FOUR).drop("source_file", "row_ord", "row_chunk")
    for n, df in enumerate((bare, bare.limit(2), charges(spark, FOUR), bare.limit(0))):
        df.coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (file,) = (tmp_path / f"w{n}").glob("part*.parquet")
        path.mkdir(exist_ok=True)
        shutil.copy(file, path / f"good-{n}.parquet")
    raw = (path / "good-0.parquet").read_bytes()
    (path / "cut.parquet").write_bytes(raw[: len(raw) // 2])
    (path / "zz.parquet").write_bytes(b"PAR1 not really PAR1")
    return path


def test_ledger(spark, folder, tmp_path):
    ledger = load_directory(spark, str(folder), str(tmp_path / "out"))
    name = F.substring_index("charge_file", "/", -1).alias("file")
    assert rows(ledger, name, "outcome", "rows_written", "rows_loaded") == [
        ("cut.parquet", "failed", None, 0),
        ("good-0.parquet", "loaded", 4, 4),
        ("good-1.parquet", "loaded", 2, 2),
        ("good-2.parquet", "loaded", 4, 4),
        ("good-3.parquet", "empty", 0, 0),
        ("zz.parquet", "failed", None, 0),
    ]
    assert all(r.error for r in ledger.where("outcome = 'failed'").collect())
    assert rows(ledger_summary(ledger), "outcome", "files", "rows_loaded") == [("empty", 1, 0), ("failed", 2, 0), ("loaded", 3, 10)]
    loaded = spark.read.parquet(str(tmp_path / "out" / "charges"))
    assert [r.row_ord for r in loaded.where("charge_file like '%good-0%'").orderBy("row_ord").collect()] == [0, 1, 2, 3]
    assert {r.source_file for r in loaded.where("charge_file like '%good-2%'").collect()} == {"file-1"}


def test_ledger_of_a_folder_without_a_good_file(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "zz.parquet").write_bytes(b"nothing")
    ledger = load_directory(spark, str(tmp_path / "bad"), str(tmp_path / "out"))
    assert rows(ledger, "outcome", "rows_loaded") == [("failed", 0)]


def codes(spark, names):
    df = spark.createDataFrame([(n, "CPT") for n in names], "code string, code_type string")
    return df.select(star.hash_id(F.col("code"), F.col("code_type")).alias("code_id"), "code", "code_type")


def test_dimensions_are_equal_after_one_and_ten_batches(spark, tmp_path):
    once, often = str(tmp_path / "once"), str(tmp_path / "often")
    names = [str(i) for i in range(200)]
    ingest.add_to_dimension(spark, once, "codes", 0, codes(spark, names))
    for n in range(10):
        ingest.add_to_dimension(spark, often, "codes", n, codes(spark, names[n * 15 : n * 15 + 65]))
    ingest.add_to_dimension(spark, often, "codes", 9, codes(spark, names[135:200]))  # repeated
    columns = ["code_id", "code", "code_type"]
    assert rows(ingest.read_dimension(spark, once, "codes"), *columns) == rows(ingest.read_dimension(spark, often, "codes"), *columns)


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path)
    ingest.add_to_dimension(spark, path, "codes", 0, codes(spark, [str(i) for i in range(500)]))
    earlier = ingest.earlier_keys(spark, path, "codes", 1, codes(spark, ["7", "new"]))
    earlier.collect()
    scan = earlier._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert "PartitionFilters: [isnotnull(batch" in scan.toString() and "bucket" in scan.toString()
    assert scan.metrics().apply("numPartitions").value() <= 2
    assert scan.metrics().apply("numFiles").value() <= 2
    assert ingest.earlier_keys(spark, path, "plans", 1, codes(spark, ["7"])) is None


def test_charge_files_hold_all_rows_and_no_ids(spark, tmp_path):
    made = charges(spark, [{"description": f"Visit {i}", "cpt_code": str(i % 7), "row_ord": i} for i in range(100)])
    adapters.write_charge_files(star.with_ids(made), f"{tmp_path}/files")
    assert len(list((tmp_path / "files/good").glob("part-*"))) == 8
    found = spark.read.parquet(f"{tmp_path}/files/good")
    assert found.columns == [*CHARGE_COLUMNS, *CHARGE_EXTRAS]
    assert rows(found) == rows(made.select(found.columns))
    ledger = load_directory(spark, f"{tmp_path}/files", f"{tmp_path}/out", "*")
    assert rows(ledger_summary(ledger), "outcome", "files", "rows_loaded") == [("failed", 1, 0), ("loaded", 8, 100)]


def test_batches_of_codes_store_the_columns_of_codes_alone(spark, monkeypatch):
    made = charges(spark, [{"cpt_code": str(i % 7), "rc_code": None if i % 2 else "0510", "row_ord": i} for i in range(40)])
    monkeypatch.setattr(driver_queries.adapters, "charges", lambda spark, sf_dir: made)
    found = driver_queries.dim_incremental(spark, "batches of codes")
    expected = [(n, *code) for n in (1, 10) for code in [*((str(i), "CPT") for i in range(7)), ("0510", "RC")]]
    assert rows(found, "batches", "code", "code_type") == sorted(expected, key=repr)
    stored = {name: df.columns for (_, folder, name), df in driver_queries._staged.items() if folder == "batches of codes"}
    assert stored == {"charge-codes": [*CODE_COLUMNS.values(), "row_ord"]}
