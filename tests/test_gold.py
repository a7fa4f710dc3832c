"""Laid-out tables: what a lookup reads, and equal answers with and without them."""

import glob

import pyarrow.parquet as pq
import pytest
from helpers import rows
from test_star import charges

from ratelantern import adapters, driver_queries
from ratelantern.operators import star
from ratelantern.plans import compare, detail, listings, search
from ratelantern.session import write_stage
from ratelantern.sinks import gold as gold_tables
from ratelantern.sinks.gold import read_gold, write_gold
from ratelantern.sinks.writers import write_star

WORDS = ["Visit", "Röntgen Thorax", "MRI knee", "100% saline_bag", "x", "", "Äther", "knee brace", "İstanbul kit"]


@pytest.fixture(scope="module")
def stars(spark, tmp_path_factory):
    """The same star without and with laid-out tables, in narrow row groups. One code holds a third of all charges."""
    path = str(tmp_path_factory.mktemp("gold"))
    dicts = [
        {
            "description": f"{WORDS[i % len(WORDS)]} {i // 90 or ''}".strip(),
            "setting": "both",
            "cpt_code": "hot" if i % 3 == 0 else f"{i % 400:05}",
            "rc_code": f"R{i % 7}" if i % 2 else None,
            "gross_charge": float(i),
            "discounted_cash": float(i % 50) if i % 4 else None,
            "payer_name": f"payer {i % 5}" if i % 5 else None,
            "plan_name": "PPO",
            "estimated_amount": float(i % 11),
            "additional_generic_notes": f"note {i % 13}",
            "source_file": f"file-{i % 6}",
            "hospital_name": f"hospital {i % 6}",
        }
        for i in range(1800)
    ]
    write_star(star.build_star(charges(spark, dicts), skip_payer_charges=False), path)
    plain = {name: spark.read.parquet(f"{path}/{name}") for name in star.STAR_TABLES}
    write_gold(plain, f"{path}/gold", rows_per_group=100, files=6)
    return plain, plain | read_gold(spark, f"{path}/gold"), f"{path}/gold"


def row_groups(path, column, value):
    """(row groups whose bounds hold the value, all, rows in the former)."""
    held = total = n = 0
    for file in glob.glob(f"{path}/*.parquet"):
        footer = pq.ParquetFile(file).metadata
        at = [footer.schema.column(i).name for i in range(footer.num_columns)].index(column)
        for g in range(footer.num_row_groups):
            bounds = footer.row_group(g).column(at).statistics
            total += 1
            if bounds.min <= value <= bounds.max:
                held += 1
                n += footer.row_group(g).num_rows
    return held, total, n


def rows_scanned(df, table):
    """Rows that the scans of a table have given out, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves, found = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        while leaf.getClass().getSimpleName().endswith("QueryStageExec"):
            leaf = leaf.plan().collectLeaves().apply(0)
        if table in leaf.toString() or table in leaf.simpleString(1000):
            found += leaf.metrics().apply("numOutputRows").value()
    return found


def test_a_code_reads_its_row_groups_alone(stars):
    _, gold, path = stars
    total = gold["code_prices"].count()
    held, groups, n = row_groups(f"{path}/code_prices", "code", "00100")
    assert groups >= 20 and held <= 2
    df = compare.selected_charges(gold, "00100")
    assert "EqualTo(code,00100)" in df._jdf.queryExecution().executedPlan().toString()
    assert 0 < rows_scanned(df, "code_prices") <= n < total / 5
    assert row_groups(f"{path}/item_prices", "description", "MRI knee 3")[0] <= 2


def test_a_hot_code_is_split(stars):
    _, gold, path = stars
    files = [f for f in glob.glob(f"{path}/code_prices/*.parquet") if "hot" in pq.read_table(f, columns=["code"])["code"].to_pylist()]
    assert len(files) > 1


@pytest.mark.parametrize("code, code_type", [("00100", None), ("hot", "CPT"), ("R3", "RC"), ("none", None), (None, None)])
def test_prices_are_the_same(stars, code, code_type):
    plain, gold, _ = stars
    for tables in ((plain, gold),):
        one, two = (rows(compare.compare_prices(t, code, code_type)) for t in tables)
        assert one == two
        one, two = (rows(detail.payer_charge_list(detail.price_rows(t, None, code, code_type))) for t in tables)
        assert one == two
    if code:
        hospital = plain["hospitals"].orderBy("source_file").first().hospital_id
        assert rows(detail.standard_charge_list(detail.price_rows(plain, hospital, code, code_type))) == rows(
            detail.standard_charge_list(detail.price_rows(gold, hospital, code, code_type))
        )
        assert rows(search.service_info(plain, code, code_type)) == rows(search.service_info(gold, code, code_type))
        assert rows(search.hospital_code_info(plain, hospital, code, "CPT")) == rows(search.hospital_code_info(gold, hospital, code, "CPT"))


def test_items_are_the_same(stars):
    plain, gold, _ = stars
    for description in ("MRI knee 3", "x", "none"):
        assert rows(listings.item_notes(plain, description)) == rows(listings.item_notes(gold, description))
        assert rows(listings.item_drug_info(plain, description)) == rows(listings.item_drug_info(gold, description))


TEXTS = ["kn", "KNEE", "nee b", "röntgen", "Ä", "äther", "öntg", "ro", "hot", "HO", "r3", "0010", "", "x", "%", "100%", "e_b", "İs", "zzz", "knee 1", "\\", "e 1"]


@pytest.mark.parametrize("wildcards", [False, True])
def test_search_is_the_same(stars, wildcards):
    plain, gold, _ = stars
    more = ["k%e", "r_n", "%nee", "1__%s", "ho%", "_o", "MRI%ee 2"] if wildcards else []
    for text in TEXTS + more:
        if wildcards and text == "\\":
            continue  # no pattern
        one = [tuple(r) for r in search.search(plain, text, None, wildcards).collect()]
        assert [tuple(r) for r in search.search(gold, text, None, wildcards).collect()] == one, text


def test_search_reads_no_items(stars):
    _, gold, _ = stars
    plan = search.search(gold, "knee")._jdf.queryExecution().executedPlan().toString()
    assert "standard_charge_items" not in plan and "item_codes" not in plan
    assert "StringStartsWith(code_key,knee)" in plan and "EqualTo(gram," in plan


def test_tables_are_written_by_name(spark, stars, tmp_path):
    """A lookup needs the tables it reads; a table written alone has the rows it has among all."""
    plain, gold, _ = stars
    for name in ("code_prices", "item_prices"):
        write_gold(plain, f"{tmp_path}/{name}", files=2, names={name})
        assert glob.glob(f"{tmp_path}/{name}/*") == [f"{tmp_path}/{name}/{name}"]
        alone = read_gold(spark, f"{tmp_path}/{name}", {name})[name]
        assert alone.exceptAll(gold[name]).count() == gold[name].exceptAll(alone).count() == 0


def test_all_codes_at_once_are_the_codes_one_by_one(stars):
    plain, _, _ = stars
    every = compare.selected_charges(plain)
    one = compare.selected_charges(plain, "hot")
    assert every.columns == one.columns
    hot = every.where("code = 'hot'")
    assert one.count() == 600 and hot.exceptAll(one).count() == one.exceptAll(hot).count() == 0


def test_a_query_stores_the_star_tables_it_reads(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(driver_queries, "_staged", {})
    monkeypatch.setattr(driver_queries, "write_stage", lambda df, name: stored.append(name) or df)
    driver_queries.code_exists(spark, "/root/testdata/sf0.001")
    assert stored == ["charges", "codes"]


def test_tables_from_charge_rows_are_those_of_the_star(spark, stars, tmp_path):
    """No star is stored or joined; items without a description, charges with no, one and many payers, repeated rows."""
    dicts = [
        {
            "description": (None, "", "knee", "K\x1f", "İ kit")[i % 5],
            "setting": "both",
            "cpt_code": "hot" if i % 3 == 0 else f"{i % 7:05}",
            "rc_code": f"R{i % 2}" if i % 4 else "",
            "gross_charge": float(i % 11) + (1e-9 if i % 2 else 0.0),
            "payer_name": f"payer {i % 2}" if i % 13 else None,
            "plan_name": "PPO" if i % 3 else None,
            "estimated_amount": float(i),
            "additional_generic_notes": f"note {i % 2}" if i % 11 > 3 else None,
            "additional_payer_notes": "" if i % 2 else "taxed",
            "source_file": f"file-{i % 2}",
            "hospital_name": f"hospital {i % 2}",
        }
        for i in range(600)
    ]
    lonely = [d | {"gross_charge": 99.0 + n, "payer_name": None, "plan_name": None} for n, d in enumerate(dicts[:40])]
    made = star.with_ids(charges(spark, dicts + lonely * 2))
    made.write.parquet(f"{tmp_path}/rows")
    made = spark.read.parquet(f"{tmp_path}/rows")
    write_star(star.build_star(made, skip_payer_charges=False), f"{tmp_path}/star")
    write_gold({name: spark.read.parquet(f"{tmp_path}/star/{name}") for name in star.STAR_TABLES}, f"{tmp_path}/joined", files=2)
    write_gold({"charge_rows": made}, f"{tmp_path}/read", files=2)
    one, two = read_gold(spark, f"{tmp_path}/joined"), read_gold(spark, f"{tmp_path}/read")
    for name in one:
        assert one[name].columns == two[name].columns and one[name].count() == two[name].count() > 0, name
        assert one[name].exceptAll(two[name]).count() == two[name].exceptAll(one[name]).count() == 0, name
    chosen = compare.selected_charges({"charge_rows": made}, "hot", "CPT").drop("code_id")
    hot = one["code_prices"].where("code = 'hot' and code_type = 'CPT'")
    assert chosen.exceptAll(hot).count() == hot.exceptAll(chosen).count() == 0


def test_counts_store_no_star(spark, monkeypatch, tmp_path):
    """Counts read each table once, and the star is written once where files are asked for."""
    stored = []
    monkeypatch.setattr(driver_queries, "_staged", {})
    monkeypatch.setattr(driver_queries, "_paths", {})
    monkeypatch.setattr(driver_queries, "write_stage", lambda df, name: stored.append(name) or df)
    for query in (driver_queries.table_counts, driver_queries.load_summary, driver_queries.star_files):
        query(spark, "/root/testdata/sf0.001")
    assert stored == ["charges"]


def test_listings_store_no_star(spark, monkeypatch):
    """Listings and flags read each table of the star once, so none is stored for them."""
    stored = []
    monkeypatch.setattr(driver_queries, "_staged", {})
    monkeypatch.setattr(driver_queries, "write_stage", lambda df, name: stored.append(name) or df)
    for query in (driver_queries.hospital_flags, driver_queries.hospital_load_summary, driver_queries.item_descriptions, driver_queries.charge_values):
        query(spark, "/root/testdata/sf0.001")
    assert stored == ["charges"]


def test_ids_are_moved_as_bytes(spark):
    """Half as long as their text; what comes out is the text again."""
    dicts = [{"description": "knee", "cpt_code": "1", "source_file": f"f{i}", "gross_charge": 1.0} for i in range(3)]
    made = write_stage(star.with_ids(charges(spark, dicts)), "rows")
    for table, key in ((star.items(made), "item_id"), (star.standard_charges(made), "standard_charge_id")):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert f"unhex({key}" in plan and table.select(key).distinct().exceptAll(made.select(key).distinct()).count() == 0
        assert table.count() == 3


def exchanges(df):
    """The optimizer's shuffles, before any runs."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [line for line in plan.splitlines() if " Exchange " in line]


def test_laid_out_tables_are_dealt_once(spark):
    """Rows of an item meet where they are written: one shuffle, without ids that follow from other columns."""
    made = star.with_ids(charges(spark, [{"description": "knee", "cpt_code": "1", "payer_name": "p", "source_file": "f"}]))
    for dealt in (gold_tables._dealt_code_prices(made, 3), gold_tables._dealt_item_prices(made, 3)):
        (only,) = exchanges(dealt)
        assert "rangepartitioning" in only
        assert dealt.count() == 1


def test_prices_of_all_codes_are_moved_once(spark, stars):
    _, gold, _ = stars
    best = compare.best_prices({"code_prices": gold["code_prices"], "hospitals": spark.createDataFrame(gold["hospitals"].collect(), gold["hospitals"].schema)})
    wide = [line for line in exchanges(best) if "estimated_amount" in line or "hashpartitioning(code" in line]
    assert len(wide) == 1 and "hashpartitioning(code" in wide[0] and "gross_charge" not in wide[0]


def test_line_items_are_moved_before_they_are_wide(spark):
    """Orders are joined before parts and suppliers, whose texts are then not moved with every line item."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # orders and lines are shuffled, as they are when large
    try:
        plan = adapters.charges(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    at = next(i for i, line in enumerate(plan) if "Join" in line and "l_orderkey" in line and "o_orderkey" in line)
    depth = plan[at].index("Join")
    below = []
    for line in plan[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert any("o_orderkey" in line for line in below) and not any("p_name" in line or "s_name" in line for line in below)
