"""The driver's generic tables seen as price-transparency data.

These views let every operator run on the given tables: a supplier acts as a hospital, a line
item as a charge row, an order as a reporting structure or an in-network item. Nested
documents are built from the columns of one row each, so no view collects a group of rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelantern.operators.charges import as_charges
from ratelantern.operators.joins import lookup_join, tasks_for
from ratelantern.schemas import CHARGE_COLUMNS, CHARGE_EXTRAS, HOSPITAL_DOCUMENT, IN_NETWORK_DOCUMENT, TOC_DOCUMENT
from ratelantern.session import write_stage
from ratelantern.sources import hospital_csv
from ratelantern.sources import in_network as in_network_source
from ratelantern.sources import toc as toc_source
from ratelantern.sources.documents import parse_documents
from ratelantern.sources.lookups import latest_descriptions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out a scan that has fewer tasks than there are cores; leave larger scans alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """Deal out a scan by its number of rows, at least to all cores.

    A file is split by its bytes, but a row group is read by one task: with few of them most splits have no rows.
    For rows that are narrow and costly, as documents made of them.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks_for(df.count(), rows_per_task)))


def _remainder(column: str, n: int) -> Column:
    return F.col(column) % n


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One charge row per line item."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    parts = table(spark, sf_dir, "part")
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    # Customers are joined to orders, so line items are not moved once more for them. Orders, the largest of the
    # others, come first: line items are moved for them before they carry the texts of parts and suppliers.
    ordered = orders.join(customers, orders.o_custkey == customers.c_custkey)
    located = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey)
    rows = (
        lines.join(ordered, lines.l_orderkey == ordered.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .join(located, lines.l_suppkey == located.s_suppkey)
    )
    has_payer = _remainder("l_linenumber", 4) != 0
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return as_charges(
        rows.select(
            F.col("p_name").alias("description"),
            F.when(F.col("l_returnflag") == "A", "inpatient")
            .when(F.col("l_returnflag") == "N", "outpatient")
            .otherwise("both")
            .alias("setting"),
            F.when(_remainder("p_partkey", 3) != 0, F.col("p_partkey").cast("string")).alias("cpt_code"),
            F.col("p_brand").alias("hcpcs_code"),
            F.when(_remainder("p_size", 2) == 0, F.col("p_type")).alias("ms_drg_code"),
            F.when(has_payer, F.col("c_mktsegment")).alias("payer_name"),
            F.when(has_payer & (_remainder("l_linenumber", 7) != 0), F.col("o_orderpriority")).alias("plan_name"),
            price.alias("gross_charge"),
            F.when(discount != 0, F.round(price * (1 - discount), 4)).alias("discounted_cash"),
            F.when(has_payer & (F.col("l_linestatus") != "O"), F.round(price * (1 - F.col("l_tax")), 4)).alias("negotiated_dollar"),
            F.when(has_payer & (F.col("l_linestatus") == "O"), F.round(100 - 100 * F.col("l_tax"), 4)).alias("negotiated_percentage"),
            F.when(has_payer & (F.col("o_orderstatus") != "P"), F.col("o_totalprice")).alias("estimated_amount"),
            F.when(F.col("l_quantity") > 10, F.round(price * 0.5, 4)).alias("min_charge"),
            F.when(F.col("l_quantity") > 20, F.round(price * 2, 4)).alias("max_charge"),
            F.when(has_payer & (_remainder("l_linenumber", 5) != 0), F.element_at(
                F.array(F.lit("fee schedule"), F.lit("case rate"), F.lit("other")),
                (_remainder("l_linenumber", 3) + 1).cast("int"),
            )).alias("methodology"),
            F.when(_remainder("l_linenumber", 6) == 1, "26|TC").alias("modifiers"),
            F.when(_remainder("p_size", 5) == 0, F.col("p_size").cast("double")).alias("drug_unit_of_measurement"),
            F.when(_remainder("p_size", 10) == 0, "ML").alias("drug_type_of_measurement"),
            F.when(F.col("l_quantity") > 45, _text("bulk ", F.col("l_returnflag"))).alias("additional_generic_notes"),
            F.when(has_payer & (F.col("l_tax") > 0.06), "taxed").alias("additional_payer_notes"),
            F.col("s_name").alias("hospital_name"),
            F.lit("2024-07-01").alias("last_updated_on"),
            F.lit("2.2.0").alias("version"),
            F.col("n_name").alias("hospital_location"),
            F.col("n_name").alias("hospital_address"),
            F.lit(True).alias("affirmation"),
            _text("supplier-", F.col("l_suppkey")).alias("source_file"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_ord"),
            F.floor(F.col("l_orderkey") / (1 << 17)).alias("row_chunk"),
        )
    )


def write_charge_files(rows: DataFrame, path: str, files: int = 8) -> None:
    """Charge rows in so many files, and one file beside them that is no Parquet.

    The files hold charge rows as converters make them; ids of parents are made when they are loaded. Each file is
    written by one task, which reads its share as compressed columns instead of shuffled rows.
    """
    rows = rows.select(*CHARGE_COLUMNS, *CHARGE_EXTRAS)
    file = F.pmod(F.monotonically_increasing_id(), F.lit(files)).cast("int")  # numbers of a task follow each other
    dealt = write_stage(rows.withColumn("_file", file), "charge-shares", "_file")
    # A union of single partitions would be one task; the last share, which is empty and not merged, keeps them apart.
    shares = [dealt.where(F.col("_file") == n).drop("_file") for n in range(files + 1)]
    shares = [share.coalesce(1) for share in shares[:files]] + shares[files:]
    reduce(DataFrame.unionByName, shares).write.parquet(f"{path}/good")
    rows.select(F.concat_ws(" ", "description", "source_file").alias("value")).limit(1000).coalesce(1).write.text(f"{path}/damaged")


# --- tables of contents --------------------------------------------------------------------


def toc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table-of-contents document per order, written as JSON text and parsed again."""
    orders = dealt(table(spark, sf_dir, "orders"))
    customers = table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    state = F.when(_remainder("c_nationkey", 5) == 0, "NY").otherwise("CA")

    def plan(n: int) -> Column:
        key = F.col("o_orderkey")
        return F.struct(
            _text(F.col("o_orderpriority"), " plan ", key % 97).alias("plan_name"),
            F.when((key + n) % 11 == 0, "Empire Health").otherwise(F.col("c_mktsegment")).alias("issuer_name"),
            F.when((key + n) % 3 == 0, "ein").otherwise("hios").alias("plan_id_type"),
            F.when((key + n) % 3 == 0, F.lpad((key % 1000).cast("string"), 9, "0"))
            .otherwise(_text(F.lpad((key % 99991).cast("string"), 5, "0"), state, "00100", F.lit(n)))
            .alias("plan_id"),
            F.when((key + n) % 3 == 0, F.col("c_name")).alias("plan_sponsor_name"),
            F.when((key + n) % 2 == 0, "individual").otherwise("group").alias("plan_market_type"),
        )

    n_files = (_remainder("o_orderkey", 4)).cast("int")
    files = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), n_files),
        lambda i: F.struct(
            F.lit("rates").alias("description"),
            F.concat(
                F.lit("https://example.org/"), F.col("o_custkey").cast("string"), F.lit("/"),
                i.cast("string"),
            ).alias("location"),
        ),
    )
    structures = F.transform(
        F.array(F.lit(0), F.lit(2)),
        lambda first: F.struct(
            F.when(first == 0, F.array(plan(0), plan(1))).otherwise(F.array(plan(2))).alias("reporting_plans"),
            files.alias("in_network_files"),
        ),
    )
    document = F.struct(
        F.col("c_name").alias("reporting_entity_name"),
        F.lit("issuer").alias("reporting_entity_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_updated_on"),
        F.lit("2.0.0").alias("version"),
        structures.alias("reporting_structure"),
        F.lit("ignored").alias("unknown_field"),
    )
    texts = rows.select(
        _text("order-", F.col("o_orderkey")).alias("source_file"), F.to_json(document).alias("text")
    )
    return parse_documents(texts, "text", "source_file", TOC_DOCUMENT)


def toc_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc_source.structures(toc_documents(spark, sf_dir))


# --- in-network rates ------------------------------------------------------------------------


def _npi(key: Column, n: Column | int) -> Column:
    return (F.lit(1_000_000_000) + key * 10 + n).cast("bigint")


def _group(key: Column, n_npis: Column, business_name: Column) -> Column:
    return F.struct(
        F.transform(
            F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), n_npis.cast("int")),
            lambda i: _npi(key, i),
        ).alias("npi"),
        F.struct(
            F.when(key % 2 == 0, "ein").otherwise("npi").alias("type"),
            F.lpad((key % 1_000_000_000).cast("string"), 9, "0").alias("value"),
            business_name.alias("business_name"),
        ).alias("tin"),
    )


def in_network_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in-network document per order: an item with two rates, and two references.

    Every fifth order writes its provider groups into the rates instead.
    """
    orders = dealt(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    supplier, part, line = F.col("o_custkey") % 1000, key % 20011, key % 7
    embedded = key % 5 == 0
    references = F.array(
        F.struct(
            supplier.alias("provider_group_id"),
            F.array(F.col("o_orderpriority")).alias("network_name"),
            F.array(_group(supplier, line % 3 + 1, F.lit("Clinic"))).alias("provider_groups"),
        ),
        F.struct(
            (supplier + 100_000).alias("provider_group_id"),
            F.array(F.col("o_orderpriority")).alias("network_name"),
            F.array(_group(part, line % 3, F.lit(""))).alias("provider_groups"),
        ),
    )

    def price(kind: str, amount: Column, billing_class: str) -> Column:
        return F.struct(
            F.lit(kind).alias("negotiated_type"),
            amount.alias("negotiated_rate"),
            F.lit(billing_class).alias("billing_class"),
            F.when(F.col("o_orderstatus") == "F", "inpatient").otherwise("outpatient").alias("setting"),
            F.lit("9999-12-31").alias("expiration_date"),
            F.array(F.lit("11"), F.lit("22")).alias("service_code"),
            F.when(F.col("o_orderstatus") == "O", "see contract").alias("additional_information"),
        )

    one = F.array(price("negotiated", F.col("o_totalprice"), "professional"))
    two = F.array(
        price("negotiated", F.col("o_totalprice"), "professional"),
        price("fee schedule", (line + 1).cast("double"), "institutional"),
    )
    groups = F.array(
        _group(supplier, line % 3, F.lit("Clinic")), _group(part, F.lit(1), F.lit(""))
    )
    rates = F.array(
        F.struct(
            F.when(~embedded, F.array(supplier, supplier + 100_000)).alias("provider_references"),
            F.when(embedded, groups).alias("provider_groups"),
            two.alias("negotiated_prices"),
        ),
        F.struct(
            F.when(~embedded, F.array(supplier + 100_000)).alias("provider_references"),
            F.when(embedded, F.array(_group(part, F.lit(2), F.lit("Lab")))).alias("provider_groups"),
            one.alias("negotiated_prices"),
        ),
    )
    bundled = F.array(
        F.struct(
            F.lit("CPT").alias("billing_code_type"),
            part.cast("string").alias("billing_code"),
            _text(F.col("o_orderpriority"), " & <more>").alias("description"),
        )
    )
    item = F.struct(
        F.when(line % 2 == 0, "bundle").otherwise("ffs").alias("negotiation_arrangement"),
        F.col("o_orderpriority").alias("name"),
        F.lit("CPT").alias("billing_code_type"),
        F.lit("2024").alias("billing_code_type_version"),
        part.cast("string").alias("billing_code"),
        F.col("o_orderstatus").alias("description"),
        rates.alias("negotiated_rates"),
        F.when(line % 2 == 0, bundled).alias("bundled_codes"),
    )
    document = F.struct(
        F.lit("Insurer").alias("reporting_entity_name"),
        F.lit("issuer").alias("reporting_entity_type"),
        F.when(line % 3 == 0, F.lit("Gold")).alias("plan_name"),
        F.lit("2024-07-01").alias("last_updated_on"),
        F.lit("2.0.0").alias("version"),
        references.alias("provider_references"),
        F.array(item).alias("in_network"),
    )
    texts = orders.select(
        _text("order-", key).alias("source_file"), F.to_json(document).alias("text")
    )
    return parse_documents(texts, "text", "source_file", IN_NETWORK_DOCUMENT)


def in_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = in_network_documents(spark, sf_dir)
    return in_network_source.items(documents), in_network_source.references(documents)


def allowed_npis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NPIs derived from every supplier with a positive balance."""
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return suppliers.select(
        F.explode(F.array(_npi(F.col("s_suppkey"), 0), _npi(F.col("s_suppkey"), 2))).alias("npi")
    ).distinct()


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as in-network items of a few large files, with provider groups in the rates."""
    orders = dealt(table(spark, sf_dir, "orders"))
    key = F.col("o_custkey")
    rates = F.array(
        F.struct(
            F.array(_group(key, key % 3, F.lit("Clinic")), _group(key + 1, F.lit(1), F.lit(""))).alias("provider_groups"),
        ),
        F.struct(
            F.when(F.col("o_orderstatus") == "F", F.array(_group(key + 2, F.lit(2), F.lit("Lab")))).alias("provider_groups"),
        ),
    )
    return orders.select(
        F.when(F.col("o_orderstatus") == "F", "file-a").otherwise("file-b").alias("source_file"),
        F.col("o_orderkey").alias("item_ord"),
        F.struct(rates.alias("negotiated_rates")).alias("item"),
    )


# --- hospital files --------------------------------------------------------------------------

_TALL_HEADER = [
    "description", "setting", "code|1", "code|1|type", "code | 2", "code|2| type",
    "standard_charge|gross", "standard_charge|discounted_cash", "Payer_Name", "plan_name",
    "standard_charge|negotiated_dollar", "standard_charge|methodology", "modifiers",
]
_WIDE_HEADER = [
    "code|1", "code|1|type", "description", "standard_charge|gross", "setting",
    "standard_charge|Acme_Health|Gold|negotiated_dollar",
    "standard_charge|Acme_Health|Gold|methodology", "estimated_amount|Acme_Health|Gold",
    "standard_charge|Beta|PPO_Plus|negotiated_percentage", "additional_payer_notes|Beta|PPO_Plus",
]
_META_NAMES = [
    "hospital_name", "last_updated_on", "version", "hospital_location", "hospital_address",
    "license_number|NY", "To the best of its knowledge and belief, all is included",
]


def _csv_records(spark: SparkSession, sf_dir: str, columns: list[str], cells: list[Column]) -> DataFrame:
    """Line items as CSV cells of two files that share a column set."""
    headers = spark.createDataFrame(
        [
            (f"hospital-{n}", _META_NAMES, [f"Hospital {n}", "7/1/2024", "2.2.0", "Main", "1 Main St", f"L{n}", "TRUE"], columns)
            for n in (0, 1)
        ],
        "source_file string, names array<string>, values array<string>, columns array<string>",
    )
    rows = spread(table(spark, sf_dir, "lineitem")).select(
        _text("hospital-", F.col("l_suppkey") % 2).alias("source_file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_ord"),
        F.floor(F.col("l_orderkey") / (1 << 17)).alias("row_chunk"),
        F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("cells"),
    )
    return lookup_join(
        rows, hospital_csv.layouts(headers), ["source_file"], lookup_bytes=10_000, spread=["row_ord"]
    )


def _dollars(c: Column) -> Column:
    return _text(" $", F.format_number(c, 2), " ")


def _tall_cells() -> list[Column]:
    odd = _remainder("l_linenumber", 2) == 1
    return [
        _text("  item ", F.col("l_partkey"), " "),
        F.when(F.col("l_returnflag") == "A", "inpatient").otherwise("outpatient"),
        F.col("l_partkey"),
        F.lit(" cpt "),
        F.when(odd, F.col("l_suppkey")),
        F.when(_remainder("l_linenumber", 3) == 0, "CPT").otherwise("unknown"),
        _dollars(F.col("l_extendedprice")),
        F.when(odd, F.lit("N/A")).otherwise(F.col("l_quantity").cast("string")),
        F.when(_remainder("l_linenumber", 4) != 0, F.col("l_returnflag")),
        F.lit("PPO"),
        F.when(F.col("l_linestatus") == "O", F.format_number("l_extendedprice", 2)),
        F.lit("fee schedule"),
        F.when(odd, "26|TC"),
    ]


def _wide_cells() -> list[Column]:
    line = F.col("l_linenumber")
    return [
        F.col("l_partkey"),
        F.lit("HCPCS"),
        _text("item ", F.col("l_partkey")),
        _dollars(F.col("l_extendedprice")),
        F.lit("both"),
        F.when(line % 2 == 0, F.format_number(F.col("l_extendedprice"), 2)),
        F.when(line % 2 == 0, "case rate"),
        F.when(line % 4 == 0, F.col("l_quantity")),
        F.when(line % 3 == 0, F.col("l_quantity")),
        F.when(line == 7, " see notes "),
    ]


def tall_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_records(spark, sf_dir, _TALL_HEADER, _tall_cells())


def wide_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_records(spark, sf_dir, _WIDE_HEADER, _wide_cells())


def write_hospital_csvs(spark: SparkSession, sf_dir: str, path: str, files: int = 24) -> None:
    """Line items as CSV files of hospitals, the even ones tall, the odd ones wide: ``path``/file=n/*.csv."""
    width = max(len(_TALL_HEADER), len(_WIDE_HEADER))

    def padded(cells: list[Column]) -> Column:
        return F.array(*[c.cast("string") for c in cells], *[F.lit(None).cast("string")] * (width - len(cells)))

    file, is_tall = F.col("l_suppkey") % files, F.col("l_suppkey") % 2 == 0
    data = spread(table(spark, sf_dir, "lineitem")).select(
        file.alias("file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"),
        F.when(is_tall, padded(_tall_cells())).otherwise(padded(_wide_cells())).alias("cells"),
    )
    n = F.col("file")
    values = [_text("Hospital ", n), F.lit("7/1/2024"), F.lit("2.2.0"), F.lit("Main"), F.lit("1 Main St"), _text("L", n), F.lit("TRUE")]
    names = [
        padded([F.lit(c) for c in _META_NAMES]),
        padded(values),
        F.when(n % 2 == 0, padded([F.lit(c) for c in _TALL_HEADER])).otherwise(padded([F.lit(c) for c in _WIDE_HEADER])),
    ]
    headers = data.select("file").distinct().select("file", F.posexplode(F.array(*names)).alias("at", "cells"))
    (
        headers.withColumn("at", F.col("at") - 3)
        .unionByName(data)
        # A task for each file; a hash would give some tasks several files and others none.
        .repartitionById(files, F.pmod(F.coalesce("file", F.lit(0)), F.lit(files)).cast("int"))
        .sortWithinPartitions("file", "at")
        .select("file", *[F.col("cells")[i].alias(f"c{i}") for i in range(width)])
        .write.partitionBy("file")
        .options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def hospital_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hospital document per order, version 2 or 3, with one item of two charges."""
    orders = dealt(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    is_v3 = key % 2 == 0
    total = F.col("o_totalprice")
    payer = F.struct(
        F.col("o_orderpriority").alias("payer_name"),
        F.lit("PPO").alias("plan_name"),
        F.lit("fee schedule").alias("methodology"),
        total.alias("standard_charge_dollar"),
        F.when(is_v3, total + 1).alias("median_amount"),
        F.when(is_v3, "11").alias("count"),
    )
    other = F.struct(
        F.lit("Other").alias("payer_name"),
        F.lit("").alias("plan_name"),
        F.lit("").alias("methodology"),
        F.lit(None).cast("double").alias("standard_charge_dollar"),
        F.lit(None).cast("double").alias("median_amount"),
        F.lit(None).cast("string").alias("count"),
    )
    charges_ = F.array(
        F.struct(
            F.lit("inpatient").alias("setting"),
            F.when(is_v3, total).alias("gross_charge"),
            F.when(~is_v3, F.format_number(total, 2)).alias("gross_charges"),
            F.when(key % 3 == 0, F.array(F.lit("26"), F.lit("TC"))).alias("modifier_code"),
            F.when(key % 5 != 0, F.array(payer, other)).alias("payers_information"),
        ),
        F.struct(
            F.lit("outpatient").alias("setting"),
            F.lit(None).cast("double").alias("gross_charge"),
            F.lit("").alias("gross_charges"),
            F.lit(None).cast("array<string>").alias("modifier_code"),
            F.when(key % 7 == 0, F.array(payer)).alias("payers_information"),
        ),
    )
    item = F.struct(
        _text("item ", key).alias("description"),
        F.array(
            F.struct(key.cast("string").alias("code"), F.lit("cpt").alias("type")),
            F.struct(F.lit("0250").alias("code"), F.lit("RC").alias("type")),
            F.struct(F.col("o_custkey").cast("string").alias("code"), F.lit("CPT").alias("type")),
        ).alias("code_information"),
        F.when(key % 4 == 0, F.struct(F.lit("1,000.5").alias("unit"), F.lit("ML").alias("type"))).alias("drug_information"),
        F.when(key % 11 != 0, charges_).alias("standard_charges"),
    )
    modifier = F.struct(
        F.lit("assistant").alias("description"),
        F.lit("AS").alias("code"),
        F.array(
            F.struct(F.col("o_orderpriority").alias("payer_name"), F.lit("PPO").alias("plan_name"), F.lit("85%").alias("description")),
            F.struct(F.lit("Other").alias("payer_name"), F.lit("HMO").alias("plan_name"), F.lit("90%").alias("description")),
        ).alias("modifier_payer_information"),
    )
    document = F.struct(
        F.lit("General").alias("hospital_name"),
        F.lit("2024-07-01").alias("last_updated_on"),
        F.when(is_v3, "3.0.0").otherwise("2.2.0").alias("version"),
        F.array(F.lit("East"), F.lit("West")).alias(  # one of the two names per version
            "hospital_location"
        ),
        F.when(is_v3, F.array(F.lit("North"))).alias("location_name"),
        F.array(F.lit("1 Main St"), F.lit("2 Main St")).alias("hospital_address"),
        F.struct(F.lit("L1").alias("license_number"), F.lit("NY").alias("state")).alias("license_information"),
        F.when(~is_v3, F.struct(F.lit(True).alias("confirm_affirmation"))).alias("affirmation"),
        F.when(is_v3, F.struct(F.lit(True).alias("confirm_attestation"), F.lit("Dr A").alias("attester_name"))).alias("attestation"),
        F.array(item).alias("standard_charge_information"),
        F.array(modifier).alias("modifier_information"),
    )
    texts = orders.select(_text("order-", key).alias("source_file"), F.to_json(document).alias("text"))
    return parse_documents(texts, "text", "source_file", HOSPITAL_DOCUMENT)


# --- rows that break rules -----------------------------------------------------------------------


def _breaking(orders: DataFrame, valid: dict[str, object], breaks: list[dict[str, object]]) -> DataFrame:
    """One row per order: the i-th of n changes where o_orderkey % (n + 1) is i, unchanged where it is n."""
    k = F.col("o_orderkey") % (len(breaks) + 1)
    columns = []
    for name, value in valid.items():
        out = F.lit(value) if not isinstance(value, Column) else value
        for i, change in enumerate(breaks):
            if name in change:
                new = change[name]
                out = F.when(k == i, new if isinstance(new, Column) else F.lit(new)).otherwise(out)
        columns.append(out.alias(name))
    return orders.select(*columns)


def broken_charges(orders: DataFrame) -> DataFrame:
    """Charge rows, in the order of the charge rules."""
    valid = {
        "description": "Visit", "setting": "inpatient", "cpt_code": "99213", "gross_charge": F.col("o_totalprice"),
        "negotiated_dollar": 5.0, "negotiated_percentage": F.lit(None).cast("double"), "min_charge": 1.0, "max_charge": 9.0,
        "payer_name": F.col("o_orderpriority"), "plan_name": "PPO", "methodology": "fee_schedule", "modifiers": F.lit(None).cast("string"),
        "ndc_code": F.lit(None).cast("string"), "drug_unit_of_measurement": F.lit(None).cast("double"), "billing_class": "facility",
        "last_updated_on": "2024-07-01",
    }
    return as_charges(
        _breaking(
            orders,
            valid,
            [
                {"setting": "elsewhere"},
                {"payer_name": None},
                {"cpt_code": None},
                {"methodology": "other"},
                {"gross_charge": None, "negotiated_dollar": None},
                {"min_charge": None},
                {"negotiated_dollar": None, "negotiated_percentage": 50.0},
                {"ndc_code": "0002-1433"},
                {"cpt_code": None, "modifiers": "26", "negotiated_dollar": None},
                {"drug_unit_of_measurement": 1.0},
                {"methodology": "guess"},
                {"billing_class": "hotel"},
                {"gross_charge": 0.0},
                {"last_updated_on": "soon"},
            ],
        )
    )


def broken_version_3(orders: DataFrame, version: str) -> DataFrame:
    """Payer values of version 3, in the order of its rules."""
    valid = {
        "version": version, "negotiated_percentage": 50.0, "count": "11", "median_amount": 1.0, "percentile_10th": 1.0,
        "percentile_90th": F.col("o_totalprice"), "additional_payer_notes": F.lit(None).cast("string"),
    }
    return as_charges(
        _breaking(orders, valid, [{"count": None}, {"median_amount": None}, {"count": "0"}, {"count": "many"}, {"percentile_10th": -1.0}])
    )


def broken_structures(orders: DataFrame) -> DataFrame:
    """Reporting structures, in the order of their rules."""
    plan = dict(
        plan_name=F.lit("Gold"), issuer_name=F.lit("Acme"), plan_id_type=F.lit("hios"), plan_id=F.col("o_orderkey").cast("string"),
        plan_sponsor_name=F.lit(None).cast("string"), plan_market_type=F.lit("group"),
    )

    def plans(**changes: str) -> Column:
        return F.array(F.struct(*[(F.lit(changes[n]) if n in changes else c).alias(n) for n, c in plan.items()]))

    def location(url: str) -> Column:
        return F.struct(F.lit("rates").alias("description"), F.lit(url).alias("location"))

    good = location("https://example.org/a")
    valid = {"reporting_plans": plans(), "in_network_files": F.array(good), "allowed_amount_file": good}
    return _breaking(
        orders,
        valid,
        [
            {"reporting_plans": F.slice(plans(), 1, 0)},
            {"in_network_files": F.slice(F.array(good), 1, 0), "allowed_amount_file": None},
            {"in_network_files": F.array(good, location("http://example.org/a"))},
            {"allowed_amount_file": location("ftp://example.org/a")},
            {"reporting_plans": plans(plan_id_type="ssn")},
            {"reporting_plans": plans(plan_market_type="street")},
            {"reporting_plans": plans(plan_id_type="ein")},
            {"reporting_plans": plans(plan_name="")},
        ],
    )


def broken_rates(orders: DataFrame) -> DataFrame:
    """Rate rows, in the order of the rate rules."""
    none = F.lit(None).cast("string")
    valid = {
        "negotiation_arrangement": "ffs", "billing_code_type": "CPT", "negotiated_type": "negotiated", "billing_class": "professional",
        "setting": "inpatient", "negotiated_rate": F.col("o_totalprice"), "expiration_date": "2025-01-01", "service_code": F.array(F.lit("11")),
        "plan_name": none, "plan_id_type": none, "plan_id": none, "plan_market_type": none, "issuer_name": none, "plan_sponsor_name": none,
    }
    plan = {"plan_name": "Gold", "plan_id_type": "ein", "plan_id": "12-3456789", "plan_market_type": "group", "issuer_name": "Acme"}
    return _breaking(
        orders,
        valid,
        [
            {"negotiation_arrangement": "barter"},
            {"billing_code_type": "ABC"},
            {"negotiated_type": "guessed"},
            {"billing_class": "hotel"},
            {"setting": "elsewhere"},
            {"negotiated_rate": 0.0},
            {"expiration_date": "soon"},
            {"service_code": None},
            {"service_code": F.array(F.lit("11"), F.lit("CSTM-00"))},
            {"plan_name": "Gold"},
            plan,
        ],
    )


def broken_providers(orders: DataFrame) -> DataFrame:
    """Provider rows, in the order of the provider rules."""
    valid = {"npi": F.lit(1_000_000_000) + F.col("o_orderkey"), "tin_type": "ein", "tin_value": "12-3456789", "business_name": "Clinic"}
    return _breaking(
        orders,
        valid,
        [{"npi": F.col("o_orderkey") + 1}, {"tin_type": "ssn"}, {"tin_value": "123"}, {"tin_type": "npi", "tin_value": "0123456789"}, {"business_name": None}],
    )


# --- files ------------------------------------------------------------------------------------


def _separated(*by: str) -> Column:
    """``value``, after a comma if it is an element and not the first of its list; elements may share a place."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("at"))
    return F.when(F.col("listed") & (place > 1), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value")


def write_json_files(header: DataFrame, arrays: dict[str, DataFrame], path: str) -> None:
    """One JSON document per ``file``: ``path``/file=x/*.json, elements a line each, so no document is one row.

    ``header`` has (file, text): an object with at least one field. Each array has (file, at, text); elements are in the order of ``at``.
    """

    def line(part: int, value: Column, at: Column = F.lit(0), listed: bool = False) -> list[Column]:
        return [F.col("file"), F.lit(part).alias("part"), at.cast("bigint").alias("at"), value.alias("value"), F.lit(listed).alias("listed")]

    lines, number = header.select(line(0, F.expr("left(text, length(text) - 1)"))), 0
    for name, elements in arrays.items():
        number += 2
        opening = header.select(line(number - 1, F.lit(f',"{name}":[')))
        listed = elements.where("file is not null and text is not null").select(line(number, F.col("text"), F.col("at"), True))
        closing = header.select(line(number, F.lit("]"), F.lit((1 << 63) - 1)))
        lines = lines.unionByName(opening).unionByName(listed).unionByName(closing)
    dealt = lines.unionByName(header.select(line(number + 1, F.lit("}")))).repartition("file")
    (
        dealt.select("file", "part", "at", _separated("file", "part"))
        .sortWithinPartitions("file", "part", "at")
        .select("file", "value")
        .write.partitionBy("file")
        .text(path)
    )


#: Orders per file and, as file and version have to agree in being even, files are added eight at a time.
ORDERS_PER_FILE = 20_000


def json_file_count(orders: int) -> int:
    """Files that so many orders are dealt to: a file read whole is one row, so its size must not grow with the tables."""
    return 8 * max(1, -(-orders // (8 * ORDERS_PER_FILE)))


def write_toc_files(structures: DataFrame, path: str, files: int | None = None) -> None:
    """Reporting structures of orders as documents of several orders each."""
    files = files or json_file_count(structures.count() // 2)
    key = F.split("source_file", "-")[1].cast("bigint")
    elements = structures.select(
        (key % files).alias("file"),
        (key * 4 + F.col("structure_id")).alias("at"),
        F.to_json(F.struct("reporting_plans", "in_network_files")).alias("text"),
    )
    header = F.struct(*[F.lit(v).alias(n) for n, v in (("reporting_entity_name", "Payer"), ("reporting_entity_type", "issuer"), ("last_updated_on", "2024-07-01"), ("version", "2.0.0"))])
    headers = elements.select("file").distinct().withColumn("text", F.to_json(header))
    write_json_files(headers, {"reporting_structure": elements}, path)


def write_in_network_files(documents: DataFrame, path: str, files: int | None = None) -> None:
    """Items and references of orders as documents of several orders each."""
    files = files or json_file_count(documents.count())
    key = F.split("source_file", "-")[1].cast("bigint")

    def elements(array: str) -> DataFrame:
        rows = documents.select((key % files).alias("file"), key.alias("key"), F.posexplode(array).alias("n", "element"))
        return rows.select("file", (F.col("key") * 4 + F.col("n")).alias("at"), F.to_json("element").alias("text"))

    header = F.struct(*[F.lit(v).alias(n) for n, v in (("reporting_entity_name", "Insurer"), ("reporting_entity_type", "issuer"), ("last_updated_on", "2024-07-01"), ("version", "2.0.0"))])
    headers = documents.select((key % files).alias("file")).distinct().withColumn("text", F.to_json(header))
    write_json_files(headers, {"provider_references": elements("provider_references"), "in_network": elements("in_network")}, path)


def write_hospital_json_files(documents: DataFrame, path: str, files: int | None = None) -> None:
    """Items of orders as documents of one version each; file and version agree in being even."""
    files = files or json_file_count(documents.count())
    key = F.split("source_file", "-")[1].cast("bigint")
    rows = documents.withColumn("file", key % files)
    items = rows.select("file", key.alias("at"), F.to_json(F.col("standard_charge_information")[0]).alias("text"))
    fields = [c for c in documents.columns if c not in ("source_file", "standard_charge_information", "modifier_information")]
    headers = rows.groupBy("file").agg(F.first(F.to_json(F.struct(*fields))).alias("text"))
    modifiers = rows.select("file", key.alias("at"), F.to_json(F.col("modifier_information")[0]).alias("text"))
    write_json_files(headers, {"standard_charge_information": items, "modifier_information": modifiers}, path)


def _write_one_json(entries: DataFrame, path: str, opening: str, closing: str) -> None:
    """One JSON text of (at, text) entries, a line each."""
    lines = entries.where("text is not null").select(F.lit(1).alias("part"), "at", F.col("text").alias("value"), F.lit(True).alias("listed"))
    end = entries.agg(F.min("at").alias("at"))
    for part, text in ((0, opening), (2, closing)):
        lines = lines.unionByName(end.select(F.lit(part).alias("part"), "at", F.lit(text).alias("value"), F.lit(False).alias("listed")))
    one = lines.coalesce(1)
    one.select("part", "at", _separated("part")).sortWithinPartitions("part", "at").select("value").write.text(path)


def write_npi_list(npis: DataFrame, path: str) -> None:
    """A JSON array of objects."""
    text = F.concat(F.lit('{"npi":"'), F.col("npi").cast("string"), F.lit('"}'))
    _write_one_json(npis.select(F.col("npi").alias("at"), text.alias("text")), path, "[", "]")


# --- plan matching -----------------------------------------------------------------------------

_STATES = ["NY", "CA", "TX", "FL", "WA"]
_METALS = ["Bronze", "Silver", "Gold", "Platinum"]
_TYPES = ["HMO", "PPO", "EPO"]


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plans; every tenth is an employer plan without a state."""
    key = F.col("p_partkey")
    is_ein = key % 10 == 0
    parts = table(spark, sf_dir, "part")
    # A plan is listed under each combination of its attributes.
    return dealt(parts, 20_000).select(
        F.when(is_ein, "ein").otherwise("hios").alias("plan_id_type"),
        F.when(is_ein, _text("12-", F.lpad(key.cast("string"), 7, "0")))
        .otherwise(_text(F.lpad(key.cast("string"), 9, "0"))).alias("plan_id"),
        _text(F.col("p_name"), " ", F.col("p_type")).alias("plan_name"),
        _text(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")), " Health").alias("issuer_name"),
        F.substring(F.col("p_brand"), 7, 5).alias("issuer_id"),
        F.when(~is_ein, _pick(_STATES, key % 5)).alias("state"),
        F.lit("individual").alias("market_type"),
        _pick(_METALS, F.col("p_size") % 4).alias("metal_level"),
        _pick(_TYPES, F.col("p_size") % 3).alias("plan_type"),
        F.lit(None).cast("string").alias("network_url"),
    )


def match_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as consumers who remember a plan roughly."""
    suppliers, parts = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    key = F.col("s_suppkey")
    return suppliers.join(parts, F.col("p_partkey") == key * 7).select(
        key.alias("input_id"),
        _text(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))).alias("issuer_name"),
        F.when(key % 3 == 0, _text(F.col("p_name"), " ", F.col("p_type")))
        .otherwise(_text(F.col("p_name"), " saver")).alias("plan_name"),
        _pick(_STATES, key % 5).alias("state"),
        F.when(key % 4 != 0, _pick(_METALS, key % 4)).alias("metal_level"),
        _pick(_TYPES, key % 3).alias("plan_type"),
        F.lit(None).cast("string").alias("employer_name"),
        F.when(key % 6 == 0, _text("12", F.lpad((key * 10).cast("string"), 7, "0"))).alias("employer_ein"),
    )


def aliased_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same consumers: every other one knows the issuer by an alias, some name their employer instead of its EIN."""
    key = F.col("input_id")
    brand = F.element_at(F.split("issuer_name", " "), -1)
    return (
        match_inputs(spark, sf_dir)
        .withColumn("issuer_name", F.when(key % 2 == 0, _text("Mutual ", brand)).otherwise(F.col("issuer_name")))
        .withColumn("employer_name", F.when(key % 6 == 3, _text("Employer No. ", key)))
    )


def write_issuer_aliases(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``{"17": ["Mutual 17", "17 Group"], ...}``: every issuer by its number."""
    number = F.substring("p_brand", 7, 5)
    issuers = table(spark, sf_dir, "part").select(number.alias("at")).distinct()
    names = F.to_json(F.array(_text("Mutual ", F.col("at")), _text(F.col("at"), " Group")))
    _write_one_json(issuers.select("at", F.concat(F.lit('"'), "at", F.lit('":'), names).alias("text")), path, "{", "}")


def write_employer_eins(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``{"Employer No. 3": "12-0000030", ...}``: suppliers as employers."""
    key = F.col("s_suppkey")
    text = _text('"Employer No. ', key, '":"12-', F.lpad((key * 10).cast("string"), 7, "0"), '"')
    _write_one_json(table(spark, sf_dir, "supplier").select(key.alias("at"), text.alias("text")), path, "{", "}")


# --- small inputs --------------------------------------------------------------------------------


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue per customer and year as maps; a map has one entry per year."""
    per_year = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.floor("o_totalprice")).alias("revenue"),
        )
    )
    year = F.col("year").cast("string")
    return per_year.groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct(year, "n"))).alias("orders"),
        F.map_from_entries(F.collect_list(F.struct(year, "revenue"))).alias("revenue"),
    )


def code_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as consumer descriptions of part numbers, some given twice, some empty."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    first = parts.select(
        F.lit(" cpt ").alias("code_type"), key.cast("string").alias("code"),
        F.lower("p_type").alias("consumer_description"), key.alias("at"),
    )
    later = parts.where(key % 4 == 0).select(
        F.lit("CPT").alias("code_type"), _text(" ", key).alias("code"),
        F.when(key % 8 == 0, "").otherwise(F.col("p_brand")).alias("consumer_description"),
        (key + (1 << 40)).alias("at"),
    )
    return latest_descriptions(first.unionByName(later), "at")
