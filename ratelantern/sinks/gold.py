"""Tables laid out for point lookups, next to the star they are made from.

The star keeps each fact once, so a question about one code joins four large tables. Here the joins
are done once and the rows are dealt to files by sampled splitters over all of a table's sort columns, then
sorted. A filter on the leading column reads the row groups of that value alone; a code so frequent that it
fills many files is split by the columns after it.

``code_prices``          charges with payer charges of each code    code, code_type, hospital, item, charge
``item_prices``          charges with payer charges of each item    description, hospital, item, charge
``described_items``      items                                      description, hospital, item
``search_entries``       described codes with hospitals counted     lower-case code, code, type, description
``search_descriptions``  the same                                   description_id, code, type
``search_grams``         postings: three characters of a lower-case description (fewer at its end) to description_id
``search_gram_counts``   how many postings each of them has
"""

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelantern.fixed_values import CODE_COLUMNS
from ratelantern.functions.clean import empty_if_null
from ratelantern.functions.codes import unpivot_codes
from ratelantern.operators.star import described_hospitals, items, loaded_text, met_charges, packed_ids, priced_columns, unpacked_ids
from ratelantern.plans.compare import in_order, selected_charges
from ratelantern.plans.search import Star, described_codes
from ratelantern.session import shuffles_freed

#: Sort columns; the first ones are what lookups filter by.
GOLD_TABLES = {
    "code_prices": ["code", "code_type", "hospital_id", "item_id", "standard_charge_id", "payer_charge_id"],
    "item_prices": ["description", "hospital_id", "item_id", "standard_charge_id", "payer_charge_id"],
    "described_items": ["description", "hospital_id", "item_id"],
    "search_entries": ["code_key", "code", "code_type", "description"],
    "search_descriptions": ["description_id", "code", "code_type"],
    "search_grams": ["gram", "description_id"],
    "search_gram_counts": ["gram"],
}
#: Made from one another, so they are written together.
SEARCH_TABLES = {"search_entries", "search_descriptions", "search_grams", "search_gram_counts"}
GRAM = 3
HASH_IDS = ("hospital_id", "item_id", "standard_charge_id", "payer_charge_id", "payer_id", "plan_id")


def description_id() -> Column:
    """Equal for equal descriptions; lookups compare the descriptions themselves again."""
    return F.xxhash64("description")


def _entries(star: Star) -> DataFrame:
    described = described_hospitals(star["charge_rows"]) if "charge_rows" in star else described_codes(star)
    return (
        packed_ids(described, "hospital_id").groupBy("code", "code_type", "description")
        .agg(F.count_distinct("hospital_id").alias("hospital_count"))
        .withColumns({"code_key": F.lower("code"), "description_id": description_id()})
    )


def _grams(entries: DataFrame) -> DataFrame:
    text = F.lower("description")
    at = F.sequence(F.lit(1), F.length(text))
    grams = F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))
    texts = entries.select("description", "description_id").where(F.length("description") > 0).distinct()
    return texts.select(F.explode(grams).alias("gram"), "description_id").distinct()


def write_clustered(
    df: DataFrame, path: str, keys: list[str], rows_per_group: int | None = None, files: int | None = None, ids: Collection[str] = ()
) -> None:
    """Rows dealt to files by ranges of ``keys`` and sorted, with narrow row groups.

    Without ``files`` there are as many ranges as shuffle partitions, and adaptive execution merges the small ones.
    ``ids`` of ``hash_id`` are moved as bytes.
    """
    names = [c for c in df.columns if c in ids]
    ranges = _ranges(packed_ids(df, *names) if names else df, keys, files)
    _write_sorted(unpacked_ids(ranges, *names) if names else ranges, path, keys, rows_per_group)


def _ranges(df: DataFrame, keys: list[str], files: int | None) -> DataFrame:
    return df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)


def _write_sorted(dealt: DataFrame, path: str, keys: list[str], rows_per_group: int | None) -> None:
    writer = (
        dealt.sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", 64 << 20)
        .option("parquet.page.size", 64 << 10)
    )
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    with shuffles_freed(dealt.sparkSession):
        writer.parquet(path)


def _dealt_code_prices(rows: DataFrame, files: int | None) -> DataFrame:
    """``code_prices`` from charge rows in one shuffle: rows are dealt with their codes, so those of an item meet where they are written."""
    kept = ["code", "code_type"]
    codes = list(CODE_COLUMNS.values())
    needed = priced_columns(rows, *codes)
    unfolded = unpivot_codes(needed, *(c for c in needed.columns if c not in codes))
    of = [*kept, "hospital_id"]
    priced = met_charges(_ranges(unfolded, [*of, "item_id"], files), *kept, of=of)
    return in_order(priced.withColumnRenamed("standard_charge_dollar", "negotiated_dollar"), kept)


def _dealt_item_prices(rows: DataFrame, files: int | None) -> DataFrame:
    """``item_prices`` likewise. Rows of an item differ in their description only as null and empty do."""
    text = empty_if_null(loaded_text(F.col("description"))).alias("_text")
    of = ["_text", "hospital_id"]
    needed = priced_columns(rows.select("*", text), "_text")
    return met_charges(_ranges(needed, [*of, "item_id"], files), of=of).drop("payer_name", "plan_name")


def write_gold(star: Star, path: str, rows_per_group: int | None = None, files: int | None = None, names: Collection[str] = GOLD_TABLES) -> None:
    """Write all tables, or those of ``names``; ``star`` is a stored star, or the stored ``charge_rows`` of one.

    From charge rows, which hold the ids, the same tables are made without storing and joining the star's.
    """
    spark = next(iter(star.values())).sparkSession

    def write(name: str, df: DataFrame) -> DataFrame:
        write_clustered(df, f"{path}/{name}", GOLD_TABLES[name], rows_per_group, files, HASH_IDS if "charge_rows" in star else ())
        return spark.read.parquet(f"{path}/{name}")

    def write_dealt(name: str, dealt: DataFrame) -> None:
        _write_sorted(dealt, f"{path}/{name}", GOLD_TABLES[name], rows_per_group)

    if "code_prices" in names and "charge_rows" in star:
        write_dealt("code_prices", _dealt_code_prices(star["charge_rows"], files))
    elif "code_prices" in names:
        write("code_prices", selected_charges(star).drop("code_id"))
    if "described_items" in names:
        write("described_items", items(star["charge_rows"]) if "charge_rows" in star else star["standard_charge_items"])
    if "item_prices" in names and "charge_rows" in star:
        write_dealt("item_prices", _dealt_item_prices(star["charge_rows"], files))
    elif "item_prices" in names:
        of_item = star["standard_charge_items"].select("item_id", "hospital_id", "description")
        charges = star["standard_charges"].withColumnRenamed("additional_notes", "charge_notes")
        payer_charges = star["payer_charges"].withColumnRenamed("additional_notes", "payer_notes")
        priced = charges.join(payer_charges, "standard_charge_id", "left")
        write("item_prices", of_item.join(priced, "item_id").select(of_item.columns + [c for c in priced.columns if c != "item_id"]))
    if SEARCH_TABLES & set(names):
        entries = write("search_entries", _entries(star))
        write("search_descriptions", entries)
        grams = write("search_grams", _grams(entries))
        write("search_gram_counts", grams.groupBy("gram").agg(F.count("*").alias("postings")))


def read_gold(spark: SparkSession, path: str, names: Collection[str] = GOLD_TABLES) -> Star:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
