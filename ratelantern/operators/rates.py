"""In-network files: rate rows, provider rows and the allow-list on NPIs.

Inputs, as produced by ``sources.in_network``:

* ``items``: one row per in-network item, with ``source_file``, ``item_ord``, the header
  fields of the file and the struct ``item``;
* ``references``: one row per provider reference, with ``source_file`` and the struct
  ``reference``.

Group ids are unique only within a file and a kind ("referenced" or "embedded"), so the key
of a provider group is (source_file, group_kind, provider_group_id).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelantern.functions.clean import empty_if_null, null_if_empty
from ratelantern.operators.joins import HOT_ROWS, skew_join
from ratelantern.operators.ordered import row_chunk, running_offset
from ratelantern.schemas import (
    CONTAINED_CODE_FIELDS,
    RATE_HEADER_OPTIONAL,
    RATE_HEADER_REQUIRED,
)

REFERENCED, EMBEDDED = "referenced", "embedded"
GROUP_KEY = ["source_file", "group_kind", "provider_group_id"]
RATE_KEY = ["source_file", "item_ord", "rate_ord"]
ITEM_FIELDS = [
    "negotiation_arrangement",
    "name",
    "billing_code_type",
    "billing_code_type_version",
    "billing_code",
    "description",
]
PRICE_FIELDS = ["negotiated_type", "billing_class", "setting", "expiration_date"]


def _provider_rows(groups: DataFrame) -> DataFrame:
    """(source_file, group_kind, provider_group_id, network_names, group) -> one row per NPI."""
    return groups.select(
        *GROUP_KEY,
        F.explode("group.npi").alias("npi"),
        empty_if_null(F.col("group.tin.type")).alias("tin_type"),
        empty_if_null(F.col("group.tin.value")).alias("tin_value"),
        null_if_empty(F.col("group.tin.business_name")).alias("business_name"),
        "network_names",
    )


def _referenced_groups(references: DataFrame) -> DataFrame:
    return references.select(
        "source_file",
        F.lit(REFERENCED).alias("group_kind"),
        F.col("reference.provider_group_id").alias("provider_group_id"),
        F.col("reference.network_name").alias("network_names"),
        F.explode("reference.provider_groups").alias("group"),
    )


def embedded_groups(items: DataFrame) -> DataFrame:
    """Provider groups written inside rates, numbered from 1 in document order per file."""
    within_item = F.flatten(
        F.transform(
            "item.negotiated_rates",
            lambda rate, rate_ord: F.transform(
                F.coalesce(rate["provider_groups"], F.array()),
                lambda group: F.struct(rate_ord.alias("rate_ord"), group.alias("group")),
            ),
        )
    )
    holders = items.select("source_file", "item_ord", within_item.alias("groups")).where(
        F.size("groups") > 0
    )
    offsets = running_offset(
        holders.select("source_file", "item_ord", F.size("groups").cast("bigint").alias("n")),
        by=["source_file"],
        order=["item_ord"],
        value="n",
        chunk=row_chunk(F.col("item_ord")),
    ).drop("n")
    return holders.join(offsets, ["source_file", "item_ord"]).select(
        "source_file",
        "item_ord",
        "offset",
        F.posexplode("groups").alias("position", "entry"),
    ).select(
        "source_file",
        "item_ord",
        F.col("entry.rate_ord").cast("int").alias("rate_ord"),
        F.lit(EMBEDDED).alias("group_kind"),
        (F.col("offset") + F.col("position") + 1).alias("provider_group_id"),
        F.lit(None).cast("array<string>").alias("network_names"),
        F.col("entry.group").alias("group"),
    )


def providers(
    items: DataFrame, references: DataFrame, allowed_npis: DataFrame | None = None
) -> DataFrame:
    """One row per provider group and NPI; with an allow-list only rows of listed NPIs."""
    embedded = embedded_groups(items).drop("item_ord", "rate_ord")
    rows = _provider_rows(_referenced_groups(references).unionByName(embedded))
    if allowed_npis is None:
        return rows
    return rows.join(allowed_npis.select("npi"), "npi", "left_semi").select(rows.columns)


def _surviving_groups(provider_rows: DataFrame) -> DataFrame:
    return provider_rows.select(*GROUP_KEY).distinct()


def _contained_codes_json(codes: Column) -> Column:
    filled = F.transform(
        codes,
        lambda c: F.struct(*[empty_if_null(c[f]).alias(f) for f in CONTAINED_CODE_FIELDS]),
    )
    text = F.to_json(filled)
    for plain, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.when(F.size(codes) > 0, text)


def _rate_groups(items: DataFrame) -> DataFrame:
    """One row per negotiated rate: fields of its item, its prices and its group ids.

    What later rows need is taken out of the nested item and rate first, so unfolding never
    copies the whole item onto each of its rates.
    """
    header = [F.coalesce(f, F.lit("")).alias(f) for f in RATE_HEADER_REQUIRED]
    flat = items.select(
        "source_file",
        "item_ord",
        *header,
        *RATE_HEADER_OPTIONAL,
        *[empty_if_null(F.col("item")[f]).alias(f) for f in ITEM_FIELDS],
        _contained_codes_json(F.col("item.bundled_codes")).alias("bundled_codes_json"),
        _contained_codes_json(F.col("item.covered_services")).alias("covered_services_json"),
        F.col("item.negotiated_rates").alias("_rates"),
    )
    carried = [c for c in flat.columns if c != "_rates"]
    return flat.select(*carried, F.posexplode("_rates").alias("rate_ord", "_rate")).select(
        *carried,
        "rate_ord",
        F.coalesce(F.size("_rate.provider_groups") > 0, F.lit(False)).alias("is_embedded"),
        F.col("_rate.provider_references").alias("provider_references"),
        F.col("_rate.negotiated_prices").alias("negotiated_prices"),
    )


def _kept_ids(ids: DataFrame) -> DataFrame:
    """(rate key, position, id) -> one ordered id list per rate; a list fits one document."""
    return ids.groupBy(*RATE_KEY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "provider_group_id"))),
            lambda e: e["provider_group_id"],
        ).alias("provider_group_ids")
    )


def _filtered_ids(items: DataFrame, surviving: DataFrame) -> DataFrame:
    """Ids of surviving groups per rate; rates left without any are absent."""
    referenced = (
        _rate_groups(items)
        .where(~F.col("is_embedded"))
        .select(
            *RATE_KEY,
            F.lit(REFERENCED).alias("group_kind"),
            F.posexplode("provider_references").alias("position", "provider_group_id"),
        )
    )
    embedded = embedded_groups(items).select(
        *RATE_KEY,
        "group_kind",
        F.lit(0).alias("position"),
        "provider_group_id",
    )
    kept = referenced.unionByName(embedded).join(surviving, GROUP_KEY, "left_semi")
    return _kept_ids(kept)


def rates(
    items: DataFrame,
    references: DataFrame | None = None,
    allowed_npis: DataFrame | None = None,
) -> DataFrame:
    """One row per item, negotiated rate and negotiated price.

    Without an allow-list referenced ids stay as written and embedded groups without NPIs
    are left out. With one, only ids of groups that keep an NPI stay and rates without ids go.
    """
    groups = _rate_groups(items)
    if allowed_npis is not None:
        surviving = _surviving_groups(providers(items, references, allowed_npis))
        rated = groups.join(_filtered_ids(items, surviving), RATE_KEY)
    else:
        referenced = groups.where(~F.col("is_embedded")).withColumn(
            "provider_group_ids", F.col("provider_references")
        )
        embedded_ids = _kept_ids(
            embedded_groups(items)
            .where(F.size("group.npi") > 0)
            .select(*RATE_KEY, F.lit(0).alias("position"), "provider_group_id")
        )
        embedded = groups.where("is_embedded").join(embedded_ids, RATE_KEY, "left")
        rated = referenced.unionByName(embedded)

    carried = [
        *RATE_KEY,
        *RATE_HEADER_REQUIRED,
        *RATE_HEADER_OPTIONAL,
        *ITEM_FIELDS,
        F.when(F.col("is_embedded"), EMBEDDED).otherwise(REFERENCED).alias("group_kind"),
        F.when(F.size("provider_group_ids") > 0, F.col("provider_group_ids")).alias(
            "provider_group_ids"
        ),
        "bundled_codes_json",
        "covered_services_json",
    ]
    priced = rated.select(
        *carried, F.posexplode("negotiated_prices").alias("price_ord", "price")
    )
    return priced.select(
        *RATE_KEY,
        "price_ord",
        *RATE_HEADER_REQUIRED,
        *RATE_HEADER_OPTIONAL,
        *ITEM_FIELDS,
        F.coalesce("price.negotiated_rate", F.lit(0.0)).alias("negotiated_rate"),
        *[empty_if_null(F.col("price")[f]).alias(f) for f in PRICE_FIELDS],
        F.col("price.service_code").alias("service_code"),
        F.col("price.billing_code_modifier").alias("billing_code_modifier"),
        null_if_empty(F.col("price.additional_information")).alias("additional_information"),
        "group_kind",
        "provider_group_ids",
        "bundled_codes_json",
        "covered_services_json",
    )


def rates_with_providers(
    rate_rows: DataFrame, provider_rows: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rates joined to the NPIs that may bill them; a widely shared group is salted."""
    exploded = rate_rows.withColumn(
        "provider_group_id", F.explode("provider_group_ids")
    ).drop("provider_group_ids")
    return skew_join(
        exploded, provider_rows, GROUP_KEY,
        spread=["item_ord", "rate_ord", "price_ord"], hot_rows=hot_rows,
    )


def conversion_stats(items: DataFrame, references: DataFrame) -> DataFrame:
    """Items, rate rows and provider rows per file, counted without flattening."""

    def length(values: Column) -> Column:
        return F.greatest(F.size(values), F.lit(0)).cast("bigint")

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    def npis(groups: Column) -> Column:
        return total(F.transform(F.coalesce(groups, F.array()), lambda g: length(g["npi"])))

    item_rates = F.coalesce(F.col("item.negotiated_rates"), F.array())
    per_item = items.select(
        "source_file",
        F.lit(1).cast("bigint").alias("items"),
        total(F.transform(item_rates, lambda r: length(r["negotiated_prices"]))).alias("rate_rows"),
        total(F.transform(item_rates, lambda r: npis(r["provider_groups"]))).alias("provider_rows"),
    )
    per_reference = references.select(
        "source_file",
        F.lit(0).cast("bigint").alias("items"),
        F.lit(0).cast("bigint").alias("rate_rows"),
        npis(F.col("reference.provider_groups")).alias("provider_rows"),
    )
    return (
        per_item.unionByName(per_reference)
        .groupBy("source_file")
        .agg(
            F.sum("items").alias("in_network_items"),
            F.sum("rate_rows").alias("rate_rows"),
            F.sum("provider_rows").alias("provider_rows"),
        )
    )
