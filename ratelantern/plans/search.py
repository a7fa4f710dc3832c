"""Search and selection of codes."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.functions.codes import normalised_key
from ratelantern.functions.predicates import search_conditions

Star = dict[str, DataFrame]


def _linked(star: Star, codes: DataFrame, items: DataFrame) -> DataFrame:
    return (
        star["item_codes"]
        .join(codes, "code_id")
        .join(items.select("item_id", "hospital_id", "description"), "item_id")
    )


def described_codes(star: Star, code: str | None = None, code_type: str | None = None) -> DataFrame:
    """codes x items: (code_id, code, code_type, item_id, hospital_id, description)."""
    codes = star["codes"]
    if code is not None:
        codes = codes.where(F.col("code") == code)
    if code_type is not None:
        codes = codes.where(F.col("code_type") == code_type)
    return _linked(star, codes, star["standard_charge_items"])


def _literals(text: str, wildcards: bool) -> list[str]:
    """Stretches of the text that stand for themselves, in lower case as the index has them.

    Only ASCII is taken: other characters may change in number when their case changes.
    """
    stretches = re.split("[%_]", text) if wildcards else [text]
    return [a.lower() for s in stretches for a in re.findall(r"[\x00-\x7F]+", s) if "\\" not in a or not wildcards]


def _candidates(star: Star, text: str, wildcards: bool) -> DataFrame | None:
    """description_id of all descriptions that may contain the text; None: any may.

    The postings of the rarest three characters of the text are enough, as the predicate is checked again.
    Their counts are as many rows as the text has characters.
    """
    literals = _literals(text, wildcards)
    grams = sorted({s[i : i + 3] for s in literals for i in range(len(s) - 2)})
    postings = star["search_grams"]
    if grams:
        counts = star["search_gram_counts"].where(F.col("gram").isin(grams)).collect()
        found = {r.gram: r.postings for r in counts}
        return postings.where(F.col("gram") == min(grams, key=lambda g: (found.get(g, 0), g))).select("description_id")
    pairs = [s for s in literals if len(s) == 2]
    if pairs:
        return postings.where(F.col("gram").startswith(pairs[0])).select("description_id").distinct()
    return None


def _indexed(star: Star, text: str, wildcards: bool) -> DataFrame:
    """The hits of ``search`` from the index, each once."""
    is_prefix, in_description = search_conditions(F.col("code"), F.col("description"), text, wildcards)
    columns = ["code", "code_type", "description", "hospital_count"]
    entries = star["search_entries"]
    start = re.match(r"[\x00-\x7F]*", re.split(r"[%_\\]", text)[0] if wildcards else text).group().lower()
    by_code = (entries.where(F.col("code_key").startswith(start)) if start else entries).where(is_prefix)
    described = star["search_descriptions"]
    candidates = _candidates(star, text, wildcards)
    if candidates is not None:
        described = described.join(candidates, "description_id", "left_semi")
    return by_code.select(columns).unionByName(described.where(in_description).select(columns)).distinct()


def search(star: Star, text: str, limit: int | None = 20, wildcards: bool = False) -> DataFrame:
    """Codes that start with the text or whose description contains it.

    Code matches come first. ``limit=None`` returns all hits in order. With an index
    (``sinks.gold``) neither items nor links are read.
    """
    is_prefix, in_description = search_conditions(
        F.col("code"), F.col("description"), text, wildcards
    )
    if len(text or "") < 2 or "search_grams" not in star:
        # Either condition concerns one table. Searched on their own, each filters its table
        # before any join; the distinct count does not mind rows found both ways.
        codes, items = star["codes"], star["standard_charge_items"]
        found = _linked(star, codes.where(is_prefix), items).unionByName(
            _linked(star, codes, items.where(in_description))
        )
        hits = found.groupBy("code", "code_type", "description").agg(
            F.count_distinct("hospital_id").alias("hospital_count")
        )
    else:
        hits = _indexed(star, text, wildcards)
    hits = hits.orderBy(F.when(is_prefix, 0).otherwise(1), "code", "code_type", "description")
    return hits if limit is None else hits.limit(limit)


def code_exists(star: Star, code: str, code_type: str) -> DataFrame:
    found = star["codes"].where((F.col("code") == code) & (F.col("code_type") == code_type))
    return found.limit(1).agg((F.count("*") > 0).alias("exists"))


def service_info(star: Star, code: str, code_type: str | None = None) -> DataFrame:
    """One (code, code_type, description) of a code: the first in order."""
    if "search_entries" in star:
        found = star["search_entries"].where(F.col("code") == code)
        found = found if code_type is None else found.where(F.col("code_type") == code_type)
    else:
        found = described_codes(star, code, code_type)
    return (
        found.select("code", "code_type", "description")
        .distinct()
        .orderBy("code_type", "description")
        .limit(1)
    )


def hospital_code_info(star: Star, hospital_id: str, code: str, code_type: str) -> DataFrame:
    """The first description that a hospital has for a code."""
    if "code_prices" in star:  # every item has a charge
        found = star["code_prices"].where((F.col("code") == code) & (F.col("code_type") == code_type))
    else:
        found = described_codes(star, code, code_type)
    return (
        found.where(F.col("hospital_id") == hospital_id)
        .select("code", "code_type", "description")
        .distinct()
        .orderBy("description")
        .limit(1)
    )


def with_consumer_description(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Replace ``description`` by the consumer text of the code where there is one."""
    lookup = descriptions.select(
        F.col("code_type").alias("_type"), F.col("code").alias("_code"), "consumer_description"
    )
    same = (normalised_key(df["code_type"]) == F.col("_type")) & (
        normalised_key(df["code"]) == F.col("_code")
    )
    return (
        df.join(lookup, same, "left")
        .withColumn("description", F.coalesce("consumer_description", "description"))
        .drop("_type", "_code", "consumer_description")
    )
