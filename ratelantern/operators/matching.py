"""Matching of consumer plan information to plans.

Scores add up points per criterion; the state must agree. The best ``max_results`` plans per
input are found without comparing every input to every plan of its state:

* Names are compared as distinct names per state, and only those that can reach the
  similarity threshold meet at all (they share one of their rarest words).
* Apart from the name, a score depends only on which attributes agree. So for every
  combination of attribute values the first ``max_results`` plans (by id) are kept in
  advance. A plan that is not among them is outranked by that many others, hence the result
  equals that of scoring all pairs.
"""

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelantern.fixed_values import MATCH_WEIGHTS
from ratelantern.functions.clean import null_if_empty
from ratelantern.functions.predicates import hios_state
from ratelantern.operators.joins import skew_join, tasks_for
from ratelantern.operators.star import hash_id
from ratelantern.session import write_stage

INDEX_COLUMNS = [
    "plan_id_type",
    "plan_id",
    "plan_name",
    "issuer_name",
    "issuer_id",
    "state",
    "market_type",
    "metal_level",
    "plan_type",
    "network_url",
]


@dataclass(frozen=True)
class MatchConfig:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(MATCH_WEIGHTS))
    min_score: float = 30.0
    max_results: int = 10
    similarity: float = 0.5

    def __post_init__(self) -> None:
        # Keeping the first plans of a class loses nothing only if no weight counts against a plan.
        if min(self.weights.values(), default=0) < 0:
            raise ValueError("weights must not be negative")


# --- index ---------------------------------------------------------------------------------


def plan_index(attributes: DataFrame, toc_plans: DataFrame) -> DataFrame:
    """One row per plan id; published attributes win over what a table of contents says."""
    hios = F.col("plan_id_type") == "hios"
    published = attributes.select(
        F.lit("hios").alias("plan_id_type"),
        "plan_id",
        "plan_name",
        "issuer_name",
        F.substring("plan_id", 1, 5).alias("issuer_id"),
        F.upper("state").alias("state"),
        F.lower("market_type").alias("market_type"),
        "metal_level",
        "plan_type",
        "network_url",
        F.lit(0).alias("_source"),
    )
    listed = toc_plans.select(
        "plan_id_type",
        "plan_id",
        null_if_empty(F.col("plan_name")).alias("plan_name"),
        null_if_empty(F.col("issuer_name")).alias("issuer_name"),
        F.when(hios, F.substring("plan_id", 1, 5)).alias("issuer_id"),
        F.when(hios, hios_state(F.col("plan_id"))).alias("state"),
        null_if_empty(F.col("plan_market_type")).alias("market_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("metal_level", "plan_type", "network_url")],
        F.lit(1).alias("_source"),
    )
    keys = ["plan_id_type", "plan_id"]

    def best(name: str) -> Column:
        order = F.struct("_source", F.col(name))
        return F.min_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)

    return (
        published.unionByName(listed)
        .groupBy(*keys)
        .agg(*[best(c) for c in INDEX_COLUMNS if c not in keys])
        .select(*INDEX_COLUMNS)
    )


def plan_files(toc_plans: DataFrame) -> DataFrame:
    """(plan_id_type, plan_id, url): rate files of each plan, as rows, each once."""
    return toc_plans.select(
        "plan_id_type", "plan_id", F.explode("in_network_urls").alias("url")
    ).distinct()


def plan_by_id(index: DataFrame, plan_id: str) -> DataFrame:
    return index.where(F.col("plan_id") == plan_id)


def index_stats(index: DataFrame, *keys: str) -> DataFrame:
    return index.groupBy(*keys).agg(
        F.count("*").alias("plans"),
        F.count_distinct("issuer_name").alias("issuers"),
        F.count_if(F.col("plan_id_type") == "hios").alias("hios_plans"),
        F.count_if(F.col("plan_id_type") == "ein").alias("ein_plans"),
    )


# --- names ---------------------------------------------------------------------------------


def plain_name(c: Column) -> Column:
    """Lower case words separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))


def word_similarity(a: Column, b: Column) -> Column:
    """Shared words over all words."""
    return F.coalesce(
        F.try_divide(
            F.size(F.array_intersect(words(a), words(b))),
            F.size(F.array_union(words(a), words(b))),
        ),
        F.lit(0.0),
    )


def word_containment(a: Column, b: Column) -> Column:
    """All words of one name occur in the other."""
    smaller = F.least(F.size(words(a)), F.size(words(b)))
    return (smaller > 0) & (F.size(F.array_intersect(words(a), words(b))) == smaller)


def similar_names(
    inputs: DataFrame, plans: DataFrame, block: list[str], similarity: float, containment: bool
) -> DataFrame:
    """Pairs (block, input_name, plan_name) of distinct names that are similar enough.

    Two sets of words with a similarity of at least ``t`` share one of the rarest
    ``n - ceil(t n) + 1`` words of each (prefix filtering); if one contains the other, the
    rarest word of the smaller is in the larger. Without containment a meeting counts only if
    sizes and places leave room for enough shared words: at the rarest word they share, no more
    than what follows it in either can be shared as well.
    """

    def worded(df: DataFrame, name: str) -> DataFrame:
        return df.select(*block, name, F.explode(words(F.col(name))).alias("word"))

    left = inputs.select(*block, "input_name").where("input_name <> ''").distinct()
    right = plans.select(*block, "plan_name").where("plan_name <> ''").distinct()
    frequency = (
        worded(left, "input_name")
        .select(*block, "word")
        .unionByName(worded(right, "plan_name").select(*block, "word"))
        .groupBy(*block, "word")
        .agg(F.count("*").alias("uses"))
    )

    def rarest(df: DataFrame, name: str) -> DataFrame:
        """Words of each name with their place from rarest to most frequent."""
        ranked = worded(df, name).join(frequency, [*block, "word"])
        # A group is the words of one name.
        by_name = Window.partitionBy(*block, name)
        return ranked.select(
            *block,
            name,
            "word",
            F.row_number().over(by_name.orderBy("uses", "word")).alias("place"),
            F.count("*").over(by_name).alias("n"),
        )

    # Products such as 25 x 0.56 come out a little above the whole number they stand for.
    needed = F.ceil(F.col("n") * similarity - 1e-9)
    in_prefix = F.col("place") <= F.col("n") - needed + 1
    left_words, right_words = rarest(left, "input_name"), rarest(right, "plan_name")
    on = [*block, "word"]
    left_rare, right_rare = left_words.where(in_prefix), right_words.where(in_prefix)
    if containment:
        left_all, right_all = left_words.drop("place", "n"), right_words.drop("place", "n")
        left_rare, right_rare = left_rare.drop("place", "n"), right_rare.drop("place", "n")
        met = left_all.join(right_rare, on).unionByName(left_rare.join(right_all, on))
    else:
        other = right_rare.withColumnsRenamed({"place": "other_place", "n": "other_n"})
        room = 1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
        # shared / (n + other_n - shared) >= t
        shared = F.ceil((F.col("n") + F.col("other_n")) * similarity / (1 + similarity) - 1e-9)
        met = left_rare.join(other, on).where(room >= shared)
    a, b = F.col("input_name"), F.col("plan_name")
    enough = word_similarity(a, b) >= similarity
    if containment:
        enough = enough | word_containment(a, b)
    return met.select(*block, "input_name", "plan_name").distinct().where(enough)


# --- scoring -------------------------------------------------------------------------------

_ATTRIBUTES = ["name", "issuer", "metal_level", "plan_type", "ein"]
_ANY = "\x00"
# Employer plans name no state; they can be found by their EIN only.
_ANY_STATE = "*"
#: A task compares about so many combinations of attributes with the first plans that have them.
OPTIONS_PER_TASK = 20_000


def _digits(c: Column) -> Column:
    return null_if_empty(F.regexp_replace(c, "[^0-9]", ""))


def _class_key(attributes: list[Column]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(a, F.lit(_ANY)) for a in attributes])


def _with_and_without(df: DataFrame, column: str) -> DataFrame:
    """Each row with the value of ``column`` and, if it has one, also without."""
    value = F.col(column)
    options = F.when(value.isNotNull(), F.array(value, F.lit(None))).otherwise(F.array(value))
    return df.withColumn(column, F.explode(options))


def _first_plans(plans: DataFrame, k: int) -> DataFrame:
    """The first ``k`` plans of every combination of attribute values."""
    rows = plans
    for attribute in _ATTRIBUTES:
        rows = _with_and_without(
            rows.withColumn(f"c_{attribute}", F.col(f"k_{attribute}")), f"c_{attribute}"
        )
    keyed = rows.withColumn("class_key", _class_key([F.col(f"c_{a}") for a in _ATTRIBUTES]))
    place = F.row_number().over(
        Window.partitionBy("block", "class_key").orderBy("plan_id", "plan_id_type")
    )
    return (
        keyed.drop(*[f"c_{a}" for a in _ATTRIBUTES])
        .withColumn("_place", place)
        .where(F.col("_place") <= k)
        .drop("_place")
    )


def find_plans(
    index: DataFrame,
    inputs: DataFrame,
    config: MatchConfig = MatchConfig(),
    issuer_aliases: DataFrame | None = None,
    employer_eins: DataFrame | None = None,
) -> DataFrame:
    """Best plans per input.

    ``inputs``: input_id, issuer_name, plan_name, state, metal_level, plan_type,
    employer_name, employer_ein; unknown values are null.
    """
    plans = index.select(
        *INDEX_COLUMNS,
        plain_name(F.col("plan_name")).alias("k_name"),
        plain_name(F.col("issuer_name")).alias("k_issuer"),
        F.lower("metal_level").alias("k_metal_level"),
        F.lower("plan_type").alias("k_plan_type"),
        F.when(F.col("plan_id_type") == "ein", _digits(F.col("plan_id"))).alias("k_ein"),
        F.coalesce("state", F.lit(_ANY_STATE)).alias("block"),
    )

    asked = inputs.select(
        "input_id",
        plain_name(F.col("plan_name")).alias("in_name"),
        plain_name(F.col("issuer_name")).alias("in_issuer"),
        F.upper("state").alias("in_state"),
        null_if_empty(F.lower("metal_level")).alias("in_metal_level"),
        null_if_empty(F.lower("plan_type")).alias("in_plan_type"),
        _digits(F.col("employer_ein")).alias("given_ein"),
        plain_name(F.col("employer_name")).alias("employer"),
    )
    if employer_eins is not None:
        known = employer_eins.groupBy(plain_name(F.col("employer_name")).alias("employer")).agg(
            F.min(_digits(F.col("ein"))).alias("known_ein")
        )
        asked = asked.join(known, "employer", "left")
    else:
        asked = asked.withColumn("known_ein", F.lit(None).cast("string"))
    asked = asked.withColumn("in_ein", F.coalesce("given_ein", "known_ein")).drop(
        "given_ein", "known_ein", "employer"
    )
    blocks = F.when(
        F.col("in_ein").isNotNull(), F.array(F.col("in_state"), F.lit(_ANY_STATE))
    ).otherwise(F.array("in_state"))
    # Equal questions are answered once, however many inputs ask them.
    asked = asked.withColumn(
        "profile", hash_id(*[F.col(c) for c in asked.columns if c != "input_id"])
    )
    askers = asked.select("input_id", "profile")
    asked = asked.drop("input_id").distinct()
    asked = asked.withColumn("block", F.explode(blocks)).drop("in_state")

    # Which names and issuers of the index each input name and issuer agrees with.
    names = similar_names(
        asked.withColumnRenamed("in_name", "input_name"),
        plans.select("block", F.col("k_name").alias("plan_name")),
        ["block"], config.similarity, containment=False,
    ).select("block", F.col("input_name").alias("in_name"), F.col("plan_name").alias("o_name"))
    issuers = similar_names(
        asked.withColumnRenamed("in_issuer", "input_name"),
        plans.select("block", F.col("k_issuer").alias("plan_name")),
        ["block"], config.similarity, containment=True,
    ).select("block", F.col("input_name").alias("in_issuer"), F.col("plan_name").alias("o_issuer"))
    if issuer_aliases is not None:
        by_alias = (
            issuer_aliases.select(plain_name(F.col("alias")).alias("in_issuer"), "issuer_id")
            .distinct()
            .join(plans.select("block", "issuer_id", F.col("k_issuer").alias("o_issuer")).distinct(), "issuer_id")
            .select("block", "in_issuer", "o_issuer")
        )
        issuers = issuers.unionByName(by_alias).distinct()

    # Every combination of agreeing attributes an input can have with some plan.
    def with_options(df: DataFrame, pairs: DataFrame, key: str, option: str) -> DataFrame:
        matched = df.join(pairs, ["block", key])
        unmatched = df.withColumn(option, F.lit(None).cast("string"))
        return matched.unionByName(unmatched)

    options = with_options(asked, names, "in_name", "o_name")
    options = with_options(options, issuers, "in_issuer", "o_issuer")
    for attribute in ("metal_level", "plan_type", "ein"):
        options = _with_and_without(
            options.withColumn(f"o_{attribute}", F.col(f"in_{attribute}")), f"o_{attribute}"
        )
    options = options.withColumn("class_key", _class_key([F.col(f"o_{a}") for a in _ATTRIBUTES]))

    # Each combination meets several wide rows, many of a state meet the same ones: dealt to tasks by their number.
    options = write_stage(options, "match-options")
    candidates = skew_join(
        options, _first_plans(plans, config.max_results), ["block", "class_key"],
        spread=["profile"], hot_rows=OPTIONS_PER_TASK, tasks=tasks_for(options.count(), OPTIONS_PER_TASK),
    ).where((F.col("block") != _ANY_STATE) | F.col("o_ein").isNotNull())
    w = config.weights
    # A candidate can come up through several combinations; the one with most agreement says
    # which of its attributes agree.
    agreed = candidates.groupBy("profile", "plan_id_type", "plan_id").agg(
        *[F.first(c).alias(c) for c in INDEX_COLUMNS if c not in ("plan_id_type", "plan_id")],
        F.first("in_name").alias("in_name"),
        F.first("k_name").alias("k_name"),
        F.bool_or(F.col("o_issuer").isNotNull()).alias("issuer_agrees"),
        F.bool_or(F.col("o_metal_level").isNotNull()).alias("metal_level_agrees"),
        F.bool_or(F.col("o_plan_type").isNotNull()).alias("plan_type_agrees"),
        F.bool_or(F.col("o_ein").isNotNull()).alias("ein_agrees"),
    )
    # A plan listed under a combination without, say, its metal level may agree on it all the
    # same; it is then also listed under that combination, unless outranked there.
    exact = (F.col("in_name") == F.col("k_name")) & (F.col("in_name") != "")
    likeness = word_similarity(F.col("in_name"), F.col("k_name"))
    fuzzy = ~exact & (likeness >= config.similarity)
    points = {
        "state": F.when(F.col("state").isNotNull(), w["state"]).otherwise(0.0),
        "exact_name": F.when(exact, w["exact_name"]).otherwise(0.0),
        "fuzzy_name": F.when(fuzzy, likeness * w["fuzzy_name"]).otherwise(0.0),
        **{
            a: F.when(F.col(f"{a}_agrees"), w[a]).otherwise(0.0)
            for a in ("issuer", "metal_level", "plan_type", "ein")
        },
    }
    total = F.lit(0.0)
    for value in points.values():
        total = total + value
    reasons = F.map_from_entries(
        F.filter(
            F.array(
                *[
                    F.struct(F.lit(name).alias("key"), F.format_string("+%.1f", value).alias("value"))
                    for name, value in points.items()
                ]
            ),
            lambda e: e["value"] != "+0.0",
        )
    )
    scored = agreed.select(
        "profile",
        *INDEX_COLUMNS,
        F.least(F.lit(100.0), total).alias("match_score"),
        F.when(exact, "exact").when(fuzzy, "fuzzy").otherwise("partial").alias("match_type"),
        reasons.alias("match_details"),
    ).where(F.col("match_score") >= config.min_score)
    order = Window.partitionBy("profile").orderBy(F.desc("match_score"), "plan_id", "plan_id_type")
    best = scored.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= config.max_results
    )
    return askers.join(best, "profile").drop("profile")
