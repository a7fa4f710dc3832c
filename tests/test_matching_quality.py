import itertools
import random

from helpers import rows
from pyspark.sql import functions as F

from ratelantern.operators import matching, quality
from ratelantern.operators.charges import as_charges

WORDS = ["gold", "silver", "hmo", "ppo", "plan", "care", "plus", "empire", "oscar", "simple"]
INDEX = ", ".join(f"{c} string" for c in matching.INDEX_COLUMNS)
INPUTS = "input_id int, issuer_name string, plan_name string, state string, metal_level string, plan_type string, employer_name string, employer_ein string"


def plain(text):
    return " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def brute_force(plans, inputs, config, aliases):
    w, result = config.weights, {}
    for i in inputs:
        found = []
        iid, issuer, name, state, metal, kind, _, ein = i
        for p in plans:
            p = dict(zip(matching.INDEX_COLUMNS, p))
            same_ein = bool(ein) and p["plan_id_type"] == "ein" and p["plan_id"].replace("-", "") == ein.replace("-", "")
            if p["state"] != state and not (p["state"] is None and same_ein):
                continue
            score = w["state"] if p["state"] else 0
            a, b = set(plain(name).split()), set(plain(p["plan_name"]).split())
            likeness = len(a & b) / len(a | b) if a | b else 0
            if a and plain(name) == plain(p["plan_name"]):
                score += w["exact_name"]
            elif likeness >= config.similarity:
                score += w["fuzzy_name"] * likeness
            a, b = set(plain(issuer).split()), set(plain(p["issuer_name"]).split())
            alike = a and b and (len(a & b) / len(a | b) >= config.similarity or a <= b or b <= a)
            # An alias stands for the issuer names its issuer id carries in that state.
            named = {
                plain(dict(zip(matching.INDEX_COLUMNS, q))["issuer_name"])
                for q in plans
                if dict(zip(matching.INDEX_COLUMNS, q))["issuer_id"] in aliases.get(plain(issuer), ())
                and dict(zip(matching.INDEX_COLUMNS, q))["state"] == p["state"]
            }
            if alike or plain(p["issuer_name"]) in named:
                score += w["issuer"]
            score += w["metal_level"] * bool(metal and metal.lower() == (p["metal_level"] or "").lower())
            score += w["plan_type"] * bool(kind and kind.lower() == (p["plan_type"] or "").lower())
            score += w["ein"] * same_ein
            score = min(100.0, score)
            if score >= config.min_score:
                found.append((-round(score, 6), p["plan_id"], p["plan_id_type"]))
        result[iid] = [(q, -s) for s, q, _ in sorted(found)[: config.max_results]]
    return {k: v for k, v in result.items() if v}


def test_best_plans_equal_scoring_all_pairs(spark):
    rng = random.Random(3)

    def name():
        return " ".join(rng.sample(WORDS, rng.randint(1, 4)))

    plans = []
    for n in range(250):
        is_ein = n % 12 == 0
        plans.append((
            "ein" if is_ein else "hios", f"12-{n:07d}" if is_ein else f"{n:05d}NY001", name(), name().title(),
            str(10000 + n % 5), None if is_ein else rng.choice(["NY", "CA"]), "group",
            rng.choice(["Gold", "Silver", None]), rng.choice(["HMO", "PPO", None]), None,
        ))
    inputs = [
        (n, rng.choice([name(), None]), rng.choice([name(), plans[n][2], None, "the alias"]), rng.choice(["NY", "CA"]),
         rng.choice(["gold", "Bronze", None]), rng.choice(["hmo", None]), None, rng.choice([None, "12-0000024"]))
        for n in range(40)
    ]
    inputs += [(n, "The Alias", "x", state, None, None, "Acme Corp", None) for n, state in enumerate(["NY", "CA", "NY"], 100)]
    aliases = spark.createDataFrame([("10001", "the alias"), ("10002", "The  Alias!")], "issuer_id string, alias string")
    employers = spark.createDataFrame([("ACME corp.", "12-0000036")], "employer_name string, ein string")
    config = matching.MatchConfig(max_results=4, min_score=20.0)
    got = matching.find_plans(
        spark.createDataFrame(plans, INDEX), spark.createDataFrame(inputs, INPUTS), config, aliases, employers
    )
    found = {}
    for r in got.orderBy("input_id", "rank").collect():
        found.setdefault(r.input_id, []).append((r.plan_id, round(r.match_score, 6)))
    known = [i[:-1] + ("12-0000036",) if i[6] else i for i in inputs]
    assert found == brute_force(plans, known, config, {"the alias": ("10001", "10002")})
    exact = got.where("match_type = 'exact'").first()
    assert exact.match_details["exact_name"] == "+40.0" and exact.match_details["state"] == "+15.0"


def test_index_merges_both_sources(spark):
    attributes = spark.createDataFrame(
        [("11111NY0010001", "Gold", None, "ny", "Individual", "Gold", "HMO", None)],
        "plan_id string, plan_name string, issuer_name string, state string, market_type string, metal_level string, plan_type string, network_url string",
    )
    toc = spark.createDataFrame(
        [("hios", "11111NY0010001", "GOLD 1", "Empire", "individual", ["u1", "u2"]), ("ein", "9", "Shop", "Empire", "group", ["u1"]),
         ("ein", "9", "Shop", "Empire", "group", ["u1"])],
        "plan_id_type string, plan_id string, plan_name string, issuer_name string, plan_market_type string, in_network_urls array<string>",
    )
    index = matching.plan_index(attributes, toc)
    assert rows(index, "plan_id", "plan_name", "issuer_name", "issuer_id", "state", "market_type") == [
        ("11111NY0010001", "Gold", "Empire", "11111", "NY", "individual"), ("9", "Shop", "Empire", None, None, "group"),
    ]
    assert matching.plan_files(toc).count() == 3
    assert matching.plan_by_id(index, "9").count() == 1
    assert rows(matching.index_stats(index)) == [(2, 1, 1, 1)]


def violations(spark, rules, schema, row):
    df = spark.createDataFrame([row], schema)
    if "cpt_code" in schema:
        df = as_charges(df)
    return {r.rule for r in quality.report(df, rules).where("violations > 0").collect()}


CHARGE = "description string, setting string, cpt_code string, ndc_code string, gross_charge double, payer_name string, plan_name string, negotiated_dollar double, negotiated_percentage double, min_charge double, max_charge double, estimated_amount double, methodology string, modifiers string, drug_unit_of_measurement double, drug_type_of_measurement string, last_updated_on string"


def charge(**more):
    base = dict.fromkeys(c.split()[0] for c in CHARGE.split(", "))
    base.update(description="x", setting="both", cpt_code="1", gross_charge=5.0, last_updated_on="2024-07-01", **more)
    return tuple(base.values())


def test_charge_rules(spark):
    rules = quality.charge_rules()

    def broken(**more):
        return violations(spark, rules, CHARGE, charge(**more))

    assert broken() == set()
    assert broken(negotiated_dollar=1.0, payer_name="A", plan_name="B", methodology="per diem", min_charge=1.0, max_charge=2.0) == set()
    assert broken(negotiated_dollar=1.0) == {"negotiated charge has payer, plan and methodology", "negotiated dollar has minimum and maximum"}
    assert broken(negotiated_percentage=1.0, payer_name="A", plan_name="B", methodology="other") == {
        "other methodology has notes", "percentage or algorithm alone has an estimate"}
    assert broken(ndc_code="1", drug_unit_of_measurement=1.0) == {"NDC has drug unit and type", "drug unit and type come together"}
    assert broken(min_charge=0.0, methodology="weekly") == {"numbers are positive", "methodology is known"}


def test_structure_and_provider_rules(spark):
    schema = (
        "reporting_plans array<struct<plan_name: string, issuer_name: string, plan_id_type: string, plan_id: string, plan_sponsor_name: string, plan_market_type: string>>,"
        " in_network_files array<struct<description: string, location: string>>, allowed_amount_file struct<description: string, location: string>"
    )
    plan = ("n", "i", "ein", "1", None, "group")
    assert violations(spark, quality.structure_rules(), schema, ([plan], [("d", "http://x")], None)) == {
        "ein plan has a sponsor", "in-network locations are https"}
    assert violations(spark, quality.structure_rules(), schema, ([], None, None)) == {"structure has plans", "structure has files"}
    provider = "npi bigint, tin_type string, tin_value string, business_name string"
    assert violations(spark, quality.provider_rules(), provider, (0, "npi", "1234567890", None)) == set()
    assert violations(spark, quality.provider_rules(), provider, (5, "ein", "1", None)) == {
        "NPI has ten digits or is zero", "EIN has its form", "EIN has a business name"}
    rows_ = spark.createDataFrame([(5, "ein", "1", None)], provider)
    assert len(quality.violations(rows_, quality.provider_rules()).first().broken_rules) == 3
