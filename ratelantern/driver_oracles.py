"""SQL with the expected result of the queries, written against the driver's tables."""

# --- charge rows and the star ----------------------------------------------------------------

_CHARGES = """
charges AS (
  SELECT
    p_name AS description,
    CASE l_returnflag WHEN 'A' THEN 'inpatient' WHEN 'N' THEN 'outpatient' ELSE 'both' END AS setting,
    CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS cpt_code,
    p_brand AS hcpcs_code,
    CASE WHEN p_size % 2 = 0 THEN p_type END AS ms_drg_code,
    CASE WHEN l_linenumber % 4 <> 0 THEN c_mktsegment END AS payer_name,
    CASE WHEN l_linenumber % 4 <> 0 AND l_linenumber % 7 <> 0 THEN o_orderpriority END AS plan_name,
    l_extendedprice AS gross_charge,
    CASE WHEN l_discount <> 0 THEN round(l_extendedprice * (1 - l_discount), 4) END AS discounted_cash,
    CASE WHEN l_linenumber % 4 <> 0 AND l_linestatus <> 'O'
         THEN round(l_extendedprice * (1 - l_tax), 4) END AS negotiated_dollar,
    CASE WHEN l_linenumber % 4 <> 0 AND l_linestatus = 'O'
         THEN round(100 - 100 * l_tax, 4) END AS negotiated_percentage,
    CASE WHEN l_linenumber % 4 <> 0 AND o_orderstatus <> 'P' THEN o_totalprice END AS estimated_amount,
    CASE WHEN l_quantity > 10 THEN round(l_extendedprice * 0.5, 4) END AS minimum,
    CASE WHEN l_quantity > 20 THEN round(l_extendedprice * 2, 4) END AS maximum,
    CASE WHEN l_linenumber % 4 <> 0 AND l_linenumber % 5 <> 0 THEN
      CASE l_linenumber % 3 WHEN 0 THEN 'fee schedule' WHEN 1 THEN 'case rate' ELSE 'other' END
    END AS methodology,
    CASE WHEN l_linenumber % 6 = 1 THEN '26|TC' END AS modifiers,
    CASE WHEN p_size % 5 = 0 THEN CAST(p_size AS DOUBLE) END AS drug_unit,
    CASE WHEN p_size % 10 = 0 THEN 'ML' END AS drug_unit_type,
    CASE WHEN l_quantity > 45 THEN 'bulk ' || l_returnflag END AS generic_notes,
    CASE WHEN l_linenumber % 4 <> 0 AND l_tax > 0.06 THEN 'taxed' END AS payer_notes,
    s_name AS hospital_name,
    n_name AS hospital_address,
    'supplier-' || l_suppkey AS source_file, l_orderkey * 8 + l_linenumber AS row_ord,
    md5('supplier-' || l_suppkey) AS hospital_id
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
)"""

_STAR = f"""
WITH {_CHARGES},
item_rows AS (
  SELECT *, concat_ws('|', source_file, description, coalesce(cpt_code, ''), coalesce(hcpcs_code, ''),
    coalesce(ms_drg_code, ''), coalesce(CAST(CAST(drug_unit AS DECIMAL(38, 4)) AS VARCHAR), ''),
    coalesce(drug_unit_type, '')) AS item_key
  FROM charges
),
rows_ AS (
  SELECT *, concat_ws('|', item_key, setting,
    coalesce(CAST(CAST(gross_charge AS DECIMAL(38, 6)) AS VARCHAR), ''),
    coalesce(CAST(CAST(discounted_cash AS DECIMAL(38, 6)) AS VARCHAR), ''),
    coalesce(CAST(CAST(minimum AS DECIMAL(38, 6)) AS VARCHAR), ''),
    coalesce(CAST(CAST(maximum AS DECIMAL(38, 6)) AS VARCHAR), ''),
    coalesce(modifiers, ''), coalesce(generic_notes, '')) AS charge_key
  FROM item_rows
),
items AS (
  SELECT item_key, any_value(hospital_id) AS hospital_id, any_value(hospital_name) AS hospital_name,
    any_value(hospital_address) AS hospital_address, any_value(description) AS description,
    any_value(drug_unit) AS drug_unit, any_value(drug_unit_type) AS drug_unit_type
  FROM rows_ GROUP BY item_key
),
item_codes AS (
  SELECT DISTINCT item_key, cpt_code AS code, 'CPT' AS code_type FROM rows_ WHERE cpt_code <> ''
  UNION ALL
  SELECT DISTINCT item_key, hcpcs_code, 'HCPCS' FROM rows_ WHERE hcpcs_code <> ''
  UNION ALL
  SELECT DISTINCT item_key, ms_drg_code, 'MS-DRG' FROM rows_ WHERE ms_drg_code <> ''
),
standard_charges AS (
  SELECT charge_key, any_value(item_key) AS item_key, any_value(setting) AS setting,
    any_value(gross_charge) AS gross_charge, any_value(discounted_cash) AS discounted_cash,
    any_value(minimum) AS minimum, any_value(maximum) AS maximum,
    any_value(modifiers) AS modifiers, any_value(generic_notes) AS generic_notes
  FROM rows_ GROUP BY charge_key
),
payer_charges AS (
  SELECT charge_key, payer_name, coalesce(plan_name, '') AS plan_name,
    coalesce(methodology, '') AS methodology, negotiated_dollar, negotiated_percentage,
    estimated_amount, payer_notes
  FROM rows_ WHERE payer_name IS NOT NULL
),
codes AS (SELECT DISTINCT code, code_type FROM item_codes),
price_rows AS (
  SELECT c.code, c.code_type, i.hospital_id, i.hospital_name, i.hospital_address, i.description,
    s.charge_key, s.setting, s.gross_charge, s.discounted_cash, s.minimum, s.maximum, s.generic_notes,
    p.payer_name, p.plan_name, p.negotiated_dollar, p.methodology, p.estimated_amount, p.payer_notes
  FROM item_codes c
  JOIN items i ON i.item_key = c.item_key
  JOIN standard_charges s ON s.item_key = c.item_key
  LEFT JOIN payer_charges p ON p.charge_key = s.charge_key
)"""


def _prices(keys: str, condition: str) -> str:
    """CTE ``prices``: best row per hospital (and further keys) with median and count."""
    return f"""{_STAR},
tuples AS (
  SELECT DISTINCT {keys} hospital_id, hospital_name, hospital_address, setting, gross_charge,
    discounted_cash, minimum, maximum, payer_name, plan_name, negotiated_dollar, methodology,
    estimated_amount
  FROM price_rows WHERE {condition}
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} hospital_id ORDER BY
    discounted_cash ASC NULLS LAST, gross_charge ASC NULLS LAST, hospital_name NULLS FIRST,
    hospital_address NULLS FIRST, setting NULLS FIRST, minimum NULLS FIRST, maximum NULLS FIRST,
    payer_name NULLS FIRST, plan_name NULLS FIRST, negotiated_dollar NULLS FIRST,
    methodology NULLS FIRST, estimated_amount NULLS FIRST) AS place
  FROM tuples
),
medians AS (
  SELECT {keys} hospital_id, round(median(estimated_amount), 6) AS median_estimate,
    count(estimated_amount) AS plan_count
  FROM tuples GROUP BY ALL
),
prices AS (
  SELECT r.* EXCLUDE (estimated_amount, place), m.median_estimate, m.plan_count
  FROM ranked r JOIN medians m USING ({keys} hospital_id) WHERE place = 1
)"""


_ONE_CODE = _prices("", "code = 'Brand#17'")
_ALL_CODES = _prices("code, code_type,", "true")

_SEARCH = f"""{_STAR}
SELECT c.code, c.code_type, i.description, CAST(count(DISTINCT i.hospital_id) AS BIGINT) AS hospital_count
FROM item_codes c JOIN items i USING (item_key)
WHERE c.code ILIKE 'ri%' OR i.description ILIKE '%ri%'
GROUP BY ALL
"""

_DETAIL_COLUMNS = """code, code_type, setting, payer_name, plan_name, methodology, negotiated_dollar,
  estimated_amount, payer_notes AS notes"""

# --- tables of contents ------------------------------------------------------------------------

_TOC = r"""
WITH listed AS (
  SELECT 'order-' || o_orderkey AS source_file,
    CASE WHEN n < 2 THEN 1 ELSE 2 END AS structure_id, o_orderkey, o_custkey, n,
    o_orderpriority || ' plan ' || (o_orderkey % 97) AS plan_name,
    CASE WHEN (o_orderkey + n) % 11 = 0 THEN 'Empire Health' ELSE c_mktsegment END AS issuer_name,
    CASE WHEN (o_orderkey + n) % 3 = 0 THEN 'ein' ELSE 'hios' END AS plan_id_type,
    CASE WHEN (o_orderkey + n) % 3 = 0 THEN lpad(CAST(o_orderkey % 1000 AS VARCHAR), 9, '0')
      ELSE lpad(CAST(o_orderkey % 99991 AS VARCHAR), 5, '0')
        || CASE WHEN c_nationkey % 5 = 0 THEN 'NY' ELSE 'CA' END || '00100' || n END AS plan_id,
    CASE WHEN (o_orderkey + n) % 3 = 0 THEN c_name ELSE '' END AS plan_sponsor_name,
    CASE WHEN (o_orderkey + n) % 2 = 0 THEN 'individual' ELSE 'group' END AS plan_market_type
  FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES (0), (1), (2)) AS numbers(n)
),
keyworded AS (
  SELECT *, lower(concat_ws(chr(10), plan_name, issuer_name, plan_sponsor_name)) AS names FROM listed
),
matched AS (
  SELECT *,
    (plan_id_type = 'hios' AND substr(upper(plan_id), 6, 2) = 'NY') OR regexp_matches(names,
      'new york|ny |ny-|nys|nyc|n\.y\.|empire|healthfirst|fidelis|emblemhealth|metroplus|affinity|excellus|mvp health|cdphp|independent health|univera')
      AS is_match
  FROM keyworded
)"""

# --- in-network rates ----------------------------------------------------------------------------

_RATES = """
WITH docs AS (
  SELECT *, 'order-' || o_orderkey AS source_file, o_custkey % 1000 AS supplier,
    o_orderkey % 20011 AS part, o_orderkey % 7 AS line, o_orderkey % 5 = 0 AS embedded
  FROM orders
),
groups AS (
  SELECT source_file, 'referenced' AS group_kind, supplier AS provider_group_id, supplier AS key,
    line % 3 + 1 AS n_npis, 'Clinic' AS business_name, o_orderpriority AS network_names, NULL AS rate_ord, 0 AS pos
  FROM docs
  UNION ALL SELECT source_file, 'referenced', supplier + 100000, part, line % 3, NULL, o_orderpriority, NULL, 0 FROM docs
  UNION ALL SELECT source_file, 'embedded', 1, supplier, line % 3, 'Clinic', NULL, 0, 0 FROM docs WHERE embedded
  UNION ALL SELECT source_file, 'embedded', 2, part, 1, NULL, NULL, 0, 1 FROM docs WHERE embedded
  UNION ALL SELECT source_file, 'embedded', 3, part, 2, 'Lab', NULL, 1, 0 FROM docs WHERE embedded
),
providers AS (
  SELECT source_file, group_kind, provider_group_id, 1000000000 + key * 10 + i AS npi,
    CASE WHEN key % 2 = 0 THEN 'ein' ELSE 'npi' END AS tin_type,
    lpad(CAST(key % 1000000000 AS VARCHAR), 9, '0') AS tin_value, business_name, network_names
  FROM groups, (VALUES (0), (1), (2)) AS numbers(i) WHERE i < n_npis
),
allowed AS (
  SELECT 1000000000 + s_suppkey * 10 + i AS npi
  FROM supplier, (VALUES (0), (2)) AS numbers(i) WHERE s_acctbal > 0
),
kept_providers AS (SELECT * FROM providers WHERE npi IN (SELECT npi FROM allowed)),
links AS (
  SELECT source_file, 0 AS rate_ord, 0 AS pos, 'referenced' AS group_kind, supplier AS provider_group_id FROM docs WHERE NOT embedded
  UNION ALL SELECT source_file, 0, 1, 'referenced', supplier + 100000 FROM docs WHERE NOT embedded
  UNION ALL SELECT source_file, 1, 0, 'referenced', supplier + 100000 FROM docs WHERE NOT embedded
  UNION ALL SELECT source_file, rate_ord, pos, group_kind, provider_group_id FROM groups
    WHERE group_kind = 'embedded' AND n_npis > 0
),
prices AS (
  SELECT source_file, 0 AS rate_ord, 0 AS price_ord, o_totalprice AS negotiated_rate, 'negotiated' AS negotiated_type FROM docs
  UNION ALL SELECT source_file, 0, 1, CAST(line + 1 AS DOUBLE), 'fee schedule' FROM docs
  UNION ALL SELECT source_file, 1, 0, o_totalprice, 'negotiated' FROM docs
)"""

_RATE_COLUMNS = """
  p.source_file, p.rate_ord, p.price_ord, CASE WHEN d.line % 3 = 0 THEN 'Gold' END AS plan_name,
  CASE WHEN d.line % 2 = 0 THEN 'bundle' ELSE 'ffs' END AS negotiation_arrangement,
  CAST(d.part AS VARCHAR) AS billing_code, p.negotiated_rate, p.negotiated_type,
  CASE WHEN d.o_orderstatus = 'F' THEN 'inpatient' ELSE 'outpatient' END AS setting,
  CASE WHEN d.o_orderstatus = 'O' THEN 'see contract' END AS additional_information,
  CASE WHEN d.embedded THEN 'embedded' ELSE 'referenced' END AS group_kind,
  l.ids AS provider_group_ids, '11,22' AS service_code,
  CASE WHEN d.line % 2 = 0 THEN '[{"billing_code_type":"CPT","billing_code_type_version":"","billing_code":"'
    || d.part || '","description":"' || d.o_orderpriority || ' \\u0026 \\u003cmore\\u003e"}]' END AS bundled_codes_json,
  CAST(NULL AS VARCHAR) AS covered_services_json
"""


def _rate_rows(join: str, links: str) -> str:
    return f"""{_RATES},
lists AS (
  SELECT source_file, rate_ord, string_agg(CAST(provider_group_id AS VARCHAR), ',' ORDER BY pos) AS ids
  FROM {links} GROUP BY ALL
)
SELECT {_RATE_COLUMNS}
FROM prices p JOIN docs d USING (source_file) {join} JOIN lists l USING (source_file, rate_ord)
"""


_KEPT_LINKS = """(SELECT * FROM links WHERE (source_file, group_kind, provider_group_id) IN
  (SELECT (source_file, group_kind, provider_group_id) FROM kept_providers))"""

# --- conformance -----------------------------------------------------------------------------------

_NEGOTIATED = "(negotiated_dollar IS NOT NULL OR negotiated_percentage IS NOT NULL)"
_CHARGE_RULES = {
    "setting is known": "setting NOT IN ('inpatient', 'outpatient', 'both')",
    "negotiated charge has payer, plan and methodology": f"{_NEGOTIATED} AND (payer_name IS NULL OR plan_name IS NULL OR methodology IS NULL)",
    "charge has a code": "coalesce(cpt_code, hcpcs_code, ms_drg_code) IS NULL AND modifiers IS NULL",
    "other methodology has notes": "methodology = 'other' AND generic_notes IS NULL AND payer_notes IS NULL",
    "item has a price": f"gross_charge IS NULL AND discounted_cash IS NULL AND NOT {_NEGOTIATED}",
    "negotiated dollar has minimum and maximum": "negotiated_dollar IS NOT NULL AND (minimum IS NULL OR maximum IS NULL)",
    "percentage or algorithm alone has an estimate": "negotiated_dollar IS NULL AND negotiated_percentage IS NOT NULL AND estimated_amount IS NULL",
    "NDC has drug unit and type": "false",
    "modifier alone has description and price or notes": "modifiers IS NOT NULL AND coalesce(cpt_code, hcpcs_code, ms_drg_code) IS NULL",
    "drug unit and type come together": "(drug_unit IS NULL) <> (drug_unit_type IS NULL)",
    "methodology is known": "methodology NOT IN ('case rate', 'fee schedule', 'percent of total billed charges', 'per diem', 'other')",
    "billing class is known": "false",
    "numbers are positive": "least(gross_charge, discounted_cash, negotiated_dollar, negotiated_percentage, estimated_amount, minimum, maximum, drug_unit) <= 0",
    "date is valid": "false",
}


def _report(rules: dict[str, str], ctes: str, source: str, keys: str = "") -> str:
    parts = [
        f"""SELECT {keys} '{rule}' AS rule, CAST(count(*) FILTER (WHERE {condition}) AS BIGINT) AS violations,
  CAST(count(*) AS BIGINT) AS checked_rows FROM {source} {"GROUP BY ALL" if keys else ""}"""
        for rule, condition in rules.items()
    ]
    return f"{ctes}\n" + "\nUNION ALL\n".join(parts)


_HOSPITAL_ROWS = """
WITH docs AS (
  SELECT *, 'order-' || o_orderkey AS source_file, o_orderkey % 2 = 0 AS is_v3 FROM orders
  WHERE o_orderkey % 11 <> 0
),
expanded AS (
  SELECT *, 'inpatient' AS setting, 1 AS payer FROM docs WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT *, 'inpatient', 2 FROM docs WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT *, 'inpatient', 0 FROM docs WHERE o_orderkey % 5 = 0
  UNION ALL SELECT *, 'outpatient', CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END FROM docs
),
rows_ AS (
  SELECT source_file, 'item ' || o_orderkey AS description, setting,
    CAST(o_custkey AS VARCHAR) AS cpt_code, '0250' AS rc_code,
    CASE WHEN setting = 'inpatient' THEN o_totalprice END AS gross_charge,
    CASE payer WHEN 1 THEN o_orderpriority WHEN 2 THEN 'Other' END AS payer_name,
    CASE payer WHEN 1 THEN 'PPO' WHEN 2 THEN '' END AS plan_name,
    CASE payer WHEN 1 THEN 'fee schedule' END AS methodology,
    CASE payer WHEN 1 THEN o_totalprice END AS negotiated_dollar,
    CASE WHEN payer = 1 AND is_v3 THEN o_totalprice + 1 END AS median_amount,
    CASE WHEN payer = 1 AND is_v3 THEN '11' END AS "count",
    CASE WHEN setting = 'inpatient' AND o_orderkey % 3 = 0 THEN '26|TC' END AS modifiers,
    CASE WHEN o_orderkey % 4 = 0 THEN 1000.5::DOUBLE END AS drug_unit_of_measurement,
    CASE WHEN o_orderkey % 4 = 0 THEN 'ML' END AS drug_type_of_measurement,
    CASE WHEN is_v3 THEN '3.0.0' ELSE '2.2.0' END AS version,
    CASE WHEN is_v3 THEN 'North' ELSE 'East; West' END AS hospital_location,
    '1 Main St; 2 Main St' AS hospital_address, 'L1' AS license_number, true AS affirmation,
    CASE WHEN is_v3 THEN 'Dr A' END AS attester_name
  FROM expanded
)"""

_CSV_META = """
  'Hospital ' || (l_suppkey % 2) AS hospital_name, 'L' || (l_suppkey % 2) AS license_number,
  'NY' AS license_state, true AS affirmation"""

_PLAN_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"


def _words(name: str) -> str:
    return _PLAN_WORDS.format(name)


def _plain(name: str) -> str:
    return f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g'))"


def _shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _likeness(a: str, b: str) -> str:
    return f"({_shared(a, b)} * 1.0 / (len({a}) + len({b}) - {_shared(a, b)}))"


_MATCH = f"""
WITH plans AS (
  SELECT CASE WHEN p_partkey % 10 = 0 THEN 'ein' ELSE 'hios' END AS plan_id_type,
    CASE WHEN p_partkey % 10 = 0 THEN '12-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')
      ELSE lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS plan_id,
    {_plain("p_name || ' ' || p_type")} AS name,
    {_plain("replace(p_brand, '#', ' ') || ' Health'")} AS issuer,
    CASE WHEN p_partkey % 10 <> 0 THEN (['NY', 'CA', 'TX', 'FL', 'WA'])[p_partkey % 5 + 1] END AS state,
    (['bronze', 'silver', 'gold', 'platinum'])[p_size % 4 + 1] AS metal,
    (['hmo', 'ppo', 'epo'])[p_size % 3 + 1] AS kind,
    CASE WHEN p_partkey % 10 = 0 THEN '12' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS ein
  FROM part
),
inputs AS (
  SELECT s_suppkey AS input_id, {_plain("replace(p_brand, '#', ' ')")} AS issuer,
    {_plain("CASE WHEN s_suppkey % 3 = 0 THEN p_name || ' ' || p_type ELSE p_name || ' saver' END")} AS name,
    (['NY', 'CA', 'TX', 'FL', 'WA'])[s_suppkey % 5 + 1] AS state,
    CASE WHEN s_suppkey % 4 <> 0 THEN (['bronze', 'silver', 'gold', 'platinum'])[s_suppkey % 4 + 1] END AS metal,
    (['hmo', 'ppo', 'epo'])[s_suppkey % 3 + 1] AS kind,
    CASE WHEN s_suppkey % 6 = 0 THEN '12' || lpad(CAST(s_suppkey * 10 AS VARCHAR), 7, '0') END AS ein
  FROM supplier JOIN part ON p_partkey = s_suppkey * 7
),
plan_words AS (SELECT *, {_words("name")} AS w, {_words("issuer")} AS iw FROM plans),
input_words AS (SELECT *, {_words("name")} AS w, {_words("issuer")} AS iw FROM inputs),
pairs AS (
  SELECT i.input_id, p.plan_id_type, p.plan_id, p.state,
    i.name = p.name AS exact_name, {_likeness("i.w", "p.w")} AS likeness,
    {_likeness("i.iw", "p.iw")} >= 0.5 OR {_shared("i.iw", "p.iw")} = least(len(i.iw), len(p.iw)) AS same_issuer,
    coalesce(i.metal = p.metal, false) AS same_metal, coalesce(i.kind = p.kind, false) AS same_kind,
    coalesce(i.ein = p.ein, false) AS same_ein
  FROM input_words i JOIN plan_words p ON i.state = p.state OR (p.state IS NULL AND i.ein = p.ein)
),
scored AS (
  SELECT input_id, plan_id_type, plan_id,
    round(least(100.0, CASE WHEN state IS NOT NULL THEN 15 ELSE 0 END
      + CASE WHEN exact_name THEN 40 WHEN likeness >= 0.5 THEN 25 * likeness ELSE 0 END
      + CASE WHEN same_issuer THEN 25 ELSE 0 END + CASE WHEN same_metal THEN 10 ELSE 0 END
      + CASE WHEN same_kind THEN 10 ELSE 0 END + CASE WHEN same_ein THEN 50 ELSE 0 END), 6)::DOUBLE AS match_score,
    CASE WHEN exact_name THEN 'exact' WHEN likeness >= 0.5 THEN 'fuzzy' ELSE 'partial' END AS match_type
  FROM pairs
),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY input_id ORDER BY match_score DESC, plan_id, plan_id_type) AS INTEGER) AS rank
  FROM scored WHERE match_score >= 30
)
SELECT input_id, rank, plan_id_type, plan_id, match_score, match_type FROM placed WHERE rank <= 5
"""

_MATCH_056 = _MATCH.replace(">= 0.5 ", ">= 0.56 ")
# Every other input knows its issuer by an alias, so only the issuer's number can agree.
_MATCH_ALIASES = (
    _MATCH.replace(
        "CASE WHEN s_suppkey % 6 = 0 THEN '12'", "CASE WHEN s_suppkey % 6 IN (0, 3) THEN '12'"
    )
    .replace(
        _plain("replace(p_brand, '#', ' ')") + " AS issuer",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'mutual ' || substr(p_brand, 7, 5) ELSE "
        + _plain("replace(p_brand, '#', ' ')")
        + " END AS issuer, CASE WHEN s_suppkey % 2 = 0 THEN substr(p_brand, 7, 5) END AS alias_of",
    )
    .replace("AS issuer,\n    CASE WHEN p_partkey", "AS issuer, substr(p_brand, 7, 5) AS issuer_id,\n    CASE WHEN p_partkey")
    .replace("AS same_issuer", "OR coalesce(i.alias_of = p.issuer_id, false) AS same_issuer")
)

_HISTORY = """
WITH per_year AS (
  SELECT o_custkey, year(o_orderdate) AS year, count(*) AS orders,
    CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS revenue
  FROM orders GROUP BY ALL
),
grid AS (
  SELECT o_custkey, metric, CAST(y AS INTEGER) AS year
  FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES ('orders'), ('revenue')) AS m(metric), range(1995, 2000) AS r(y)
),
history AS (
  SELECT g.o_custkey, g.metric, g.year,
    CASE WHEN g.metric = 'orders' THEN p.orders ELSE p.revenue END AS value
  FROM grid g LEFT JOIN per_year p ON p.o_custkey = g.o_custkey AND p.year = g.year
)"""

_EXPLANATIONS = """CASE code_type
  WHEN 'CPT' THEN 'Standard codes for medical procedures and services performed by clinicians.'
  WHEN 'HCPCS' THEN 'Codes for medical services supplies and equipment used for billing.'
  WHEN 'MS-DRG' THEN 'Medicare severity-adjusted DRG groups for inpatient hospital payment.' END"""

# Records of the CSV files: payers of a tall file, filled groups of a wide one.
_CSV_FILES = """
WITH records AS (
  SELECT l_suppkey % 24 AS file, l_suppkey % 2 = 0 AS is_tall, l_returnflag, l_linenumber,
    l_suppkey % 2 = 0 AND l_linenumber % 4 <> 0 AS has_payer,
    l_suppkey % 2 = 1 AND l_linenumber % 2 = 0 AS acme,
    l_suppkey % 2 = 1 AND (l_linenumber % 3 = 0 OR l_linenumber = 7) AS beta
  FROM lineitem
), counted AS (
  SELECT *, CASE WHEN is_tall THEN has_payer::INT ELSE acme::INT + beta::INT END AS payers FROM records
)"""

ORACLES: dict[str, str] = {
    "csv_conversion_stats": f"""{_CSV_FILES}
SELECT file, count(*) AS input_records, CAST(sum(CASE WHEN is_tall THEN 1 ELSE greatest(payers, 1) END) AS BIGINT) AS charge_rows,
  CAST(sum(payers) AS BIGINT) AS payer_rows,
  count(DISTINCT CASE WHEN has_payer THEN l_returnflag END) + bool_or(acme)::INT + bool_or(beta)::INT AS payer_plan_pairs
FROM counted GROUP BY file""",
    "dim_incremental": f"""{_STAR} SELECT CAST(batches AS INTEGER) AS batches, code, code_type FROM codes, (VALUES (1), (10)) AS loads(batches)""",
    "load_ledger": f"""WITH {_CHARGES}
SELECT outcome, files, CAST(CASE outcome WHEN 'loaded' THEN n ELSE 0 END AS BIGINT) AS rows_loaded, hospitals
FROM (SELECT count(*) AS n, count(DISTINCT source_file) AS hospitals FROM charges), (VALUES ('loaded', 8), ('failed', 1)) AS outcomes(outcome, files)""",
    "toc_files": f"""{_TOC}
SELECT reader, output, issuer_name, plan_id_type, CAST(count(*) AS BIGINT) AS plans, CAST(count(DISTINCT plan_id) AS BIGINT) AS plan_ids,
  (SELECT CAST(sum(n) AS INTEGER) FROM (SELECT source_file, structure_id, any_value(o_orderkey % 4) AS n FROM matched WHERE is_match GROUP BY ALL)) AS urls
FROM matched, (VALUES ('whole'), ('elements')) AS readers(reader), (VALUES ('plans'), ('normalised'), ('json')) AS outputs(output)
WHERE is_match GROUP BY reader, output, issuer_name, plan_id_type""",
    "in_network_files": f"""{_RATES},
counted AS (
  SELECT negotiated_type || ' ' || CASE WHEN d.o_orderstatus = 'F' THEN 'inpatient' ELSE 'outpatient' END AS kind,
    CAST(count(*) AS BIGINT) AS n, max(negotiated_rate) AS highest
  FROM prices p JOIN docs d USING (source_file) GROUP BY 1
  UNION ALL SELECT 'tin ' || tin_type, count(*), CAST(max(npi) AS DOUBLE) FROM kept_providers GROUP BY 1
)
SELECT kind, n, highest, reader FROM counted, (VALUES ('whole'), ('elements')) AS readers(reader)""",
    "hospital_json_files": f"""{_HOSPITAL_ROWS}
SELECT reader, description, setting, cpt_code, rc_code, gross_charge, payer_name, plan_name, methodology, negotiated_dollar,
  median_amount, "count", modifiers, drug_unit_of_measurement, version, hospital_location, license_number, attester_name
FROM rows_, (VALUES ('whole'), ('elements')) AS readers(reader)""",
    "charges_adjacent": f"""{_STAR},
placed AS (
  SELECT source_file, row_ord, item_key <> lag(item_key) OVER w AS new_item, charge_key <> lag(charge_key) OVER w AS new_charge
  FROM rows_ WINDOW w AS (PARTITION BY source_file ORDER BY row_ord, gross_charge)
)
SELECT source_file, CAST(count(*) FILTER (WHERE coalesce(new_item, true)) AS BIGINT) AS items,
  CAST(count(*) FILTER (WHERE coalesce(new_charge, true)) AS BIGINT) AS charges
FROM placed GROUP BY source_file""",
    "load_date": f"""WITH {_CHARGES} SELECT DISTINCT source_file,
  CASE WHEN CAST(split_part(source_file, '-', 2) AS INTEGER) % 3 = 0 THEN '2025-01-31' ELSE '2024-07-01' END AS last_updated_on FROM charges""",
    "payer_charge_keys": f"""{_CSV_FILES}
SELECT reading, CAST(sum(payers) AS BIGINT) AS payer_charges, CAST(sum(payers) AS BIGINT) AS ids, CAST(sum(payers) AS BIGINT) AS known
FROM counted, (VALUES ('together'), ('split'), ('alone')) AS readings(reading)
WHERE reading <> 'alone' OR file = 5 GROUP BY reading""",
    "price_compare": f"{_ONE_CODE} SELECT * FROM prices",
    "price_compare_all_codes": f"{_ALL_CODES} SELECT * FROM prices",
    "code_search": f"""SELECT * FROM ({_SEARCH}) AS hits
ORDER BY CASE WHEN code ILIKE 'ri%' THEN 0 ELSE 1 END, code, code_type, description LIMIT 20""",
    "code_search_all_hits": _SEARCH,
    "code_search_index": _SEARCH.replace("'ri%'", "'l ring%'").replace("'%ri%'", "'%l ring%'"),
    "hospital_code_info": f"""{_STAR} SELECT DISTINCT c.code, c.code_type, i.description
FROM item_codes c JOIN items i USING (item_key) WHERE c.code = 'Brand#17' AND c.code_type = 'HCPCS'
AND i.hospital_id = (SELECT md5(min('supplier-' || l_suppkey)) FROM lineitem) ORDER BY i.description LIMIT 1""",
    "code_exists": f"{_STAR} SELECT count(*) > 0 AS exists FROM codes WHERE code = 'Brand#17' AND code_type = 'HCPCS'",
    "service_info": f"""{_STAR} SELECT DISTINCT c.code, c.code_type, i.description
FROM item_codes c JOIN items i USING (item_key) WHERE c.code = 'Brand#17'
ORDER BY c.code_type, i.description LIMIT 1""",
    "hospital_detail_percentiles": f"""{_STAR}
SELECT hospital_id, code, code_type, CAST(count(*) AS BIGINT) AS n_values,
  round(quantile_cont(amount, 0.1), 6) AS percentile_10th,
  round(quantile_cont(amount, 0.5), 6) AS percentile_50th,
  round(quantile_cont(amount, 0.9), 6) AS percentile_90th
FROM (SELECT *, coalesce(negotiated_dollar, estimated_amount) AS amount FROM price_rows WHERE payer_name IS NOT NULL)
WHERE amount IS NOT NULL GROUP BY ALL""",
    "hospital_flags": f"""{_STAR}
SELECT hospital_id, hospital_name, hospital_address, CAST(NULL AS VARCHAR) AS license_state,
  '2024-07-01' AS last_updated_on,
  bool_or(lower(setting) IN ('inpatient', 'both')) AS has_inpatient,
  bool_or(lower(setting) IN ('outpatient', 'both')) AS has_outpatient
FROM rows_ GROUP BY ALL""",
    "standard_charges_dedup": f"""{_STAR}
SELECT code, code_type, setting, gross_charge, discounted_cash, minimum, maximum, generic_notes AS notes
FROM item_codes JOIN standard_charges USING (item_key)""",
    "payer_charge_details": f"{_STAR} SELECT {_DETAIL_COLUMNS} FROM price_rows WHERE payer_name IS NOT NULL",
    "headline_price": f"""{_STAR},
cash AS (
  SELECT hospital_id, code, code_type, discounted_cash, row_number() OVER (
    PARTITION BY hospital_id, code, code_type ORDER BY setting, discounted_cash, gross_charge NULLS LAST) AS place
  FROM price_rows WHERE discounted_cash IS NOT NULL
),
gross AS (
  SELECT hospital_id, code, code_type, gross_charge, row_number() OVER (
    PARTITION BY hospital_id, code, code_type ORDER BY setting, discounted_cash NULLS LAST, gross_charge) AS place
  FROM price_rows WHERE gross_charge IS NOT NULL
),
keys AS (SELECT DISTINCT hospital_id, code, code_type FROM price_rows)
SELECT k.*, coalesce(c.discounted_cash, g.gross_charge) AS headline_price FROM keys k
LEFT JOIN (SELECT * FROM cash WHERE place = 1) c USING (hospital_id, code, code_type)
LEFT JOIN (SELECT * FROM gross WHERE place = 1) g USING (hospital_id, code, code_type)""",
    "price_summary": f"""{_ALL_CODES}
SELECT code, code_type, min(coalesce(discounted_cash, gross_charge)) AS lowest_price,
  max(coalesce(discounted_cash, gross_charge)) AS highest_price, CAST(count(*) AS BIGINT) AS hospital_count
FROM prices GROUP BY ALL""",
    "lowest_flag": f"""{_ALL_CODES},
shown AS (
  SELECT *, coalesce(discounted_cash, gross_charge) AS display_price,
    CASE WHEN discounted_cash IS NOT NULL THEN 'Cash Price' WHEN gross_charge IS NOT NULL THEN 'Gross Charge' END AS price_kind
  FROM prices
)
SELECT code, code_type, hospital_name, display_price, price_kind,
  coalesce(display_price = min(display_price) OVER (PARTITION BY code, code_type), false) AS is_lowest
FROM shown""",
    "sort_by_median_nulls_last": f"""{_ONE_CODE}
SELECT hospital_id, discounted_cash, gross_charge, median_estimate FROM prices ORDER BY median_estimate NULLS LAST, hospital_id""",
    "describe_codes": f"""{_STAR},
given AS (
  SELECT CAST(p_partkey AS VARCHAR) AS code,
    CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 <> 0 THEN p_brand ELSE lower(p_type) END AS consumer_description
  FROM part
),
described AS (SELECT DISTINCT c.code, c.code_type, i.description FROM item_codes c JOIN items i USING (item_key))
SELECT d.code, d.code_type, coalesce(g.consumer_description, d.description) AS description, {_EXPLANATIONS} AS explanation
FROM described d LEFT JOIN given g ON d.code_type = 'CPT' AND d.code = g.code""",
    "unpivot_codes": f"""WITH {_CHARGES},
pairs AS (
  SELECT hospital_name, cpt_code AS code, 'CPT' AS code_type FROM charges
  UNION ALL SELECT hospital_name, hcpcs_code, 'HCPCS' FROM charges
  UNION ALL SELECT hospital_name, ms_drg_code, 'MS-DRG' FROM charges
)
SELECT hospital_name, code, code_type, CAST(count(*) AS BIGINT) AS uses FROM pairs WHERE code <> '' GROUP BY ALL""",
    "dim_codes": f"{_STAR} SELECT md5(code || chr(31) || code_type) AS code_id, code, code_type FROM codes",
    "item_codes": f"{_STAR} SELECT code, code_type, CAST(count(*) AS BIGINT) AS linked_items FROM item_codes GROUP BY ALL",
    "items_by_key": f"{_STAR} SELECT hospital_id, description, drug_unit, drug_unit_type FROM items",
    "charges_by_key": f"""{_STAR} SELECT setting, gross_charge, discounted_cash, minimum, maximum,
  modifiers AS modifier_codes, generic_notes AS additional_notes FROM standard_charges""",
    "hospitals": f"""WITH {_CHARGES} SELECT DISTINCT hospital_id, source_file, hospital_name AS name,
  hospital_address AS first_address, hospital_address AS first_location, '2.2.0' AS version, '2024-07-01' AS last_updated_on
FROM charges""",
    "payer_charges": f"""{_STAR} SELECT md5(payer_name) AS payer_id, md5(plan_name) AS plan_id, methodology,
  negotiated_dollar AS standard_charge_dollar, negotiated_percentage AS standard_charge_percentage,
  estimated_amount, payer_notes AS additional_notes,
  CAST(CAST(negotiated_dollar AS DECIMAL(18, 4)) AS VARCHAR) AS dollar_text FROM payer_charges""",
    "items_adjacent": """WITH marked AS (
  SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
),
numbered AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM marked)
SELECT user_id, run, any_value(event_type) AS event_type, min(event_id) AS first_event, CAST(count(*) AS BIGINT) AS rows
FROM numbered GROUP BY user_id, run""",
    "dim_upsert": "SELECT DISTINCT p_name AS name FROM part",
    "dim_payers_union": """SELECT md5(name) AS payer_id, name FROM (
  SELECT c_mktsegment AS name FROM customer UNION SELECT o_orderpriority FROM orders)""",
    "payer_anti": """SELECT DISTINCT o_orderpriority AS name FROM orders
WHERE o_orderpriority NOT IN (SELECT c_mktsegment FROM customer)""",
    "payer_backfill": "SELECT o_orderkey, md5(o_orderpriority) AS payer_id FROM orders",
    "payer_backfill_down": "SELECT c_custkey, c_mktsegment AS payer_name FROM customer",
    "table_counts": f"""{_STAR}
SELECT 'items' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM items
UNION ALL SELECT 'codes', count(*) FROM codes
UNION ALL SELECT 'item_codes', count(*) FROM item_codes
UNION ALL SELECT 'charges', count(*) FROM standard_charges
UNION ALL SELECT 'payer_charges', count(*) FROM payer_charges
UNION ALL SELECT 'plans', count(DISTINCT plan_name) FROM payer_charges
UNION ALL SELECT 'payers', count(DISTINCT payer_name) FROM payer_charges""",
    "load_summary": f"""{_STAR}
SELECT (SELECT count(DISTINCT hospital_id) FROM rows_) AS hospitals, (SELECT count(*) FROM codes) AS codes,
  (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM standard_charges) AS charges,
  (SELECT count(*) FROM payer_charges) AS payer_charges""",
    "hospital_load_summary": f"""{_STAR}
SELECT hospital_id, hospital_name AS name, '2.2.0' AS version, '2024-07-01' AS last_updated_on,
  CAST(count(DISTINCT item_key) AS BIGINT) AS items, CAST(count(DISTINCT charge_key) AS BIGINT) AS charges
FROM rows_ GROUP BY ALL""",
    "first_hospital": f"""WITH {_CHARGES} SELECT hospital_name AS name, '2.2.0' AS version, hospital_address AS first_address
FROM charges ORDER BY ALL LIMIT 1""",
    "item_descriptions": f"{_STAR} SELECT description FROM items",
    "charge_values": f"{_STAR} SELECT description, gross_charge FROM standard_charges JOIN items USING (item_key)",
    "payer_details": f"""{_STAR} SELECT payer_name, plan_name, negotiated_dollar AS standard_charge_dollar, methodology
FROM payer_charges""",
    "item_drug_info": f"{_STAR} SELECT drug_unit, drug_unit_type FROM items WHERE description = 'small ring'",
    "item_notes": f"""{_STAR} SELECT s.generic_notes, p.payer_notes FROM items i
JOIN standard_charges s USING (item_key) JOIN payer_charges p USING (charge_key) WHERE i.description = 'small ring'""",
    "toc_plans": f"""{_TOC}
SELECT source_file, CAST(structure_id AS BIGINT) AS structure_id, plan_name, plan_id_type, plan_id, plan_market_type, issuer_name,
  plan_name || ' ' || plan_market_type || ' market plan from ' || issuer_name || ' (' || upper(plan_id_type) || ': ' || plan_id || ')'
    || CASE WHEN plan_sponsor_name <> '' THEN ', sponsored by ' || plan_sponsor_name ELSE '' END AS description,
  concat_ws(' ', CASE WHEN o_orderkey % 4 > 0 THEN 'https://example.org/' || o_custkey || '/0' END,
    CASE WHEN o_orderkey % 4 > 1 THEN 'https://example.org/' || o_custkey || '/1' END,
    CASE WHEN o_orderkey % 4 > 2 THEN 'https://example.org/' || o_custkey || '/2' END) AS in_network_urls,
  CAST(o_orderkey % 4 AS INTEGER) AS url_count
FROM matched WHERE is_match""",
    "toc_plans_market": f"""{_TOC}
SELECT plan_id_type, plan_market_type, issuer_name, CAST(count(*) AS BIGINT) AS plans
FROM listed WHERE plan_market_type = 'individual' GROUP BY ALL""",
    "toc_urls": f"""{_TOC}
SELECT source_file, CAST(structure_id AS BIGINT) AS reporting_structure_id, CAST(i AS INTEGER) AS url_ord,
  'https://example.org/' || o_custkey || '/' || i AS url
FROM (SELECT DISTINCT source_file, structure_id, o_orderkey, o_custkey FROM matched WHERE is_match),
  (VALUES (0), (1), (2)) AS numbers(i) WHERE i < o_orderkey % 4""",
    "toc_stats": f"""{_TOC}
SELECT source_file, CAST(2 AS BIGINT) AS total_structures, CAST(count(*) AS BIGINT) AS total_plans,
  CAST(count(DISTINCT CASE WHEN is_match THEN structure_id END) AS BIGINT) AS matched_structures,
  CAST(count(*) FILTER (WHERE is_match) AS BIGINT) AS matched_plans
FROM matched GROUP BY source_file""",
    "rates_flat": _rate_rows("LEFT", "links"),
    "npi_filtered_rates": _rate_rows("", _KEPT_LINKS),
    "providers_flat": f"{_RATES} SELECT * FROM providers",
    "npi_filtered_providers": f"{_RATES} SELECT * FROM kept_providers",
    "rates_join_providers": f"""{_RATES}
SELECT pr.npi, CAST(count(*) AS BIGINT) AS rates, max(p.negotiated_rate) AS highest_rate
FROM prices p JOIN links l USING (source_file, rate_ord)
JOIN providers pr USING (source_file, group_kind, provider_group_id) GROUP BY pr.npi""",
    "embedded_groups": """WITH listed AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'file-a' ELSE 'file-b' END AS source_file, o_orderkey AS item_ord,
    rate_ord, pos, o_custkey + pos + 2 * rate_ord AS key,
    CASE WHEN rate_ord = 1 THEN 2 WHEN pos = 0 THEN o_custkey % 3 ELSE 1 END AS n_npis
  FROM orders, (VALUES (0, 0), (0, 1), (1, 0)) AS v(rate_ord, pos) WHERE rate_ord = 0 OR o_orderstatus = 'F'
)
SELECT source_file, item_ord, CAST(rate_ord AS INTEGER) AS rate_ord,
  row_number() OVER (PARTITION BY source_file ORDER BY item_ord, rate_ord, pos) AS provider_group_id,
  lpad(CAST(key AS VARCHAR), 9, '0') AS tin_value,
  concat_ws(',', CASE WHEN n_npis > 0 THEN CAST(1000000000 + key * 10 AS VARCHAR) END,
    CASE WHEN n_npis > 1 THEN CAST(1000000000 + key * 10 + 1 AS VARCHAR) END) AS npis
FROM listed""",
    "conversion_stats": f"""{_RATES}
SELECT d.source_file, CAST(1 AS BIGINT) AS in_network_items, CAST(3 AS BIGINT) AS rate_rows,
  CAST(count(p.npi) AS BIGINT) AS provider_rows
FROM docs d LEFT JOIN providers p USING (source_file) GROUP BY d.source_file""",
    "tall_parse": f"""
SELECT 'hospital-' || (l_suppkey % 2) AS source_file, l_orderkey * 8 + l_linenumber AS row_ord,
  'item ' || l_partkey AS description, CASE WHEN l_returnflag = 'A' THEN 'inpatient' ELSE 'outpatient' END AS setting,
  CAST(CASE WHEN l_linenumber % 2 = 1 AND l_linenumber % 3 = 0 THEN l_suppkey ELSE l_partkey END AS VARCHAR) AS cpt_code,
  CAST(NULL AS VARCHAR) AS hcpcs_code, l_extendedprice AS gross_charge,
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS discounted_cash,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_returnflag END AS payer_name, 'PPO' AS plan_name,
  CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS negotiated_dollar,
  CAST(NULL AS DOUBLE) AS negotiated_percentage, CAST(NULL AS DOUBLE) AS estimated_amount,
  'fee schedule' AS methodology, CASE WHEN l_linenumber % 2 = 1 THEN '26|TC' END AS modifiers,
  CAST(NULL AS VARCHAR) AS additional_payer_notes, {_CSV_META}
FROM lineitem""",
    "wide_unpivot": f"""WITH long AS (
  SELECT *, 'Acme Health' AS payer_name FROM lineitem WHERE l_linenumber % 2 = 0
  UNION ALL SELECT *, 'Beta' FROM lineitem WHERE l_linenumber % 3 = 0 OR l_linenumber = 7
  UNION ALL SELECT *, NULL FROM lineitem WHERE l_linenumber IN (1, 5)
)
SELECT 'hospital-' || (l_suppkey % 2) AS source_file, l_orderkey * 8 + l_linenumber AS row_ord,
  'item ' || l_partkey AS description, 'both' AS setting, CAST(NULL AS VARCHAR) AS cpt_code,
  CAST(l_partkey AS VARCHAR) AS hcpcs_code, l_extendedprice AS gross_charge, CAST(NULL AS DOUBLE) AS discounted_cash,
  payer_name, CASE payer_name WHEN 'Acme Health' THEN 'Gold' WHEN 'Beta' THEN 'PPO Plus' END AS plan_name,
  CASE WHEN payer_name = 'Acme Health' THEN l_extendedprice END AS negotiated_dollar,
  CASE WHEN payer_name = 'Beta' AND l_linenumber % 3 = 0 THEN l_quantity END AS negotiated_percentage,
  CASE WHEN payer_name = 'Acme Health' AND l_linenumber % 4 = 0 THEN l_quantity END AS estimated_amount,
  CASE WHEN payer_name = 'Acme Health' THEN 'case rate' END AS methodology, CAST(NULL AS VARCHAR) AS modifiers,
  CASE WHEN payer_name = 'Beta' AND l_linenumber = 7 THEN 'see notes' END AS additional_payer_notes, {_CSV_META}
FROM long""",
    "json_expand": f"{_HOSPITAL_ROWS} SELECT * FROM rows_",
    "charge_conversion_stats": f"""{_HOSPITAL_ROWS}
SELECT source_file, CAST(count(*) AS BIGINT) AS charge_rows, CAST(count(payer_name) AS BIGINT) AS payer_rows,
  CAST(count(DISTINCT CASE WHEN payer_name IS NOT NULL THEN payer_name || '|' || plan_name END) AS BIGINT) AS payer_plan_pairs
FROM rows_ GROUP BY source_file""",
    "modifier_payers": """
SELECT 'AS' AS code, 'assistant' AS modifier, payer_name, description, CAST(count(*) AS BIGINT) AS uses FROM (
  SELECT o_orderpriority AS payer_name, '85%' AS description FROM orders
  UNION ALL SELECT 'Other', '90%' FROM orders) GROUP BY ALL""",
    "date_fallback": """SELECT o_orderkey,
  CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
    "flex_numbers": """SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 < 2 THEN o_totalprice WHEN o_orderkey % 7 = 6 THEN round(o_totalprice) END AS money,
  CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice WHEN o_orderkey % 7 = 6 THEN round(o_totalprice) END AS flexible,
  o_orderkey % 7 IN (1, 3, 4, 5) AS is_bad FROM orders""",
    "utf8_repair": """SELECT doc_id,
  md5(regexp_replace(text, '[eaou�]+', chr(65533), 'g')) AS repaired,
  md5(regexp_replace(text, '[eaou�]+', ' ', 'g')) AS loaded FROM documents""",
    "metric_history": f"{_HISTORY} SELECT o_custkey, metric, year, value FROM history",
    "metric_range": f"""{_HISTORY}
SELECT o_custkey, metric, min(value) AS min_value, max(value) AS max_value FROM history GROUP BY ALL""",
    "plan_match_topk": _MATCH,
    "plan_index_stats": f"""{_TOC},
published AS (
  SELECT 'hios' AS plan_id_type, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS plan_id,
    replace(p_brand, '#', ' ') || ' Health' AS issuer_name, (['NY', 'CA', 'TX', 'FL', 'WA'])[p_partkey % 5 + 1] AS state
  FROM part WHERE p_partkey % 10 <> 0
),
plan_ids AS (
  SELECT plan_id_type, plan_id, min(issuer_name) AS issuer_name,
    CASE WHEN plan_id_type = 'hios' THEN substr(upper(plan_id), 6, 2) END AS state
  FROM listed GROUP BY plan_id_type, plan_id
  UNION ALL SELECT * FROM published
)
SELECT state, CAST(count(*) AS BIGINT) AS plans, CAST(count(DISTINCT issuer_name) AS BIGINT) AS issuers,
  CAST(count(*) FILTER (WHERE plan_id_type = 'hios') AS BIGINT) AS hios_plans,
  CAST(count(*) FILTER (WHERE plan_id_type = 'ein') AS BIGINT) AS ein_plans
FROM plan_ids GROUP BY state""",
    "conformance_report": _report(_CHARGE_RULES, f"WITH {_CHARGES}", "charges", "source_file,"),
    "toc_conformance": _report(
        {
            "structure has plans": "false",
            "structure has files": "o_orderkey % 4 = 0",
            "in-network locations are https": "false",
            "allowed-amount location is https": "false",
            "plan id type is known": "false",
            "market type is known": "false",
            "ein plan has a sponsor": "false",
            "plan has name, id and issuer": "false",
        },
        "WITH structures AS (SELECT o_orderkey FROM orders, (VALUES (1), (2)) AS v(n))",
        "structures",
    ),
    "rate_conformance": _report(
        {
            "arrangement is known": "false",
            "billing code type is known": "false",
            "negotiated type is known": "negotiated_type NOT IN ('negotiated', 'fee schedule')",
            "billing class is known": "false",
            "setting is known": "false",
            "rate is positive": "negotiated_rate <= 0",
            "expiration date is a date": "false",
            "professional rate has service codes": "false",
            "service codes are valid": "false",
            "plan fields come together": "line % 3 = 0",
            "ein plan has a sponsor": "false",
        },
        _RATES,
        "prices JOIN docs USING (source_file)",
    ),
    "provider_conformance": _report(
        {
            "NPI has ten digits or is zero": "npi NOT BETWEEN 1000000000 AND 9999999999 AND npi <> 0",
            "TIN type is known": "tin_type NOT IN ('ein', 'npi')",
            "EIN has its form": "tin_type = 'ein' AND NOT regexp_matches(tin_value, '^[0-9]{2}-?[0-9]{7}$')",
            "NPI as TIN has its form": "tin_type = 'npi' AND NOT regexp_matches(tin_value, '^[1-9][0-9]{9}$')",
            "EIN has a business name": "tin_type = 'ein' AND business_name IS NULL",
        },
        _RATES,
        "providers",
    ),
    "json_conformance": _report(
        {
            "percentage or algorithm has a count": "false",
            "count above zero has median and percentiles": "false",
            "count of zero has notes": "false",
            "count has a valid form": '"count" NOT IN (\'11\')',
            "amounts are positive": "median_amount <= 0",
        },
        _HOSPITAL_ROWS,
        "rows_",
        "version,",
    ),
}

ORACLES["star_files"] = f"{ORACLES['table_counts']} UNION ALL SELECT 'linked payer charges', count(*) FROM payer_charges"


def _breaks(part: str, rules: list[str], broken: bool = True) -> str:
    """The i-th of n rules is broken where o_orderkey % (n + 1) is i, and nowhere else."""
    values = ", ".join(f"('{rule}', {i})" for i, rule in enumerate(rules))
    condition = f"o_orderkey % {len(rules) + 1} = i" if broken else "false"
    return f"""SELECT '{part}' AS part, rule, CAST(count(*) FILTER (WHERE {condition}) AS BIGINT) AS violations,
  CAST(count(*) AS BIGINT) AS checked_rows FROM orders, (VALUES {values}) AS rules(rule, i) GROUP BY rule"""


_V3_RULES = [
    "percentage or algorithm has a count",
    "count above zero has median and percentiles",
    "count of zero has notes",
    "count has a valid form",
    "amounts are positive",
]
ORACLES["conformance_breaks"] = " UNION ALL ".join(
    [
        _breaks("charges", list(_CHARGE_RULES)),
        _breaks("version 3", _V3_RULES),
        _breaks("version 2", _V3_RULES, broken=False),
        _breaks(
            "structures",
            [
                "structure has plans",
                "structure has files",
                "in-network locations are https",
                "allowed-amount location is https",
                "plan id type is known",
                "market type is known",
                "ein plan has a sponsor",
                "plan has name, id and issuer",
            ],
        ),
        _breaks(
            "rates",
            [
                "arrangement is known",
                "billing code type is known",
                "negotiated type is known",
                "billing class is known",
                "setting is known",
                "rate is positive",
                "expiration date is a date",
                "professional rate has service codes",
                "service codes are valid",
                "plan fields come together",
                "ein plan has a sponsor",
            ],
        ),
        _breaks(
            "providers",
            [
                "NPI has ten digits or is zero",
                "TIN type is known",
                "EIN has its form",
                "NPI as TIN has its form",
                "EIN has a business name",
            ],
        ),
    ]
)
ORACLES["csv_code_conformance"] = _report(
    {"code and code type come together": "l_linenumber % 2 = 0", "code type is known": "l_linenumber % 3 <> 0"},
    "WITH records AS (SELECT *, 'hospital-' || (l_suppkey % 2) AS source_file FROM lineitem)",
    "records",
    "source_file,",
)

ORACLES["plan_match_similarity_056"] = _MATCH_056
ORACLES["plan_match_aliases"] = _MATCH_ALIASES
ORACLES["plan_by_id"] = f"""{_TOC}
SELECT 'hios' AS plan_id_type, '000000007' AS plan_id, p_name || ' ' || p_type AS plan_name,
  replace(p_brand, '#', ' ') || ' Health' AS issuer_name, (['NY', 'CA', 'TX', 'FL', 'WA'])[p_partkey % 5 + 1] AS state
FROM part WHERE p_partkey = 7
UNION ALL SELECT plan_id_type, plan_id, min(plan_name), min(issuer_name), NULL FROM listed WHERE plan_id = '000000007' GROUP BY plan_id_type, plan_id"""

ORACLES["json_conversion_stats"] = f"""{_HOSPITAL_ROWS}
SELECT 'order-' || o_orderkey AS source_file, CAST(1 AS BIGINT) AS input_records, CAST(count(r.source_file) AS BIGINT) AS charge_rows,
  CAST(count(payer_name) AS BIGINT) AS payer_rows,
  CAST(count(DISTINCT CASE WHEN payer_name IS NOT NULL THEN payer_name || '|' || plan_name END) AS BIGINT) AS payer_plan_pairs
FROM orders LEFT JOIN rows_ r ON r.source_file = 'order-' || o_orderkey GROUP BY o_orderkey"""
