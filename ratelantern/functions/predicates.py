"""Filter conditions as columns."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelantern.fixed_values import NEW_YORK_KEYWORDS
from ratelantern.functions.clean import empty_if_null


@dataclass(frozen=True)
class PlanFilter:
    """Which plans to keep. Keywords and state codes act only when a state is given."""

    state: str = ""
    market: str = ""
    use_hios: bool = True
    use_keywords: bool = True
    keywords: Sequence[str] = field(default_factory=lambda: tuple(NEW_YORK_KEYWORDS))
    extra_keywords: Sequence[str] = ()

    @property
    def all_keywords(self) -> list[str]:
        extra = [k.strip().lower() for k in self.extra_keywords]
        if any("\n" in k or "\\E" in k for k in extra):
            raise ValueError("a keyword is a single line of plain text")
        return [*self.keywords, *[k for k in extra if k]]


def _any_of(keywords: Sequence[str]) -> str:
    """A pattern that finds any of the literal texts."""
    return "|".join(r"\Q" + k + r"\E" for k in keywords)


def hios_state(plan_id: Column) -> Column:
    """Characters six and seven of a HIOS plan id."""
    return F.when(F.length(plan_id) >= 7, F.substring(F.upper(plan_id), 6, 2))


def plan_matches(plan: Callable[[str], Column], wanted: PlanFilter) -> Column:
    """Condition on a plan; ``plan("plan_id")`` yields the column of that field."""
    market_ok = F.lit(True)
    if wanted.market:
        market_ok = empty_if_null(plan("plan_market_type")) == wanted.market
    evidence = []
    if wanted.state and wanted.use_hios:
        is_hios = plan("plan_id_type") == "hios"
        evidence.append(is_hios & (hios_state(plan("plan_id")) == wanted.state.upper()))
    if wanted.state and wanted.use_keywords:
        # One text with line breaks between the names; no keyword has one, so none can match
        # across two names.
        names = F.concat_ws("\n", *[plan(f) for f in ("plan_name", "issuer_name", "plan_sponsor_name")])
        evidence.append(F.lower(names).rlike(_any_of(wanted.all_keywords)))
    if not evidence:
        return market_ok
    found = reduce(or_, [F.coalesce(e, F.lit(False)) for e in evidence])
    return market_ok & found


def plan_description(plan: Callable[[str], Column]) -> Column:
    market = F.when(plan("plan_market_type") == "individual", "individual").otherwise("group")
    id_kind = F.when(plan("plan_id_type") == "hios", "HIOS").otherwise("EIN")
    sponsor = empty_if_null(plan("plan_sponsor_name"))
    return F.concat(
        empty_if_null(plan("plan_name")), F.lit(" "), market, F.lit(" market plan from "),
        empty_if_null(plan("issuer_name")), F.lit(" ("), id_kind, F.lit(": "),
        empty_if_null(plan("plan_id")), F.lit(")"),
        F.when(sponsor != "", F.concat(F.lit(", sponsored by "), sponsor)).otherwise(""),
    )


def escape_like(text: str) -> str:
    """Make ``%``, ``_`` and the escape character stand for themselves."""
    return text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def search_conditions(
    code: Column, description: Column, text: str, wildcards: bool = False
) -> tuple[Column, Column]:
    """(code starts with the text, description contains it); texts under two characters
    match nothing."""
    if not text or len(text) < 2:
        return F.lit(False), F.lit(False)
    pattern = text if wildcards else escape_like(text)
    return code.ilike(f"{pattern}%"), description.ilike(f"%{pattern}%")
