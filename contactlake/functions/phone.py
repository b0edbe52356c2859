"""Phone expressions, parameterised by numbering plan."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import fixed_values as V

_GAP = rf"[{V.WHITE_SPACE}\-()]*"


@dataclass(frozen=True)
class NumberingPlan:
    """One country's rules.  All patterns run on digits only, except the text runs."""

    name: str
    country: str           # first digit of a normalised number
    national: str          # digits -> group 1 = ten national digits
    allowed: str           # same, but only numbers worth calling
    toll_free: str         # on the national part
    mobile: str
    city: str
    trunk_run: str         # number in running text, with country or trunk prefix
    bare_run: str | None   # number in running text without any prefix
    hint: str              # cheap test for a likely number in raw HTML

    def text_run(self, strict: bool = False) -> str:
        first = rf"(?<![0-9]){self.trunk_run}" if strict else self.trunk_run
        return f"{first}|{self.bare_run}" if self.bare_run else first


RU = NumberingPlan(
    name="ru", country="7",
    national=r"^[78]?([0-9]{10})$",
    allowed=r"^[78]?((?:[345679][0-9]{2}|8(?:[1-9][0-9]|0[1-9]))[0-9]{7})$",
    toll_free=r"^800", mobile=r"^9", city=r"^[3-8]",
    trunk_run=rf"(?:\+7|8){_GAP}(?:[0-9]{_GAP}){{10}}",
    bare_run=rf"(?<![0-9])9[0-9]{{2}}{_GAP}[0-9]{{3}}{_GAP}[0-9]{{2}}{_GAP}[0-9]{{2}}(?![0-9])",
    hint=rf"(?i)(?:\+7|8){_GAP}(?:[0-9]{_GAP}){{9,}}|tel:\s*\+?[0-9]",
)

# The North American plan has no mobile range.  The split by first digit is a
# convention that lets type-dependent rules run on such data.
NANP = NumberingPlan(
    name="nanp", country="1",
    national=r"^1?([0-9]{10})$",
    allowed=r"^1?((?:[1-79][0-9]{2}|8(?:[1-9][0-9]|0[1-9]))[0-9]{7})$",
    toll_free=r"^800", mobile=r"^[5679]", city=r"^[12348]",
    trunk_run=rf"\+1{_GAP}(?:[0-9]{_GAP}){{10}}",
    bare_run=None,
    hint=rf"(?i)\+1{_GAP}(?:[0-9]{_GAP}){{9,}}|tel:\s*\+?[0-9]",
)

PLANS = {p.name: p for p in (RU, NANP)}


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]+", "")


def _with_country(national: Column, plan: NumberingPlan) -> Column:
    # nullif, so that a number that does not fit becomes NULL and not the bare prefix
    return F.concat(F.lit(plan.country), F.nullif(national, F.lit("")))


def normalize_digits(raw: Column, plan: NumberingPlan = RU) -> Column:
    """Eleven digits with the country digit first, NULL when the input has another shape."""
    return _with_country(F.regexp_extract(_digits(raw), plan.national, 1), plan)


def normalize_phone(raw: Column, plan: NumberingPlan = RU) -> Column:
    """``normalize_digits`` for numbers of an allowed type (mobile or city), else NULL."""
    return _with_country(F.regexp_extract(_digits(raw), plan.allowed, 1), plan)


def phone_type(phone: Column, plan: NumberingPlan = RU) -> Column:
    """mobile / city / excluded (toll-free) / invalid."""
    national = F.substring(phone, 2, 10)
    shaped = phone.rlike(rf"^{plan.country}[0-9]{{10}}$")
    return (
        F.when(phone.isNull() | ~shaped, "invalid")
        .when(national.rlike(plan.toll_free), "excluded")
        .when(national.rlike(plan.mobile), "mobile")
        .when(national.rlike(plan.city), "city")
        .otherwise("invalid")
    )


def is_valid(phone: Column, plan: NumberingPlan = RU) -> Column:
    return phone_type(phone, plan).isin("mobile", "city")


def invalid_reason(phone: Column, plan: NumberingPlan = RU) -> Column:
    """Empty for a valid number; otherwise empty input, toll-free or bad format."""
    kind = phone_type(phone, plan)
    return (
        F.when(phone.isNull() | (phone == ""), "empty")
        .when(kind.isin("mobile", "city"), "")
        .when(kind == "excluded", "toll-free")
        .otherwise("format")
    )


def format_display(raw: Column, plan: NumberingPlan = RU) -> Column:
    """``+7 (ddd) ddd-dd-dd``; input that is not a number is returned unchanged."""
    shown = F.regexp_replace(
        normalize_digits(raw, plan),
        r"^(\d)(\d{3})(\d{3})(\d{2})(\d{2})$", r"+$1 ($2) $3-$4-$5",
    )
    return F.coalesce(shown, raw, F.lit(""))


def phones_in_text(text: Column, plan: NumberingPlan = RU, strict: bool = False) -> Column:
    """Allowed numbers in running text, in order, with repeats."""
    runs = F.regexp_extract_all(text, F.lit(plan.text_run(strict)), F.lit(0))
    return F.filter(F.transform(runs, lambda r: normalize_phone(r, plan)), lambda p: p.isNotNull())


_CONTEXT = (
    rf"(?iu)(?:{'|'.join(V.CONTEXT_WORDS)})[:{V.WHITE_SPACE}\-—]{{0,12}}"
    rf"([+0-9(){V.WHITE_SPACE}\-—]{{10,24}})"
)


def phones_after_words(text: Column, plan: NumberingPlan = RU) -> Column:
    """Allowed numbers announced by a word such as "phone:"."""
    runs = F.regexp_extract_all(text, F.lit(_CONTEXT), F.lit(1))
    return F.filter(F.transform(runs, lambda r: normalize_phone(r, plan)), lambda p: p.isNotNull())


def phone_hint(html: Column, plan: NumberingPlan = RU) -> Column:
    """Cheap test on the first 80 000 characters."""
    return F.coalesce(F.substring(html, 1, 80_000).rlike(plan.hint), F.lit(False))


def filter_by_policy(phones: Column, policy: str, plan: NumberingPlan = RU, fallback: bool = False) -> Column:
    """Keep the numbers the policy wants, in order.

    ``fallback`` adds the picking rule: "mobile" without any mobile falls back to business.
    """
    keep = {
        "mobile": lambda p: phone_type(p, plan) == "mobile",
        "city": lambda p: phone_type(p, plan) == "city",
        "business": lambda p: phone_type(p, plan).isin("mobile", "city"),
        "all": lambda p: phone_type(p, plan).isin("mobile", "city"),
        "no-800": lambda p: ~p.rlike(rf"^{plan.country}800"),
    }
    if policy not in keep:
        return F.filter(phones, lambda p: F.lit(False))
    kept = F.filter(phones, keep[policy])
    if fallback and policy == "mobile":
        return F.when(F.size(kept) > 0, kept).otherwise(F.filter(phones, keep["business"]))
    return kept
