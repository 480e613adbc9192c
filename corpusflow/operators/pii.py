"""Masking of personal data: by regular expressions in Catalyst, or by scored recognisers."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Literal

import pandas as pd
from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fields import get_field, helper, set_field, with_helpers, without_helpers
from corpusflow.functions.text import SPACE
from corpusflow.plans.base import MapFn, Semantics
from corpusflow.plans.registry import components

Entity = Literal["CREDIT_CARD", "IBAN_CODE", "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "URL"]
ENTITIES: tuple[str, ...] = ("CREDIT_CARD", "IBAN_CODE", "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "URL")  # the order in which they are masked

PLACEHOLDER = {
    "de": dict(zip(ENTITIES, ("4242 4242 4242 4242", "DE02 1203 0000 0000 2020 51", "name@beispiel.de", "+49 123 45678910", "192.0.2.255", "https://www.beispiel.de"))),
    "en": dict(zip(ENTITIES, ("4242 4242 4242 4242", "GB29 NWBK60 1613 3192 6819", "name@example.com", "+1 123 456 7890", "192.0.2.255", "https://www.example.com"))),
}

# countries by the structure of their account numbers: n digits, a capitals, c alphanumerics; a blank is an optional space
IBAN = {
    " n2 a4 n4 n4 n4 n4 n4": "SV",
    "n2 a1n3 n4 n3c1 c4 c4 c3": "IT SM",
    "n2 a2 n2 n4 n4 n4 n2": "GE",
    "n2 a2n2 n4 n4 n2": "FK",
    "n2 a4 c4 c4 c4 c1": "LV",
    "n2 a4 c4 c4 c4 c2": "BH",
    "n2 a4 c4 c4 c4 c3": "GI",
    "n2 a4 c4 c4 c4 c4": "AZ RO",
    "n2 a4 c4 c4 c4 c4 c4 c1": "PS QA",
    "n2 a4 c4 c4 c4 c4 c4 c2": "KW",
    "n2 a4 c4 c4 c4 c4 c4 c4": "LC",
    "n2 a4 n4 c4 c4": "BG",
    "n2 a4 n4 c4 c4 c4 c4 c2": "JO",
    "n2 a4 n4 n1c3 c4 c4 c4 c3": "MT",
    "n2 a4 n4 n4 n2": "IE NL",
    "n2 a4 n4 n4 n4 n2": "GB",
    "n2 a4 n4 n4 n4 n3": "IQ",
    "n2 a4 n4 n4 n4 n4": "VG",
    "n2 a4 n4 n4 n4 n4 n3a1 a2": "MU",
    "n2 a4 n4 n4 n4 n4 n4": "NI",
    "n2 a4 n4 n4 n4 n4 n4 a3": "SC",
    "n2 c4 c4 c4 c4 c4": "MD",
    "n2 c4 c4 c4 c4 c4 c4": "GT",
    "n2 c4 n4 c4 c4 c4 c4": "BY",
    "n2 c4 n4 n4 n4 n4 n4": "DO",
    "n2 n2c2 c4 c4 c4 c4": "SA",
    "n2 n3 n3 n15": "LY",
    "n2 n3 n4 n4 n4 n3": "VA",
    "n2 n3c1 c4 c4 c3": "MK",
    "n2 n3c1 c4 c4 c4": "KZ LU",
    "n2 n3c1 c4 c4 c4 c3": "OM",
    "n2 n4 c4 c4 c4 c4 c4": "LB",
    "n2 n4 n1c3 c4 c4 c1": "CH LI",
    "n2 n4 n2c2 c4 c4 c4 c2": "TR",
    "n2 n4 n2c2 c4 c4 c4 c4 c1": "UA",
    "n2 n4 n3c1 c4 c4 c4 c3": "GR",
    "n2 n4 n4 c12": "AD",
    "n2 n4 n4 c4 c4 c4 c4": "AL CY",
    "n2 n4 n4 n2c2 c4 c4 c1n2": "FR",
    "n2 n4 n4 n3": "NO",
    "n2 n4 n4 n4": "BE",
    "n2 n4 n4 n4 n2": "DK FI FO GL SD",
    "n2 n4 n4 n4 n2c2 c4 c4 c4 c1": "RU",
    "n2 n4 n4 n4 n3": "SI SO",
    "n2 n4 n4 n4 n4": "AT BA EE LT MN XK",
    "n2 n4 n4 n4 n4 n1": "HR",
    "n2 n4 n4 n4 n4 n2": "CR DE ME RS",
    "n2 n4 n4 n4 n4 n3": "AE IL MR TL",
    "n2 n4 n4 n4 n4 n4": "CZ ES SE SK TN",
    "n2 n4 n4 n4 n4 n4 c1n2": "MC",
    "n2 n4 n4 n4 n4 n4 n1": "PT ST",
    "n2 n4 n4 n4 n4 n4 n2": "IS",
    "n2 n4 n4 n4 n4 n4 n3": "DJ",
    "n2 n4 n4 n4 n4 n4 n3a1 c1": "BR",
    "n2 n4 n4 n4 n4 n4 n4": "HU PL",
    "n2 n4 n4 n4 n4 n4 n4 n1": "EG",
    "n2 n5 n5 n11 n2": "BI",
}
_SETS = {"n": r"\p{Nd}", "a": "[A-Z]", "c": "[a-zA-Z0-9]"}


def iban_pattern(digit: str, space: str) -> str:
    sets = _SETS | {"n": digit}

    def part(code: str) -> str:
        return re.sub(r" |([nac])(\d+)", lambda m: f"{space}?" if m.group() == " " else f"{sets[m.group(1)]}{{{m.group(2)}}}", code)

    return "|".join(f"(?:{'|'.join(countries.split())}){part(code)}" for code, countries in IBAN.items())


def patterns(digit: str = r"\p{Nd}", space: str = SPACE, semantics: Semantics = "compat") -> dict[str, str]:
    """Java patterns; ``compat`` has the URL pattern that begins with a backspace and so hardly ever matches."""
    not_in = space.replace("[", "[^", 1)[:-1] if space.startswith("[") else "[^" + space
    around = r".,?!;:)(@"
    octet = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    start = r"\x08" if semantics == "compat" else r"(?<![\p{L}\p{N}_])"
    inner = r"\((?:[^\s()<>]+|\([^\s()<>]+\))*\)"
    return {
        "CREDIT_CARD": rf"(?={digit})(?<![\p{{L}}\p{{N}}_])(?:{digit}{{4}}(?:-|{space})?){{3}}{digit}{{4}}(?![\p{{L}}\p{{N}}_])",
        "IBAN_CODE": f"(?=[A-Z]{{2}}{digit})(?:{iban_pattern(digit, space)})",
        "EMAIL_ADDRESS": rf"(?:[{around}]|{space})*({not_in}@]+@{not_in}@,?!;:)(]+?)(?:[{around}]|{space})?{space}",
        "PHONE_NUMBER": rf"{space}+\(?({digit}{{3}})\)?[-. ]*({digit}{{3}})[-. ]?({digit}{{4}})",
        "IP_ADDRESS": rf"(?=[0-9])(?:{octet}\.){{3}}{octet}",
        "URL": rf"(?i){start}(?:https?://|www{digit}{{0,3}}[.]|[a-z0-9.-]+[.][a-z]{{2,4}}/)(?:[^\s()<>]+|{inner})+(?:{inner}|[^\s`!()\[\]{{}};:'\".,<>?«»“”‘’])",
    }


class _Masking(MapFn):
    entity_types: list[Entity] = Field(default=list(ENTITIES), description="What to mask; always in the same order")
    language: Literal["en", "de"] = Field(default="de")
    anonymization_method: Literal["redact", "replace"] = Field(default="replace")


@components.add("format", "pii_regex")
class RegexPII(_Masking):
    name: str = Field(default="pii_regex")
    flag: str | None = Field(default=None, description="Field that tells whether the text changed")
    semantics: Semantics = Field(default="compat")

    def masked(self, text: Column) -> Column:
        every, source = patterns(semantics=self.semantics), text
        for e in ENTITIES:
            if e in self.entity_types:
                new = F.regexp_replace(text, every[e], "" if self.anonymization_method == "redact" else PLACEHOLDER[self.language][e])
                text = F.when(F.contains(source, F.lit("@")), new).otherwise(text) if e == "EMAIL_ADDRESS" else new
        return text

    def transform(self, df: DataFrame) -> DataFrame:
        text = self.text(df)
        new = self.masked(text)
        if not self.flag:
            return set_field(df, self.to, new)
        out = with_helpers(df, masked=new)
        out = set_field(out, self.flag, ~get_field(out, self.on).eqNullSafe(helper("masked")))
        return without_helpers(set_field(out, self.to, helper("masked")))

    __call__ = transform


def luhn(number: str) -> bool:
    ds = [int(c) for c in number if c.isdigit()][::-1]
    return len(ds) >= 12 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def iban_valid(code: str) -> bool:
    c = "".join(code.split()).upper()
    return c.isalnum() and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


Recogniser = Callable[[str], list[tuple[int, int, str, float]]]


def _rules() -> Recogniser:
    """Spans with scores: checksums raise a candidate, their failure lowers it."""
    of = {e: re.compile(p) for e, p in {
        "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "IBAN_CODE": iban_pattern(r"\d", r"\s"), "EMAIL_ADDRESS": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "PHONE_NUMBER": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]*\d{3}[ .-]?\d{4}(?!\d)",
        "IP_ADDRESS": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])", "URL": r"(?:https?://|www\.)[^\s<>()]+[^\s<>().,;:!?]"}.items()}

    def score(e: str, t: str) -> float:
        if e == "CREDIT_CARD":
            return 1.0 if luhn(t) else 0.3
        if e == "IBAN_CODE":
            return 1.0 if iban_valid(t) else 0.4
        return {"EMAIL_ADDRESS": 1.0, "PHONE_NUMBER": 0.5, "IP_ADDRESS": 0.6, "URL": 0.6}[e]

    return lambda text: [(m.start(), m.end(), e, score(e, m.group())) for e, p in of.items() for m in p.finditer(text)]


@components.add("format", "pii_presidio")
class ScoredPII(_Masking):
    """Recogniser spans above a confidence, each entity with its own method.

    The default backend is rules with checksums; with ``nlp_engine_name`` other than
    'rules' the analyzer package of that name must be installed. One recogniser is
    made per worker, not one actor for all.
    """

    name: str = Field(default="pii_scored")
    confidence_threshold: float = Field(default=0.5, ge=0, le=1)
    entity_methods: dict[str, str] = Field(default_factory=dict, description="Method by entity")
    nlp_engine_name: str = Field(default="rules")
    pool_size: int = Field(default=1, gt=0, description="Kept for configurations; workers need no pool")

    def column(self, df: DataFrame) -> Column:
        wanted, least, methods, default, fill = set(self.entity_types), self.confidence_threshold, dict(self.entity_methods), self.anonymization_method, PLACEHOLDER[self.language]
        engine, language = self.nlp_engine_name, self.language

        def recogniser() -> Recogniser:
            if engine == "rules":
                return _rules()
            from presidio_analyzer import AnalyzerEngine
            from presidio_analyzer.nlp_engine import NlpEngineProvider

            nlp = NlpEngineProvider(nlp_configuration={"nlp_engine_name": engine, "models": [{"lang_code": language, "model_name": f"{language}_core_news_sm"}]}).create_engine()
            a = AnalyzerEngine(nlp_engine=nlp)
            return lambda t: [(r.start, r.end, r.entity_type, r.score) for r in a.analyze(text=t, language=language, entities=sorted(wanted))]

        @F.pandas_udf("string")
        def mask(texts: pd.Series) -> pd.Series:
            find = recogniser()

            def one(t: str | None) -> str | None:
                if not t:
                    return t
                spans = sorted((s for s in find(t) if s[2] in wanted and s[3] >= least), key=lambda s: (-s[3], s[0] - s[1], s[0]))
                taken: list[tuple[int, int, str]] = []
                for a, b, e, _ in spans:
                    if all(b <= x or y <= a for x, y, _ in taken):
                        taken.append((a, b, e))
                for a, b, e in sorted(taken, reverse=True):
                    t = t[:a] + ("" if methods.get(e, default) == "redact" else fill.get(e, "")) + t[b:]
                return t

            return texts.map(one)

        return mask(self.text(df))
