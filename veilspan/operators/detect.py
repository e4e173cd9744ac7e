"""Pattern detectors: pages in, spans out.

A detector is data (name, label, confidence, pattern, validator), kept in a
registry in order of evaluation. Later matches with the place of an earlier one
are dropped; other overlaps are left to the resolution.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BOUNDARY, DATE_NUMERIC, DATE_WRITTEN, digits, let, matches, normalize, running, siren_checksum, spaced, strip
from .scanning import arrow_pattern, scanner
from .spans import SPANS_TYPE, resolved_items, sort_item

# The detection patterns ({B} is an ASCII word boundary).
UUID = r"[A-F0-9]{8}-[A-F0-9]{4}-[0-9A-F]{4}-[A-F0-9]{4}-[A-F0-9]{12}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_FR = r"(?:(?:\+33|0033|0)\s*[1-9](?:[\s.-]*[0-9]{2}){4})"
PHONE_INTL = r"(?:\+[0-9]{1,3}[\s.-]?)?\(?[0-9]{2,4}\)?[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{0,4}"
IBAN = r"{B}FR\s?[0-9]{2}(?:\s?[0-9A-Z]{4}){5}\s?[0-9A-Z]{3}{B}"
SIRET = r"{B}[0-9]{3}\s?[0-9]{3}\s?[0-9]{3}\s?[0-9]{5}{B}"
SIREN = r"{B}[0-9]{3}\s?[0-9]{3}\s?[0-9]{3}{B}"
CAPITAL = r"{B}[0-9]{1,3}(?:[\s,.]?[0-9]{3})*(?:[,.][0-9]{2})?\s*(?:€|euros?|EUR){B}"
DOCUSIGN = r"DocuSign\s+Envelope\s+ID:\s*" + UUID
ADDRESS_FULL = r"[0-9]{1,4}[,\s]+(?:rue|avenue|boulevard|place|allée|impasse|chemin|route)\s+[A-Za-zÀ-ÿ\s\x27-]+[,\s]+[0-9]{5}\s+[A-Za-zÀ-ÿ\s-]+"
POSTAL_CITY = r"{B}[0-9]{5}\s+[A-Z][a-zà-ÿ]+(?:[-\s][A-Za-zà-ÿ]+)*{B}"

# Texts that are never entities.
KNOWN_FALSE_POSITIVES = ("l'investisseur", "l'acquéreur", "l'investisseur financier", "l'investisseur financier.", "société", "filiales", "groupe", "entité")


@dataclass(frozen=True)
class Detector:
    name: str
    label: str
    confidence: float
    pattern: str
    ignore_case: bool = False
    valid: Callable[[Column], Column] | None = None
    #: Drop a match inside a strictly longer earlier one.
    within_longer: bool = False
    #: A class that holds whatever a match can begin with: other places are passed over at a glance.
    first: str = ""
    #: What every match holds, as a quick test of the text; ``digit`` for any digit.
    needs: str = ""
    #: Another spelling of the pattern with the same matches, if there is one that is found faster.
    faster: str = ""
    #: What ``valid`` tests, in the words of ``scanning.passing``; a detector that has ``valid`` alone is run by Spark's patterns.
    test: str = ""

    def arrow(self) -> str:
        return ("(?i)" if self.ignore_case else "") + arrow_pattern(spaced(self.pattern.replace("{B}", r"\b")))

    def java(self) -> str:
        body = self.faster or self.pattern
        if self.first and body.startswith("{B}"):  # before a word character a boundary is one that no word character precedes
            body = "(?<![A-Za-z0-9_])" + body.removeprefix("{B}")
        ahead = f"(?={self.first})" if self.first else ""
        return ("(?iu)" if self.ignore_case else "") + ahead + spaced(body.replace("{B}", BOUNDARY))


def _ten_digits(m: Column) -> Column:
    return F.length(digits(m)) >= 10


#: A match begins where a run of its characters does, or where the last match ended: no place inside a run is tried in vain.
_EMAIL_RUN = EMAIL.replace("+@", "++@", 1)
_DIGIT = {"first": "[0-9]", "needs": "digit"}
DETECTORS = (
    Detector("email", "IDENTIFIER", 0.95, EMAIL, needs="@", faster=rf"(?:\G|(?<![a-zA-Z0-9._%+-])){_EMAIL_RUN}"),
    Detector("phone_fr", "IDENTIFIER", 0.8, PHONE_FR, valid=_ten_digits, test="ten", first="[+0]", needs="digit"),
    Detector("phone_intl", "IDENTIFIER", 0.8, PHONE_INTL, valid=_ten_digits, test="ten", first="[+(0-9]", needs="digit"),
    Detector("iban", "IDENTIFIER", 0.95, IBAN, ignore_case=True, first="F", needs="digit"),
    Detector("siret", "IDENTIFIER", 0.85, SIRET, valid=siren_checksum, test="siren", **_DIGIT),
    Detector("siren", "IDENTIFIER", 0.85, SIREN, valid=siren_checksum, test="siren", within_longer=True, **_DIGIT),
    Detector("capital", "IDENTIFIER", 0.85, CAPITAL, ignore_case=True, **_DIGIT),
    Detector("docusign", "IDENTIFIER", 0.95, DOCUSIGN, ignore_case=True),
    Detector("date_numeric", "DATE", 0.7, "{B}" + DATE_NUMERIC + "{B}", **_DIGIT),
    Detector("date_written", "DATE", 0.7, "{B}" + DATE_WRITTEN + "{B}", ignore_case=True, **_DIGIT),
    Detector("address", "ADDRESS", 0.85, ADDRESS_FULL, ignore_case=True, **_DIGIT),
    Detector("postal_city", "ADDRESS", 0.85, POSTAL_CITY, **_DIGIT),
)


def run_detector(pages: DataFrame, detector: Detector) -> DataFrame:
    """One detector's valid matches: (doc_id, page_index, n, text, char_start, char_end)."""
    found = pages.select("doc_id", "page_index", F.posexplode(matches(F.col("text"), detector.java())).alias("n", "m"))
    out = found.select("doc_id", "page_index", "n", F.col("m.text").alias("text"), F.col("m.start").alias("char_start"), F.col("m.stop").alias("char_end"))
    return out.where(detector.valid(F.col("text"))) if detector.valid else out


def _kept(hits: Column, longer: list[int]) -> Column:
    """Hits in order of detection without those that have an earlier one's place, or (of detectors ``longer``) lie inside a strictly longer earlier one.

    One pass in order of place, longest first: an equal place is the neighbour before, and what reaches
    furthest of all before holds a hit if anything does.
    """
    by_place = lambda h: F.array_sort(F.transform(h, lambda m: F.struct(m["start"].alias("a"), (-m["stop"]).alias("z"), m["d"].alias("d"), m.alias("m"))))

    def choose(items: Column) -> Column:
        # furthest end of the hits of detectors before each one of ``longer``
        reach = [running(F.transform(items, (lambda k: lambda x: F.when(x["d"] < k, -x["z"]).otherwise(F.lit(-1)))(k)), lambda x, y: F.greatest(x, y)) for k in longer]

        def filtered(reached: Column) -> Column:
            def good(x: Column, i: Column) -> Column:
                before = F.get(items, i - 1)
                out = ~((i > 0) & (before["a"] == x["a"]) & (before["z"] == x["z"]))
                for n, k in enumerate(longer):
                    out = out & ~((x["d"] == k) & (i > 0) & (F.coalesce(F.get(F.get(reached, F.lit(n)), i - 1), F.lit(-1)) >= -x["z"]))
                return out

            return F.filter(items, good)

        return let(F.array(*reach), filtered) if longer else filtered(F.lit(None))

    in_order = lambda kept: F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["m"]["d"].alias("d"), x["m"]["i"].alias("i"), x["m"].alias("m")))), lambda x: x["m"])
    return let(hits, lambda h: F.when(F.size(h) > 1, in_order(let(by_place(h), choose))).otherwise(h))


def _hits(text: Column, detectors: tuple[Detector, ...]) -> Column:
    """Valid matches of all detectors as one array, in order of detection; texts without a digit skip the patterns that need one."""

    def of(k: int, d: Detector) -> Column:
        found = matches(text, d.java())
        if d.needs not in ("", "digit"):
            found = F.when(F.contains(text, F.lit(d.needs)), found).otherwise(F.array().cast("array<struct<start:int,stop:int,text:string>>"))
        if d.valid:
            found = F.filter(found, lambda m: d.valid(m["text"]))
        return F.transform(found, lambda m, i: F.struct(F.lit(k).alias("d"), i.alias("i"), m["start"].alias("start"), m["stop"].alias("stop"), m["text"].alias("text")))

    joined = lambda some: F.flatten(F.array(*[of(k, d) for k, d in some])) if some else F.array().cast("array<struct<d:int,i:int,start:int,stop:int,text:string>>")
    every = list(enumerate(detectors))
    return F.when(F.rlike(text, F.lit("[0-9]")), joined(every)).otherwise(joined([(k, d) for k, d in every if d.needs != "digit"]))


def _page_spans(text: Column, detectors: tuple[Detector, ...]) -> Column:
    """The raw spans of a text as an array of structs, with ``ord``, their order of detection."""
    kept = _kept(_hits(text, detectors), [k for k, d in enumerate(detectors) if d.within_longer])
    pick = lambda m, f: F.element_at(F.array(*[F.lit(f(d)) for d in detectors]), m["d"] + 1)
    return F.transform(
        kept,
        lambda m, i: F.struct(
            i.cast("long").alias("ord"), pick(m, lambda d: d.label).alias("label"), m["text"].alias("text"), normalize(m["text"]).alias("norm_text"),
            pick(m, lambda d: d.confidence).alias("confidence"), F.lit("regex").alias("source"), m["start"].alias("char_start"), m["stop"].alias("char_end"),
        ),
    )


def _scanned(detectors: tuple[Detector, ...], resolved: bool) -> Column:
    """A page's raw or resolved spans by ``scanning``: all patterns run over a batch of pages.

    Told to be non-deterministic, as in ``ner.token_starts``: the filter that a later ``inline`` brings would scan every page a second time.
    """
    body = scanner([(d.arrow(), d.test, d.within_longer) for d in detectors], [d.label for d in detectors], [d.confidence for d in detectors], resolved)
    return F.arrow_udf(body, SPANS_TYPE).asNondeterministic()("text")


def _by_arrow(detectors: tuple[Detector, ...]) -> bool:
    """Whether Arrow can run the detectors: no validators of their own, and patterns that it has too."""
    try:
        for d in detectors:
            pc.match_substring_regex(pa.array(["0"]), d.arrow())
    except pa.ArrowInvalid:  # look-around, for one
        return False
    return bool(detectors) and all(d.test or not d.valid for d in detectors)


def _page_resolved(spans: Column) -> Column:
    kind = f"array<struct<k1:int,k2:double,k3:bigint,s:{SPANS_TYPE.removeprefix('array<').removesuffix('>')}>>"
    resolved = lambda spans: let(F.array_sort(F.transform(spans, sort_item)).cast(kind), lambda items: F.transform(resolved_items(items, kind), lambda i: i["s"]))
    return let(spans, lambda spans: F.when(F.size(spans) > 1, resolved(spans)).otherwise(spans))


def page_spans(pages: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, *, resolved: bool = False) -> DataFrame:
    """Pages (doc_id, page_index, text) with their raw or resolved ``spans`` as one array."""
    if _by_arrow(detectors):
        spans = _scanned(detectors, resolved)
    else:
        raw = _page_spans(F.col("text"), detectors)
        spans = _page_resolved(raw) if resolved else raw
    return pages.select("doc_id", "page_index", "text", spans.alias("spans"))


def detect(pages: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """All detectors in one pass over the pages: raw spans with ``ord``, their order of detection.

    Matches of all detectors of a page are one array, so nothing is shuffled.
    """
    return page_spans(pages, detectors).select("doc_id", "page_index", F.inline("spans"))


def detect_resolved(pages: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """``process(detect(pages))`` for pages that are one row each: resolved where they are read, so nothing is shuffled."""
    return page_spans(pages, detectors, resolved=True).select("doc_id", "page_index", F.inline("spans"))


def excluded(text: Column, label: Column) -> Column:
    """Whether a model's span is a document id, a registration number taken for an address, or an id taken for a person."""
    t = strip(text)
    keyword = rf"(?i){BOUNDARY}(?:docusign|envelope|signature|id:|ref:|reference){BOUNDARY}"
    return (
        t.rlike("(?i)" + UUID)
        | t.rlike(keyword)
        | ((label == "ADDRESS") & (t.rlike(r"^[A-Z]\.[0-9]{5,7}$") | t.rlike(spaced(r"^[0-9]{3}\s+[0-9]{3}\s+[0-9]{3}$"))))
        | ((label == "PERSON") & (t.rlike(r"^[0-9]+$") | t.rlike(r"^[A-Z0-9-]{8,}$")))
    )


def without_false_positives(spans: DataFrame, known: tuple[str, ...] = KNOWN_FALSE_POSITIVES) -> DataFrame:
    """Spans whose normalised text is no known false positive."""
    return spans.where(~F.col("norm_text").isin(*[" ".join(k.lower().split()) for k in known]))


def with_order(spans: DataFrame, *keys: str) -> DataFrame:
    """Numbers a document's spans from 0 in the order of the keys."""
    return spans.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys)).cast("long") - 1)
