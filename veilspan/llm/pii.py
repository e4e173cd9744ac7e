"""Operator 1: personal data by candidate gradient boosting, in DataFrame expressions.

Base patterns with validators give spans that always stay. High-recall
generators propose further, overlapping candidates (obfuscated addresses,
phones without a plus, cards with other separators); every candidate gets
format and context features; boosted regression trees score it; and a threshold
for each kind, calibrated on examples that training did not see, selects. The
trees are trained in numpy on the driver from a bounded, seeded set of worded
examples, with features from the same expressions that serve the corpus; then
they are CASE expressions. Training, calibration and evaluation take examples
of three families that share no cue and no filler word.

Patterns are possessive and anchored at the begin of a run of their characters,
so they take linear time on texts of any length and no recursion in the engine.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, running
from .common import sha256_hex, table

KINDS = ("email", "ip", "card", "phone")
#: Trees, their depth, their learning rate; worded examples of a family; the precision that thresholds are calibrated to.
TREES, DEPTH, RATE = 30, 3, 0.3
EXAMPLES = 3000
PRECISION = 0.995

_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A pattern's first part tells cheaply whether a text can hold it at all.
BASE = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": (r"(?i)@|\bdot\b", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\{at\}|(?<= )at(?= )) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= )) ?[A-Za-z0-9-]++){1,6}+"),
    "ip": (r"(?i)[0-9] ?[\[(](?:\.|dot)[\])]|(?:[0-9a-f]{1,4}:){7}", r"(?i)(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9A-Za-z])|(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])"),
    "card": (r"[0-9](?:[ ./-]{0,2}[0-9]){13}", r"(?<![0-9A-Za-z])[0-9](?:[ ./-]{0,2}[0-9]){13,18}+(?![0-9A-Za-z])"),
    "phone": (r"[0-9](?:[ ()./-]{0,3}[0-9]){8}", r"(?<![0-9A-Za-z.+/-])(?:00[ .-]?)?(?:\(0?[0-9]{2,4}\)|[0-9]{2,4})(?:[ ./-]{1,2}[0-9]{2,4}){2,4}+(?![0-9A-Za-z-])|(?<![0-9A-Za-z.+/-])0[0-9]{9,10}(?![0-9A-Za-z-])"),
}
_CUES = {
    "email": r"(?i)(?:mail|correo|courriel|contact|write|reach|schreib)",
    "ip": r"(?i)(?:\bip\b|host|server|serveur|adress|address|gateway)",
    "card": r"(?i)(?:card|carte|karte|tarjeta|visa|amex|credit|debit|payment)",
    "phone": r"(?i)(?:phone|\btel\b|tél|telef|call|fax|mobile|cell|sms|anruf|appel)",
    "other": r"(?i)(?:order|invoice|\bref|isbn|serial|ticket|tracking|version|page|facture|bestell|pedido|\bid\b|\bno\b|date|lot\b|batch)",
}
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": n.between(14, 19) & _luhn(_digits(match)),
        "phone": n.between(10, 15),
    }[kind]


def _matches(text: Column, screen: str, pattern: str, kind: int) -> Column:
    """Every match as (start, kind, end, hit, before, after); offsets are running sums of the lengths of gaps and matches."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string,before:string,after:string>>")

    def spans(gaps: Column, hits: Column) -> Column:
        ends = running(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h)), lambda x, y: x + y)
        return let(ends, lambda e: F.transform(hits, lambda h, i: F.struct(
            (F.get(e, i) - F.length(h)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), h.alias("hit"),
            F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"))))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(screen), let(parts, lambda p: spans(p["gaps"], p["hits"]))).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The valid base matches of all kinds, sorted by start, then kind."""
    def valid(kind: str):
        return lambda m: _valid(kind, m["hit"])

    found = [F.filter(_matches(text, *BASE[k], n), valid(k)) for n, k in enumerate(KINDS)]
    return F.array_sort(F.transform(F.concat(*found), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))))


def candidates(text: Column) -> Column:
    return F.concat(*[_matches(text, *LOOSE[k], n) for n, k in enumerate(KINDS)])


#: Features of a candidate (its text, up to 24 code points of the gap before it, 8 of that after), by name.
def _features(c: Column) -> dict[str, Column]:
    hit, before, after = c["hit"], c["before"], c["after"]
    digits = _digits(hit)
    count = lambda p: F.regexp_count(hit, F.lit(p))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return {
        "kind": c["kind"],
        "digits": F.length(digits),
        "length": F.length(hit),
        "letters": count("[A-Za-z]"),
        "separators": count("[ ./-]"),
        "groups": count("[0-9]++"),
        "luhn": flag(F.length(digits).between(13, 19) & _luhn(digits)),
        "octets": flag(hit.rlike(rf"(?i)^{_OCTET}(?: ?[\[(](?:\.|dot)[\])] ?{_OCTET}){{3}}$")),
        "colons": count(":"),
        "date": flag(hit.rlike(r"^(?:[0-9]{1,2}[ ./-]){2}[0-9]{4}|^[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}")),
        "parentheses": count(r"\("),
        "leading_zero": flag(hit.startswith("0")),
        "even_groups": flag(hit.rlike(r"^(?:[0-9]{4}[ ./-]{1,2}){3}[0-9]{1,7}$|^[0-9]+$|^(?:[0-9]{2,3}[ .-]){2,4}[0-9]{2,4}$")),
        "at_word": flag(hit.rlike(r"(?i)[\[({]at[\])}]| at ")),
        "sentence_end": flag(hit.rlike(r"\. [A-Za-z]")),
        "dot_word": flag(hit.rlike(r"(?i)[\[({]dot[\])}]| dot ")),
        "ending": flag(hit.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|fr|de|es|uk)$")),
        **{f"cue_{k}": flag(before.rlike(p)) for k, p in _CUES.items()},
        "joined": flag(before.rlike(r"[#$%=_&*]$") | after.rlike(r"^[%$_=&*]")),
    }


#: Words around examples, cues and look-alikes of three families: one trains, one calibrates, one is for evaluation.
FAMILIES = (
    {
        "syllables": "aeioubcdlmnrst",
        0: ("mail me: ", "e-mail ", "contact ", ""), 1: ("ip ", "host ", "", "server "), 2: ("card ", "visa ", "", "credit card no "), 3: ("call ", "phone: ", "tel ", "mobile "),
        "card": ("order ", "invoice ", "serial ", ""), "date": ("date ", "on ", ""), "book": ("isbn ",), "dotted": ("version ", "page "), "number": ("order ", "id ", "ref ", ""), "groups": ("order ", "lot ", "total ", ""), "prose": ("look ", ""), "time": ("time ", ""),
    },
    {
        "syllables": "aeiouyfghkpvwz",
        0: ("courriel : ", "write to ", "mail: ", ""), 1: ("address ", "gateway ", "", "ip: "), 2: ("carte : ", "debit card ", "", "payment card: "), 3: ("tél. ", "fax ", "my cell: ", "phone "),
        "card": ("tracking ", "ref ", "pedido ", ""), "date": ("le ", "since ", ""), "book": ("ISBN-13 ",), "dotted": ("v", "pages "), "number": ("batch ", "ticket no ", "id: ", ""), "groups": ("ref. ", "invoice ", "id ", ""), "prose": ("we met ", ""), "time": ("at ", ""),
    },
    {
        "syllables": "aeioubdghlnrtz",
        0: ("reach us at ", "E-Mail: ", "contact: ", ""), 1: ("IP ", "serveur ", "", "host: "), 2: ("Karte ", "tarjeta ", "", "card number "), 3: ("Fax: ", "call me: ", "téléphone ", "tel. "),
        "card": ("facture ", "serial no ", "ticket ", ""), "date": ("dated ", "am ", ""), "book": ("ISBN: ",), "dotted": ("Version ", "page "), "number": ("tracking ", "invoice ", "no ", ""), "groups": ("lot no ", "batch ", "pedido ", ""), "prose": ("they sat ", ""), "time": ("from ", ""),
    },
)


def worded_examples(n: int, family: int, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """(text, kind, begin, end) of the personal data in it; kind -1: a text with look-alikes only."""
    rng, words = random.Random(100 * seed + family), FAMILIES[family]
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(words["syllables"]) for _ in range(rng.randint(3, 8)))

    def card(valid: bool) -> str:
        body = rng.choice("3456") + d(rng.choice([13, 14, 14, 14, 15]))
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
        last = (-total) % 10
        return body + str(last if valid else (last + rng.randint(1, 9)) % 10)

    def grouped(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    def date() -> str:
        s = sep()
        return f"{rng.randint(1, 28):02d}{s}{rng.randint(1, 12):02d}{s}{rng.randint(1900, 2030)}"

    def email() -> str:
        a = rng.choice([" at ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " @ "])
        b = " dot " if a == " at " else rng.choice([" dot ", "(dot)", "[dot]", " [dot] ", "."])
        return word() + a + word() + b + rng.choice(["com", "org", "net", "fr", "de", "es", "io"])

    def phone() -> str:
        return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{rng.randint(30, 49)} {d(3)} {d(3)} {d(3)}", f"0{d(9)}"])

    def address() -> str:
        return rng.choice(["[.]", "(.)", "[dot]", " (dot) "]).join(str(rng.randint(1, 255)) for _ in range(4)) if rng.random() < 0.7 else ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))

    sep = lambda: rng.choice([" ", ".", "-", "/"])
    positive = {0: email, 1: address, 2: lambda: grouped(card(True), rng.choice([".", "/", "  ", "-"])), 3: phone}
    negative = [
        ("card", lambda: card(False)), ("card", lambda: grouped(card(False), sep())), ("date", date), ("book", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"), ("dotted", lambda: ".".join(d(2) for _ in range(4))),
        ("number", lambda: d(rng.choice([10, 11, 12]))), ("groups", lambda: sep().join(d(rng.randint(2, 4)) for _ in range(rng.randint(3, 5)))), ("prose", lambda: f"{word()} at {word()}"), ("prose", lambda: f"{word()} at {word()} dot {word()}"), ("prose", lambda: f"dot, {word()} at {word()}. {word().title()}"), ("prose", lambda: f"dot: {word()} at {word()}.{word()}"),
        ("time", lambda: ":".join(f"{rng.randint(0, 59):02d}" for _ in range(8))), ("time", lambda: "".join(f"[{rng.randint(0, 9)}]" for _ in range(4))), ("groups", lambda: " ".join(d(3) for _ in range(5))),
    ]
    out = []
    for i in range(n):
        lead, tail = " ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))
        kind = rng.randrange(len(KINDS)) if i % 2 else -1
        cues, make = (words[kind], positive[kind]) if kind >= 0 else (lambda c: (words[c[0]], c[1]))(rng.choice(negative))
        head = (lead + " " if lead else "") + rng.choice(cues)
        made = make()
        out.append((f"{head}{made} {tail}".rstrip(), kind, len(head), len(head) + len(made)))
    return out


@dataclass
class Forest:
    names: list[str]
    prior: float
    trees: list[list[tuple[int, float, int, int, float]]]  # feature (-1: leaf), threshold, left, right, value
    thresholds: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum(_apply(t, x) for t in self.trees)

    def column(self, features: dict[str, Column]) -> Column:
        """The margin as nested CASE expressions."""

        def node(tree, k: int) -> Column:
            f, cut, left, right, value = tree[k]
            return F.lit(value) if f < 0 else F.when(features[self.names[f]] <= cut, node(tree, left)).otherwise(node(tree, right))

        return reduce(lambda a, b: a + b, [node(t, 0) for t in self.trees], F.lit(self.prior))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(x)), np.zeros(len(x), int)
    for k, (f, cut, left, right, value) in enumerate(tree):
        here = at == k
        if f < 0:
            out[here] = value
        else:
            at[here] = np.where(x[here, f] <= cut, left, right)
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> list[tuple[int, float, int, int, float]]:
    """One regression tree on gradients and curvatures; splits by gain."""
    tree: list = []

    def build(rows: np.ndarray, left: int) -> int:
        k = len(tree)
        tree.append(None)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if left and len(rows) > 10:
            for f in range(x.shape[1]):
                order = np.argsort(x[rows, f], kind="stable")
                v, cg, ch = x[rows, f][order], np.cumsum(g[rows][order])[:-1], np.cumsum(h[rows][order])[:-1]
                gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                gain[v[1:] == v[:-1]] = 0
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], f, float(v[i] + v[i + 1]) / 2)
        if best[1] is None:
            tree[k] = (-1, 0.0, 0, 0, float(RATE * gs / (hs + 1)))
        else:
            low = x[rows, best[1]] <= best[2]
            tree[k] = (best[1], best[2], build(rows[low], left - 1), build(rows[~low], left - 1), 0.0)
        return k

    build(np.arange(len(x)), depth)
    return tree


def boost(names: list[str], x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic boosting of TREES trees; the thresholds are yet to be calibrated."""
    rate = np.clip(y.mean(), 0.01, 0.99)
    forest = Forest(names, float(np.log(rate / (1 - rate))), [], [float("inf")] * len(KINDS))
    margin = np.full(len(x), forest.prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        forest.trees.append(_grow(x, y - p, p * (1 - p), DEPTH))
        margin += _apply(forest.trees[-1], x)
    return forest


def calibrate(forest: Forest, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> None:
    """Sets each kind's threshold: the lowest score at which candidates of a family that training didn't see have the precision.

    Halfway to the next candidate below; a kind that never has the precision adds nothing.
    """
    scores, kind = forest.margin(x), x[:, forest.names.index("kind")].astype(int)
    for k in range(len(KINDS)):
        values, where = np.unique(scores[kind == k], return_inverse=True)  # equal scores pass together
        total, right = np.bincount(where, minlength=len(values)), np.bincount(where, y[kind == k], minlength=len(values))
        enough = np.flatnonzero(right[::-1].cumsum()[::-1] >= precision * total[::-1].cumsum()[::-1])
        if len(enough):
            at = int(enough[0])
            forest.thresholds[k] = float(values[at] if at == 0 else (values[at] + values[at - 1]) / 2)


def examples(spark: SparkSession, n: int, family: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The features' names, and features and truth of the candidates of ``n`` worded examples."""
    worded = spark.createDataFrame(worded_examples(n, family), "text string, truth int, begin int, stop int")
    found = worded.select("*", F.explode(candidates(F.col("text"))).alias("c"))
    features = _features(F.col("c"))
    right = (F.col("truth") == F.col("c.kind")) & (F.col("c.start") < F.col("stop")) & (F.col("c.end") > F.col("begin"))
    rows = found.select(*[v.cast("double").alias(k) for k, v in features.items()], right.cast("double").alias("y"), F.col("text"), F.col("c.start").alias("start")).collect()
    rows.sort(key=lambda r: (r["text"], r["start"], r["kind"]))
    names = list(features)
    return names, np.array([[r[n] for n in names] for r in rows]), np.array([r["y"] for r in rows])


def train(spark: SparkSession) -> Forest:
    """The forest of this module's worded examples (a fixed number, whatever the corpus): one family trains, another calibrates."""
    forest = boost(*examples(spark, EXAMPLES, 0))
    calibrate(forest, *examples(spark, EXAMPLES, 1)[1:])
    return forest


def _apart(passed: Column, base: Column) -> Column:
    """The candidates that meet no base span: none that starts before the candidate's end reaches over its start."""
    def without(reach: Column) -> Column:
        # the number of base spans that start before an end, by halving
        middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        halve = lambda end: lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get(base, middle(a))["start"] < end, F.struct((middle(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle(a).alias("hi")))
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(base) + 1.0)).cast("int") + 1)
        before = lambda c: F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(base).alias("hi")), halve(c["end"]))["lo"]
        return F.filter(passed, lambda c: F.coalesce(F.get(reach, before(c) - 1), F.lit(0)) <= c["start"])

    return F.when(F.size(base) == 0, passed).otherwise(let(running(F.transform(base, lambda b: b["end"]), F.greatest), without))


def _greedy(run: Column) -> Column:
    """Of candidates that overlap, from the highest score down, those that meet none chosen before."""
    ranked = F.array_sort(run, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["end"] - b["end"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    free = lambda kept, c: ~F.exists(kept, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))
    return F.aggregate(ranked, none, lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept))


def _chosen(passed: Column) -> Column:
    """Greedy choice by score among overlapping candidates, run by run: a run ends where the next candidate starts beyond all before."""
    def runs(sorted_: Column, reach: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: F.coalesce(F.get(sorted_, i)["start"] >= F.get(reach, i - 1), F.lit(True)))
        cut = lambda p: F.flatten(F.transform(p, lambda at, i: _greedy(F.slice(sorted_, at + 1, F.coalesce(F.get(p, i + 1), F.size(sorted_)) - at))))
        return let(places, cut)

    ordered = F.array_sort(passed)
    return F.when(F.size(passed) == 0, passed).otherwise(let(ordered, lambda s: let(running(F.transform(s, lambda c: c["end"]), F.greatest), lambda reach: runs(s, reach))))


def with_spans(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` (text and others) with ``base`` and ``spans``, arrays of (start, kind, end); columns of those names are replaced, all others stay.

    Added spans overlap neither base spans nor each other: of overlapping ones
    the higher score stays, then the earlier, then the first kind; one that is
    beaten only by a beaten one stays. Base spans always stay, also where two
    kinds overlap. A null or empty text has no span. Very long texts are read
    whole, in about n log n steps of their n matches. Repeated rows are marked
    alike; an empty table gives none.
    """
    rest = [c for c in docs.columns if c not in ("base", "spans")]
    text = F.coalesce(F.col("text"), F.lit(""))
    bar = F.array(*[F.lit(t) for t in forest.thresholds])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), base_spans(text).alias("base"), candidates(text).alias("found"))
    scored = F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), forest.column(_features(c)).alias("score")))
    passed = F.when(F.size("found") > 0, _apart(F.filter(scored, lambda c: c["score"] >= F.get(bar, c["kind"])), F.col("base")))
    added = F.transform(_chosen(F.col("passed")), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    spans = F.when(F.size("passed") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base"))
    return packed.withColumn("passed", passed).select("doc.*", "base", spans.alias("spans"))


def redact(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans, what is left of the later goes with the first.

    Null texts stay null. Columns named ``base`` or ``spans`` are left out.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(s: Column, reach: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        pieces = F.transform(s, lambda x, i: F.when(x["start"] >= begin(i), F.concat(F.substring(F.col("text"), begin(i) + 1, x["start"] - begin(i)), F.get(names, x["kind"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), begin(F.size(s)) + 1, F.length("text")))

    marked = with_spans(docs, forest)
    rewritten = let(running(F.transform("spans", lambda s: s["end"]), F.greatest), lambda reach: cut(F.col("spans"), reach))
    return marked.withColumn("text", F.when(F.size("spans") > 0, rewritten).otherwise(F.col("text"))).drop("base", "spans")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), train(spark))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return marked.select("doc_id", *map(of, range(len(KINDS))), sha256_hex(_listed("base")).alias("base_sha256"), _listed("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
