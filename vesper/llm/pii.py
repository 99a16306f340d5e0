"""Personal data by weak supervision; DataFrame functions only.

Strict and loose patterns propose spans. Four labelers vote on each: the strict
pattern, a gazetteer of its kind, cue words in front, and the span's shape.
Expectation-maximisation estimates the labelers' reliabilities from how often each
combination of votes occurs; the spans' probabilities then train a classifier on
features of the span and its neighbours, which decides on those that the strict
pattern alone doesn't carry. The driver sees one row for each combination of
votes and features, of which there are at most COMBINATIONS.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")
#: Strict patterns. As the contract has them, but that a run is entered at its start or where the last match ended, so that long runs take linear time; possessive where nothing can be given back.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Loose patterns: spelt-out at signs, six-group addresses, shorter cards, numbers without a country.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]{2,63}+(?: ?[\[({]dot[\])}] ?|\.)[A-Za-z]{2,24}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+().-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": ("@", r"[\[({]at[\])}]"), "ip": (None, r"(?:[0-9A-Fa-f]{1,4}:){7}"), "card": (None, None), "phone": ("+", None)}
#: By rule: domains of countries (two letters) and the older generic ones; addresses that hosts have; issuers' first digits; calling codes by zone.
GAZETTEER = {
    "email": r"(?i)\.(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|tel|cat|asia|post|app|dev|cloud|online|shop|site|tech)$",
    "ip": r"^(?:(?!0\.|127\.|169\.254\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)[0-9.]+|(?!(?:0{1,4}:){7}|[fF][eEfF])[0-9A-Fa-f:]+)$",
    "card": r"^(?:4|5[0-9]|2[2-7]|3[04-9]|6[0-9])",
    "phone": r"^(?:\+(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9])|\(?[2-9][0-9]{2})",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|contacto|correo|courriel)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|direcci)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|mastercard|karte|carte|tarjeta|credit)[^\n]{0,12}$",
    "phone": r"(?i)(?:tel|phone|call|fon|mobil|móvil|fax)[^\n]{0,12}$",
}
SHAPE = {
    "email": r"^[A-Za-z][A-Za-z0-9._%+-]{1,63}(?:@| ?[\[({]at)",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$|:",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{3,6}){2,4})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}$",
}
#: 4 kinds, 16 combinations of votes, 2 sources, 5 lengths, 4 neighbours before and 4 after.
COMBINATIONS = 4 * 16 * 2 * 5 * 4 * 4
BEFORE = 24


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points: lengths of matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The check that a match must pass."""
    if kind == "ip":
        return value.contains(":") | F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return _luhn(F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _proposed(text: Column, kind: str, strict: bool) -> Column:
    pattern, need = (STRICT if strict else LOOSE)[kind], NEEDS[kind][0 if strict else 1]
    there = text.contains(need) if strict and need else text.rlike(need or pattern)
    passed = F.filter(_found(text, pattern), lambda s: _passes(kind, s["value"]))
    spans = F.transform(passed, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(strict).alias("base"), s["value"].alias("value")))
    return F.when(there, spans).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,value:string>>"))


def _edge(c: Column) -> Column:
    """Class of a neighbouring character: none or space, letter or digit, closing mark, other."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{N}]"), 1).when(c.rlike(r"^[.,;:!?)\]}]"), 2).otherwise(3)


def candidates(docs: DataFrame, text_col: str = "text", name: str = "_vesper_spans") -> DataFrame:
    """docs with an array column of proposed spans: kind (number in KINDS), start, end, base, votes, length, before, after.

    Spans of the strict patterns are base. A loose one that overlaps a base span is dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_vesper_base", F.concat(*[_proposed(text, k, True) for k in KINDS])).withColumn("_vesper_loose", F.concat(*[_proposed(text, k, False) for k in KINDS]))
    apart = F.when(F.size("_vesper_loose") > 0, F.filter("_vesper_loose", lambda x: ~F.exists(F.col("_vesper_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))).otherwise(F.col("_vesper_loose"))

    def describe(s: Column) -> Column:
        front = F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE)))
        behind = F.substring(text, s["end"] + 1, F.lit(1))
        plain = F.regexp_replace(s["value"], "[ -]", "")
        vote = lambda table, on: F.coalesce(*[F.when(s["kind"] == i, on.rlike(table[k])) for i, k in enumerate(KINDS)])
        gazetteer = F.when(s["kind"] == 2, plain.rlike(GAZETTEER["card"])).otherwise(vote(GAZETTEER, s["value"]))
        votes = F.array(*[v.cast("int") for v in (s["base"], gazetteer, vote(CONTEXT, front), vote(SHAPE, s["value"]))])
        size = F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(4)).cast("int")
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), votes.alias("votes"), size.alias("length"), _edge(F.reverse(front)).alias("before"), _edge(behind).alias("after"))

    spans = F.concat("_vesper_base", apart)
    # evaluated for texts with spans only
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,length:int,before:int,after:int>>")
    return out.withColumn(name, F.when(F.size(spans) > 0, F.transform(spans, describe)).otherwise(none)).drop("_vesper_base", "_vesper_loose")


@dataclass
class Classifier:
    """Reliabilities of the labelers by kind, and the weights of features (log odds)."""

    sensitivity: dict[int, list[float]] = field(default_factory=dict)
    false_rate: dict[int, list[float]] = field(default_factory=dict)
    prior: dict[int, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)


FEATURES = ("length", "before", "after")


def fit(spans: DataFrame, name: str = "_vesper_spans", rounds: int = 25) -> Classifier:
    """Expectation-maximisation over combinations of votes, then the classifier's weights from the spans' probabilities."""
    each = spans.select(F.explode(name).alias("s")).select("s.*")
    rows = each.groupBy("kind", "votes", *FEATURES).agg(F.count("*").alias("n")).limit(COMBINATIONS).collect()  # the limit is what can occur
    rows = sorted(((r.kind, tuple(r.votes), tuple(r[f] for f in FEATURES), r.n) for r in rows))
    out = Classifier()
    positive: dict[str, float] = {}
    negative: dict[str, float] = {}
    for kind in range(len(KINDS)):
        combos: dict[tuple, int] = {}
        for k, votes, _, n in rows:
            if k == kind:
                combos[votes] = combos.get(votes, 0) + n
        p = {v: min(0.9, max(0.1, sum(v) / len(v))) for v in combos}
        sens, wrong, prior = [0.8] * len(LABELERS), [0.2] * len(LABELERS), 0.5
        for _ in range(rounds):
            yes = sum(n * p[v] for v, n in combos.items())
            no = sum(n * (1 - p[v]) for v, n in combos.items())
            prior = (yes + 1) / (yes + no + 2)
            # as if four spans were known, on which labelers are right three times of four
            sens = [(sum(n * p[v] * v[j] for v, n in combos.items()) + 3) / (yes + 4) for j in range(len(LABELERS))]
            wrong = [(sum(n * (1 - p[v]) * v[j] for v, n in combos.items()) + 1) / (no + 4) for j in range(len(LABELERS))]
            for v in combos:
                odds = math.log(prior / (1 - prior)) + sum(math.log((s if x else 1 - s) / (w if x else 1 - w)) for x, s, w in zip(v, sens, wrong, strict=True))
                p[v] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        out.sensitivity[kind], out.false_rate[kind], out.prior[kind] = sens, wrong, prior
        for k, votes, features, n in rows:
            if k == kind:
                for f, x in zip(FEATURES, features, strict=True):
                    key = f"{kind} {f} {x}"
                    positive[key] = positive.get(key, 0) + n * p[votes]
                    negative[key] = negative.get(key, 0) + n * (1 - p[votes])
        for f in FEATURES:
            keys = [key for key in positive if key.startswith(f"{kind} {f} ")]
            yes, no = sum(positive[k] for k in keys), sum(negative[k] for k in keys)
            for key in keys:
                out.weights[key] = math.log((positive[key] + 1) / (yes + len(keys))) - math.log((negative[key] + 1) / (no + len(keys)))
    return out


def probability(model: Classifier, s: Column) -> Column:
    """The classifier's probability of a span: votes by their reliability, features by their weight."""
    total = F.lit(0.0)
    for kind in range(len(KINDS)):
        odds = F.lit(math.log(model.prior[kind] / (1 - model.prior[kind])))
        for j, (sens, wrong) in enumerate(zip(model.sensitivity[kind], model.false_rate[kind], strict=True)):
            odds = odds + F.when(F.get(s["votes"], F.lit(j)) == 1, math.log(sens / wrong)).otherwise(math.log((1 - sens) / (1 - wrong)))
        for f in FEATURES:
            for key, weight in model.weights.items():
                if key.startswith(f"{kind} {f} "):
                    odds = odds + F.when(s[f] == int(key.rsplit(" ", 1)[1]), weight).otherwise(0.0)
        total = F.when(s["kind"] == kind, odds).otherwise(total)
    return 1 / (1 + F.exp(-total))


def _kept(proposed: DataFrame, least: float, name: str) -> DataFrame:
    """proposed with the spans that stay in the column `name`, sorted by kind and start; the model comes from all its rows."""
    model = fit(proposed.select("_vesper_spans"))
    scored = F.transform("_vesper_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), probability(model, s).alias("score")))
    kept = F.array_sort(F.filter(scored, lambda s: s["base"] | (s["score"] >= least)))
    named = F.transform(kept, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    return proposed.withColumn(name, F.when(F.size("_vesper_spans") > 0, named).otherwise(none)).drop("_vesper_spans")


def find(docs: DataFrame, text_col: str = "text", least: float = 0.5, name: str = "pii") -> DataFrame:
    """docs with an array column: struct<kind, start, end, base, score>, sorted by kind (as in KINDS) and start.

    start and end are code points of the text, end exclusive. Spans of the strict
    patterns stay whatever their score; others need it to be at least `least`. A
    null or empty text has none; a column of that name is replaced; rows that repeat
    keep a row each; an empty table has no rows. The reliabilities come from all
    texts of docs. The patterns read each text once: docs with their proposed spans
    are written to the shared folder and read from there.
    """
    return _kept(cut(candidates(docs.drop(name), text_col)), least, name)


def mask(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; spans that overlap are replaced together, by the first's.

    A text without spans, null included, stays as it is.
    """
    found = find(docs, text_col, least, "_vesper_pii")
    text = F.col(text_col)
    ordered = F.array_sort(F.transform("_vesper_pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0))))
    masked = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    return found.withColumn(text_col, F.when(F.size("_vesper_pii") > 0, masked).otherwise(text)).drop("_vesper_pii").select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all), for each row of docs.

    A null or empty text has no spans; rows that repeat an id or have none keep a
    row each; an empty table has no rows. Only ids and spans are written between
    the two passes.
    """
    proposed = cut(candidates(docs.select(id_col, text_col), text_col).select(id_col, "_vesper_spans"))
    found = _kept(proposed, least, "pii")
    base = F.filter("pii", lambda s: s["base"])
    # sorted by kind and start already
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("pii", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(join(base), 256).alias("base_sha256"), join(F.col("pii")).alias("spans"))
