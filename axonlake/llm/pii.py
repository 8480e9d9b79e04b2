"""Personal data by weak supervision (operator 4), in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.llm.common import read, stash

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. Possessive repeats and the look-behinds find the same matches as the plain forms without backtracking:
#: a match that could begin within a run of its first class begins at the run's start or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, whose matches the labelers judge: masked addresses, numbers that fail a check or lack a prefix.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+[0-9]|00[1-9]|\(?[0-9]{3}\)?[\x20.-])[\x20().0-9-]{5,18}[0-9](?![0-9A-Za-z])",
}
#: A text without this sign has no match.
NEEDS = {"email": "[@(\\[]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Fixed values of the gazetteers: top-level domains, calling codes and issuer prefixes.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|be|pl|ca|us|mx|br|jp|cn|in|au"
CALLING = r"\+?(?:00)?(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30|62"
#: Fixed values of the context labeler: words before a span that speak for it, and words that speak against any.
CUES = {"email": "mail|e-mail|contact|write|correo|courriel", "ip": r"\bip\b|address|server|host|login|adresse", "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment", "phone": "phone|tel|call|fax|mobile|cell|telefon"}
AGAINST = r"version|isbn|issn|order|invoice|serial|token|hash|sha|uuid|build|release|\bno\.|\bid\b"
#: Characters before a span that the context labeler reads, and rounds of expectation-maximisation.
BEFORE, ROUNDS = 40, 8
#: Candidates by which the rates of a labeler's votes are drawn to their share of all.
SHRINK = 2.0
#: What a labeler may say: no, nothing, yes.
VOTES = (-1, 0, 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    d = F.reverse(_digits(x))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), F.substr(d, i, F.lit(1)).cast("int"))))
    return total % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, x: Column) -> Column:
    """The base check of a match."""
    n = F.length(_digits(x))
    return {"email": lambda: F.lit(True), "ip": lambda: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), "card": lambda: F.when(n.between(12, 19), _luhn(x)).otherwise(False), "phone": lambda: n.between(9, 15)}[kind]()


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """(gap, hit): the pieces between matches and the matches; one gap more than hits."""
    has = text.rlike(NEEDS[kind])
    hits = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.arrays_zip(F.when(has, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")).alias("gap"), hits.alias("hit"))


def _spans(pieces: Column, keep, of) -> Column:
    """`of(hit, start, end, gap)` of the hits that `keep`s, with positions in code points added up over the pieces."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(of(F.lit(""), F.lit(0), F.lit(0), F.lit(""), True)).alias("out"))

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        out = F.when(F.coalesce(keep(p["hit"]), F.lit(False)), F.array_append(acc["out"], of(p["hit"], start, end, p["gap"], False))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), out.alias("out"))

    return F.aggregate(pieces, zero, step, lambda a: a["out"])


def _votes(kind: str, x: Column, gap: Column) -> list[Column]:
    """What the four labelers say of a match x after the text `gap`: check, form, gazetteer, context."""
    when = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    n, context = F.length(_digits(x)), F.lower(F.right(gap, F.lit(BEFORE)))
    # the check has no opinion on masked addresses and on numbers that only lack the prefix
    strict = {"email": when(x.contains("@")), "ip": when(_valid("ip", x), ~_valid("ip", x)), "card": when(_valid("card", x), ~_valid("card", x)), "phone": when(x.startswith("+") & n.between(9, 15), ~n.between(9, 15))}[kind]
    form = {
        "email": when(x.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@"), x.rlike(r"\.\.|^\.|-\.")),
        "ip": when(~x.rlike(r"(?:^|\.)0[0-9]"), x.rlike(r"(?:^|\.)0[0-9]")),
        "card": when(x.rlike(r"^(?:[0-9]{4}[ -]){3}[0-9]{1,7}$|^[0-9]{13,16}$"), x.rlike("[ -].*[0-9]{5}[ -]")),
        "phone": when(x.rlike(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), n < 9),
    }[kind]
    listed = {"email": when(x.rlike(rf"(?i)[.)\]] ?(?:{DOMAINS})$")), "ip": when(~x.rlike("^(?:0|127|2(?:2[4-9]|[3-5]))"), x.rlike("^(?:0|127|255)")), "card": when(_digits(x).rlike(f"^(?:{ISSUERS})"), ~_digits(x).rlike(f"^(?:{ISSUERS})")), "phone": when(x.rlike(f"^{CALLING}") & x.rlike(r"^(?:\+|00)"))}[kind]
    return [strict, form, listed, when(context.rlike(CUES[kind]), context.rlike(AGAINST))]


def _features(kind: str, x: Column, gap: Column) -> list[Column]:
    """What the classifier sees besides the votes: length, separators, the sign before."""
    return [F.least(F.length(x) / 4, F.lit(8)).cast("int"), x.rlike(r"[ ().-]").cast("int"), F.when(F.right(gap, F.lit(1)).rlike("[ \n\t]"), 1).when(F.length(gap) == 0, 2).otherwise(0)]


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates of every row; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base, wide = [], []
    for k, kind in enumerate(KINDS):

        def plain(x, start, end, gap, kind_of, k=k):
            return "array<struct<start:int,kind:int,end:int>>" if kind_of else F.struct(start.cast("int").alias("start"), F.lit(k).alias("kind"), end.cast("int").alias("end"))

        def judged(x, start, end, gap, kind_of, k=k, kind=kind):
            if kind_of:
                return "array<struct<start:int,kind:int,end:int,said:array<int>>>"
            return F.struct(start.cast("int").alias("start"), F.lit(k).alias("kind"), end.cast("int").alias("end"), F.array(*[c.cast("int") for c in (*_votes(kind, x, gap), *_features(kind, x, gap))]).alias("said"))

        base.append(_spans(F.col(f"base_{kind}"), lambda x, kind=kind: x.isNotNull() & _valid(kind, x), plain))
        wide.append(_spans(F.col(f"wide_{kind}"), lambda x: x.isNotNull(), judged))
    cut = docs.select("doc_id", *(_matches(text, k, BASE[k]).alias(f"base_{k}") for k in KINDS), *(_matches(text, k, WIDE[k]).alias(f"wide_{k}") for k in KINDS))
    return cut.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*wide).alias("candidates"))


def _table(weights: dict) -> Column:
    """A lookup of fixed size as a map literal."""
    return F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))) if weights else F.create_map().cast("map<string,double>")


def _said(j: int, kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind.cast("string"), F.lit(str(j)), value.cast("string"))


def learned(candidates: DataFrame) -> dict[str, float]:
    """Log-odds of the span classifier by `kind:number:value`, and of each kind as `kind`.

    The votes of all candidates are counted by pattern: a table whose size has a bound. On it,
    expectation-maximisation estimates how often each labeler says what of true and of false spans, with the
    labels hidden; the classifier is then fitted to the labels' posterior, on votes and features.
    """
    patterns = stash(candidates.groupBy("kind", "said").agg(F.count("*").alias("n")), "patterns")
    labelers, everything = range(4), range(7)
    # to begin with, each vote is right in four of five cases
    weights = {f"{k}": 0.0 for k in range(len(KINDS))} | {f"{k}:{j}:{v}": v * math.log(4) for k in range(len(KINDS)) for j in labelers for v in VOTES if v}

    def fitted(weights: dict, seen, judges) -> dict:
        table, kind = _table(weights), F.col("kind")
        odds = table[kind.cast("string")] + sum(F.coalesce(table[_said(j, kind, F.get("said", F.lit(j)))], F.lit(0.0)) for j in judges)
        truth = patterns.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds)))))
        parts = F.explode(F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).alias("v")), *(F.struct(F.lit(j).alias("j"), F.get("said", F.lit(j)).alias("v")) for j in seen)))
        rows = truth.select("kind", "n", "p", parts.alias("x")).groupBy("kind", "x.j", "x.v").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
        total = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["j"] < 0}
        out = {f"{k}": math.log((yes + 1) / (no + 1)) for k, (yes, no) in total.items()}

        def weight(r) -> float:
            """Log-odds of a value, both rates drawn to its share of all candidates by SHRINK of them: a rare class says little."""
            yes, no = total[r["kind"]]
            share = SHRINK * (r["yes"] + r["no"]) / (yes + no)
            return math.log((r["yes"] + share) / (yes + SHRINK)) - math.log((r["no"] + share) / (no + SHRINK))

        return {f"{k}": 0.0 for k in range(len(KINDS))} | out | {f"{r['kind']}:{r['j']}:{r['v']}": weight(r) for r in rows if r["j"] >= 4 or r["j"] >= 0 and r["v"]}  # no vote says nothing

    for _ in range(ROUNDS):
        weights = fitted(weights, labelers, labelers)
    return fitted(weights, everything, labelers)


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; `added` counts the spans beyond the base.

    Base spans are those of the patterns that pass their checks and stay in any case. Wider patterns give candidates;
    regex, form, gazetteer and context labelers vote on them, their reliabilities come from all candidates of the
    table, and the classifier adds a candidate if its probability reaches `threshold` and it overlaps no span before it.
    One pass over the texts, then only spans are read again; only counts of vote patterns are shuffled.
    Null and empty texts have no spans. Repeated rows are treated alike. Texts are taken whole. Without candidates
    nothing is added. Candidates are scored by a table whose size has a bound.
    """
    rows = stash(found(docs.select("doc_id", "text")), "spans")
    weights = _table(learned(rows.select(F.explode("candidates").alias("c")).select("c.kind", "c.said")))
    odds = lambda c: F.coalesce(weights[c["kind"].cast("string")], F.lit(0.0)) + sum(F.coalesce(weights[_said(j, c["kind"], F.get(c["said"], F.lit(j)))], F.lit(0.0)) for j in range(7))
    limit = math.log(threshold / (1 - threshold))
    slim = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    free = lambda c, others: ~F.exists(others, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    likely = F.array_sort(F.transform(F.filter("candidates", lambda c: free(c, F.col("base")) & (odds(c) >= limit)), slim))
    rows = rows.select("doc_id", "base", F.when(F.size("candidates") > 0, likely).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("likely"))
    apart = F.aggregate("likely", F.array().cast("array<struct<start:int,kind:int,end:int>>"), lambda acc, c: F.when(F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] > c["start"], F.lit(False)), acc).otherwise(F.array_append(acc, c)))
    rows = rows.select("doc_id", "base", F.when(F.size("likely") > 0, apart).otherwise(F.col("likely")).alias("added"))
    names = F.lit(KINDS)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("added"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(read(spark, sf_dir, "documents"))
