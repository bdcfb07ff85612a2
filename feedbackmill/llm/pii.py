"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans. Looser patterns give further candidates, on which pattern,
gazetteer, context, checksum and repetition labelers vote. Expectation-maximisation estimates how
reliable each labeler is, from the counts of vote patterns, and the resulting probabilities train
a span classifier that decides which candidates become spans as well.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedbackmill.session import stage

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base spans. Quantifiers are possessive and runs begin at their first character,
# where that finds the same matches, so that no text makes them slow.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?:at|AT) ?[\])}] ?"
    r"[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.\]])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9.\[(])",
    "card": r"(?<![0-9./])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    "phone": r"(?<![0-9A-Za-z+(./-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z./-])",
}
#: What a text must hold for a pattern to be tried at all.
HINTS: dict[tuple[str, bool], Callable[[Column], Column]] = {
    ("email", False): lambda t: t.contains("@"),
    ("ip", False): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", False): lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    ("phone", False): lambda t: t.contains("+"),
    ("email", True): lambda t: t.rlike(r"[\[({] ?(?:at|AT) ?[\])}]"),
    ("ip", True): lambda t: t.rlike(r"[0-9][\[(]\.[\])][0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9]{4}[./_][0-9]{4}[./_]"),
    ("phone", True): lambda t: t.rlike(r"[0-9]\)?[ .-][0-9]{3}"),
}
# Gazetteers.
ENDINGS = r"(?i)\b(?:com|org|net|edu|gov|mil|int|info|biz|io|co|eu|uk|us|ca|au|de|at|ch|fr|be|nl|es|mx|ar|it|pt|br|in|jp|cn)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|30[0-5]|35|6011|65|62)"
CALLING = r"^(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
PRIVATE = r"^(?:10|127|192\D+168|172\D+(?:1[6-9]|2[0-9]|3[01]))\D"
#: Words before a span that speak for its kind, and words that speak against all kinds.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|write|reach|kontakt|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|server|address|addr|client|adresse)\b",
    "card": r"(?i)\b(?:cards?|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|telephone|call|fax|mobile|cell|telefon|portable|rufen)\b",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|invoice|token|hash|serial|part|section|figure|no)\b"
#: Code points before a span that the context labeler reads.
REACH = 32
VOTES = ("form", "gazetteer", "context", "checksum", "repetition")
EM_ROUNDS = 30
FIT_ROUNDS = 300

_MATCH = "struct<start:int,end:int,value:string,before:string>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with start, end (code points, end exclusive), value and the text just before.

    A match begins where the gaps and matches before it end. They are summed in one pass; full
    runs of 512 are set aside, so that texts with very many matches stay linear.
    """
    gaps = F.transform(
        F.split(text, pattern, -1),
        lambda g: F.struct(F.length(g).alias("size"), F.right(g, F.lit(REACH)).alias("before")),
    )
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, values, lambda g, v: F.struct(g["size"].alias("gap"), g["before"].alias("before"), v.alias("value")))
    zero = F.struct(
        F.lit(0).alias("at"),
        F.array().cast(f"array<array<{_MATCH}>>").alias("full"),
        F.array().cast(f"array<{_MATCH}>").alias("open"),
    )

    def add(s, x):
        start = s["at"] + x["gap"]
        end = start + F.length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before")))
        close = F.size(s["open"]) >= 512
        more = F.struct(
            end.alias("at"),
            F.when(close, F.concat(s["full"], F.array(s["open"]))).otherwise(s["full"]).alias("full"),
            F.when(close, one).otherwise(F.concat(s["open"], one)).alias("open"),
        )
        return F.when(x["value"].isNull(), s).otherwise(more)

    return F.aggregate(steps, zero, add, lambda s: F.flatten(F.concat(s["full"], F.array(s["open"]))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    parts = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    return F.forall(parts, lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the strict pattern is a base span."""
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        plain = digits(value)
        return (F.length(plain) <= 19) & F.call_function("luhn_check", plain)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _sign(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(-1)


def votes(kind: str, loose: bool, m: Column) -> list[Column]:
    """The labelers' votes on a match: 1 for, -1 against, 0 when they abstain."""
    value, plain = m["value"], digits(m["value"])
    gazetteer = {
        "email": lambda: _sign(F.regexp_replace(value, r"[\])} ]", "").rlike(ENDINGS)),
        "ip": lambda: F.when(value.rlike(PRIVATE), 1).otherwise(0),
        "card": lambda: _sign(plain.rlike(ISSUERS)),
        "phone": lambda: F.lit(0) if loose else _sign(plain.rlike(CALLING)),
    }[kind]()
    checksum = {
        "email": lambda: _sign(F.length(value) <= 254),
        "ip": lambda: _sign(_octets(value)),
        "card": lambda: _sign(F.length(plain).between(12, 19) & F.call_function("luhn_check", plain)),
        "phone": lambda: _sign(F.length(plain).between(10 if loose else 9, 11 if loose else 15)),
    }[kind]()
    return [
        F.lit(0) if loose else _sign(valid(kind, value)),
        gazetteer,
        F.when(m["before"].rlike(AGAINST + r"\W*$"), -1).when(m["before"].rlike(CONTEXT[kind]), 1).otherwise(0),
        checksum,
        F.when(plain.rlike(r"^([0-9])\1{7,}$"), -1).otherwise(0),
    ]


def traits(kind: str, loose: bool, m: Column) -> list[Column]:
    """What the span classifier sees: the span itself and the text just before it."""
    value, before = m["value"], m["before"]
    return [
        F.lit(int(loose)),
        F.least(F.floor(F.length(value) / 8), F.lit(3)).cast("int"),
        value.contains(" ").cast("int"),
        value.contains("-").cast("int"),
        before.rlike(r"[:=#>]\s*$").cast("int"),
        before.rlike(CONTEXT[kind]).cast("int"),
        before.rlike(AGAINST + r"\W*$").cast("int"),
        digits(value).rlike(ISSUERS if kind == "card" else CALLING).cast("int"),
    ]


TRAITS = ("loose", "length", "space", "hyphen", "mark", "named", "against", "number")


def _span(m: Column, k: int) -> tuple[Column, ...]:
    return m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")


def _base_spans(k: int) -> Column:
    fine = F.filter(f"{KINDS[k]}_0", lambda m: valid(KINDS[k], m["value"]))
    return F.transform(fine, lambda m: F.struct(*_span(m, k)))


def _pool_of(k: int, loose: bool) -> Column:
    kind = KINDS[k]
    return F.transform(f"{kind}_{int(loose)}", lambda m: F.struct(
        *_span(m, k),
        *(v.cast("int").alias(n) for n, v in zip(VOTES, votes(kind, loose, m), strict=True)),
        *(t.cast("int").alias(n) for n, t in zip(TRAITS, traits(kind, loose, m), strict=True)),
    ))


def candidates(docs: DataFrame, kept: Column, text: str) -> DataFrame:
    """Per row: kept, base, the base spans, and pool, all candidates with votes and traits.

    Staged, so that patterns are sought once.
    """
    rows = docs.select(kept.alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    empty = F.array().cast(f"array<{_MATCH}>")
    for loose, patterns in ((False, STRICT), (True, LOOSE)):
        rows = rows.select("*", *(
            F.when(HINTS[k, loose](F.col("text")), matches(F.col("text"), p)).otherwise(empty).alias(f"{k}_{int(loose)}")
            for k, p in patterns.items()
        ))
    base = [_base_spans(k) for k in range(len(KINDS))]
    pool = [_pool_of(k, loose) for k in range(len(KINDS)) for loose in (False, True)]
    return stage(rows.select("kept", F.array_sort(F.concat(*base)).alias("base"), F.concat(*pool).alias("pool")), "pii")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """Probability that a span with these votes is personal data, for each pattern of votes.

    Expectation-maximisation over counts of vote patterns, at most 3 to the number of labelers.
    Each labeler has its own chances of its three votes on true and on false spans. They start from
    majority votes, and some pseudo-spans keep a labeler better than chance until data says more.
    """
    post = {p: 1 / (1 + math.exp(-2.0 * sum(p))) for p, _ in patterns}
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        true = sum(n * post[p] for p, n in patterns)
        share = (true + 1) / (total + 2)
        chance = {}
        for j in range(len(VOTES)):
            for side in (1, 0):
                mass = {v: {1: 4.0, 0: 4.0, -1: 1.0}[v if side else -v] for v in (1, 0, -1)}
                for p, n in patterns:
                    mass[p[j]] += n * (post[p] if side else 1 - post[p])
                whole = sum(mass.values())
                for v in mass:
                    chance[j, side, v] = mass[v] / whole
        for p, _ in patterns:
            odds = math.log(share / (1 - share))
            odds += sum(math.log(chance[j, 1, v] / chance[j, 0, v]) for j, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post


def _bits(kind: int, values: tuple[int, ...]) -> list[str]:
    return ["bias", f"kind={kind}", *(f"{kind}:{n}={v}" for n, v in zip(TRAITS, values, strict=True) if v)]


def fit_classifier(
    rows: list[tuple[int, tuple[int, ...], float, float]], rounds: int = FIT_ROUNDS, rate: float = 0.5
) -> dict[str, float]:
    """Logistic regression of probabilities on traits, from (kind, traits, sum of probabilities, count)."""
    weights: dict[str, float] = {}
    total = sum(n for *_, n in rows)
    cases = [(_bits(k, t), p, n) for k, t, p, n in rows]
    mass: dict[str, float] = {}
    for bits, _, n in cases:
        for b in bits:
            mass[b] = mass.get(b, 0) + n
    for _ in range(rounds if total else 0):
        slope = dict.fromkeys(mass, 0.0)
        for bits, p, n in cases:
            z = sum(weights.get(b, 0.0) for b in bits)
            error = p - n / (1 + math.exp(-max(-30, min(30, z))))
            for b in bits:
                slope[b] += error
        for b, g in slope.items():
            # Steps by the share of rows with the trait, so rare traits learn as fast as common ones.
            weights[b] = weights.get(b, 0.0) * (1 - 1e-3) + rate * g / (mass[b] + 1)
    return weights


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans of every row: arrays of (start, kind, end), kind an index into KINDS.

    Base spans are the valid strict matches, and all are among the spans. The classifier adds loose
    candidates that it finds at least as likely as not and that overlap no base span. Null and empty
    texts have no spans; repeated rows come back each; other columns are ignored.
    """
    found = _with_spans(docs, F.col(doc_id).cast("long"), text)
    return found.select(F.col("kept").alias("doc_id"), "base", "spans")


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with all columns, marks in place of spans, and redacted: whether there were any.

    Null texts stay null, and repeated rows come back each. A column named redacted is replaced.
    """
    columns = [c for c in docs.columns if c != "redacted"]
    found = _with_spans(docs, F.struct(*(F.col(c) for c in columns)), text)
    clean = redact(F.col(f"kept.{text}"), F.col("spans"))
    return found.select(
        *(clean.alias(c) if c == text else F.col(f"kept.{c}").alias(c) for c in columns),
        (F.size("spans") > 0).alias("redacted"),
    )


def _with_spans(docs: DataFrame, kept: Column, text: str) -> DataFrame:
    rows = candidates(docs, kept, text)
    pool = rows.select(F.explode("pool").alias("c")).select("c.*")
    # Both tables are bounded by the numbers of votes and traits, not by the corpus.
    counted = pool.groupBy("kind", *VOTES).count().collect()
    post = {
        kind: reliabilities([(tuple(r[v] for v in VOTES), r["count"]) for r in counted if r["kind"] == kind])
        for kind in range(len(KINDS))
    }
    likely = F.lit(0.0)
    for kind, table in post.items():
        for pattern, p in sorted(table.items()):
            same = [F.col(v) == x for v, x in zip(VOTES, pattern, strict=True)]
            match = F.col("kind") == kind
            for s in same:
                match = match & s
            likely = likely + F.when(match, p).otherwise(0.0)
    learned = (
        pool.select("kind", *TRAITS, likely.alias("p")).groupBy("kind", *TRAITS)
        .agg(F.sum("p").alias("p"), F.count("*").alias("n")).orderBy("kind", *TRAITS).collect()
    )
    weights = fit_classifier([(r["kind"], tuple(r[t] for t in TRAITS), r["p"], r["n"]) for r in learned])
    wanted = {}
    for r in learned:
        values = tuple(r[t] for t in TRAITS)
        if r["loose"] and sum(weights.get(b, 0.0) for b in _bits(r["kind"], values)) >= 0:
            wanted[r["kind"], values] = True

    def accepted(c):
        found = F.lit(False)
        for kind, values in wanted:
            match = c["kind"] == kind
            for t, v in zip(TRAITS, values, strict=True):
                match = match & (c[t] == v)
            found = found | match
        return found

    def free(c):
        return ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    added = F.transform(
        F.filter(F.col("pool"), lambda c: accepted(c) & free(c)),
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
    )
    spans = F.array_sort(F.concat("base", added)) if wanted else F.col("base")
    return rows.select("kept", "base", spans.alias("spans"))


def count_kind(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]`` for each span.

    Of overlapping spans the first one's mark stands for all that they cover together.
    """
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(s, x):
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        fresh = F.concat(s["parts"], F.array(gap, F.element_at(marks, x["kind"] + 1)))
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], fresh).otherwise(s["parts"]).alias("parts"),
        )

    def finish(s):
        return F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, add, finish))
