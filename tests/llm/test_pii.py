"""Personal data against a plain reading of the base patterns."""

import hashlib
import random
import re

import pyarrow.parquet as pq

from feedbackmill.llm import pii
from feedbackmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    odd = [int(c) for c in number[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def plain_spans(text):
    found = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            numbers = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(numbers) <= 19 and luhn(numbers)):
                continue
            if kind == "phone" and not 9 <= len(numbers) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_against_plain_patterns(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: r for r in QUERIES["op10_personal_data"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        base, mine = plain_spans(r["text"]), got[r["doc_id"]]
        assert mine["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        assert [mine[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert set(filter(None, shown(base).split(","))) <= set(mine["spans"].split(","))


def odd_texts():
    random.seed(2)
    parts = [
        "a.b%c@d.e", "x@y@z.com", "a@b.c%d@e.f.g", "1.2.3.4.5.6.7.8", "999.1.1.1", "255.255.255.255", "é😀", " ", "\n", "-",
        "4111 1111 1111 1111", "4111111111111112", "+1 (212) 555-0100", "+49 30 1234567)", "+1", "12", "1-2 3", "0000000000000",
        "+", "@", ".", "(", "99999999999999999999999999", "id 5500-0000-0000-0004x",
    ]
    return ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(1500)]


def test_odd_texts(spark):
    texts = [*odd_texts(), None, "", "1" * 50_000, "a" * 50_000, "1 " * 30_000, "a@b.c " * 3000, "+1" * 5000, "1.2.3.4 " * 2000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, kind int")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t[:80]
    assert pii.find_personal_data(df.limit(0)).collect() == []


def test_method_adds_spans_and_keeps_base(spark):
    good = [
        ("write an e-mail to jane [at] corp [dot] com today", "email"), ("call tel 212-555-0142 now", "phone"),
        ("visa card 4111.1111.1111.1111 was billed", "card"), ("the server 10[.]1[.]2[.]3 is down", "ip"),
    ]
    rows = [(i, t, k) for i, (t, k) in enumerate(good * 25)]
    rows += [(1000 + i, "mail me: bob@corp.com or visa card 4111 1111 1111 1111, tel +1 212 555 0100, server 10.0.0.7", "") for i in range(50)]
    rows += [(2000 + i, "order 1234.5678.9012.3456 of version 300[.]1[.]2[.]3 and room 12 345 678", "none") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    found = pii.find_personal_data(df).join(df, "doc_id").select("want", "text", "base", pii.spans_text(pii.F.col("spans")).alias("spans"), pii.redact(pii.F.col("text"), pii.F.col("spans")).alias("clean"))
    for r in found.collect():
        if r["want"] == "none":
            assert r["spans"] == "" and r["clean"] == r["text"]
        elif r["want"]:
            assert not r["base"] and r["spans"].startswith(r["want"] + ":"), r
            assert f"[{r['want'].upper()}]" in r["clean"]
        else:
            assert [x.split(":")[0] for x in r["spans"].split(",")] == ["email", "card", "phone", "ip"]
            assert r["clean"] == "mail me: [EMAIL] or visa card [CARD], tel [PHONE], server [IP]"


def test_reliabilities_tell_a_good_labeler_from_a_coin():
    random.seed(1)
    rows = {}
    for _ in range(4000):
        y = random.random() < 0.4
        p = tuple([
            *(1 if (random.random() < q) == y else -1 for q in (0.95, 0.9, 0.85)), random.choice((1, -1)), 0
        ])
        rows.setdefault(p, []).append(y)
    post = pii.reliabilities([(p, len(ys)) for p, ys in rows.items()])
    right = sum(((post[p] >= 0.5) == y) for p, ys in rows.items() for y in ys)
    assert right / 4000 > 0.93
    assert pii.reliabilities([]) == {} and pii.fit_classifier([]) == {}
