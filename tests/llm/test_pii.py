import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vesper.llm import pii

from .conftest import ODD

TEXTS = ["", None, "a@b.c_d@e.f x@y.z.@q.r 1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1", "4111 1111 1111 1111 9", "+4111 1111 1111 1111 é😀 +49 (30) 1234-567-", "😀é a.b@c.de card 4111-1111-1111-1111 ", "x" * 20_000 + "@a.b", "1" * 30_000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4111-1111-1111-1111 and 5500  4111111111111111", "a@b.c.d-.e@f@g.h 1..2.3.4 00001.2.3.4 99999999999999.2.3.4", "+1 (555) 123-4567, +12, +1234567890123456 +-1", "a@b", "@b.c", "." * 10_000 + "@x.y", "a.b" * 5000 + "@c" + ".d" * 5000]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in spans) for k in pii.KINDS]
        every = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert {(k, str(s), str(e)) for k, s, e in spans} <= set(every)
        assert every == sorted(every, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


def test_base_spans(spark, documents):
    check(pii.report(documents).collect(), {r.doc_id: r.text for r in documents.collect()})
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(pii.report(frame).collect(), dict(enumerate(TEXTS)))


def test_random_texts(spark):
    found = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(alphabet=st.sampled_from([*"0011459 -.+()@_%abé😀,"]), max_size=60))
    def gather(text):
        found.append(text)

    gather()
    check(pii.report(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(4)).collect(), dict(enumerate(found)))


def test_expectation_maximisation_adds_spans(spark):
    rows = [(i, f"call me: tel {'+' if i % 3 else ''}{'1 ' if i % 3 else ''}415-555-{1000 + i} now") for i in range(300)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "inline(pii)").collect()
    assert {r.doc_id for r in found if not r.base} and all(r.score >= 0.5 for r in found if not r.base)


def test_mask(spark):
    frame = spark.createDataFrame([(1, "mail a@b.co or +4111 1111 1111 1111, é 10.0.0.1."), (2, "clean"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask(frame).collect()}
    assert got[1].startswith("mail <EMAIL> or +<CARD>, é <IP>.") and got[2] == "clean" and got[3] is None and got[4] == ""
    assert "@" not in got[1] and "1111" not in got[1]


def test_odd_rows(odd, none):
    assert len(pii.report(odd).collect()) == len(ODD)
    assert pii.mask(odd).columns == odd.columns and pii.report(none).collect() == []


def test_runs_without_python(documents):
    plan = pii.report(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
