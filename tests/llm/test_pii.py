"""Personal data against Python's ``re`` and hand-made cases."""

import hashlib
import re

import pytest

from repoaudit.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        spans = [m for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
        found.append([f"{kind}:{m.start()}:{m.end()}" for m in spans])
    return found


TEXTS = [
    None,
    "",
    " ",
    "a@b.c_d@e.f a@b@c.de .@x.y",
    "x@y.zz.. %%a+b@c-d.e-f",
    "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 1.2.3 1..2.3.4",
    "é𝄞 4111 1111 1111 1111 é 4111-1111-1111-1112 4041894974608795",
    "1 4111111111111111 and 4111111111111111 2 then 4111111111111111x",
    "+1 (269) 555-3296 +49 30 (1) ) +1 2 ++44 20 7946 0958.",
    "+4111111111111111 10.0.0.1-4111 1111 1111 1111",
    "9" * 5000,
    "a" * 20000 + "@" + "b." * 3000 + "c",
    "1." * 5000 + "7",
    "7 " * 6000,
]


@pytest.fixture(scope="module")
def digests(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[3:5], "doc_id long, text string, kind string")
    return pii.pii_digest(df).collect()


def test_base_spans_equal_plain_search(digests):
    assert len(digests) == len(TEXTS) + 2
    for row in digests:
        want = brute(TEXTS[row.doc_id])
        counts = [row.n_email, row.n_ip, row.n_card, row.n_phone]
        assert counts == [len(w) for w in want], row
        text = ",".join(x for w in want for x in w)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.spans == text


def spans(spark, text):
    return pii.find_pii(spark.createDataFrame([(text,)], "text string")).first().pii


def test_account_number_needs_its_remainder(spark):
    good = spans(spark, "pay to DE89 3704 0044 0532 0130 00 please, not DE88370400440532013000")
    assert [(s.kind, s.start, s.end) for s in good if s.kind == "iban"] == [("iban", 7, 34)]


def test_social_security_number_needs_context(spark):
    assert not [s for s in spans(spark, "code 123-45-6789 here") if s.kind == "ssn"]
    assert [s.kind for s in spans(spark, "my SSN is 123-45-6789")] == ["ssn"]


def test_context_changes_the_score(spark):
    near, far = spans(spark, "write to a@b.cd"), spans(spark, "a@b.cd")
    assert near[0].score > far[0].score


def test_redact_merges_overlaps_and_keeps_null(spark):
    rows = [("x +4111111111111111 y a@b.cd.",), (None,), ("none",)]
    df = pii.redact(pii.find_pii(spark.createDataFrame(rows, "text string")))
    assert [r.text for r in df.collect()] == ["x +[CARD] y [EMAIL].", None, "none"]


def test_many_spans_in_one_text(spark):
    """Places and masks over thousands of spans and many blocks, with characters of four bytes."""
    parts = [f"😀u{i}@host.example, " if i % 2 else f"é 10.0.{i % 256}.7\n" for i in range(6000)]
    text = "".join(parts)
    found = pii.find_pii(spark.createDataFrame([(text,)], "text string"))
    row = pii.redact(found).collect()[0]
    assert len(row.pii) == 6000
    for span in row.pii:
        cut = text[span.start : span.end]
        assert cut.endswith("@host.example") if span.kind == "email" else re.fullmatch(r"10\.0\.\d+\.7", cut)
    assert row.text == "".join("😀[EMAIL], " if i % 2 else "é [IP]\n" for i in range(6000))


def test_context_across_blocks(spark):
    rows = [("😀" * shift + " ssn 123-45-6789",) for shift in range(pii.BLOCK - 60, pii.BLOCK + 3)]
    found = pii.find_pii(spark.createDataFrame(rows, "text string")).collect()
    assert all([s.kind for s in r.pii] == ["ssn"] for r in found)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, pii string, start int")
    found = pii.find_pii(df)
    assert found.count() == 0 and set(found.columns) == {"doc_id", "text", "pii", "start"}


def test_base_columns_equal_sql(spark):
    """The counts and base spans of all documents against DuckDB; ``spans`` holds further kinds."""
    from repoaudit.llm import oracles
    from repoaudit.llm.queries import op2_pii
    from tests.oracle_check import difference

    def base(session, folder):
        return op2_pii(session, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")

    assert difference(spark, "/root/testdata/sf0.001", base, oracles.pii_base()) is None
