"""Values are found where the corpus says they are, in every way of writing, and nothing else is touched."""

import random

import pytest

from passagemill.llm import pii_sanitise as P

SCHEMA = "id string, question string, pii_categories array<string>, must_not_echo string, note string, found string"

VALUES = {
    "email": ["kra.fel@mon.example", "kra_fel (at) mon (dot) example", "kra+x @ mon.example", "KRA@MON.EXAMPLE.ORG", "kra [at] mon [dot] co [dot] invalid"],
    "phone": ["+91 98765 43210", "(503) 555-0150", "9876543210", "98765 43210", "987-654-3210", "nine eight seven six five four three two one zero", "09876543210", "+44 7700 900123"],
    "pan": ["ABCDE1234F", "abcde1234f", "ABC DE 1234 F", "ABCDE-1234-F"],
    "aadhaar": ["1234 5678 9012", "1234-5678-9012", "123456789012", "123 456 789 012", "123456 789012"],
    "account": ["123456789012345", "1234 5678 90123", "012-3456-789012"],
    "ifsc": ["KRAF0AB12CD", "kraf0ab12cd", "KRAF 0AB12CD", "KRAF-0AB12CD"],
    "otp": ["123456", "1234", "123 456", "123-456"],
    "name": ["Krafel Montis", "K. M. Boufel", "krafel montis", "Krafel D'Montis", "KRAFEL MONTIS", "मोदीभो पिलगि"],
    "address": ["Flat 3B, 12-4-5 Kraven Road, Montis 123 456", "House No. 7, Kraven Street, Boufel", "38/B Kraven Marg\nMontis 123456", "Plot 12, Sector 4, Boufel 123 456"],
}
FRAMES = {
    "email": "Reply to {}, please.", "phone": "My mobile: {}", "pan": "KYC was done with PAN {}.", "aadhaar": "My aadhar no. {} is known.", "account": "Bank account {} is linked.",
    "ifsc": "The ifsc code is {}, I think.", "otp": "The OTP is {}.", "name": "Joint holder Mr {} agrees.", "address": "We live at {}.",
}
PLAIN = ["What does Kraven Growth Fund charge?", "My folio is 50371099.", "Ticket 1402-67-0098 is open.", "Batch 1232-5592-5515 was rejected.", "Plan code 1756 Growth.", "NAV was 306.7060 on 6 June 2014.", "I put in Rs 362,000 in 2019-2021.", "Mr. Market does as it likes.", "Kraven Street Partners is the index provider.", "SIP id SIP-2025-895948.", "Voucher KLMN01627856 has lapsed.", "My name is on the list already."]


def made(seed, n):
    rng = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        pick = rng.sample(sorted(VALUES), rng.choice([0, 1, 1, 2]))
        parts = [(FRAMES[c], rng.choice(VALUES[c]), c) for c in pick] + [(t, None, None) for t in rng.sample(PLAIN, rng.randint(1, 2))]
        rng.shuffle(parts)
        text = ""
        for frame, value, c in parts:
            at = len(text) + frame.find("{}")
            text += (frame.format(value) if value else frame) + rng.choice([" ", "\n"])
            if c:
                truth.add((f"q{i}", c, at))
        labels = [rng.choice([c, c.upper()]) for c in pick] if rng.random() < 0.4 else None
        rows.append((f"q{i}", text, labels, None, "clash", "clash"))
    return rows, truth


@pytest.mark.parametrize("n", [40, 900])
def test_found_at_their_places(spark, n):
    rows, truth = made(n, n)
    rows += rows[:3] + [("null", None, None, None, None, None), ("empty", "", [], None, None, None)]
    got = [(r.id, r.category, r.start_at) for r in P.personal_information(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & truth) >= (0.97 if n > 100 else 0.9) * len(truth)
    assert len(set(got) & truth) >= (0.97 if n > 100 else 0.9) * len(got)


def test_sanitised_text_keeps_the_rest(spark):
    rows, truth = made(7, 600)
    rows += [("null", None, None, None, None, None), ("empty", "", None, None, None, None)]
    got = {r.id: r for r in P.sanitised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and got["null"].sanitised is None and got["empty"].sanitised == ""
    row = next(r for r in got.values() if r.pii_categories == ["otp"])
    assert "[OTP]" in row.sanitised and row.sanitised.replace("[OTP]", "") in (row.text.replace(v, "", 1) for v in VALUES["otp"])


@pytest.mark.parametrize(("common", "n"), [("email", 10), *((c, n) for c in sorted(VALUES) for n in (40, 400))])
def test_most_rows_hold_one_category(spark, common, n):
    rng, rows, truth = random.Random(n), [], set()
    for i in range(n):
        value, plain = rng.choice(VALUES[common]), rng.choice(PLAIN)
        rows.append((f"q{i}", f"{plain} {FRAMES[common].format(value)}", [common], None, "clash", "clash"))
        truth.add((f"q{i}", common, len(plain) + 1 + FRAMES[common].find("{}")))
    got = {(r.id, r.category, r.start_at) for r in P.personal_information(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_forms():
    of = lambda t: {(t[c.start : c.end], x) for c in P.candidates(t) for x in c.categories}
    assert ("123-456", "otp") in of("code 123-456.") and ("+91-66666-21265", "phone") in of("at +91-66666-21265 now")
    assert not {x for _, x in of("paid 12,345.50 on 2019-05-06, ISIN INF455Z0131Q4, SIP-2025-895948")} - {"otp"}
    assert ("1 2 3", "otp") not in of("1 2 3")
    assert {v for v, c in of("a b" * 5000) if c} == set()


@pytest.mark.parametrize(
    "text, value, category",
    [
        ("Ring me on 9 8 7 6 5 4 3 2 1 0 now", "9 8 7 6 5 4 3 2 1 0", "phone"), ("call 98 76 54 32 10 please", "98 76 54 32 10", "phone"), ("UID 12 34 56 78 90 12 ok", "12 34 56 78 90 12", "aadhaar"),
        ("phone 0091 98765 43210", "0091 98765 43210", "phone"), ("tel (91) 98765 43210", "(91) 98765 43210", "phone"), ("tel +91 (98765) 43210.", "+91 (98765) 43210", "phone"), ("whatsapp 040-23456789", "040-23456789", "phone"),
        ("My name is Juan Carlos Maria de la Cruz Santos Lopez Garcia. Bye", "Juan Carlos Maria de la Cruz Santos Lopez Garcia", "name"), ("Holder Capt. Dr. Krafel Montis agrees", "Krafel Montis", "name"),
        ("write to kra dot fel at mon dot example", "kra dot fel at mon dot example", "email"), ("We live at Flat 3B, 2nd Floor, Kraven Apartments, 12 Kraven Road, Montis 123456.", "Flat 3B, 2nd Floor, Kraven Apartments, 12 Kraven Road, Montis 123456", "address"),
        ("Post: B-204, Green Residency, 5 Kraven Road, Boufel 500001", "B-204, Green Residency, 5 Kraven Road, Boufel 500001", "address"), ("code 1 2 3 4 5 6", "1 2 3 4 5 6", "otp"),
    ],
)
def test_further_writings(text, value, category):
    assert (value, category) in {(text[c.start : c.end], x) for c in P.candidates(text) for x in c.categories}


def test_no_text_is_judged_by_its_own_labels(spark):
    rows = [(f"q{i}", f"The number {i:04d} is on page 7.", [], None, None, None) for i in range(60)]
    odd = ("odd", "The number 1234 is on page 7.", ["otp"], None, None, None)
    got = P.personal_information(spark.createDataFrame([*rows, odd], SCHEMA)).collect()
    assert got == []


def test_long_text_and_empty_table(spark):
    text = "word " * 40_000 + "The OTP is 123456." + " 9" * 5000
    rows, _ = made(3, 100)
    got = P.personal_information(spark.createDataFrame([*rows, ("long", text, None, None, None, None)], SCHEMA)).where("id = 'long'").collect()
    assert ("otp", 200_000 + len("The OTP is ")) in {(r.category, r.start_at) for r in got}
    assert P.personal_information(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overlaps_are_settled():
    assert P.settle([(0, 15, "phone", 0.6), (1, 15, "phone", 0.9)]) == [(0, 15, "phone", 0.6)]
    assert P.settle([(5, 11, "otp", 0.9), (0, 30, "address", 0.6), (40, 52, "account", 0.6), (40, 52, "aadhaar", 0.9)]) == [(0, 30, "address", 0.6), (40, 52, "aadhaar", 0.9)]
