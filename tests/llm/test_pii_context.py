"""Added kinds of personal data: context on both sides, lists, and where an account number ends."""

from termloom.llm import pii

CARDS = ["378282246310005", "371449635398431", "378734493671000", "30569309025904", "38520000023237"]


def found(spark, texts, kind):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = pii.find_spans(docs).selectExpr("_input_row.doc_id as i", "t", "spans").collect()
    return [
        [r.t[s.start:s.end] for s in r.spans if s.kind == kind] for r in sorted(rows, key=lambda r: r.i)
    ]


def test_context(spark):
    got = found(spark, [
        "ssn 123-45-6789, 321-65-4321", "123-45-6789 (SSN)", "ssn 123-45-6789, 000-12-3456; 321-65-4321",
        "123-45-6789 and " + "x " * 30 + "ssn", "𝒳é ssn\n" + "123-45-6789\n" * 9, "123-45-6789",
    ], "ssn")
    assert got == [
        ["123-45-6789", "321-65-4321"], ["123-45-6789"], ["123-45-6789", "321-65-4321"], [],
        ["123-45-6789"] * 9, [],
    ]
    got = found(spark, ["card " + ", ".join(CARDS), "amex\n" + "\n".join(CARDS), ", ".join(CARDS)], "short_card")
    assert got == [CARDS, CARDS, []]


def test_end_of_an_account_number(spark):
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    got = found(spark, [
        f"IBAN {de} BIC COBADEFFXXX", f"{gb} I paid", f"{de} 12 May", f"{de} {gb} {de} A", f"NR12 {gb}",
        f"{de[:-1]}1 BIC", f"x {gb}", "ZZ18 1234 5678 9012 345 OK",
    ], "iban")
    own = [f"ZZ{n:02} 1234 5678 9012 345" for n in range(2, 99)]
    valid = [x for x in own if int(f"{x[5:].replace(' ', '')}3535{x[2:4]}") % 97 == 1]
    assert got[:7] == [[de], [gb], [de], [de, gb, de], [gb], [], [gb]]
    assert found(spark, [f"{valid[0]} OK"], "iban") == [[valid[0]]]
