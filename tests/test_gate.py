import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import matching as M
from siltstone.functions import text as T
from siltstone.operators import gate as G

HELD = [
    "Don't write this down, but the engineer signed off a slab.", "Please do not put this in the report.", "Never minute that.", "Off the record, the beam was wrong.", "That doesn't go in the minutes.",
    "Keep this between us.", "Just between you and me, it leaks.", "Strike that from the record.", "Leave it out of the notes.", "Moenie dit neerskryf nie, ons was verkeerd.", "Moenie dit nou vir almal skryf en neer sit nie.",
    "Hou dit tussen ons.", "Dit is nie vir die rekord nie.", "Ungakubhali oku.", "Musa ukubhala le nto.", "do n’t  write any of it down.", "DONT WRITE THAT DOWN.", "don't include the price in the write-up.",
]
NOT_HELD = ["Don't write to the trustees yet.", "Moenie skryf aan die trustees nie.", "Die prys is R12,000, maar moenie vir hulle se wat ons betaal het nie.", "Write the price down for me.", "We keep the record in the office.", "Between the wall and the roof.", "I never said. Write it down."]


@pytest.mark.parametrize("said", HELD)
def test_requests_are_held_with_their_neighbours(said):
    text = f"First. One before. {said} One after. Last."
    found = [f for f in G.findings_in(text) if f[2] == "do_not_write_down"]
    assert found and all(text[s:e].startswith("One before.") and "Last" not in text[s:e] for s, e, *_ in found)


@pytest.mark.parametrize("said", NOT_HELD)
def test_ordinary_speech_is_not(said):
    assert G.findings_in(said) == []


def test_what_must_stay_inside():
    for said in ("This must not leave the firm.", "It cannot, ever, leave this office", "Dit mag nie die kantoor of leave the building nie"):
        assert [f[2] for f in G.findings_in(said)] == ["legal_exposure"], said


@pytest.mark.parametrize(
    "text,want",
    [
        ("his number is 8001015009087 he said", [("8001015009087", "identity")]), ("his number is 800101 5009 087 he said", [("800101 5009 087", "identity")]), ("invoice 8001015009087", [("8001015009087", "identity")]),
        ("pay 4111 1111 1111 1111 now", [("4111 1111 1111 1111", "card")]), ("invoice 4111111111111111", []), ("the invoice number is 4501234567890 for the roof", []), ("account number 62731100456, please", [("62731100456", "account")]),
        ("rekening 62731100456", [("62731100456", "account")]), ("order, account 62731100456", []), ("unit 14 and 021 555 0000", []), ("R48,000,123456 of it", []), ("takkode 250655", [("250655", "account")]),
        ("12 8001015009087 34", [("8001015009087", "identity")]),
    ],
)
def test_numbers(text, want):
    assert [(text[s:e], rule) for s, e, _, rule in G.findings_in(text)] == want


def test_own_identifiers_are_no_findings():
    text = "see file 4111111111111111.m4a and card 5500005555555559"
    assert [text[s:e] for s, e, *_ in G.findings_in(text, ["4111111111111111.m4a"])] == ["5500005555555559"]


def test_likely_places_find_a_near_quote_in_a_long_text():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(600)]
    text = " ".join(rng.choices(vocab, k=20_000))
    words = text.split()
    began = time.time()
    for at in (0, 7_777, 19_980):
        quote = words[at : at + 20]
        near = quote[:9] + ["other"] + quote[10:]
        c = M.check_quote(" ".join(near), text)
        assert c["method"] == "fuzzy" and abs(c["start"] - len(" ".join(words[:at]))) < 12
        assert not M.check_quote(" ".join(rng.sample(vocab, 20)), text)["ok"]
    assert time.time() - began < 20


SPELLINGS = ["carel@example.co.za", "carel(at)example.co.za", "carel[at]example.co.za", "carel {at} example.co.za", "carel @ example.co.za", "carel at example.co.za", "carel＠example.co.za", "carel﹫example.co.za", "carel%40example.co.za", "carel&#64;example.co.za", "carel&#x40;example.co.za", "carel [@] example.co.za", "carel at example dot co dot za", "Carel, at example dot co dot za", "carel@example dot co dot za", "carel at example.co dot za"]
ORDINARY = ["Look at the roof before you price it.", "meet me at the roof dot com", "set it at 3 dot 5 metres", "The slab is 3 dot 5 metres at the east end.", "Ring James on 021 555 0000 about the scaffold.", "Sit at reception. Ok then.", "We were at Beach Court. Then we left.", "Meeting at 08h00. Thanks."]


def test_every_spelling_of_an_address_goes_and_speech_stays(spark):
    df = spark.createDataFrame([(f"Send it to {s} when you can.",) for s in SPELLINGS] + [(s,) for s in ORDINARY], "t string")
    out = [r.x for r in df.select(T.strip_dictated(T.strip_emails("t")).alias("x")).collect()]
    for said, text in zip(SPELLINGS, out, strict=False):
        assert "[address removed]" in text and not any(p in text.lower() for p in ("carel", "example", "%40", "&#")), (said, text)
    assert out[len(SPELLINGS) :] == ORDINARY


@pytest.mark.parametrize("address", ["joão@example.com", "müller@site.co.za", "x&#x40;example.com", "josé.silva <@> kbc.co.za"])
def test_addresses_with_letters_of_any_script(spark, address):
    text = spark.range(1).select(T.strip_emails(F.lit(f"to {address}, please")).alias("x")).first().x
    assert text == "to [address removed], please"
