"""Detectors and contacts that look for plain texts first, against the whole patterns in Python."""

import random
import re
import time

from pyspark.sql import functions as F

from shopfront.functions import contacts, detect, fixed

PIECES = [
    "calendly.com", "book", "booknow", "book.now", "book now", "book an", "book-your", "book a ", "booking", "simplybook.me", "appointment",
    "reserv", "reserve", "reservation", "rendez-vous", "réserver", "réserve", "حجز", "fresha.com", "setmore.com", "vagaro.com", ".com",
    "acuityscheduling.com", "squareup.com/appointments", "google.co.uk/maps", "google.", "maps.google.", "maps.googleapis.com", "goo",
    "maps.app.goo.gl", "goo.gl/maps", "g.page/", "wa.me/", "wa.link/", "wa.", "whatsapp", "joinchat", "click-to-chat", "phone=", "+", "12345678",
    "domain", "this domain is parked", "buy this domain", "related searches", "courtesy page", " page", " ", "-", "é", "x", "<", ">", "&",
]
MAIL = ["a", "b.co", "@", "@@", ".", "..", "com", "x.org", "_", "%", "+1", "-", " ", "<", ">", "\n", ",", "é", "1", "ab.c1", "name@here.net", "'"]
EMAIL = re.compile(fixed.EMAIL, re.A)


def texts(rng, pieces, count, longest):
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(longest))) for _ in range(count)]


def test_detectors_agree_with_their_patterns(spark):
    rows = [(t,) for t in PIECES + texts(random.Random(5), PIECES, 3000, 4)]
    patterns = {"maps": fixed.MAPS, "whatsapp": fixed.WHATSAPP, "booking": fixed.BOOKING}
    found = spark.createDataFrame(rows, "t string").selectExpr(
        "t", *(f"{detect.linked(c, 't', repr(''))} AS {c}" for c in patterns), f"{detect.is_parked('t')} AS parked",
        f"{contacts.whatsapp_number('t')} AS number",
    ).collect()
    for r in found:
        for check, pattern in patterns.items():
            assert r[check] == bool(re.search(pattern, r.t)), (check, r.t)
        assert r.parked == any(m in r.t for m in fixed.PARKED)
        number = re.search(fixed.WHATSAPP_NUMBER.replace(r"\p{Nd}", r"\d"), r.t)
        assert r.number == (number[1] if number else None), r.t


def test_addresses_agree_with_the_pattern(spark):
    rows = [(t,) for t in texts(random.Random(7), MAIL, 4000, 14)]
    found = spark.createDataFrame(rows, "t string").selectExpr("t", f"{contacts._found_emails('t')} AS found").collect()
    assert [r.found for r in found] == [EMAIL.findall(r.t) for r in found] and sum(len(r.found) for r in found) > 500


def test_long_texts_are_searched_for_texts_first(spark):
    """The detectors take a fraction of the time that the whole patterns take on texts that show nothing."""
    rows = spark.range(0, 64, 1, 4).select(F.expr("repeat('many words about colour, science and travel without a fee ', 20000) AS t")).cache()
    rows.count()

    def seconds(*columns):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            rows.selectExpr(*(f"count({c})" for c in columns)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    whole = seconds(f"t RLIKE r'(?=[cbarfsvح]){fixed.BOOKING}'", f"nullif(regexp_extract(t, r'(?=[wp]){fixed.WHATSAPP_NUMBER}', 1), '')")
    ours = seconds(detect.linked("booking", "t", "''"), f"coalesce({contacts.whatsapp_number('t')}, '')")
    rows.unpersist()
    assert ours < whole / 2, (ours, whole)
