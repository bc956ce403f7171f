"""Base spans against the plain patterns, added spans, redaction."""

import random
import re
import time

import numpy as np

from shopfront.llm import boosting, pii


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(40_000):
        text = "".join(rng.choice("ab@@..1234500 -+()_é%🙂") for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == plain(text), text
    card = "é 4111 1111-1111 1111, +1 (337) 555-7349; a.b@c.example.com 0255.1.2.3"
    assert pii.base_spans(card) == plain(card) and len(plain(card)) == 4


def test_long_texts_take_linear_time():
    begin = time.time()
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "@" * 100_000, "+" * 50_000 + "1 " * 50_000,
                 "a.b-" * 50_000 + " dot ", "Aa1-" * 50_000, "AB12 " * 40_000):
        pii.base_spans(text)
        pii.candidates(text)
    assert time.time() - begin < 30


def test_trees_learn_and_pass_nothing_without_labels():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x[:2000], y[:2000], 0.9)
    passed = model.probability(x[2000:]) >= model.threshold
    assert y[2000:][passed].mean() > 0.9 and passed.sum() > 300
    one = boosting.fit(x, np.ones(3000), 0.9)
    assert not (one.probability(x) >= one.threshold).any()


def texts():
    rng = random.Random(9)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    out = []
    for n in range(300):
        out += [f'plain words and token = "{hexes()}" more', f"an id {rng.randrange(10**15, 10**16)} here",
                f"call +1 (337) 555-{rng.randrange(1000, 9999)} now", "nothing at all to see"]
    return out


def test_added_spans_and_redaction(make):
    docs = make(list(enumerate(texts())))
    model = pii.fit(docs)
    rows = {r.doc_id: r for r in pii.find(docs, model).collect()}
    secret = [i for i, t in enumerate(texts()) if "token" in t]
    assert sum("secret:" in rows[i].spans for i in secret) > 0.9 * len(secret)
    clean = [r for i, r in rows.items() if "nothing" in texts()[i]]
    assert all(r.spans == "" for r in clean)
    shown = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert shown[0] == 'plain words and token = "[secret]" more' and shown[3] == "nothing at all to see"
    assert shown[2] == "call [phone] now"
    assert pii.redacted("ab cd ef", [("card", 1, 4), ("ip", 3, 7)]) == "a[card]f"


def test_every_generated_kind_is_found_and_redacted(make):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(150):
        account = digits(18)
        check = 98 - int(account + "131400") % 97
        right, wrong = (f"DE{c % 97:02}{account}" for c in (check, check + 5))
        rows += [("iban", f"please pay to {right} by friday"), ("", f"the part {wrong} is out of stock"),
                 ("number", f"call me on {digits(3)} {digits(3)} {digits(4)} today"), ("number", f"her ssn is {digits(3)}-{digits(2)}-{digits(4)} now"),
                 ("", f"batch of {digits(9)} pieces"), ("spelled", f"so {word()} (at) {word()} (dot) com is mine"),
                 ("", f"{word()} at {word()} dot matrix"), ("secret", f'api_key = "{word()}{digits(20)}" set')]
    rows = [(kind, text) for kind, text in rows if not pii.base_spans(text)]
    docs = make([(n, text) for n, (_, text) in enumerate(rows)])
    model = pii.fit(docs)
    shown = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    for kind in pii.ADDED:
        hits = [f"[{kind}]" in shown[n] for n, (k, _) in enumerate(rows) if k == kind]
        assert sum(hits) > 0.9 * len(hits) > 50, kind
    clean = [shown[n] == text for n, (k, text) in enumerate(rows) if not k]
    assert sum(clean) > 0.9 * len(clean)


def test_masked_base_spans_are_candidates():
    text = "ask a.b@c.example.com or +1 (337) 555-7349, card 4111 1111 1111 1111"
    got = [(around[s:e], kind) for around, (kind, s, e) in pii.masked(text, pii.base_spans(text))]
    assert got == [("a.b (at) c (dot) example (dot) com", "spelled"), ("1 (337) 555-7349", "number"), ("4111.1111.1111.1111", "number")]


def test_awkward_rows(awkward, empty):
    model = pii.fit(awkward)
    rows = pii.find(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r.spans == "" for r in rows)
    assert rows[0].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    back = pii.redact(awkward, model)
    assert back.columns == awkward.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, awkward.collect()))
    assert pii.find(empty, pii.fit(empty)).count() == 0 and pii.redact(empty, model).count() == 0
