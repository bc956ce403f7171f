"""Templates, slots and windows against a plain search."""

from shopfront.llm import decontaminate as d

ITEM = "Anna Miller buys 12 kg of flour and 3 liters of milk for 40 dollars at the Berlin market today"
CHANGED = "Peter Jones buys 15 kg of flour and 7 liters of milk for 99 dollars at the Paris market today"


def found(spark, make, docs, items=((1, ITEM),)):
    bench = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in d.matches(make(docs), bench).collect()}


def test_reparameterised_items(spark, make):
    got = found(spark, make, [
        (1, f"before. {CHANGED} after"), (2, f"x {ITEM} y"), (3, ITEM.upper()), (4, "Peter Jones buys 15 kg of flour"),
        (5, ITEM.lower().replace("12 kg", "12kg").replace("3 liters", "3  liters,")), (6, None), (7, ""), (None, ITEM),
    ])
    assert {k for k, r in got.items() if r.n_changed == 0} == {(2, 1), (3, 1), (5, 1)}
    assert got[1, 1].n_changed == 6 and got[1, 1].n_windows == got[1, 1].n_item_windows


def test_slots_must_agree(spark, make):
    item = "a box holds 5 red balls and 5 blue balls while the other box holds 7 balls of any colour"
    same = item.replace("5", "8").replace("7", "9")
    mixed = item.replace("5 red", "8 red").replace("5 blue", "6 blue")
    got = found(spark, make, [(1, same), (2, mixed)], [(1, item)])
    assert got[1, 1].n_changed == 2 and (2, 1) not in got


def test_clean_and_partial_texts(spark, make):
    words = [f"word{n}x" for n in range(60)]
    item = " ".join(words)
    got = found(spark, make, [
        (1, " ".join(f"other{n}y" for n in range(300))), (2, " ".join(words[:10])), (3, " ".join(["p"] * 50 + words[20:40])),
        (4, " ".join(words[:9] + ["z"] + words[10:19])),
    ], [(1, item), (2, item), (3, "12 13 14 15"), (4, None)])
    assert set(got) == {(3, 1), (3, 2)}  # equal items are all reported


def test_words_put_in_or_left_out_do_not_split_an_item(spark, make):
    item = "Anna carries four wooden crates of ripe pears up the steep stone steps while her brother counts every single pear twice"
    got = found(spark, make, [
        (1, item.replace("Anna", "Mary Ann")), (2, item.replace("stone steps", "old grey stone steps")), (3, item.replace("steep ", "")),
        (5, " ".join(reversed(item.split()))),
    ], [(7, item)])
    assert set(got) == {(n, 7) for n in (1, 2, 3)}
    assert got[2, 7].n_windows == 7  # those that do not hold the new words


def test_short_items(spark, make):
    got = found(spark, make, [(1, "so he asked what is seven times eight and left"), (2, "what is")], [(1, "What is seven times eight"), (2, "what is")])
    assert set(got) == {(1, 1)}


def test_exact_against_plain_search(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()}
    squeeze = lambda t: " " + " ".join(w.strip(".,!|*$%&#") for w in t.casefold().split()) + " "
    items = [(r.item_id, squeeze(r.text)) for r in bench.collect()]
    texts = [(r.doc_id, squeeze(r.text)) for r in docs.collect()]
    whole = {(i, j) for i, t in texts for j, b in items if b in t}
    assert whole <= got and len(got) <= len(whole) + 2


def test_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (None, "x"), (2, "")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in d.matches(awkward, bench).collect()] == [(1, 1)]
    left = d.without_matches(awkward, bench)
    assert left.columns == awkward.columns and left.count() == awkward.count() - 2
    assert d.matches(empty, bench).count() == 0
    assert d.matches(awkward, bench.where("false")).count() == 0


def test_filter_keeps_every_key(spark):
    import numpy as np

    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 500)
    bits = d.filter_bits(spark.createDataFrame([(int(k),) for k in keys], "key bigint"), 1 << 16)
    marks = np.frombuffer(bits, np.uint64)
    assert len(d.passing(keys.astype(np.uint64), marks)) == 500
    other = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    assert len(d.passing(other, marks)) < 20
