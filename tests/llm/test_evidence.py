"""Languages, licences and quotations on small cases."""

import pytest

from importlib import resources

from shopfront.llm import langid, licenses, quotes


# --- languages ----------------------------------------------------------------------------
def test_text_between_tags():
    page = '<html lang="fr"><script>var a="<p>";</script><style>x</style><!-- no -->A<b>B</b><p>C < D</p><script>open'
    assert langid.visible(page).split() == ["A", "B", "C"] and langid.visible("") == ""
    assert langid.address("https://U:p@Shop.Example.DE:8080/fr/x?y") == ("shop.example.de", "de", "fr")
    assert langid.address("http://a.de/about") == ("a.de", "de", "de")
    assert langid.address("no address") == (None, "", None) == langid.address(None)


def test_languages_of_pages_and_documents(spark, sf_dir):
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    rows = langid.identify(docs, pages).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    known = [r.lang == truth[r.doc_id] for r in rows if r.kind == "document"]
    assert len(known) == len(truth) and sum(known) >= 0.97 * len(known)
    assert sum(r.kind == "page" for r in rows) == pages.count()


def test_host_and_declaration_decide_where_the_text_is_silent(spark):
    docs = [(i, "the cat and the dog of the house" if i % 2 else "der hund und die katze im haus", "en" if i % 2 else "de", f"s{i % 2}", 0) for i in range(200)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    german, english = "<p>der hund und die katze im haus</p>", "<p>the cat and the dog of the house</p>"
    pages = [(i, "http://a.test/x", german) for i in range(40)] + [(i, "http://b.test/x", english) for i in range(40, 80)]
    pages += [(i, "http://c.test/", '<html lang="de">' + german) for i in range(80, 100)]
    pages += [(100, "http://a.test/y", ""), (101, "http://b.test/y", None), (102, "http://new.test/", '<html lang="de-AT">123'), (None, None, None)]
    pages = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.lang for r in langid.identify(docs, pages).collect() if r.kind == "page"}
    assert got[100] == "de" and got[101] == "en" and got[102] == "de" and len(got) == 104


def test_language_of_awkward_rows(awkward, empty, spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    docs = awkward.selectExpr("doc_id", "score AS source", "'en' AS lang").join(awkward.selectExpr("doc_id AS d").where("false"), how="left", on=awkward["doc_id"] == 0)
    assert langid.identify(empty, pages).count() == 0
    plain = spark.createDataFrame([(None, None, None, None), (1, None, None, None), (1, "", "x", "s"), (2, "a " * 9000, "x", None)], "doc_id bigint, text string, lang string, source string")
    assert langid.identify(plain, pages).count() == 4 and docs is not None


def test_every_language_that_occurs_is_known(spark):
    made = [(f"l{n:02}", f"{a}{b}") for n, (a, b) in enumerate((a, b) for a in ("ba", "ke", "ri", "to", "mu") for b in "cdfghjlnpqsx")]
    rows = [(100 * n + at, " ".join(stem + end for end in ("aro", "ite", "ul", "en")), lang, None)
            for n, (lang, stem) in enumerate(made) for at in range(4 if n else 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = langid.fit(docs)
    assert model.languages == [lang for lang, _ in made]  # 60
    got = {r.id: r.lang for r in langid.fuse(langid.document_evidence(docs, model), model).collect()}
    assert sum(got[doc] == lang for doc, _, lang, _ in rows) > 0.95 * len(rows)


# --- licences -----------------------------------------------------------------------------
def test_licences_and_inheritance(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.\n" + "code " * 500, "p/a.c"), (2, "no licence here", "p/lib/x/b.c"),
        (3, mit, "p/lib/LICENSE"), (4, "plain", "p/c.c"), (5, "This work is licensed under the GNU General Public License, version 3.", "p/lib/x/y/COPYING"),
        (6, "deep", "p/lib/x/y/z/d.c"), (7, None, "p/lib/e.c"), (8, "", None), (9, "RELEASED!! UNDER!! THE!! MIT!! LICENSE!!", "q"),
        (10, "a driving licence is issued by the office", "p/f.c"), (11, "mot " * 30 + "Licensed under CC BY-NC 4.0. mot", "p/g.c"), (11, "mot " * 30 + "Licensed under CC BY-NC 4.0. mot", "p/g.c"),
        (None, "x", "p/lib/h.c"),
    ]
    got = sorted(((r.doc_id or 0, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string, path string")).collect()), key=repr)
    assert got == sorted([
        (1, "Apache-2.0", None), (2, "MIT", "p/lib"), (3, "MIT", None), (4, None, None), (5, "GPL-3.0", None), (6, "GPL-3.0", "p/lib/x/y"),
        (7, "MIT", "p/lib"), (8, None, None), (9, "MIT", None), (10, None, None), (11, "CC-BY-NC-4.0", None), (11, "CC-BY-NC-4.0", None), (0, "MIT", "p/lib"),
    ], key=repr)
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string, path string")).count() == 0


def test_full_texts_speak_for_their_directories_and_the_root(spark):
    full = resources.files("shopfront.llm") / "license_texts"
    texts = {f.name[:-4]: f.read_text() for f in full.iterdir() if f.name.endswith(".txt")}
    rows, says = [], {}
    for n, (name, text) in enumerate(sorted(texts.items())):
        rows += [(2 * n, "Copyright (c) 2031 Some Holder\n\n" + text, f"{n}/text"), (2 * n + 1, "int x;", f"{n}/src/deep/a.c")]
        says[2 * n] = (name, None)
        says[2 * n + 1] = (name, str(n))
    rows += [(100, texts["MIT"], "LICENSE"), (101, "int y;", "a/b.c"), (102, "int z;", "z.c"), (103, "int w;", "/abs/w.c"),
             (104, "Our terms. " + "word " * 60 + "Licensed under CC BY 4.0. " + "word " * 60, "c/LICENSE.md"), (105, "plain", "c/d/e"),
             (106, "Notes on a driving licence, for people who read the text of the law as it is and of the work they do", "f/notes"), (107, "plain", "f/g/h")]
    says |= {100: ("MIT", None), 101: ("MIT", "."), 102: ("MIT", "."), 103: (None, None), 104: ("CC-BY-4.0", None), 105: ("CC-BY-4.0", "c"),
             106: ("MIT", "."), 107: ("MIT", ".")}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string, path string")).collect()
    assert {r.doc_id: (r.license, r.inherited_from) for r in got} == says



def test_every_statement_in_documents_is_found(spark, sf_check):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet").selectExpr("doc_id", "text", "'x' AS path")
    own = {r.doc_id: r.own_license for r in licenses.scan(docs).collect()}
    says = {"Apache License": "Apache-2.0", "MIT License": "MIT", "GNU General Public": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    for r in docs.collect():
        expected = {v for k, v in says.items() if k in r.text}
        assert own[r.doc_id] in expected if expected else True


# --- quotations ---------------------------------------------------------------------------
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("block", [1, 1024])
def test_replies(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "TURNS_A_BLOCK", block)
    rows = [
        (1, -2, "u", "Hello there.\nHow do I pack boxes?\nThanks"), (1, 1, "a", "> How do I pack  Boxes?\nLongest first."),
        (1, 2, "u", ">> How do I pack boxes?\n> Longest first.\nAnd then?"), (1, 3, "u", "> Thanks\nWelcome"), (1, 4, "u", "new"),
        (1, 5, "a", "Thanks"), (1, 6, "u", "> thanks\r\n> nobody wrote this\nok"), (2, 0, "u", None), (2, 0, "u", ""), (2, 0, "u", ""),
        (2, 1, "u", "> How do I pack boxes?\nhm"), (None, 1, "x", "> q\nr"), (3, None, None, "s"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert quotes.link(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    parents = {k: r.parent_turn for k, r in got.items() if k[0] == 1}
    assert parents == {(1, -2): None, (1, 1): -2, (1, 2): 1, (1, 3): -2, (1, 4): None, (1, 5): None, (1, 6): 5}
    assert got[1, 2].depth == 2 and got[1, 2].root_turn == -2 and got[1, 2].n_linked == 2 and got[1, 2].reply == "And then?"
    assert [t for _, t in sorted((got[1, t].position, t) for t in (-2, 1, 2, 3, 4, 5, 6))] == [-2, 1, 2, 3, 4, 5, 6]
    assert got[2, 1].parent_turn is None and got[2, 1].n_passages == 1 and got[None, 1].position is None
    assert quotes.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_thread(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, n, "u", f"> line {n - 1}\nline {n}\nok") for n in range(1, 120)]
    got = {r.turn: r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[n].depth == n and got[n].root_turn == 0 and got[n].position == n for n in got)


def test_derived_quotes_lead_to_the_messages_before(spark, sf_check):
    from shopfront.llm import queries

    table = spark.read.parquet(f"{sf_check}/conversations.parquet").select("conv_id", "turn", "role", "text")
    texts = {}
    for r in table.collect():
        texts.setdefault((r.conv_id, r.turn), []).append(r.text)
    got = quotes.link(queries.quoting(table)).collect()
    assert len(got) == sum(map(len, texts.values()))
    linked = 0
    for r in got:
        before = [t for t in texts.get((r.conv_id, r.turn - 1), []) if t and t.strip()]
        if r.turn % 3 and before and min(texts[r.conv_id, r.turn - 1]).strip() and r.reply:
            assert r.parent_turn == r.turn - 1 and r.depth == r.turn % 3, r
            linked += 1
        elif not r.turn % 3:
            assert r.n_passages == 0 and r.parent_turn is None
        assert r.reply == "\n".join(texts[r.conv_id, r.turn][0].split("\n")).strip("\n") or len(texts[r.conv_id, r.turn]) > 1
    assert linked > 200


def test_quotes_in_awkward_rows(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    rows = [(1, 0, "u", "w" * 50_000 + " " + "é日 " * 9000, "x", 9), (1, 1, "a", "> " + "w" * 50_000 + " " + "é日 " * 9000 + "\nyes", "x", 9)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, TEXT string, position int")
    got = {r.turn: r for r in quotes.link(table).collect()}
    spark.conf.set("spark.sql.caseSensitive", "false")
    assert (got[1].parent_turn, got[1].reply, got[1].position) == (0, "yes", 1)


def test_inheritance_in_a_tree_equals_a_walk_up(spark):
    import random

    rng = random.Random(9)
    statements = {"MIT": "Licensed under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    folders = [""]
    for _ in range(120):
        folders.append(f"{rng.choice(folders)}{rng.choice('abc')}{rng.randrange(9)}/")
    folders = sorted(set(folders))
    rows, speaks = [], {}
    for folder in folders:
        if rng.random() < 0.15:
            name = rng.choice(sorted(statements))
            speaks[folder] = name
            rows.append((len(rows), statements[name], folder + "LICENSE"))
        for n in range(rng.randrange(3)):
            rows.append((len(rows), "plain words of a file " * rng.randrange(2), f"{folder}f{n}.c"))
    rows.append((len(rows), "mot " * 60_000 + statements["MIT"], "long/x.c"))
    spark.conf.set("spark.sql.caseSensitive", "true")
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, path string, PATH string, cosine double")
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    spark.conf.set("spark.sql.caseSensitive", "false")
    for number, text, path in rows:
        own = next((k for k, s in statements.items() if s in text), None)
        expected = (own, None)
        if own is None:
            at = path.rpartition("/")[0]
            while True:
                folder = f"{at}/" if at else ""
                if folder in speaks:
                    expected = (speaks[folder], at or ".")
                    break
                if not at:
                    break
                at = at.rpartition("/")[0]
        assert (got[number].license, got[number].inherited_from) == expected, path
