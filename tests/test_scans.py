"""Large JSON and CSV files cut up by many tasks, against Python's readers and Spark's own."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from shopfront.sources import csv_scan, json_scan, leads, osm, ranges

MARKS = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "🙂", "a", "b", " ", '"}', "},{", "\\\"", "]}", '{"name":']


@pytest.fixture
def tiny(spark, monkeypatch):
    """Ranges of a few thousand bytes and chunks of a few dozen."""
    monkeypatch.setattr(ranges, "CHUNK_BYTES", 60)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def word(rng, size=6):
    return "".join(rng.choice(MARKS) for _ in range(rng.randrange(size)))


def value(rng, deep=3):
    kind = rng.randrange(8 if deep else 5)
    if kind < 3:
        return word(rng)
    if kind < 5:
        return rng.choice([None, True, 7, -1.5e3, ""])
    if kind < 7:
        return {word(rng): value(rng, deep - 1) for _ in range(rng.randrange(4))}
    return [value(rng, deep - 1) for _ in range(rng.randrange(4))]


def listed(document):
    """The objects of the list that counts."""
    if isinstance(document, list):
        return document
    return next(v for v in document.values() if isinstance(v, list) and v and isinstance(v[0], dict))


def scanned(spark, path, **options):
    out = {}
    for r in json_scan.records(spark, str(path), **options).collect():
        out.setdefault(r.file.rpartition("/")[2], []).append(json.dumps(json.loads(r.text), sort_keys=True))
    return {f: sorted(texts) for f, texts in out.items()}


@pytest.fixture
def seen(monkeypatch):
    """The latest staged table of each name."""
    found = {}
    for module in (json_scan, csv_scan):
        monkeypatch.setattr(module, "stage", lambda table, name, stage=module.stage: found.setdefault(name, stage(table, name)))
    return found


def test_json_of_every_shape_is_cut_as_python_reads_it(tiny, tmp_path, seen):
    rng, expected = random.Random(3), {}
    for n in range(36):
        items = [{word(rng): value(rng) for _ in range(rng.randrange(1, 6))} | {"n": i, "big": "x" * rng.choice([0, 0, 500])}
                 for i in range(rng.randrange(1, 25))]
        document = items
        if n % 3:
            document = {word(rng) + str(i): value(rng) for i in range(rng.randrange(3))} | {"pl}ac\"es" + word(rng): items}
            document |= {"more": rng.choice([[], [{"no": 1}], 5, {"a": {"b": {}}}, [[{}]]])}
        text = json.dumps(document, indent=rng.choice([None, None, 1, 4]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"{n}.json").write_text(text + rng.choice(["", "\n", " \n "]), encoding=rng.choice(["utf-8", "utf-8-sig"]))
        expected[f"{n}.json"] = sorted(json.dumps(r, sort_keys=True) for r in listed(document))
    got = scanned(tiny, tmp_path)
    assert got == expected
    assert seen["chunk-states"].count() > 1000 and seen["chunk-states"].select("file", "block").distinct().count() > 40


def test_repeated_names(tiny, tmp_path):
    (tmp_path / "a.json").write_text('{"x": [{"n": 1}], "y": [{"n": 2}], "x": [{"n": 3}, {"n": 4, "n": 5}]}')
    (tmp_path / "b.json").write_text('{"x": [{"n": 1}], "y": [{"n": 2}], "x": "none"}')
    (tmp_path / "c.json").write_text('[{"name": "A", "name": "B", "contact": {"email": "a@x.test", "email": "b@x.test"}}]')
    got = scanned(tiny, tmp_path)
    assert got["a.json"] == ['{"n": 3}', '{"n": 5}'] and got["b.json"] == ['{"n": 2}']
    (row,) = leads.load(tiny, str(tmp_path / "c.json"), contact_from="contact").collect()
    assert (row.name, row.email) == ("B", "b@x.test")
    assert tiny.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    held = tiny.createDataFrame([((tmp_path / "a.json").read_text(),), ('{"no": "[{1", "y": [{"name": "Y"}], "y": [{"name": "Z}", "name": "[Z"}]}',)], "doc string")
    found = leads.records_of_documents(held, "doc").selectExpr("to_json(record) AS r").collect()
    assert sorted(r.r for r in found) == ['{"n":3}', '{"n":5}', '{"name":"[Z"}']
    (tmp_path / "d.jsonl").write_text('{"name": "A", "name": "B"}\n\n{"name": "C"}\n')
    assert sorted(r.name for r in leads.load(tiny, str(tmp_path / "d.jsonl")).collect()) == ["B", "C"]


BAD = [" \n", "5", '"x"', '{"a": 1}', '{"a": []}', '{"a": [1, {}]}', '[{"a": 1}', '{"a": [{"b": 1}]', '[{"a": 1}]}', '[{"a": 1}] x', '[{"a": 1}][{"b": 2}]',
       '[{"a": 1} {"b": 2}]', '[{"a": 1},, {"b": 2}]', '[{"a": "1}]', 'x[{"a": 1}]', '{"a": [{"b": 1}]}}', '[{"a": {"b": 1}]', "}", '{"a": [{"b": 1}]} {"a": [{"b": 1}]}',
       '[{"a": 1}' + " " * 300 + ', {"b": 2}' * 30]


def test_documents_without_records_are_errors(tiny, tmp_path, seen):
    for n, text in enumerate(BAD):
        (tmp_path / f"{n}.json").write_text(text)
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    with pytest.raises(Exception, match="expected JSON with records"):
        leads.read_json_records(tiny, str(tmp_path)).collect()
    right = {r.file.rpartition("/")[2] for r in seen["documents"].where("right").collect()}
    assert right == {"good.json"} and seen["documents"].count() == len(BAD) + 1
    (tmp_path / "0.json").write_text('[{"a" 1}]')
    with pytest.raises(Exception, match="expected JSON with records"):
        leads.read_json_records(tiny, str(tmp_path / "0.json")).collect()


def test_empty_lists_and_other_items(tiny, tmp_path):
    for name, text in {"a": "[]", "b": " [ ] ", "c": '[null, {"n": 1}, 2, "}{", {"n": 2}, [{"n": 3}]]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert scanned(tiny, tmp_path) == {"c.json": ['{"n": 1}', '{"n": 2}']}


def test_elements_of_any_document(tiny, tmp_path):
    many = [{"type": "node", "id": i, "lat": i / 8, "lon": -i / 8, "tags": {"name": f"N{{{i}", "shop": "x]"}} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps({"version": 0.6, "osm3s": {"x": [{}]}, "remark": [{"type": "no"}], "elements": many}, indent=1))
    (tmp_path / "b.json").write_text('{"remark": [{"type": "node"}]}')
    (tmp_path / "c.json").write_text('{"elements": []}')
    (tmp_path / "d.json").write_text('{"elements": [{"id": 1}], "elements": [{"type": "way", "id": -2, "id": -3, "tags": {"name": "A", "shop": "s", "name": "B"}}]}')
    got = {r.id: r for r in osm.read_elements(tiny, str(tmp_path)).collect()}
    assert sorted(got) == [-3, *range(200)]
    assert got[-3].tags == {"name": "B", "shop": "s"} and got[7].tags == {"name": "N{7", "shop": "x]"} and got[8].lat == 1.0
    assert got[-3].type == "way"


def test_csv_rows_equal_the_one_task_reader(tiny, tmp_path, seen):
    rng, names = random.Random(5), [f"c{i}" for i in range(5)]
    parts = ['"', "\n", ",", "\r\n", "a", "é", " ", "''", '""', "b\r", "\n\n"]
    for n in range(16):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\r\n" if n % 4 == 0 else "\n", quoting=csv.QUOTE_ALL if n % 3 == 0 else csv.QUOTE_MINIMAL)
        writer.writerow(names)
        for _ in range(rng.randrange(60)):
            writer.writerow(["".join(rng.choice(parts) for _ in range(rng.randrange(5))).strip("\r") + rng.choice(["", "z"]) for _ in names])
            if rng.random() < 0.1:
                out.write("\n")
        text = out.getvalue()
        (tmp_path / f"{n}.csv").write_text(text if n % 5 else text.rstrip("\r\n"), newline="")
    (tmp_path / "loose.csv").write_text('c0,c1,c2\n5" pipe,a "b" c,x\n"q"z,"w""\n"",y"\n"two\nlines","open\nnever, closed')
    headers, rows = csv_scan.tables(tiny, str(tmp_path))
    width, got, whole = len(headers.first().names), {}, {}
    for r in rows.collect():
        got.setdefault(r.file.rpartition("/")[2], []).append([v or "" for v in r["values"]])
    schema = ", ".join(f"c{n} string" for n in range(width))
    reader = tiny.read.schema(schema).option("multiLine", True).option("header", True).option("quote", '"').option("escape", '"')
    for r in reader.csv(str(tmp_path)).select("*", "_metadata.file_name").na.fill("").collect():
        whole.setdefault(r.file_name, []).append(list(r)[:-1])
    # where lines end in \r\n, Spark's reader changes line breaks inside cells too
    for name in whole:
        if not name[0].isdigit() or int(name.split(".")[0]) % 4:
            assert sorted(got[name]) == sorted(whole[name]), name
    for file in tmp_path.glob("[0-9]*.csv"):
        with open(file, newline="") as text:
            plain = [r + [""] * (width - len(r)) for r in list(csv.reader(text))[1:] if r]
        assert sorted(got.get(file.name, [])) == sorted(plain)
    assert seen["chunk-states"].where("inside = 1").count() > 20  # borders fell inside quoted cells


def test_files_of_a_folder_have_columns_of_their_own(tiny, tmp_path):
    (tmp_path / "a.csv").write_text("name,website,phone,phone\nA,a.test,1,2\n,none.test,,\n")
    (tmp_path / "b.csv").write_text("ID,Site,Company_Name,NAME,Name,id\n9,b.test,B,no,no,7\n8,c.test\n")
    (tmp_path / "c.csv").write_text("name,website\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("Company,street\n\"E\nS\",\"x, y\"")
    got = {r.name: r for r in leads.load(tiny, str(tmp_path), fmt="csv", mapping={"address": "street"}).collect()}
    assert sorted(got) == ["A", "E\nS", "no"]
    assert (got["A"].phone, got["A"].website) == ("2", "a.test")
    assert (got["no"].source_id, got["no"].website) == ("7", "b.test")
    assert got["E\nS"].address == "x, y"
    whole = leads.load(tiny, str(tmp_path / "b.csv"), multi_line=False).collect()
    assert [(r.name, r.source_id) for r in whole] == [("no", "7")]


def test_rows_sort_as_in_the_files(tiny, tmp_path):
    names = [f"N{n} " + "x" * (n % 90) for n in range(300)]
    (tmp_path / "a.json").write_text(json.dumps({"places": [{"name": n} for n in names[:150]]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"name": n} for n in names[150:]]))
    (tmp_path / "a.csv").write_text("name,city\n" + "".join(f'{n},"a\nb"\n' for n in names))
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"name": n}) + "\n" for n in names))
    for path in ("*.json", "a.csv", "a.jsonl"):
        found = leads.load(tiny, str(tmp_path / path), order="at", fmt="json" if path == "*.json" else None)
        assert found.columns[-1] == "at" and [r.name for r in found.orderBy("at").collect()] == names, path
    with pytest.raises(ValueError):
        leads.load(tiny, str(tmp_path / "a.csv"), multi_line=False, order="at")


def test_audited_files_keep_the_order_and_clashing_columns(tiny, tmp_path):
    from shopfront.plans import lead_audit
    from shopfront.sources.fetches import FETCH_SCHEMA

    (tmp_path / "a.json").write_text(json.dumps([{"name": f"N{n}", "site": "" if n % 3 else f"s{n}.test", "id": n} for n in range(60)]))
    found = leads.load(tiny, str(tmp_path / "a.json"), order="lead_no").withColumns({"_site": F.lit("own"), "title": F.lit("own")})
    audited = lead_audit.audit_leads(found, tiny.createDataFrame([], FETCH_SCHEMA), order="lead_no")
    assert audited.columns[0] == "lead_no" and "_site" in audited.columns and "_site_" not in audited.columns
    lead_audit.write_audited(audited, str(tmp_path / "out"))
    rows = leads.read_csv_records(tiny, str(tmp_path / "out")).collect()
    assert [r.name for r in rows] == [f"N{n}" for n in range(60)]
    assert {r._site for r in rows} == {"own"} and {r.title for r in rows} == {""}
    assert all("respond" in r.problems for r in rows if r.website)
    assert {r.error for r in rows if not r.website} == {"no url given"}
