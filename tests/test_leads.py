import json

import pytest

from shopfront.functions import fixed
from shopfront.sources import leads, sinks


def rows(table):
    return [r.asDict() for r in table.collect()]


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_aliases_are_tried_in_order_and_ignore_case():
    found = leads.resolve_mapping(["URL", "Title", "Business_Name", "tel", "other", "site"])
    assert found == {"name": "Business_Name", "website": "URL", "phone": "tel"}
    overridden = leads.resolve_mapping(["name", "mail"], {"email": "wrong", "bogus": "x"})
    assert overridden == {"name": "name", "email": "wrong"}
    assert leads.resolve_mapping(["NAME", "Name", "name"]) == {"name": "NAME"}
    assert leads.parse_mapping(["a=b=c", "d="]) == {"a": "b=c", "d": ""}
    with pytest.raises(ValueError):
        leads.parse_mapping(["nothing"])


def test_wrapped_json_with_nested_contact(spark, tmp_path):
    document = {
        "meta": [1, 2], "empty": [], "zoo": [
            {"name": "Corner Bakery", "website": "https://corner.test", "sector": "bakery", "id": 7,
             "contact": {"emails": ["a@corner.test", "b@corner.test"], "phones": ["+1 2"]},
             "lat": 33.5, "lon": -1, "city": ["Tyre", "Sidon"], "country": {"code": "LB"}},
            {"name": "Blank Site", "website": "", "contact": {"emails": [], "email": "c@d.test"},
             "slug": "blank", "active": True, "phone": 961123},
            {"name": "", "website": "https://nameless.test"},
            {"name": " ", "email": "own@x.test", "contact": {"emails": ["no@x.test"]}},
            {"name": None}, {"name": True, "contact": "text"},
        ],
        "after": [{"name": "not this list"}],
    }
    path = write(tmp_path, "list.JSON", json.dumps(document, indent=1))
    got = rows(leads.load(spark, path, contact_from="contact"))
    assert [r["name"] for r in got] == ["Corner Bakery", "Blank Site", " ", "True"]
    assert list(got[0]) == list(fixed.LEAD_FIELDS)
    assert got[0] | {} == {
        "name": "Corner Bakery", "website": "https://corner.test", "phone": "+1 2",
        "email": "a@corner.test", "address": "", "city": "Tyre", "country": "",
        "category": "bakery", "source": "local", "source_id": "7", "lat": "33.5", "lon": "-1",
    }
    assert (got[1]["email"], got[1]["phone"], got[1]["source_id"]) == ("c@d.test", "961123", "blank")
    assert got[2]["email"] == "own@x.test"
    without = rows(leads.load(spark, path))
    assert without[0]["email"] == ""


def test_bare_list_lines_and_errors(spark, tmp_path):
    bare = write(tmp_path, "bare.json", '[{"company": "A", "web": "a.test"}, {"company": "B"}]')
    got = rows(leads.load(spark, bare))
    assert [(r["name"], r["website"]) for r in got] == [("A", "a.test"), ("B", "")]
    lines = write(tmp_path, "many.jsonl", '{"name": "A", "id": "x"}\n{"name": "B", "mail": "m"}\n')
    got = rows(leads.load(spark, lines, mapping={"category": "id"}))
    assert [(r["name"], r["email"], r["category"]) for r in got] == [("A", "", "x"), ("B", "m", "")]
    assert rows(leads.load(spark, write(tmp_path, "none.json", "[]"))) == []
    with pytest.raises(Exception, match="expected JSON with records"):
        leads.load(spark, write(tmp_path, "bad.json", '{"a": [1], "b": 2}')).collect()
    with pytest.raises(ValueError):
        leads.load(spark, bare, fmt="xml")


def test_csv_with_aliases_overrides_and_quotes(spark, tmp_path):
    text = (
        "company_name,Homepage,contact_email,street_address,city,sector,lat\n"
        '"Gym, ""North""",https://gym.test,,"Main\nStreet 1",Beirut,gym,33.10\n'
        "Estate,,info@estate.test,,Jounieh\n"
        ",https://nameless.test,,,,,\n"
        " padded ,x,,,,,\n"
    )
    path = write(tmp_path, "clients.csv", text)
    got = rows(leads.load(spark, path, mapping={"name": "company_name", "phone": "missing"}))
    assert [r["name"] for r in got] == ['Gym, "North"', "Estate", " padded "]
    assert got[0]["address"] == "Main\nStreet 1"
    assert (got[0]["website"], got[0]["lat"], got[0]["phone"]) == ("https://gym.test", "33.10", "")
    assert (got[1]["email"], got[1]["category"]) == ("info@estate.test", "")
    assert rows(leads.load(spark, path)) == []
    empty = write(tmp_path, "empty.csv", "name,website\n")
    assert rows(leads.load(spark, empty)) == []


def test_lead_sink_round_trip(spark, tmp_path):
    table = spark.createDataFrame(
        [('a "q", b', " x ", None, "dropped")], "name string, website string, phone string, extra string"
    ).coalesce(1)
    out = str(tmp_path / "leads")
    sinks.write_leads(table, out)
    text = "".join(p.read_text() for p in (tmp_path / "leads").glob("part-*"))
    assert text.splitlines() == [",".join(fixed.LEAD_FIELDS), '"a ""q"", b", x ,,,,,,,,,,']
    back = rows(leads.read_csv_records(spark, out))
    assert back[0]["name"] == 'a "q", b' and back[0]["website"] == " x " and back[0]["lat"] == ""


def test_merged_columns():
    merged = sinks.merged_fields(["name", "website", "title", "emails"])
    assert merged[:4] == ["name", "website", "title", "emails"]
    assert merged.count("title") == 1 and set(fixed.AUDIT_FIELDS) <= set(merged)


def test_headers_as_people_write_them(spark, tmp_path):
    path = write(tmp_path, "twice.csv", "name,phone,phone\nA,1,2\n")
    assert [(r["name"], r["phone"]) for r in rows(leads.load(spark, path))] == [("A", "2")]
    path = write(tmp_path, "cases.csv", "Name,name,website\nX,y,z.test\n")
    assert [(r["name"], r["website"]) for r in rows(leads.load(spark, path))] == [("X", "z.test")]
    path = write(tmp_path, "many.csv", "name,website\nA,a.test\nB,b.test\n")
    assert [r["name"] for r in rows(leads.load(spark, path, multi_line=False))] == ["A", "B"]


def test_override_values_are_no_keys(spark, tmp_path):
    path = write(tmp_path, "o.json", '[{"name": "A", "homepage": "a.test"}]')
    got = rows(leads.load(spark, path, mapping={"category": "url"}))
    assert [(r["name"], r["website"], r["category"]) for r in got] == [("A", "a.test", "")]
    assert len(rows(leads.load(spark, path, mapping={"category": "Name"}))) == 1


def test_numbers_keep_their_form(spark, tmp_path):
    path = write(tmp_path, "n.json", '[{"name": "A", "phone": 96170.0, "lat": 34.0, "lon": 1e-7, "id": 12}]')
    got = rows(leads.load(spark, path))[0]
    assert (got["phone"], got["lat"], got["lon"], got["source_id"]) == ("96170.0", "34.0", "1e-07", "12")
    table = spark.sql("SELECT 'A' AS name, array('p1', 'p2') AS phone, map('k', 'v') AS email, 12345678.5D AS lat, 0.0005D AS lon")
    got = rows(leads.from_table(table))[0]
    assert (got["phone"], got["email"], got["lat"], got["lon"]) == ("p1", "", "12345678.5", "0.0005")


def test_names_that_differ_by_case_are_written(spark, tmp_path):
    from shopfront.plans import lead_audit

    table = spark.createDataFrame([(0, "a", "b")], "n long, Title string, url string").toDF("lead_no_", "Title", "title")
    out = str(tmp_path / "cases")
    lead_audit.write_audited(table, out)
    assert "".join(p.read_text() for p in (tmp_path / "cases").glob("part-*")).splitlines() == ["Title,title", "a,b"]
    assert lead_audit.free_name(["name", "Lead_No"]) == "lead_no_"
