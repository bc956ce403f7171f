"""Lead files: CSV or JSON of any shape, mapped by field name to the lead schema.

Columns are matched by name (aliases, then overrides), never by type; every value becomes
text. Only the names of the keys reach the driver, and only those that a field could use.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfront.functions import fixed
from shopfront.functions.text import any_of, mark_json_texts, number_text, quoted, unmark_json_texts
from shopfront.sources import csv_scan, json_scan

SCHEMA_FIELDS = tuple(fixed.LEAD_ALIASES)
_PROVENANCE_KEYS = ("id", "slug", "lat", "lon")


def parse_mapping(pairs: list[str] | None) -> dict[str, str]:
    """``["email=contact_email"]`` as a mapping; the first ``=`` splits."""
    mapping = {}
    for pair in pairs or []:
        field, separator, key = pair.partition("=")
        if not separator:
            raise ValueError(f"a mapping is written field=source_key, got {pair!r}")
        mapping[field] = key
    return mapping


def resolve_mapping(keys: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Schema field to source key: the override, else the first alias among the keys.

    Of keys that differ only by case the alphabetically first is taken. A wrong override gives
    an empty field, without falling back to aliases; overrides of unknown fields are ignored.
    """
    overrides = overrides or {}
    by_lower: dict[str, str] = {}
    for key in sorted(keys, reverse=True):
        by_lower[key.lower()] = key
    found = {}
    for field, aliases in fixed.LEAD_ALIASES.items():
        alias = next((a for a in aliases if a in by_lower), None)
        if field in overrides:
            found[field] = overrides[field]
        elif alias is not None:
            found[field] = by_lower[alias]
    return found


def _named_only(leads: DataFrame, *kept: str) -> DataFrame:
    """Leads without a name are dropped; a blank one counts as a name."""
    return leads.where("name <> ''").select(*fixed.LEAD_FIELDS, *kept)


#: Where a record stands in the input: rows sort by it as the files have them.
_PLACE = "struct(file, place.block AS block, place.part AS part, place.at AS at)"
_READ_AT = "struct(_metadata.file_path AS file, _metadata.file_block_start AS block, 0 AS part, monotonically_increasing_id() AS at)"


# --- tables and CSV ---------------------------------------------------------------------
def _value_text(value: str, kind: T.DataType) -> str:
    """Text of a typed value: of a list its first item, nothing of maps and objects."""
    if isinstance(kind, T.ArrayType):
        return _value_text(f"get({value}, 0)", kind.elementType)
    if isinstance(kind, (T.MapType, T.StructType)):
        return "''"
    if isinstance(kind, T.BooleanType):
        return f"coalesce(initcap(string({value})), '')"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # through its shortest text, so that a float shows no digits it does not have
        return f"coalesce({number_text(f'double(string({value}))')}, '')"
    return f"coalesce(string({value}), '')"


def from_table(
    records: DataFrame, mapping: dict[str, str] | None = None, names: list[str] | None = None
) -> DataFrame:
    """Leads from a flat table whose columns have arbitrary names, its own or ``names``.

    Of columns with the very same name the last one counts.
    """
    names = names or records.columns
    flat = records.toDF(*(f"_{at}" for at in range(len(names))))
    place = {name: f"_{at}" for at, name in enumerate(names)}
    resolved = resolve_mapping(list(place), mapping)

    def value(key: str | None) -> str:
        if key is None or key not in place:
            return "''"
        return _value_text(place[key], flat.schema[place[key]].dataType)

    source_id = next((k for k in ("id", "slug") if k in place), None)
    fields = {f: value(resolved.get(f)) for f in SCHEMA_FIELDS}
    fields |= {
        "source": "'local'",
        "source_id": value(source_id),
        "lat": value("lat"),
        "lon": value("lon"),
    }
    return _named_only(flat.selectExpr(*(f"{sql} AS {f}" for f, sql in fields.items())))


def _csv_reader(spark: SparkSession, multi_line: bool):
    return spark.read.option("multiLine", multi_line).option("quote", '"').option("escape", '"')


def csv_header(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    """The names in the first line, as they are written: repeated ones and ones that differ by case
    alone are left for the reader to tell apart."""
    first = _csv_reader(spark, multi_line).option("header", False).csv(path).limit(1).collect()
    return [name or "" for name in first[0]] if first else []


def read_csv_records(
    spark: SparkSession, path: str, multi_line: bool = True, width: int | None = None
) -> DataFrame:
    """Rows of CSV files with a header, all text, '' where empty or missing. With ``width``, so many
    columns under names of their own, for headers that Spark would rename.

    Files whose quoted cells hold no line breaks can be read with ``multi_line=False``, which
    lets Spark split each file over many tasks.
    """
    reader = _csv_reader(spark, multi_line).option("header", True)
    if width is not None:
        columns = ", ".join(f"_{at} string" for at in range(width))
        reader = reader.option("enforceSchema", True).schema(columns)
    return reader.csv(path).na.fill("")


def from_rows(
    headers: DataFrame, rows: DataFrame, mapping: dict[str, str] | None = None, order: str | None = None
) -> DataFrame:
    """Leads from ``file, place, values`` by the ``file, names`` of each file's header, so files of one folder may
    have their columns in any order. The rules are those of ``resolve_mapping``, applied to each header.
    """
    overrides = mapping or {}

    def last_place(name: str) -> str:
        """Place of the last column of that very name, null without one."""
        return f"nullif(size(names) - array_position(reverse(names), {name}), size(names))"

    def by_alias(aliases: tuple[str, ...]) -> str:
        return "coalesce(" + ", ".join(f"array_min(filter(names, n -> lower(n) = {quoted(a)}))" for a in aliases) + ")"

    def key(field: str) -> str:
        return quoted(overrides[field]) if field in overrides else by_alias(fixed.LEAD_ALIASES[field])

    places = {f: last_place(key(f)) for f in SCHEMA_FIELDS}
    places |= {"source_id": f"coalesce({last_place(quoted('id'))}, {last_place(quoted('slug'))})"}
    places |= {f: last_place(quoted(f)) for f in ("lat", "lon")}
    named = headers.selectExpr("file", "transform(names, n -> coalesce(n, '')) AS names")
    columns = named.selectExpr("file", *(f"{sql} AS _{f}" for f, sql in places.items()))
    fields = {f: f"coalesce(get(values, int(_{f})), '')" for f in places} | {"source": "'local'"}
    joined = rows.join(F.broadcast(columns), "file")  # one row a file, as in Spark's own file listing
    kept = [order] if order else []
    placed = [f"{_PLACE} AS `{order}`"] if order else []
    return _named_only(joined.selectExpr(*(f"{sql} AS {f}" for f, sql in fields.items()), *placed), *kept)


def load_csv(
    spark: SparkSession, path: str, mapping: dict[str, str] | None = None, multi_line: bool = True, order: str | None = None
) -> DataFrame:
    """Leads of CSV files. Large files are read by many tasks, also where quoted cells hold line breaks;
    ``multi_line=False`` spares looking for such cells, and takes all columns by the first file's header.
    """
    if multi_line:
        return from_rows(*csv_scan.tables(spark, path), mapping, order)
    if order:
        raise ValueError("the order of a file is known where all of its lines are read as records: multi_line=True")
    names = csv_header(spark, path, multi_line)
    if not names:
        return from_table(spark.createDataFrame([], "name string"), mapping)
    return from_table(read_csv_records(spark, path, multi_line, len(names)), mapping, names)


# --- JSON -------------------------------------------------------------------------------
@contextmanager
def repeated_keys(spark: SparkSession) -> Iterator[None]:
    """Within, expressions that parse JSON to VARIANT are built so that the last of repeated keys counts.

    The setting is part of an expression from when it is built on, and is put back before anything runs.
    """
    name = "spark.sql.variant.allowDuplicateKeys"
    earlier = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if earlier is None else spark.conf.set(name, earlier)


def _parsed(texts: DataFrame, column: str, order: str | None = None, place: str = _PLACE) -> DataFrame:
    problem = f"raise_error({quoted(json_scan.PROBLEM)})"
    placed = [f"{place} AS `{order}`"] if order else []
    with repeated_keys(texts.sparkSession):
        return texts.selectExpr(f"coalesce(try_parse_json({column}), {problem}) AS record", *placed)


def read_json_records(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Records of JSON documents of any size, one VARIANT column ``record`` per object, and where each stands in the
    input in a column ``order``.

    A document is a list of objects, or an object holding one non-empty list of objects (the
    first such in document order). Anything else is an error. Of repeated keys the last counts.
    """
    return _parsed(json_scan.records(spark, path), "text", order)


def records_of_documents(documents: DataFrame, column: str) -> DataFrame:
    """Explode JSON documents held in a text column to their records."""
    is_list = f"{column} RLIKE r'^\\s*\\['"
    # as texts, item by item, so that a list may be larger than one VARIANT can be
    marked = mark_json_texts(column)
    objects = "filter(from_json({}, 'array<string>'), i -> startswith(i, '{{'))"
    entries = f"map_entries(from_json({marked}, 'map<string,string>'))"
    # of members with one name the last one's value counts, at the first one's place
    values = f"""transform(array({entries}), es -> transform(array_distinct(transform(es, e -> e.key)),
        k -> element_at(filter(es, e -> e.key = k), -1).value))[0]"""
    wrapped = f"get(filter({values}, v -> v RLIKE r'^\\[\\s*\\{{'), 0)"
    texts = f"if({is_list}, {objects.format(marked)}, {objects.format(wrapped)})"
    problem = f"raise_error({quoted(json_scan.PROBLEM)})"
    items = documents.selectExpr(f"explode(coalesce({texts}, {problem})) AS item")
    return _parsed(items.selectExpr(f"{unmark_json_texts('item')} AS text"), "text")


def read_json_lines(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Records of JSON Lines files, which Spark can split: the form for large lists."""
    return _parsed(spark.read.text(path).where("value RLIKE r'\\S'"), "value", order, _READ_AT)


def _usable_keys(records: DataFrame) -> list[str]:
    """The keys that occur in the records and that some alias names, in whatever case."""
    wanted = {a for aliases in fixed.LEAD_ALIASES.values() for a in aliases}
    fields = records.sparkSession.tvf.variant_explode(F.col("record").outer())
    names = (
        records.lateralJoin(fields)
        .select("key")
        .where(f"lower(key) IN ({any_of(sorted(wanted))})")
        .distinct()
    )
    return sorted(r["key"] for r in names.collect())


def _path(*keys: str) -> str:
    return quoted("$" + "".join(f'["{k}"]' for k in keys))


def _as_text(value: str) -> str:
    """Text of a JSON value: '' for null and objects, ``True`` for true, whole numbers as written,
    others as doubles in their short form (``34.0`` stays ``34.0``)."""
    text = f"try_variant_get({value}, '$', 'string')"
    number = f"try_variant_get({value}, '$', 'double')"
    return f"""CASE WHEN {value} IS NULL OR is_variant_null({value}) THEN ''
        WHEN schema_of_variant({value}) LIKE 'OBJECT<%' THEN ''
        WHEN schema_of_variant({value}) = 'BOOLEAN' THEN initcap({text})
        WHEN schema_of_variant({value}) RLIKE '^(DECIMAL|DOUBLE|FLOAT)'
          THEN transform(array({number}), num -> {number_text('num')})[0]
        ELSE coalesce({text}, '') END"""


def _first_of_list(value: str) -> str:
    return f"""if(schema_of_variant({value}) LIKE 'ARRAY<%',
        try_variant_get({value}, '$[0]', 'variant'), {value})"""


def _field(key: str | None, source: str = "record") -> str:
    """Text of a record's key; of a list the first item."""
    if key is None:
        return "''"
    value = f"try_variant_get({source}, {_path(key)}, 'variant')"
    return f"""transform(array({value}), v -> transform(array({_first_of_list('v')}), w ->
        {_as_text('w')})[0])[0]"""


def _nested_contact(contact_from: str, plural: str, single: str) -> str:
    """First of ``plural``, else ``single``, in the nested contact object; '' if neither."""
    many = f"try_variant_get(record, {_path(contact_from, plural)}, 'variant')"
    one = f"try_variant_get(record, {_path(contact_from, single)}, 'variant')"

    def text(value: str) -> str:
        return f"""transform(array({value}), v ->
            transform(array({_first_of_list('v')}), w -> {_as_text('w')})[0])[0]"""

    def is_empty(value: str) -> str:
        return f"""coalesce(is_variant_null({value}) OR to_json({value}) IN
            ('""', '[]', '0', 'false', '{{}}'), true)"""

    return f"if({is_empty(many)}, if({is_empty(one)}, '', {text(one)}), {text(many)})"


def from_json_records(
    records: DataFrame, mapping: dict[str, str] | None = None, contact_from: str | None = None
) -> DataFrame:
    """Leads from VARIANT records. ``contact_from`` names a nested contact object, which
    fills an empty e-mail or phone. Columns beside ``record`` stay.
    """
    overrides = mapping or {}
    resolved = resolve_mapping(_usable_keys(records), overrides)
    fields = {f: _field(resolved.get(f)) for f in SCHEMA_FIELDS}
    if contact_from:
        for field in ("email", "phone"):
            nested = _nested_contact(contact_from, field + "s", field)
            fields[field] = f"coalesce(nullif({fields[field]}, ''), {nested})"
    has_id = f"try_variant_get(record, {_path('id')}, 'variant') IS NOT NULL"
    fields |= {
        "source": "'local'",
        "source_id": f"if({has_id}, {_field('id')}, {_field('slug')})",
        "lat": _field("lat"),
        "lon": _field("lon"),
    }
    kept = [f"`{c}`" for c in records.columns if c != "record"]
    return _named_only(records.selectExpr(*(f"{sql} AS {f}" for f, sql in fields.items()), *kept), *kept)


def load_json(
    spark: SparkSession,
    path: str,
    mapping: dict[str, str] | None = None,
    contact_from: str | None = None,
    order: str | None = None,
) -> DataFrame:
    return from_json_records(read_json_records(spark, path, order), mapping, contact_from)


def load(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    mapping: dict[str, str] | None = None,
    contact_from: str | None = None,
    multi_line: bool = True,
    order: str | None = None,
) -> DataFrame:
    """Leads from files: ``json``, ``csv`` or ``jsonl``, by suffix if not given; all are read by many tasks.

    Rows come in no order. ``order`` names a further column by which they sort as in the files, the
    files by their names. A CSV without line breaks inside cells needs less work with ``multi_line=False``.
    """
    by_suffix = {".json": "json", ".jsonl": "jsonl"}
    guessed = next((f for s, f in by_suffix.items() if path.lower().endswith(s)), "csv")
    fmt = fmt or guessed
    if fmt == "json":
        return load_json(spark, path, mapping, contact_from, order)
    if fmt == "jsonl":
        return from_json_records(read_json_lines(spark, path, order), mapping, contact_from)
    if fmt == "csv":
        return load_csv(spark, path, mapping, multi_line, order)
    raise ValueError(f"lead files are csv, json or jsonl, not {fmt!r}")
