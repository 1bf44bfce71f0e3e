import bisect
import csv
import gzip
import json
import random
import sqlite3
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tidemill import Adapter, Column, DatabaseSource, FileSource, Jdbc, LocalFiles, MySql, ObjectStore, PostgreSql, Sqlite
from tidemill.errors import MissingSource, SpecError
from tidemill.sources.databases import _key_and_quote, _split_field, balanced_cuts, jdbc_options, range_predicates
from tidemill.sources.ingest import ingest
from tidemill.sources.object_store import bucket_root, s3a_options, session_conf
from tidemill.sources.paths import expand_date_tokens, key_regex, literal_prefix, matching_objects, under
from tidemill.specs import column_type


def load(spark, base, path, columns=(), **options):
    return ingest(spark, Adapter("t", "c", FileSource(path, **options), tuple(columns)), LocalFiles(str(base)))


def tuples(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    "pattern, expanded",
    [
        ("in/{YYYY}/{MM}{DD}/{HH}.parquet", "in/*/*/*.parquet"),
        ("{DD}.{MM}.{YYYY} [final].csv", "*.*.* [final].csv"),
        ("{mm}{HH}", "*"),
        ("{yyyy}/{Mm}/a b.json", "{yyyy}/{Mm}/a b.json"),
        ("dump***.gz", "dump*.gz"),
    ],
)
def test_date_tokens(pattern, expanded):
    assert expand_date_tokens(pattern) == expanded


def test_base_path():
    assert under("/data/", "a.csv") == "/data/a.csv"
    assert under("/data", "/other/a.csv") == "/other/a.csv"


def test_csv_with_header_and_types(spark, tmp_path):
    (tmp_path / "users.csv").write_text("id,name,created_at\n1,Ann,2024-01-15\n2,,2024-01-16\n")
    df = load(spark, tmp_path, "users.csv")
    assert tuples(df) == [(1, "Ann", date(2024, 1, 15)), (2, None, date(2024, 1, 16))]


def test_csv_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1|x|NA\n2|NA|3.5\n")
    df = load(spark, tmp_path, "a.csv", has_header=False, delimiter="|", null_value="NA")
    assert df.columns == ["column0", "column1", "column2"]
    assert df.orderBy("column0").collect() == [(1, "x", None), (2, None, 3.5)]


@pytest.mark.parametrize("delimiter", [",", "|", ";", "\t"])
def test_csv_delimiter_is_found_if_asked_for(spark, tmp_path, delimiter):
    rows = [["id", "text"], ["1", "a, b"], ["2", 'say "x; y" | z']]
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out, delimiter=delimiter, quoting=csv.QUOTE_ALL).writerows(rows)
    assert tuples(load(spark, tmp_path, "a.csv", delimiter="auto")) == [(1, "a, b"), (2, 'say "x; y" | z')]


def test_a_delimiter_must_fit_all_lines(spark, tmp_path):
    (tmp_path / "titled.csv").write_text("All our boats\n" + "".join(f"{i};x\n" for i in range(50)))
    (tmp_path / "other.csv").write_text("".join(f"{i},y\n" for i in range(50)))
    (tmp_path / "both.csv").write_text("a;b|c\n1;2|3\n")
    for name in ("titled.csv", "*.csv", "both.csv"):
        with pytest.raises(SpecError, match="delimiter"):
            load(spark, tmp_path, name, delimiter="auto")
    (tmp_path / "single.csv").write_text("id\n\n7\n")
    assert tuples(load(spark, tmp_path, "single.csv", delimiter="auto")) == [(7,)]
    assert load(spark, tmp_path, "titled.csv").columns == ["All our boats"]


def test_listed_files_are_names_and_must_be_there(spark, tmp_path):
    for name in ("b[1].csv", "b1.csv", "b*.csv", "{b}?.csv"):
        (tmp_path / name).write_text(f"name\n{name}\n")
    assert tuples(load(spark, tmp_path, ("b[1].csv", "{b}?.csv"))) == [("b[1].csv",), ("{b}?.csv",)]
    assert tuples(load(spark, tmp_path, ("b*.csv",))) == [("b*.csv",)]
    with pytest.raises(MissingSource):
        load(spark, tmp_path, ("b1.csv", "gone.csv"))


def test_hours_that_come_twice_stay_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"at": "2024-11-03T05:30:00Z"}\n{"at": "2024-11-03T06:30:00Z"}\n')
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = load(spark, tmp_path, "a.json", [Column("at", "TIMESTAMP")], format="json").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(r.at.hour for r in rows) == [5, 6]


def test_declared_parquet_columns_keep_dots_and_comments(spark, tmp_path):
    spark.sql("SELECT 1 AS `a.b`, 2 AS c").write.parquet(str(tmp_path / "p"))
    df = load(spark, tmp_path, "p", [Column("a.b", "BIGINT", "dotted"), Column("c", "INTEGER")], format="parquet")
    assert df.collect() == [(1, 2)] and df.schema["a.b"].metadata == {"comment": "dotted"}


def test_a_folder_of_compressed_files(spark, tmp_path):
    spark.range(4).write.options(header=True, compression="gzip").csv(str(tmp_path / "zipped"))
    assert load(spark, tmp_path, "zipped", compression="gzip").count() == 4


def test_csv_of_one_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n2\n")
    assert tuples(load(spark, tmp_path, "a.csv")) == [(1,), (2,)]


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n')
    assert tuples(load(spark, tmp_path, "a.csv", delimiter=",", multi_line=True)) == [(1, "two\nlines"), (2, "plain")]


def test_csv_timestamps_are_wall_clock(spark, tmp_path):
    (tmp_path / "a.csv").write_text("at\n2024-03-01 10:15:00\n")
    df = load(spark, tmp_path, "a.csv")
    assert df.schema["at"].dataType == T.TimestampNTZType()
    assert df.first().at == datetime(2024, 3, 1, 10, 15)


def test_declared_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "amount": 12.5, "at": "2024-03-01T10:15:00Z", "day": "2024-03-01"}\n')
    columns = [Column("id", "BIGINT"), Column("amount", "decimal", "paid"), Column("at", "Datetime"), Column("day", "DATE")]
    df = load(spark, tmp_path, "a.json", columns, format="json")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "decimal(18,3)", "timestamp_ntz", "date"]
    assert df.schema["amount"].metadata == {"comment": "paid"}
    assert tuples(df) == [(1, Decimal("12.500"), datetime(2024, 3, 1, 10, 15), date(2024, 3, 1))]


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_timestamps_with_and_without_zone(spark, tmp_path, session_zone):
    texts = ["2024-03-01T10:15:00Z", "2024-03-01T10:15:00+09:00", "2024-03-01 10:15:00.5", "2024-03-01", None]
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"at": t}) for t in texts))
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        rows = load(spark, tmp_path, "a.json", [Column("at", "TIMESTAMP")], format="json").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    day = lambda *time: datetime(2024, 3, 1, *time)
    assert [r.at for r in rows] == [day(10, 15), day(1, 15), day(10, 15, 0, 500000), day(), None]


def test_declared_csv_columns_must_match_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception):
        load(spark, tmp_path, "a.csv", [Column("a", "INTEGER"), Column("b", "INTEGER")]).collect()


@pytest.mark.parametrize("name, type_", [("INTEGER", "int"), ("varchar", "string"), ("DECIMAL(10, 2)", "decimal(10,2)"), ("float", "float"), ("DateTime", "timestamp_ntz"), ("HUGEINT", "decimal(38,0)")])
def test_declared_types(name, type_):
    assert column_type(name).simpleString() == type_


def test_unknown_declared_type():
    with pytest.raises(SpecError):
        column_type("shape")


def test_json_lines_arrays_and_a_mixture(spark, tmp_path):
    rows = [{"id": i, "v": f"x{i}"} for i in range(6)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows[:2])))
    (tmp_path / "array.json").write_text("\n [\n" + ",\n".join(json.dumps(r, indent=1) for r in rows[2:4]) + "\n]\n")
    with gzip.open(tmp_path / "one.json.gz", "wt") as out:
        out.write(json.dumps(rows[4:]))
    want = [(r["id"], r["v"]) for r in rows]
    assert tuples(load(spark, tmp_path, "lines.json", format="json")) == want[:2]
    assert tuples(load(spark, tmp_path, "array.json", format="json")) == want[2:4]
    assert tuples(load(spark, tmp_path, "*", format="json")) == want
    assert tuples(load(spark, tmp_path, "lines.json", format="json", layout="lines")) == want[:2]


def test_json_layout_through_the_text_reader(spark, tmp_path, monkeypatch):
    from tidemill.sources import json_layout

    (tmp_path / "a b.json").write_text('\n\n{"id": 1}\n{"id": 2}\n')
    (tmp_path / "c.json").write_text('[\n{"id": 3}\n]')
    rows = json_layout._first_characters(spark, str(tmp_path), {}).collect()
    assert sorted(r.first for r in rows) == ["[", "{"]
    assert tuples(load(spark, tmp_path, "*.json", format="json")) == [(1,), (2,), (3,)]


def test_globs_parquet_and_gzip(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p" / "part_1"))
    spark.range(3, 5).write.parquet(str(tmp_path / "p" / "part_2"))
    assert tuples(load(spark, tmp_path, "p/part_?", format="parquet")) == [(i,) for i in range(5)]
    with gzip.open(tmp_path / "2024_01.csv.gz", "wt") as out:
        out.write("id\n1\n")
    assert tuples(load(spark, tmp_path, "{YYYY}_{MM}.csv.gz", compression="gzip")) == [(1,)]
    with pytest.raises(SpecError):
        load(spark, tmp_path, "plain.csv", compression="gzip")


@pytest.mark.parametrize("format_", ["csv", "json", "parquet"])
def test_no_match_is_no_error(spark, tmp_path, format_):
    assert load(spark, tmp_path, "none_*", format=format_) is None
    assert load(spark, tmp_path, "none.x", format=format_) is None


def test_wrong_declarations(spark, tmp_path):
    with pytest.raises(SpecError):
        load(spark, tmp_path, "a.xml", format="xml")
    with pytest.raises(SpecError):
        ingest(spark, Adapter("t", "c", DatabaseSource("x")), LocalFiles("/"))
    with pytest.raises(SpecError):
        ingest(spark, Adapter("t", "c", FileSource("x")), Sqlite("/x.db"))


@pytest.fixture
def shop(tmp_path):
    path = str(tmp_path / "shop.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE products (id INTEGER PRIMARY KEY, name TEXT, price DECIMAL(10,2), rate REAL, made DATE, at DATETIME, raw BLOB, ok BOOLEAN)")
    db.executemany(
        "INSERT INTO products VALUES (?,?,?,?,?,?,?,?)",
        [(i * 7, f"p{i}", f"{i}.25", i / 2, "2024-01-02", "2024-01-02 03:04:05", bytes([i % 250]), i % 2) for i in range(1, 1001)] + [(9000, None, None, None, None, None, None, None)],
    )
    db.execute('CREATE TABLE "empty one" (id INTEGER)')
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    db.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
    db.commit()
    db.close()
    return path


def test_sqlite_table_in_ranges(spark, shop, monkeypatch):
    from tidemill.sources import sqlite

    df = ingest(spark, Adapter("p", "c", DatabaseSource("products")), Sqlite(shop))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "decimal(10,2)", "double", "date", "timestamp_ntz", "binary", "boolean"]
    rows = tuples(df.where("id in (7, 9000)"))
    assert rows == [(7, "p1", Decimal("1.25"), 0.5, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), b"\x01", True), (9000, *[None] * 7)]
    reader = sqlite.SqliteReader(df.schema, {"files": json.dumps([shop]), "table": "products", "rowsPerPartition": "1000"})
    assert len(reader.partitions()) == 9
    reader.step = 1
    wide = sqlite3.connect(shop)
    wide.execute("INSERT INTO products (id) VALUES (2000000000000)")
    wide.commit()
    wide.close()
    assert len(reader.partitions()) <= sqlite.MAX_PARTITIONS
    assert sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part)) == 1002
    assert ingest(spark, Adapter("p", "c", DatabaseSource("products")), Sqlite(shop)).count() == 1002


def test_sqlite_empty_missing_and_without_rowid(spark, shop):
    read = lambda table: ingest(spark, Adapter("p", "c", DatabaseSource(table)), Sqlite(shop))
    assert read("empty one").count() == 0
    assert tuples(read("keyed")) == [("a", 1), ("b", 2)]
    with pytest.raises(MissingSource):
        read("nothing")


def test_jdbc_through_an_embedded_database(spark):
    url = "jdbc:derby:memory:tidemill;create=true"
    connection = Jdbc(url, "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    spark.range(100).selectExpr("id", "cast(id * 2 as int) as twice").write.format("jdbc").options(**jdbc_options(connection), dbtable="NUMBERS").save()
    plain = ingest(spark, Adapter("n", "c", DatabaseSource("NUMBERS")), connection)
    split = ingest(spark, Adapter("n", "c", DatabaseSource("NUMBERS", '"id"', 5)), connection)
    assert tuples(plain) == tuples(split) == [(i, 2 * i) for i in range(100)]
    assert split.rdd.getNumPartitions() == 5
    with pytest.raises(MissingSource):
        ingest(spark, Adapter("n", "c", DatabaseSource("NOTHING")), connection)


def test_jdbc_parts_are_balanced_without_a_declared_column(spark):
    connection = Jdbc("jdbc:derby:memory:tidemill;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    # Two far clusters of keys, a busy value and nulls: equal ranges would put nearly all rows into one part.
    keys = [*range(-300, -100), *range(10**15, 10**15 + 200), *[7] * 100, *[None] * 20]
    rows = spark.createDataFrame([(f"r{i}", k) for i, k in enumerate(keys)], "name string, k bigint").coalesce(1)
    rows.write.format("jdbc").options(**jdbc_options(connection), dbtable="SKEWED").save()
    split = ingest(spark, Adapter("s", "c", DatabaseSource("SKEWED", partitions=10)), connection)
    assert sorted(r.name for r in split.collect()) == sorted(r.name for r in rows.collect())
    sizes = [len(part) for part in split.rdd.glom().collect()]
    assert len(sizes) >= 8 and max(sizes) == 100 and sorted(sizes)[-2] <= 70
    empty = rows.limit(0)
    empty.write.format("jdbc").options(**jdbc_options(connection), dbtable="NO_ROWS").save()
    assert ingest(spark, Adapter("s", "c", DatabaseSource("NO_ROWS")), connection).count() == 0


def test_jdbc_splits_by_the_primary_key(spark):
    url = "jdbc:derby:memory:tidemill;create=true"
    connection = Jdbc(url, "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    spark.range(1).write.format("jdbc").options(**jdbc_options(connection), dbtable="FIRST_USE").save()
    own = spark._jvm.java.sql.DriverManager.getConnection(url)
    own.createStatement().execute("CREATE TABLE keyed (kind INT, id BIGINT NOT NULL PRIMARY KEY)")
    own.close()
    assert _key_and_quote(spark, jdbc_options(connection), "keyed") == ({"ID"}, '"')
    rows = spark.range(90).selectExpr("1 AS KIND", "id AS ID")
    rows.write.format("jdbc").mode("append").options(**jdbc_options(connection), dbtable="keyed").save()
    split = ingest(spark, Adapter("k", "c", DatabaseSource("keyed", partitions=9)), connection)
    assert sorted(len(part) for part in split.rdd.glom().collect()) == [10] * 9
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("day", T.DateType())])
    assert _split_field("jdbc:mysql://h", {"day"}, schema).name == "day" and _split_field("jdbc:derby:x", {"day"}, schema) is None


def test_cuts_need_no_values_between():
    class Probe:
        def __init__(self, values):
            self.values = values

        def bounds(self):
            return min(self.values, default=None), max(self.values, default=None), len(self.values)

        def counts(self, low, high, width):
            return Counter((v - low) // width for v in self.values if low <= v <= high)

    rng = random.Random(4)
    for values in ([], [5], [5] * 50, [2**62, -(2**62)] * 20, [rng.randint(0, 9) ** 20 for _ in range(500)], list(range(1000))):
        cuts = balanced_cuts(Probe(values), 8)
        assert cuts == sorted(set(cuts)) and len(cuts) < 16
        sizes = Counter(bisect.bisect_right(cuts, v) for v in values)
        busiest = max(Counter(values).values(), default=0)
        assert max(sizes.values(), default=0) <= max(-(-len(values) // 8), busiest)
    assert range_predicates("k", [3, 9]) == ["k < 3", "k >= 3 AND k < 9", "k >= 9 OR k IS NULL"] and range_predicates("k", []) == []


def test_jdbc_urls():
    assert jdbc_options(MySql("h", 3306, "d", "u", "p"))["url"] == "jdbc:mysql://h:3306/d"
    options = jdbc_options(PostgreSql("h", 5432, "d", "u", "p"))
    assert (options["url"], options["user"], options["password"]) == ("jdbc:postgresql://h:5432/d", "u", "p")


def test_object_store_options():
    plain = s3a_options(ObjectStore("b", access_key_id="k", secret_access_key="s", endpoint_url="http://store:9000", path_style_access=True))
    assert plain["fs.s3a.bucket.b.endpoint"] == "store:9000"
    assert plain["fs.s3a.bucket.b.connection.ssl.enabled"] == "false"
    assert plain["fs.s3a.bucket.b.path.style.access"] == "true"
    assert plain["fs.s3a.bucket.b.access.key"] == "k"
    token = s3a_options(ObjectStore("b", access_key_id="k", secret_access_key="s", session_token="t"))
    assert token["fs.s3a.bucket.b.session.token"] == "t" and "Temporary" in token["fs.s3a.bucket.b.aws.credentials.provider"]
    assert session_conf(ObjectStore("b", region="eu-west-1"))["spark.hadoop.fs.s3a.bucket.b.endpoint.region"] == "eu-west-1"
    assert bucket_root(ObjectStore("b")) == "s3a://b"
    chain = s3a_options(ObjectStore("b", auth_method="credential_chain"))
    assert "fs.s3a.bucket.b.access.key" not in chain and "fs.s3a.bucket.b.endpoint" not in chain


def test_object_listing_crosses_folders(spark, tmp_path):
    keys = ["raw/2024/01/a.parquet", "raw/2024/b.parquet", "raw/2024 old/x[1].parquet", "raw/readme", "_hidden/z.parquet", "tail'd.parquet"]
    for key in keys:
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(b"x")
    found = lambda pattern: sorted(r.path.split(str(tmp_path) + "/")[1] for r in matching_objects(spark, str(tmp_path), pattern, {}).collect())
    assert found("*.parquet") == sorted(k for k in keys if k.endswith("parquet") and not k.startswith("_"))
    assert found("raw/2024/*") == ["raw/2024/01/a.parquet", "raw/2024/b.parquet"]
    assert found("raw/*[1]*") == ["raw/2024 old/x[1].parquet"]
    assert found("raw/????/b.*") == ["raw/2024/b.parquet"]
    assert found("raw/readme") == ["raw/readme"]
    assert literal_prefix("p/q/r?/s") == "p/q" and literal_prefix("file") == ""
    assert key_regex("(x)?.*") == r"^\(x\).\..*$"
