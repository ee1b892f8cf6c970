import datetime as dt

import pytest
from pyspark.sql import functions as F

from lograft.constants import MIB
from lograft.operators import catalogue, planning, requests

WHEN = dt.datetime(2024, 1, 1)
FLAGS = "struct<public:boolean,private:boolean,auto:boolean,only_gist:boolean,only_repository:boolean,"
FLAGS += "shared_repository:boolean,dry_mode:boolean,verbose:boolean,test:boolean,quick:boolean,description:string>"
SCHEMA = f"request_id bigint, owner string, path string, requested_at timestamp, cli {FLAGS}, env {FLAGS}, settings {FLAGS}"


def layer(**options):
    names = [field.split(":")[0] for field in FLAGS[len("struct<") : -1].split(",")]
    return tuple(options.get(n) for n in names)


@pytest.fixture
def asked(spark):
    def make(*specs):
        data = [
            (i, "me", s.get("path", "/f.log"), WHEN, layer(**s.get("cli", {})), layer(**s.get("env", {})), layer(**s.get("settings", {})))
            for i, s in enumerate(specs)
        ]
        return spark.createDataFrame(data, SCHEMA)

    return make


@pytest.fixture
def files(spark):
    return spark.createDataFrame(
        [("/f.log", 10), ("/big.log", 26 * MIB), ("/huge.log", 250 * MIB)], "path string, size_bytes bigint"
    )


def test_layers_in_order(asked):
    df = requests.resolve_requests(
        asked(
            {"cli": {"public": True}, "env": {"public": False}},
            {"env": {"shared_repository": False}, "settings": {"shared_repository": True}},
            {"settings": {"dry_mode": True, "description": "d"}},
            {},
        )
    )
    got = {r.request_id: r for r in df.collect()}
    assert got[0].is_public and not got[1].shared_repository and got[2].dry_mode
    assert got[2].description == "d"
    d = got[3]
    assert (d.auto, d.shared_repository, d.dry_mode, d.verbose, d.is_public, d.description) == (True, True, False, False, False, "")
    assert d.public is None and d.only_gist is None


@pytest.mark.parametrize(
    "cli, public",
    [({}, False), ({"public": True}, True), ({"private": True}, False), ({"private": False}, True), ({"public": False}, False)],
)
def test_visibility(asked, cli, public):
    assert requests.resolve_requests(asked({"cli": cli})).first().is_public is public


def test_flat_columns_count_as_first_layer(spark, asked):
    df = asked({"cli": {"public": False}}).withColumn("public", F.lit(True))
    assert requests.resolve_requests(df).first().is_public


def test_raw_maps(spark):
    df = spark.createDataFrame([({"p": "true", "dry": "no", "auto": "maybe", "d": "x", "colour": "red"},)], "raw map<string,string>")
    row = df.select(requests.typed_options(F.col("raw")).alias("o"), requests.unknown_options(F.col("raw")).alias("u")).first()
    assert (row.o.public, row.o.dry_mode, row.o.auto, row.o.description) == (True, False, None, "x")
    assert row.u == ["colour"]


@pytest.mark.parametrize(
    "spec, rules",
    [
        ({}, []),
        ({"cli": {"public": True, "private": False}}, ["public_private_conflict"]),
        ({"cli": {"only_gist": True, "only_repository": True}}, ["only_conflict"]),
        ({"cli": {"auto": False}}, ["no_auto_needs_target"]),
        ({"cli": {"auto": False, "only_gist": True}}, []),
        ({"cli": {"auto": False, "only_gist": False}}, ["no_auto_needs_target"]),
        ({"cli": {"auto": False, "test": True}, "path": None}, []),
        ({"path": None}, ["path_required"]),
        ({"path": ""}, ["path_required"]),
        ({"path": "/nonexistent/file.log"}, ["file_missing"]),
    ],
)
def test_rules(asked, files, spec, rules):
    df = requests.validate_requests(asked(spec), files)
    assert [r.rule for r in df.collect()] == rules


def test_unknown_option(asked, files):
    df = asked({}).withColumn("unknown_options", F.array(F.lit("colour")))
    assert [r.rule for r in requests.validate_requests(df, files).collect()] == ["unknown_option"]
    assert planning.plan_uploads(df, files).count() == 0


@pytest.mark.parametrize(
    "spec, expected",
    [
        ({}, ("gist", "[DRY MODE] Would create gist", "f.log.txt", None, None)),
        ({"cli": {"only_repository": True}}, ("repo", "[DRY MODE] Would upload to private-logs/log-f", None, "private-logs", "log-f")),
        (
            {"path": "/big.log", "cli": {"public": True}},
            ("repo", "[DRY MODE] Would upload to public-logs/log-big", None, "public-logs", "log-big"),
        ),
        (
            {"path": "/big.log", "cli": {"shared_repository": False}},
            ("repo", "[DRY MODE] Would create repository", None, "log-big", None),
        ),
        ({"path": "/huge.log", "cli": {"only_gist": True}}, ("gist", "[DRY MODE] Would create gist", "huge.log.txt", None, None)),
    ],
)
def test_plan(asked, files, spec, expected):
    row = planning.plan_uploads(asked(spec), files).first()
    assert (row.type, row.url, row.file_name, row.repository_name, row.repository_path) == expected
    assert (row.file_count, row.raw_url, row.deduplicated) == (1, None, False)


def test_plan_and_violations_cover_every_request(asked, files):
    df = asked({}, {"path": None}, {"path": "/no"}, {"cli": {"test": True}}, {"cli": {"public": True, "private": True}, "path": "/no"})
    planned = {r.request_id for r in planning.plan_uploads(df, files).collect()}
    invalid = {r.request_id for r in requests.validate_requests(df, files).collect()}
    assert planned == {0} and invalid == {1, 2, 4}


def test_missing_inputs(asked, files, rows):
    df = catalogue.missing_inputs(asked({}, {"path": "/no.log"}, {"path": ""}, {"path": None}), files)
    assert rows(df) == [(1, "/no.log", "File does not exist: /no.log")]
