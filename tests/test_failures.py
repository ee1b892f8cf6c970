import pytest
from pyspark.sql import functions as F

from lograft.constants import MIB
from lograft.operators import failures, summaries

ATTEMPTS = (
    "attempt_id bigint, request_id bigint, stage string, error_code string, exit_code int, "
    "message string, stdout string, stderr string"
)


@pytest.fixture
def attempts(spark):
    def make(*specs):
        names = ("stage", "error_code", "exit_code", "message", "stdout", "stderr")
        return spark.createDataFrame(
            [(i, s.get("request_id", 0), *(s.get(n) for n in names)) for i, s in enumerate(specs)], ATTEMPTS
        )

    return make


@pytest.mark.parametrize(
    "spec, label",
    [
        ({"error_code": "ENOSPC"}, "no_space"),
        ({"message": "ENOSPC: no space left on device, write"}, "no_space"),
        ({"message": "Error: No Space left on device"}, "no_space"),
        ({"stderr": "ENOSPC: x"}, "no_space"),
        ({"stderr": "fatal: no space left on device"}, "no_space"),
        ({"stderr": "GraphQL: Name already exists on this account (createRepository)"}, "name_conflict"),
        ({"stderr": "gh: Not Found (HTTP 404)"}, "not_found"),
        ({"stderr": "", "stdout": "HTTP 404"}, "not_found"),
        ({"stderr": "fatal: couldn't find remote ref main"}, "missing_ref"),
        ({"stderr": "Could not find remote branch x"}, "missing_ref"),
        ({"error_code": "EACCES", "message": "Permission denied"}, None),
        ({"message": "enospc"}, None),
        ({"stdout": "ENOSPC"}, None),
        ({"stderr": "odd", "stdout": "HTTP 404"}, None),
        ({}, None),
    ],
)
def test_labels(attempts, spec, label):
    row = failures.classify_failures(attempts(spec)).first()
    assert {name: row[name] for name in failures.LABELS} == {name: name == label for name in failures.LABELS}


@pytest.mark.parametrize(
    "spec, code, detail",
    [
        ({"exit_code": 2, "stderr": " bad \n", "stdout": "out"}, 2, "bad"),
        ({"exit_code": 2, "stderr": " \n", "stdout": "\tout"}, 2, "out"),
        ({"exit_code": 2}, 2, "Command exited with code 2"),
        ({"stderr": "warned"}, 0, None),
    ],
)
def test_detail(attempts, spec, code, detail):
    row = failures.classify_failures(attempts(spec)).first()
    assert (row.exit, row.detail) == (code, detail)


def test_child_exit_code(attempts):
    df = attempts({}, {"exit_code": 0}).withColumn("child_exit_code", F.lit(9))
    assert [r.exit for r in failures.classify_failures(df).orderBy("attempt_id").collect()] == [9, 0]


@pytest.mark.parametrize(
    "stdout, repository, gist, gist_id",
    [
        ("https://github.com/test-user/repo", "https://github.com/test-user/repo", None, None),
        ("x\r\n  https://github.com/u/one \r\nhttps://github.com/u/two", "https://github.com/u/one", None, None),
        ("https://github.com/u/r/tree/main", None, None, None),
        ("see https://github.com/u/r", None, None, None),
        ("https://github.com/u/a b", None, None, None),
        ("https://github.com/u/a b", None, None, None),
        ("\nhttps://gist.github.com/test-user/123\n", None, "https://gist.github.com/test-user/123", "123"),
        ("https://gist.github.com/", None, None, None),
        (None, None, None, None),
    ],
)
def test_urls(attempts, stdout, repository, gist, gist_id):
    row = failures.extract_urls(attempts({"stdout": stdout})).first()
    assert (row.repository_url, row.gist_url, row.gist_id) == (repository, gist, gist_id)


PLAN = (
    "request_id bigint, owner string, path string, size_bytes bigint, type string, only_gist boolean, "
    "is_public boolean, shared_repository boolean, dry_mode boolean, deduplicated boolean"
)
GIST_OK = {"stage": "gist", "exit_code": 0, "stdout": "https://gist.github.com/u/1"}
GIST_FULL = {"stage": "gist", "error_code": "ENOSPC", "message": "ENOSPC: no space left on device, copy"}
GIST_BAD = {"stage": "gist", "exit_code": 1, "stderr": " secondary rate limit\n"}
REPO_OK = {"stage": "repo", "exit_code": 0}
REPO_FULL = {"stage": "repo", "exit_code": 1, "stderr": "No space left on device"}
REPO_BAD = {"stage": "repo", "exit_code": 1, "stderr": "denied"}
SHARED = "https://github.com/me/private-logs/tree/main/log-f"


def as_planned(spark, *row):
    """A row of a plan after dedup."""
    url = F.when(F.col("type") == "repo", SHARED).otherwise("planned")
    return spark.createDataFrame([row], PLAN).withColumns(
        {
            "url": url,
            "raw_url": F.lit(None).cast("string"),
            "file_count": F.lit(1).cast("bigint"),
            "repository_name": F.when(F.col("type") == "repo", "private-logs"),
            "repository_path": F.when(F.col("type") == "repo", "log-f"),
        }
    )


@pytest.mark.parametrize(
    "planned, tries, expected",
    [
        ({}, [GIST_OK], ("gist", "created", False, "https://gist.github.com/u/1", None)),
        ({}, [GIST_OK, REPO_OK], ("gist", "created", False, "https://gist.github.com/u/1", None)),
        ({}, [GIST_FULL, REPO_OK], (None, "error", False, None, "gist upload")),
        ({"only_gist": True}, [GIST_BAD, REPO_OK], (None, "error", False, None, None)),
        ({}, [GIST_BAD, REPO_OK], ("repo", "created", True, SHARED, None)),
        ({}, [GIST_BAD, REPO_BAD], (None, "error", False, None, None)),
        ({}, [GIST_BAD, REPO_FULL], (None, "error", False, None, "repository upload (requires temp disk space)")),
        ({}, [GIST_BAD], (None, "pending", False, None, None)),
        ({}, [], (None, "pending", False, None, None)),
        ({"type": "repo"}, [REPO_OK], ("repo", "created", False, SHARED, None)),
        ({"type": "repo"}, [REPO_BAD, REPO_OK], ("repo", "created", False, SHARED, None)),
        ({"type": "repo"}, [REPO_FULL], (None, "error", False, None, "repository upload")),
        ({"type": "repo"}, [REPO_BAD], (None, "error", False, None, None)),
        ({"dry_mode": True}, [], ("gist", "would be created", False, "planned", None)),
        ({"type": "repo", "deduplicated": True}, [], ("repo", "already exists", False, SHARED, None)),
    ],
)
def test_outcomes(spark, attempts, planned, tries, expected):
    base = {"type": "gist", "only_gist": None, "dry_mode": False, "deduplicated": False, **planned}
    plan = as_planned(
        spark, 0, "me", "/f.log", 10, base["type"], base["only_gist"], False, True, base["dry_mode"], base["deduplicated"]
    )
    row = failures.resolve_outcomes(plan, attempts(*tries)).first()
    assert (row.type, row.status, row.fell_back, row.url, row.error_operation) == expected
    assert (row.error is not None) == (row.status == "error")


@pytest.mark.parametrize("size, hint", [(25 * MIB, True), (25 * MIB + 1, False)])
def test_hint_only_where_the_small_tier_would_do(spark, attempts, size, hint):
    plan = as_planned(spark, 0, "me", "/f.log", size, "repo", None, False, True, False, False)
    error = failures.resolve_outcomes(plan, attempts(REPO_FULL)).first().error
    assert error.startswith("No space left on device during repository upload. Suggestion: Free disk space and retry.")
    assert ("(25.00 MB) fits in a gist. Try --only-gist" in error) is hint


def test_result_record(spark, attempts):
    plan = as_planned(spark, 0, "me", "/f.log", 10, "repo", None, True, False, False, False).withColumn("final_name", F.lit("log-f-7"))
    row = failures.resolve_outcomes(plan, attempts(REPO_OK)).first()
    assert (row.repository_name, row.repository_path, row.url) == ("log-f-7", None, "https://github.com/me/log-f-7")
    assert (row.file_count, row.file_name, row.is_public, row.deduplicated) == (1, None, True, False)
    refused = as_planned(spark, 0, "me", "/f.log", 10, "repo", None, True, True, False, False).withColumns(
        {"action": F.lit("error"), "error": F.lit("wrong visibility")}
    )
    row = failures.resolve_outcomes(refused, attempts(REPO_OK)).first()
    assert (row.status, row.error, row.url) == ("error", "wrong visibility", None)


def test_gist_error_texts(spark, attempts):
    plan = as_planned(spark, 0, "me", "/f.log", 1, "gist", True, False, True, False, False)
    assert failures.resolve_outcomes(plan, attempts(GIST_BAD)).first().error == "Failed to create gist: secondary rate limit"
    silent = {"stage": "gist", "stdout": "nothing"}
    assert failures.resolve_outcomes(plan, attempts(silent)).first().error == "Failed to create gist: Unknown error"


def test_outcome_summary(spark, rows):
    outcomes = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("b", None)], "suite string, passed boolean")
    suites = spark.createDataFrame([("a",), ("b",), ("idle",)], "suite string")
    assert rows(summaries.outcome_summary(outcomes, suites)) == [
        ("a", 2, 0, 2, True),
        ("b", 1, 2, 3, False),
        ("idle", 0, 0, 0, True),
    ]


def test_strategy_summary(spark, rows):
    plan = spark.createDataFrame(
        [("gist", False, 1024, False, None), ("repo", True, 2048, True, 2), ("repo", False, 1024, False, 1)],
        "type string, is_public boolean, size_bytes bigint, needs_split boolean, num_chunks bigint",
    )
    total = summaries.strategy_summary(plan).where("level = 3").first()
    assert (total.n_files, total.total_bytes, total.n_split, total.n_chunks, total.readable_total) == (3, 4096, 1, 3, "4.00 KB")
    assert summaries.strategy_summary(plan).count() == 6
