import datetime as dt

import pytest

from lograft.operators import changelog, changesets, notes

PKG = "my-pkg"
T = dt.datetime(2024, 1, 1)


def record(bump="patch", text="Some text", quote="'"):
    return f"---\n{quote}{PKG}{quote}: {bump}\n---\n\n{text}\n"


@pytest.mark.parametrize(
    "content, strict, bump, description",
    [
        (record("major"), False, "major", "Some text"),
        (record("minor", quote='"'), True, "minor", "Some text"),
        (record(quote=""), False, "patch", "Some text"),
        (record(quote=""), True, None, None),
        (record("huge"), False, None, None),
        (f"---\n'{PKG}': patch\nno end", False, "patch", ""),
        (record(text=" \t\n "), False, "patch", ""),
        (record(text="a\n---\nb"), False, "patch", "a\n---\nb"),
        (f"---\n'other': major\n'{PKG}':   minor\n---\nx", False, "minor", "x"),
        (f"---\n x'{PKG}': minor\n---\nx", False, None, None),
        (f"'{PKG}': minor---a--- b ", False, "minor", "b"),
        (f"--- '{PKG}': minor\n---\nx", False, "minor", "x"),
        (f"---\u0085'{PKG}': minor\n---\nx", False, None, None),
    ],
)
def test_parse(spark, content, strict, bump, description):
    df = spark.createDataFrame([("f.md", content)], "file string, content string")
    row = changesets.parse_changesets(df, PKG, strict).first()
    assert (row.bump, row.description) == (bump, description)


def test_package_names_are_literal(spark):
    df = spark.createDataFrame([("'myxpkg': patch",), ("'my.pkg': patch",)], "content string")
    got = [r.bump for r in changesets.parse_changesets(df, "my.pkg").collect()]
    assert got == [None, "patch"]


@pytest.fixture
def batches(spark):
    data = [
        ("two", "b.md", T, record("patch", "second by name")),
        ("two", "a.md", T, record("minor", "first by name")),
        ("two", "z.md", T - dt.timedelta(seconds=1), record("patch", "oldest")),
        ("two", "e.md", T, record("patch", "")),
        ("one", "a.md", T, record("major")),
        ("bad", "a.md", T, "x"),
        ("bad", "b.md", T, "y"),
        ("half", "a.md", T, "x"),
        ("half", "b.md", T, record("patch", "only")),
    ]
    return spark.createDataFrame(data, "batch string, file string, mtime timestamp, content string")


def test_merge(batches):
    got = {r.batch: r for r in changesets.merge_changesets(batches, PKG).collect()}
    assert {b: r.action for b, r in got.items()} == {"two": "merged", "one": "none", "bad": "error", "half": "merged"}
    assert got["two"].bump == "minor" and got["two"].n_descriptions == 3


def test_merged_records_come_in_pieces(batches):
    pieces = changesets.merged_entries(batches, PKG).orderBy("batch", "piece", "mtime", "file").collect()
    texts = {b: "".join(r.text for r in pieces if r.batch == b) for b in {r.batch for r in pieces}}
    assert texts == {
        "two": f"---\n'{PKG}': minor\n---\n\noldest\n\nfirst by name\n\nsecond by name\n",
        "half": record("patch", "only"),
    }


def test_manual_record(spark):
    df = spark.createDataFrame([("patch", "text"), ("minor", ""), ("major", None)], "bump string, description string")
    got = [r.content for r in changesets.manual_changeset(df, PKG).collect()]
    assert got == [record("patch", "text"), record("minor", "Manual minor release"), record("major", "Manual major release")]


def test_gate(spark):
    prs = spark.createDataFrame([(i,) for i in range(1, 10)], "pr_id bigint")
    diff = spark.createDataFrame(
        [
            (1, "A", ".changeset/ok.md"), (1, "M", ".changeset/other.md"), (1, "A", "src/x.md"),
            (2, "A", ".changeset/ok.md"), (2, "A", ".changeset/empty.md"),
            (3, "A", ".changeset/README.md"), (3, "R100", ".changeset/ok.md"), (3, "A", ".changeset/x.txt"),
            (4, "A", ".changeset/unquoted.md"), (5, "A", ".changeset/short.md"), (6, "A", ".changeset/empty.md"),
            (7, "A", ".changeset/gone.md"), (8, "A", ".changeset/MY-README.md"),
        ],
        "pr_id bigint, status string, path string",
    )
    records = spark.createDataFrame(
        [("ok.md", record("minor")), ("empty.md", record(text=" ")), ("unquoted.md", record(quote="")), ("short.md", f"'{PKG}': patch")],
        "file string, content string",
    )
    got = {r.pr_id: (r.n_added, r.verdict, r.bump) for r in changesets.changeset_gate(prs, diff, records, PKG).collect()}
    assert got == {
        1: (1, "valid", "minor"),
        2: (2, "multiple", None),
        3: (0, "none", None),
        4: (1, "missing_type", None),
        5: (1, "missing_description", None),
        6: (1, "empty_description", None),
        7: (1, "unreadable", None),
        8: (0, "none", None),
        9: (0, "none", None),
    }
    names = spark.createDataFrame([("README.md",), ("MY-README.md",), ("a.md",), ("a.txt",)], "file string")
    assert {r.file for r in changesets.listed_changesets(names).collect()} == {"MY-README.md", "a.md"}


LOG = "# pkg\n\n## 0.8.20\n\n### Patch Changes\n\n- new\n\n## 0.8.2\n\n### Minor Changes\n\n- old\n  ## 3 indented\n\n## Next\n\ntext\n"


def test_sections(spark, rows):
    df = spark.createDataFrame([(1, LOG), (2, "# nothing"), (3, "## 1.0.0\n")], "doc_id bigint, body string")
    assert rows(changelog.explode_changelog(df)) == [
        (1, 0, "0.8.20", "### Patch Changes\n\n- new"),
        (1, 1, "0.8.2", "### Minor Changes\n\n- old\n  ## 3 indented\n\n## Next\n\ntext"),
        (3, 0, "1.0.0", ""),
    ]


@pytest.mark.parametrize(
    "version, exact, legacy",
    [
        ("0.8.20", "### Patch Changes\n\n- new", "### Patch Changes\n\n- new"),
        ("0.8.2", "### Minor Changes\n\n- old\n  ## 3 indented\n\n## Next\n\ntext", "0\n\n### Patch Changes\n\n- new"),
        ("9.9.9", "Release 9.9.9", "Release 9.9.9"),
    ],
)
def test_release_notes(spark, version, exact, legacy):
    logs = spark.createDataFrame([(1, LOG)], "doc_id bigint, body string")
    wanted = spark.createDataFrame([(1, version)], "doc_id bigint, version string")
    assert changelog.release_notes(logs, wanted).first().notes == exact
    assert changelog.release_notes(logs, wanted, legacy=True).first().notes == legacy


@pytest.mark.parametrize(
    "body, expected",
    [
        ("# pkg\n\n## 1.0.0\nx", "# pkg\n\nENTRY## 1.0.0\nx"),
        ("# pkg\n\ntext", "# pkg\n\nENTRY\n\ntext"),
        ("intro\n# pkg", "intro\n# pkg\n\nENTRY"),
        ("text ## 1", "ENTRY\ntext ## 1"),
        ("", "ENTRY\n"),
    ],
)
def test_prepend(spark, body, expected):
    df = spark.createDataFrame([(body, "1.1.0", "minor", "done")], "body string, version string, bump string, description string")
    entry = "## 1.1.0\n\n### Minor Changes\n\n- done\n\n"
    assert changelog.prepend_entries(df).first().body == expected.replace("ENTRY", entry)


@pytest.mark.parametrize("version", ["1.0(", "1.0[", "1.0)", "a{", "1\\", "1.**"])
def test_a_version_that_is_no_pattern_falls_back(spark, version):
    logs = spark.createDataFrame([(1, "## 1.0\n\n- x")], "doc_id bigint, body string")
    wanted = spark.createDataFrame([(1, version), (1, "1.0")], "doc_id bigint, version string")
    got = {r.version: r.notes for r in changelog.release_notes(logs, wanted, legacy=True).collect()}
    assert got == {version: f"Release {version}", "1.0": "- x"}


HEAD = "### Patch Changes\n\n- "


@pytest.mark.parametrize(
    "body, commit, description",
    [
        (HEAD + "abc1234: Fix it", "abc1234", "Fix it"),
        (HEAD + "Fix it", None, "Fix it"),
        (HEAD + "add: x", "add", "x"),
        (HEAD + "fix: x", None, "fix: x"),
        ("### Major Changes  \n\n  -   one\n- two", None, "one\n- two"),
        (HEAD + r"a\nb\n\n\n\nc", None, "a\nb\n\nc"),
        (HEAD + "\\'\\\"text'\"", None, "text"),
        (HEAD + "\"'text", None, "text"),
        (HEAD + "text'\n", None, "text'"),
        (HEAD + "text \U0001f4e6 npm\nmore", None, "text"),
        (HEAD + "text\n---\nmore", None, "text"),
        (HEAD + " a \n\t b \n", None, "a\nb"),
        (HEAD + "a\n\n### Minor Changes\n\n- b", None, "a\n\n### Minor Changes\n\n- b"),
    ],
)
def test_cleaning(spark, body, commit, description):
    releases = spark.createDataFrame([(1, "v1.2.3", "passed", body)], "release_id bigint, version string, commit_sha string, body string")
    pulls = spark.createDataFrame(
        [(c, 2, 12, "feat") for c in ("passed", commit) if c] + [(c, 1, 11, "chore: version packages") for c in ("passed", commit) if c],
        "commit_sha string, position bigint, number bigint, title string",
    )
    links = notes.link_commits_to_prs(releases, pulls)
    assert tuple(links.first()) == (1, commit or "passed", 12)
    row = notes.clean_release_notes(releases, links, PKG).first()
    badge = f"[![npm version](https://img.shields.io/badge/npm-1.2.3-blue.svg)](https://www.npmjs.com/package/{PKG}/v/1.2.3)"
    assert row.status == "formatted"
    assert notes.clean_linked(notes.with_pull_requests(releases, pulls), PKG).collect() == [row]
    assert row.body == f"{description}\n\n**Related Pull Request:** #12\n\n---\n\n{badge}"


def test_left_alone(spark):
    bodies = [(1, HEAD + "x\n![](https://img.shields.io/a)"), (2, "nothing here"), (3, HEAD), (4, None)]
    releases = spark.createDataFrame([(i, "1.0.0", None, b) for i, b in bodies], "release_id bigint, version string, commit_sha string, body string")
    pulls = spark.createDataFrame([], "commit_sha string, position bigint, number bigint, title string")
    df = notes.clean_release_notes(releases, notes.link_commits_to_prs(releases, pulls), PKG)
    got = {r.release_id: (r.status, r.body) for r in df.collect()}
    assert got == {1: ("already_formatted", bodies[0][1]), 2: ("no_changes", bodies[1][1]), 3: ("no_changes", HEAD), 4: ("no_changes", None)}


def test_only_version_bumps_means_no_link(spark):
    releases = spark.createDataFrame([(1, "1", "c", HEAD + "x")], "release_id bigint, version string, commit_sha string, body string")
    pulls = spark.createDataFrame([("c", 1, 5, "chore: version packages")], "commit_sha string, position bigint, number bigint, title string")
    links = notes.link_commits_to_prs(releases, pulls)
    assert links.first().pr_number is None
    assert "Related" not in notes.clean_release_notes(releases, links, PKG).first().body
