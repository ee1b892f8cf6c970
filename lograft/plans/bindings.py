"""The operators' input tables, derived from the given Parquet tables.

Everything here is a narrow projection of ``documents``, ``events``, ``orders`` or
``nation``, so the inputs grow with them. Paths are a function of the document
number alone, which spares requests a join. Hot keys are built in: a third of
all requests ask for one file, and two thirds come from one owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lograft.functions.naming import folder_name
from lograft.functions.text import int_div

GIST_LIMIT = 2048
CHUNK_SIZE = 8192
GRANULARITY = 1
PACKAGE = "sample-pkg"
HOT_DOC = 11
# Small, so that files have many parts.
DIGEST_CHUNK = 100
LIMITS = {"gist_limit": GIST_LIMIT, "chunk_size": CHUNK_SIZE}


# The columns that are used. Timestamps without zone are read as UTC.
SCHEMAS = {
    "documents": "doc_id bigint, text string, source string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string",
    "orders": "o_orderkey bigint, o_orderpriority string",
    "customer": "c_custkey bigint",
    "nation": "n_nationkey int, n_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _cat(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _case(selector: Column, cases: dict[int, Column | str], default: Column | str | None = None) -> Column:
    out = F
    for value, result in cases.items():
        out = out.when(selector == value, result)
    return out.otherwise(default) if default is not None else out


def path_of(doc: str) -> Column:
    """The path of a document, by its number (a column name or SQL expression)."""
    return F.expr(
        f"""concat(
        CASE {doc} % 8 WHEN 0 THEN concat('/var/log/app', {doc} % 5, '/') WHEN 1 THEN './logs/'
            WHEN 2 THEN 'C:\\\\logs\\\\' WHEN 3 THEN '///srv//' WHEN 4 THEN 'var/log/'
            WHEN 5 THEN '/var/tmp/' WHEN 6 THEN '/a/b/' ELSE '/a-b/' END,
        CASE WHEN {doc} % 8 < 6 THEN {doc} ELSE {doc} div 8 END,
        CASE {doc} % 8 WHEN 3 THEN '.log.txt' WHEN 4 THEN '.txt' WHEN 5 THEN '' ELSE '.log' END)"""
    )


def short_sha(number: Column) -> Column:
    return F.substring(F.md5(number.cast("string")), 1, 7)


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        path_of("doc_id").alias("path"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.col("text").cast("binary").alias("content"),
    )


def n_docs(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "documents").agg(F.count("*")).scalar()


# The option layers of request n: true, false or unset by its remainders.
CLI = """named_struct(
    'public', CASE n % 5 WHEN 0 THEN true WHEN 1 THEN false END,
    'private', CASE n % 7 WHEN 0 THEN true WHEN 1 THEN false END,
    'only_gist', CASE n % 11 WHEN 0 THEN true WHEN 1 THEN false END,
    'only_repository', CASE WHEN n % 6 = 0 THEN true END,
    'auto', CASE WHEN n % 13 = 0 THEN false END,
    'verbose', CASE WHEN n % 9 = 0 THEN true END,
    'dry_mode', CASE WHEN n % 8 = 3 THEN true END,
    'description', CASE WHEN n % 10 = 4 THEN concat('note ', n) END,
    'test', CASE WHEN n % 61 = 60 THEN true END) AS cli"""
ENV = """named_struct(
    'public', CASE WHEN n % 17 = 3 THEN true END,
    'shared_repository', CASE WHEN n % 4 = 1 THEN false END,
    'dry_mode', CASE WHEN n % 23 = 5 THEN true END) AS env"""
SETTINGS = """named_struct(
    'shared_repository', CASE WHEN n % 4 < 2 THEN true END,
    'description', CASE WHEN n % 10 = 5 THEN 'from file' END,
    'private', CASE WHEN n % 19 = 7 THEN false END) AS settings"""


def requests_from(events: DataFrame, docs: Column) -> DataFrame:
    n = F.col("event_id")
    aimed = events.select(
        n.alias("n"), "ts", "user_id", F.when(n % 3 == 0, F.lit(HOT_DOC)).otherwise(n % docs).alias("target")
    )
    return aimed.withColumn("wanted", path_of("target")).selectExpr(
        "n AS request_id",
        "ts AS requested_at",
        "CASE WHEN n % 3 < 2 THEN 'nation_0' ELSE concat('nation_', user_id % 30) END AS owner",
        """CASE WHEN n % 97 = 96 THEN concat('/missing/', n, '.log')
            WHEN n % 101 = 100 THEN CASE WHEN n % 2 = 0 THEN '' END ELSE wanted END AS path""",
        CLI,
        ENV,
        SETTINGS,
        "CASE WHEN n % 53 = 52 THEN array('colour') END AS unknown_options",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(table(spark, sf_dir, "events"), n_docs(spark, sf_dir))


def archive_listings(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Listings of a tenth of the documents' folders; with ``every``, of a folder of its own for nearly each document."""
    doc = F.col("doc_id")
    folder = folder_name(path_of("doc_id"))
    nothing = (doc % 10 != 0) | (doc % 70 == 10)
    if every:
        folder, nothing = _cat(folder, "-", doc), doc % 7 == 3
    public = (doc % 20 != 0)
    entry = F.concat(
        F.lit('{"name":"'), folder, F.lit('.log.txt","download_url":"https://raw.example.org/'), folder,
        F.when(public, F.lit('"}')).otherwise(F.lit('?token=abc"}')),
    )
    hidden = F.lit('{"name":".keep","download_url":null}')
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.lit("nation_0").alias("owner"),
            F.when(public, "public-logs").otherwise("private-logs").alias("repository_name"),
            F.when(doc % 50 == 0, "trunk").otherwise("main").alias("branch"),
            folder.alias("repository_path"),
            F.when(public, "public").otherwise("private").alias("visibility"),
            F.when(nothing, F.lit(None))
            .when(doc % 110 == 30, "{broken")
            .when(doc % 40 == 0, F.lit(" \n"))
            .when(doc % 30 == 0, F.concat(F.lit("["), entry, F.lit(","), hidden, F.lit("]")))
            .otherwise(F.concat(F.lit("["), entry, F.lit("]\n")))
            .alias("listing"),
        )
    )


def folder_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lookup of each document's folder printed: arrays, objects, errors and garbage, with its text in them."""
    doc, folder = F.col("doc_id"), folder_name(path_of("doc_id"))
    entry = F.to_json(F.struct(folder.alias("name"), F.col("text").alias("download_url"), doc.alias("size")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        _case(
            doc % 10,
            {
                1: '{"message":"Not Found","status":"404"}',
                2: F.to_json(F.struct(F.col("text").alias("message"), F.lit("502").alias("status"))),
                3: " [] ",
                4: " \n",
                5: F.concat(F.lit("[{"), F.col("text")),
                6: F.concat(F.lit("["), entry, F.lit(",7]\n")),
                7: entry,
                8: F.concat(F.lit('[{"name":5},'), entry, F.lit(',{"download_url":null,"name":".keep"}]')),
                9: F.concat(F.lit('"folder '), doc.cast("string"), F.lit('"')),
            },
        ).alias("answer"),
    )


def raw_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command-line options of each event as a raw map: short and long forms, odd values, unknown names."""
    n = F.col("event_id")
    given = {
        "public": F.when(n % 3 == 0, "true").when(n % 3 == 1, "no"),
        "p": F.when(n % 4 == 1, "TRUE"),
        "private": F.when(n % 5 == 2, "maybe"),
        "dry": F.when(n % 6 < 2, "1"),
        "description": F.when(n % 7 == 3, F.col("event_type")),
        "d": F.when(n % 2 == 0, _cat("note ", n)),
        "colour": F.when(n % 11 == 10, "red"),
        "Public": F.when(n % 13 == 12, "true"),
    }
    every = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in given.items()))
    return table(spark, sf_dir, "events").select(
        n.alias("request_id"), F.map_from_entries(F.filter(every, lambda e: e["value"].isNotNull())).alias("raw")
    )


def gist_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    one = _cat('"f', doc, '.log.txt":{"raw_url":"https://gist.example.org/', doc, '/raw","size":', doc, "}")
    return table(spark, sf_dir, "documents").select(
        doc.alias("gist_id"),
        F.when(doc % 9 == 1, F.lit(None))
        .when(doc % 9 == 2, F.lit("{broken"))
        .when(doc % 9 == 3, F.concat(F.lit('{"files":{'), one, F.lit(',"second.txt":{"raw_url":"x"}}}')))
        .when(doc % 9 == 4, F.lit('{"files":{}}'))
        .otherwise(F.concat(F.lit('{"files":{'), one, F.lit("}}")))
        .alias("listing"),
    )


def repository_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("repository_id"),
        F.when(key % 6 == 0, F.lit(None))
        .when(key % 6 == 1, F.lit('{"defaultBranch":null,"visibility":"private"}\n'))
        .otherwise(_cat('{"defaultBranch":"b', key % 4, '","visibility":"public","extra":1}'))
        .alias("listing"),
    )


def shared_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.lower("n_name").alias("owner"),
        F.when(n % 2 == 0, "private-logs").otherwise("public-logs").alias("name"),
        F.when(n % 4 == 1, "").when(n % 4 != 2, "trunk").alias("default_branch"),
        F.when(n % 3 == 0, "private").when(n % 3 == 1, "public").otherwise("internal").alias("visibility"),
    )


def taken_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedicated repositories that exist: bare names, and some suffixed ones."""
    doc, n = F.col("doc_id"), F.col("event_id")
    bare = table(spark, sf_dir, "documents").where(doc % 6 == 0).select(
        F.lit("nation_0").alias("owner"), folder_name(path_of("doc_id")).alias("name")
    )
    asked = requests(spark, sf_dir)
    suffixed = asked.where(F.col("request_id") % 33 == 0).select(
        "owner", F.concat_ws("-", folder_name(F.col("path")), F.unix_millis("requested_at").cast("string")).alias("name")
    )
    return bare.unionByName(suffixed).where("name is not null")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts an event. Every document's whole text stands around what one attempt printed."""
    n, s = F.col("event_id"), F.col("_s")
    gist = s == 0
    v = (n + s * 4) % 9
    body = F.col("text")
    head, tail = F.coalesce(_cat(body, "\n"), F.lit("")), F.coalesce(_cat("\n", body), F.lit(""))
    ok_out = F.when(gist, _cat("https://gist.github.com/user", n % 40, "/", n % 500, "\n")).otherwise(
        _cat(head, "created\r\n  https://github.com/nation_0/repo-", n % 500, " \r\nhttps://github.com/x/y/z\n", tail)
    )
    tried = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("_s"))
    doc = F.col("doc_id")
    printed = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tried.join(printed, (doc * 10 == n) & (doc % 2 == s), "left").select(
        (n * 2 + s).alias("attempt_id"),
        n.alias("request_id"),
        F.when(gist, "gist").otherwise("repo").alias("stage"),
        F.when(v == 1, "ENOSPC").alias("error_code"),
        _case(v, {2: F.lit(1), 3: F.lit(128), 4: F.lit(1), 5: F.lit(1), 6: F.lit(1), 0: F.lit(0)}).alias("exit_code"),
        F.when(v == 8, F.lit(3)).when((v == 7) & ~gist, F.lit(128)).alias("child_exit_code"),
        _case(v, {1: "ENOSPC: no space left on device, write", 2: "Error: No space left on device"}).alias("message"),
        _case(v, {0: ok_out, 7: "https://gist.github.com/", 8: _cat(head, " build failed \t", tail)}).alias("stdout"),
        _case(
            v,
            {
                0: F.when(gist, body),
                1: body,
                2: body,
                3: _cat(head, "fatal: No Space Left on device", tail),
                4: _cat(head, "GraphQL: Name already exists on this account (createRepository)", tail),
                5: _cat(head, "gh: Not Found (HTTP 404)", tail),
                6: _cat(head, "  secondary rate limit\n", tail),
                7: _cat(head, "fatal: couldn't find remote ref main", tail),
                8: "",
            },
        ).alias("stderr"),
    )


def captured_line() -> Column:
    """What a command printed behind each document: failures and URLs, or nothing."""
    doc = F.col("doc_id")
    return _case(
        doc % 8,
        {
            0: _cat("fatal: No Space Left on device ", doc, " "),
            1: _cat("  https://github.com/nation_0/repo-", doc % 500, " \r"),
            2: _cat("\tGraphQL: Name already exists on this account ", doc),
            3: _cat("gh: Not Found (HTTP 404) ", doc),
            4: _cat("see https://github.com/nation_0/repo-", doc, " for more"),
            5: _cat("fatal: couldn't find remote ref b", doc),
            6: _cat(" https://gist.github.com/user/", doc % 50),
        },
        "",
    )


def changesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    bump = _case(doc % 3, {0: "patch", 1: "minor"}, "major")
    text = F.col("text")
    head = F.concat(F.lit(f"---\n'{PACKAGE}': "), bump, F.lit("\n"))
    content = _case(
        doc % 13,
        {
            0: F.concat(F.lit("---\n'other': patch\n---\n\n"), text, F.lit("\n")),
            1: F.concat(F.lit(f"---\n{PACKAGE}: "), bump, F.lit("\n---\n\n"), text, F.lit("\n")),
            2: F.concat(head, F.lit("\n"), text),
            3: F.concat(head, F.lit("---\n \t\n")),
            4: F.concat(head, F.lit("---\n\n"), text, F.lit("\n---\nmore\n")),
        },
        F.concat(head, F.lit("---\n\n"), text, F.lit("\n")),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("batch"),
        _cat("cs-", doc, ".md").alias("file"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (doc * 7919) % 997).alias("mtime"),
        content.alias("content"),
    )


def manual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases by hand, described by whole texts or not at all."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        _case(doc % 3, {0: "patch", 1: "minor"}, "major").alias("bump"),
        F.when(doc % 5 != 0, F.col("text")).otherwise("").alias("description"),
    )


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    names = _case(doc % 5, {0: "README.md", 1: "MY-README.md", 2: "config.json"}, _cat("cs-", doc, ".md"))
    return table(spark, sf_dir, "documents").select("doc_id", names.alias("file"))


def prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pr_id"))


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    own = _cat(".changeset/cs-", doc, ".md")
    return table(spark, sf_dir, "documents").select(
        int_div(doc, 2).alias("pr_id"),
        _case(doc % 7, {1: "M", 2: "D", 5: "R100"}, "A").alias("status"),
        _case(doc % 7, {3: ".changeset/README.md", 4: "src/x.md"}, own).alias("path"),
    )


def changelogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    one = two = F.col("text")
    entry = F.concat(
        _cat("## 1.", doc, ".10\n\n### Minor Changes\n\n- "), one,
        _cat("\n\n## Unnumbered\n\n## 1.", doc, ".1\n\n### Patch Changes\n\n- "), two, F.lit("\n"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(doc % 8 == 5, F.concat(F.lit("# log\n\n"), one))
        .when(doc % 8 == 6, one)
        .otherwise(F.concat(F.lit("# log\n\n"), entry))
        .alias("body"),
    )


def wanted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(doc % 4 == 3, _cat("9.", doc)).otherwise(_cat("1.", doc, ".1")).alias("version")
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    text = F.col("text")
    head = F.lit("### Patch Changes\n\n- ")
    with_sha = F.concat(head, short_sha(doc), F.lit(": "))
    body = _case(
        doc % 11,
        {
            0: F.concat(with_sha, text, F.lit("\n![x](https://img.shields.io/y)")),
            1: F.concat(F.lit("Notes\n\n- "), text),
            2: F.concat(head, text),
            3: F.concat(head, F.lit("add: "), text),
            4: F.concat(with_sha, F.lit("first\\nsecond \\n\\n\\n\\n"), text),
            5: F.concat(with_sha, F.lit("\\'\\'\"'"), text, F.lit("'\"")),
            6: F.concat(with_sha, text, F.lit(" \U0001f4e6 npm\nrest")),
            7: F.concat(with_sha, text, F.lit("\n---\ntail")),
            8: F.concat(with_sha, F.lit("  "), text, F.lit("  \n\n \n\n  end\t\n")),
            9: F.concat(with_sha, F.col("text")),
        },
        F.concat(F.lit("x\n### Major Changes \n\n - "), text, F.lit("\n\n### Minor Changes\n\n- other")),
    )
    return table(spark, sf_dir, "documents").select(
        doc.alias("release_id"),
        _cat(F.when(doc % 2 == 0, "v").otherwise(""), "1.", doc, ".0").alias("version"),
        F.when(doc % 5 != 4, short_sha(doc + 1)).alias("commit_sha"),
        body.alias("body"),
    )


def commit_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        short_sha(F.when(key % 4 == 0, F.lit(HOT_DOC)).otherwise(key % 5000)).alias("commit_sha"),
        ((key * 7) % 1009 * 1_000_000 + key).alias("position"),
        key.alias("number"),
        F.when(key % 3 == 0, "chore: version packages")
        .when(key % 3 == 1, "Version Packages by hand")
        .otherwise(_cat("feat: order ", key))
        .alias("title"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "steady").otherwise(F.col("event_type")).alias("suite"),
        _cat("case ", n).alias("name"),
        F.when(F.col("event_type") == "error", F.lit(True)).when(n % 41 != 7, n % 7 != 0).alias("passed"),
    )


def suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types, and the order priorities as suites without outcomes."""
    ran = outcomes(spark, sf_dir).select("suite").distinct()
    idle = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("suite")).distinct()
    return ran.unionByName(idle)
