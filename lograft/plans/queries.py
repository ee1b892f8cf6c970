"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lograft.operators import (
    audit,
    catalogue,
    changelog,
    changesets,
    chunks,
    corpus,
    dedup,
    failures,
    folders,
    listings,
    log_scan,
    names,
    notes,
    planning,
    repositories,
    requests,
    strategy,
    summaries,
)
from lograft.plans import bindings as b
from lograft.session import scratch_path, stored
from lograft.sources.archive import read_archive, write_archive
from lograft.sources.textfiles import write_text_files
from lograft.streaming.archive_stream import stream_archive, stream_files

Query = Callable[[SparkSession, str], DataFrame]
CHUNKING = {"chunk_size": b.CHUNK_SIZE, "granularity": b.GRANULARITY}
PLAN_COLUMNS = (
    "request_id",
    "type",
    "url",
    "raw_url",
    "file_name",
    "repository_name",
    "repository_path",
    "file_count",
    "is_public",
    "dry_mode",
    "deduplicated",
)
MAX_BODY_LINES = 40
DOCS_PER_FILE = 100
MAX_FILE_LINES = 900
RANGE_BYTES = 1 << 16
SMALL_CHUNK = 16
CORPUS_PART_LINES = 1000


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_uploads(b.requests(spark, sf_dir), b.log_files(spark, sf_dir), **b.LIMITS)


def _stored_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan as a table of its own, for queries that read it more than once."""
    return stored(_plan(spark, sf_dir).drop("upload_description", "file_name"), "plan")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.explode_listing(b.archive_listings(spark, sf_dir), "listing", "folder")


def _write_text_files(docs: DataFrame, root: str, body: Column | str = "text") -> None:
    """Documents as text files of 100 each, in order."""
    body = F.col(body) if isinstance(body, str) else body
    numbered = docs.select("doc_id", F.expr(f"doc_id div {DOCS_PER_FILE}").alias("part"), body.alias("text"))
    write_text_files(numbered, root, "part", "text", "doc_id")


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as text files in the shared scratch folder."""
    root = scratch_path(spark, "text")
    _write_text_files(b.table(spark, sf_dir, "documents"), root)
    return root


def _captured_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as text files, each followed by a line of captured output."""
    root = scratch_path(spark, "captured")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), b.captured_line())
    _write_text_files(b.table(spark, sf_dir, "documents"), root, body)
    return root


def _part() -> Column:
    return F.regexp_extract("path", r"/part=(\d+)/", 1).cast("bigint").alias("part")


def scan_log_files(spark, sf_dir):
    files = catalogue.scan_log_files(spark, _text_files(spark, sf_dir), (".txt",), include_dotfiles=False)
    return files.select(_part(), "size_bytes")


def missing_inputs(spark, sf_dir):
    return catalogue.missing_inputs(b.requests(spark, sf_dir), b.log_files(spark, sf_dir))


def _every_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.explode_listing(b.archive_listings(spark, sf_dir, every=True), "listing", "folder")


def folder_listing(spark, sf_dir):
    return _every_folder(spark, sf_dir).select(
        "repository_name", "repository_path", "present", "malformed", "name", "download_url"
    )


def gist_listing(spark, sf_dir):
    return listings.explode_listing(b.gist_listings(spark, sf_dir), "listing", "gist")


def repository_metadata(spark, sf_dir):
    return listings.explode_listing(b.repository_listings(spark, sf_dir), "listing", "repository")


def folder_answers(spark, sf_dir):
    """Lookups of folders as they were answered, a shape a document."""
    return listings.explode_answers(b.folder_answers(spark, sf_dir), "answer")


def typed_options(spark, sf_dir):
    """Raw option maps as a layer, and the names in them that do not exist."""
    raw = F.col("raw")
    layers = b.raw_options(spark, sf_dir).select(
        "request_id", requests.typed_options(raw).alias("cli"), requests.unknown_options(raw).alias("unknown")
    )
    return layers.select(
        "request_id",
        F.col("cli.public").alias("public"),
        F.col("cli.private").alias("private"),
        F.col("cli.dry_mode").alias("dry_mode"),
        F.col("cli.description").alias("description"),
        F.array_join(F.array_sort("unknown"), ",").alias("unknown"),
    )


def classify_strategy(spark, sf_dir):
    return strategy.classify_strategy(b.log_files(spark, sf_dir).drop("content"), **b.LIMITS)


def assign_archive_names(spark, sf_dir):
    return names.assign_archive_names(b.log_files(spark, sf_dir).select("path"))


def name_clashes(spark, sf_dir):
    return names.name_clashes(b.log_files(spark, sf_dir))


def clash_members(spark, sf_dir):
    return names.clash_members(b.log_files(spark, sf_dir))


def resolve_requests(spark, sf_dir):
    return requests.resolve_requests(b.requests(spark, sf_dir)).select(
        "request_id",
        "path",
        "is_public",
        "auto",
        "only_gist",
        "only_repository",
        "shared_repository",
        "dry_mode",
        "verbose",
        "self_test",
        "description",
    )


def validate_requests(spark, sf_dir):
    return requests.validate_requests(b.requests(spark, sf_dir), b.log_files(spark, sf_dir))


def plan_uploads(spark, sf_dir):
    return _plan(spark, sf_dir).select(*PLAN_COLUMNS)


def dedup_uploads(spark, sf_dir):
    return dedup.dedup_uploads(_stored_plan(spark, sf_dir), _contents(spark, sf_dir), **CHUNKING).select(
        "request_id",
        "owner",
        "repository_name",
        "repository_path",
        "deduplicated",
        "duplicate_of",
        "file_count",
        "raw_url",
        "url",
        "action",
        "error",
    )


def check_shared_repositories(spark, sf_dir):
    return repositories.check_shared_repositories(_plan(spark, sf_dir), b.shared_repositories(spark, sf_dir))


def bytechunks(spark, sf_dir):
    """Every byte range of every file; the hash is one of the hexadecimal digits, as SQL can cut those."""
    ranges = chunks.scan_chunks(spark, _text_files(spark, sf_dir), RANGE_BYTES, (".txt",))
    return ranges.select(_part(), "chunk_no", "offset", "length", F.sha2(F.hex("content"), 256).alias("sha"))


def chunk_manifest(spark, sf_dir):
    return chunks.chunk_manifest(b.log_files(spark, sf_dir).drop("content"), **CHUNKING)


def chunk_overflow(spark, sf_dir):
    """Files of so many parts that their numbers have three digits and more."""
    small = chunks.chunk_manifest(b.log_files(spark, sf_dir).drop("content"), SMALL_CHUNK, 1)
    return small.where(F.col("size_bytes") > 100 * SMALL_CHUNK).groupBy("path", "size_bytes").agg(
        F.count("*").alias("n_parts"),
        F.sum("length").alias("total_bytes"),
        F.min("chunk_name").alias("first_name"),
        F.max("chunk_name").alias("last_name"),
    )


def split_content(spark, sf_dir):
    return chunks.split_content(b.log_files(spark, sf_dir), **CHUNKING).select(
        "path", "chunk_name", "offset", "length", F.sha2("content", 256).alias("sha")
    )


def check_coverage(spark, sf_dir):
    """Every file's stored chunks against its own bytes."""
    files = b.log_files(spark, sf_dir)
    return chunks.verify_chunks(stored(chunks.split_content(files, **CHUNKING), "chunks"), files)


def file_digests(spark, sf_dir):
    """The CRC-32 of every file from those of its chunks."""
    parts = chunks.part_digests(chunks.split_content(b.log_files(spark, sf_dir), b.DIGEST_CHUNK, b.GRANULARITY))
    return chunks.file_digests(parts)


def wrong_parts(spark, sf_dir):
    """Chunks of which some are lost and some changed, against what was cut."""
    cut = chunks.split_content(b.log_files(spark, sf_dir), **CHUNKING)
    turn = (F.col("chunk_no") + F.col("size_bytes")) % 5
    kept = cut.where(turn != 0).withColumn(
        "content", F.when(turn == 1, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content"))
    )
    return chunks.wrong_parts(chunks.part_digests(kept), chunks.part_digests(cut))


def _archived(spark: SparkSession, root: str) -> DataFrame:
    return read_archive(spark, root).select(
        "owner",
        "repository",
        "repository_path",
        "chunk_name",
        "size_bytes",
        F.sha2("content", 256).alias("sha"),
    )


def archive_write(spark, sf_dir):
    files = b.log_files(spark, sf_dir)
    plan = _stored_plan(spark, sf_dir)
    marked = dedup.dedup_uploads(
        plan, _contents(spark, sf_dir), b.shared_repositories(spark, sf_dir), **CHUNKING
    )
    shared = dedup.uploads_to_write(marked).select(*dedup.KEY, "path", "size_bytes")
    uploads = stored(shared.unionByName(dedup.dedicated_to_write(plan, b.taken_names(spark, sf_dir))), "uploads")
    bodies = uploads.join(files.select("path", "content"), "path")
    root = scratch_path(spark, "archive")
    write_archive(chunks.split_content(bodies, **CHUNKING), root)
    return _archived(spark, root)


def generate_log_corpus(spark, sf_dir):
    sizes = b.table(spark, sf_dir, "documents").groupBy("source").agg(
        F.sum(F.octet_length("text")).alias("target_bytes")
    )
    return corpus.corpus_lines(sizes).select("source", "line_no", "line")


def corpus_summary(spark, sf_dir):
    return corpus.corpus_summary(generate_log_corpus(spark, sf_dir), "source")


def corpus_files(spark, sf_dir):
    """A corpus file for each source as large as its texts: the written parts, read back."""
    sizes = b.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("target_bytes"))
    root = scratch_path(spark, "corpus")
    parts = corpus.write_corpus_files(sizes, root, "source", part_lines=CORPUS_PART_LINES)
    read = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary, source string, part bigint")
    found = read.format("binaryFile").load(root).select(
        "source", "part", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha")
    )
    same = found["source"].eqNullSafe(parts["source"]) & (found["part"] == parts["part"])
    return found.join(parts, same, "full").select(
        found["source"], found["part"], "first_line", "last_line", "offset", "length", "size_bytes", "sha"
    )


def resolve_name_collisions(spark, sf_dir):
    return repositories.resolve_name_collisions(_stored_plan(spark, sf_dir), b.taken_names(spark, sf_dir))


def link_commits_to_prs(spark, sf_dir):
    return notes.link_commits_to_prs(b.releases(spark, sf_dir), b.commit_pulls(spark, sf_dir))


def strategy_summary(spark, sf_dir):
    return summaries.strategy_summary(_plan(spark, sf_dir))


def folder_rollup(spark, sf_dir):
    return folders.folder_rollup(_every_folder(spark, sf_dir))


def folder_rollup_local(spark, sf_dir):
    return folders.folder_rollup(_every_folder(spark, sf_dir), include_dotfiles=False).select(
        "repository_name", "repository_path", "file_count", "raw_url"
    )


def gist_rollup(spark, sf_dir):
    return folders.gist_rollup(gist_listing(spark, sf_dir))


def line_limit_report(spark, sf_dir):
    root = _text_files(spark, sf_dir)
    report = audit.line_limit_report(spark, root, MAX_FILE_LINES, (".txt",), exclude=("_temporary",))
    return report.select(_part(), "size_bytes", "lines")


def body_line_report(spark, sf_dir):
    bodies = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    return audit.body_line_report(bodies, MAX_BODY_LINES).select("doc_id", "lines")


def parse_changesets(spark, sf_dir):
    return changesets.parse_changesets(b.changesets(spark, sf_dir), b.PACKAGE).select("file", "bump", "description")


def merge_changesets(spark, sf_dir):
    return changesets.merge_changesets(b.changesets(spark, sf_dir), b.PACKAGE)


def merged_entries(spark, sf_dir):
    return changesets.merged_entries(b.changesets(spark, sf_dir), b.PACKAGE).select("batch", "piece", "file", "text")


def manual_changeset(spark, sf_dir):
    return changesets.manual_changeset(b.manual_records(spark, sf_dir), b.PACKAGE).select("doc_id", "content")


def listed_changesets(spark, sf_dir):
    return changesets.listed_changesets(b.record_files(spark, sf_dir))


def changeset_gate(spark, sf_dir):
    return changesets.changeset_gate(
        b.prs(spark, sf_dir), b.diff(spark, sf_dir), b.changesets(spark, sf_dir), b.PACKAGE
    )


def outcome_summary(spark, sf_dir):
    return summaries.outcome_summary(b.outcomes(spark, sf_dir), b.suites(spark, sf_dir))


def classify_failures(spark, sf_dir):
    return failures.classify_failures(b.attempts(spark, sf_dir)).select(
        "attempt_id", *failures.LABELS, "exit", "detail"
    )


def failure_counts(spark, sf_dir):
    return failures.failure_counts(b.attempts(spark, sf_dir))


def resolve_outcomes(spark, sf_dir):
    plan = _stored_plan(spark, sf_dir)
    names = repositories.resolve_name_collisions(plan, b.taken_names(spark, sf_dir))
    marked = dedup.dedup_uploads(
        plan, _contents(spark, sf_dir), b.shared_repositories(spark, sf_dir), **CHUNKING
    ).join(names.select("request_id", "final_name"), "request_id", "left")
    return failures.resolve_outcomes(marked, b.attempts(spark, sf_dir), b.GIST_LIMIT, **CHUNKING)


def scan_failures(spark, sf_dir):
    found = log_scan.scan_failures(spark, _captured_files(spark, sf_dir), (".txt",))
    return found.select(_part(), *failures.LABELS, "n_failures", "first_failure", "repository_url")


def scan_url_targets(spark, sf_dir):
    return log_scan.scan_url_targets(spark, _captured_files(spark, sf_dir), (".txt",))


def extract_urls(spark, sf_dir):
    return failures.extract_urls(b.attempts(spark, sf_dir)).select(
        "attempt_id", "repository_url", "gist_url", "gist_id"
    )


def url_targets(spark, sf_dir):
    return failures.url_targets(b.attempts(spark, sf_dir))


def explode_changelog(spark, sf_dir):
    return changelog.explode_changelog(b.changelogs(spark, sf_dir))


def release_notes(spark, sf_dir):
    return changelog.release_notes(b.changelogs(spark, sf_dir), b.wanted_versions(spark, sf_dir))


def release_notes_legacy(spark, sf_dir):
    return changelog.release_notes(b.changelogs(spark, sf_dir), b.wanted_versions(spark, sf_dir), legacy=True)


def prepend_entries(spark, sf_dir):
    wanted = b.changelogs(spark, sf_dir).withColumns(
        {
            "version": F.concat(F.lit("2."), F.col("doc_id").cast("string")),
            "bump": F.when(F.col("doc_id") % 2 == 0, "minor").otherwise("patch"),
            "description": F.when(F.col("doc_id") % 3 == 0, "").otherwise("by hand"),
        }
    )
    return changelog.prepend_entries(wanted)


def clean_release_notes(spark, sf_dir):
    linked = notes.with_pull_requests(b.releases(spark, sf_dir), b.commit_pulls(spark, sf_dir))
    return notes.clean_linked(linked, b.PACKAGE)


def stream_archive_query(spark, sf_dir):
    """Requests stream in from the events table; the archive is read back."""
    stream = spark.readStream.schema(b.SCHEMAS["events"]).parquet(f"{sf_dir}/[e]vents.parquet")
    docs = F.lit(b.table(spark, sf_dir, "documents").count())
    root, checkpoint = scratch_path(spark, "archive"), scratch_path(spark, "stream")
    stream_archive(
        b.requests_from(stream, docs),
        b.log_files(spark, sf_dir),
        root,
        checkpoint,
        b.shared_repositories(spark, sf_dir),
        **b.LIMITS,
        granularity=b.GRANULARITY,
    ).awaitTermination()
    return _archived(spark, root)


def stream_files_query(spark, sf_dir):
    """Text files turn up in two goes and are archived; their chunks are read back."""
    docs = b.table(spark, sf_dir, "documents")
    inbox, root, checkpoint = (scratch_path(spark, label) for label in ("inbox", "archive", "stream"))
    for go in (0, 1):
        _write_text_files(docs.where((F.expr(f"doc_id div {DOCS_PER_FILE}") + F.lit(go)) % 2 == 0), inbox)
        stream_files(
            spark, inbox, root, checkpoint, "nation_0", suffixes=(".txt",), exclude=("_temporary",),
            gist_limit=0, chunk_size=RANGE_BYTES, granularity=1,
        ).awaitTermination()
    number = F.regexp_extract("chunk_name", r"\.part-(\d+)\.log\.txt", 1)
    return read_archive(spark, root).select(
        F.regexp_extract("repository_path", r"part=(\d+)-", 1).cast("bigint").alias("part"),
        F.when(number == "", 0).otherwise(number.try_cast("bigint")).cast("bigint").alias("chunk_no"),
        F.col("size_bytes").alias("length"),
        F.sha2(F.hex("content"), 256).alias("sha"),
    )


QUERIES: dict[str, Query] = {
    "o01_scan_log_files": scan_log_files,
    "o01_missing_inputs": missing_inputs,
    "o02_folder_listing": folder_listing,
    "o02_gist_listing": gist_listing,
    "o02_repository_metadata": repository_metadata,
    "o02_folder_answers": folder_answers,
    "o03_classify_strategy": classify_strategy,
    "o04_assign_archive_names": assign_archive_names,
    "o04_name_clashes": name_clashes,
    "o04_clash_members": clash_members,
    "o05_resolve_requests": resolve_requests,
    "o05_typed_options": typed_options,
    "o06_validate_requests": validate_requests,
    "o07_plan_uploads": plan_uploads,
    "o08_dedup_uploads": dedup_uploads,
    "o09_check_shared_repositories": check_shared_repositories,
    "o10_bytechunks": bytechunks,
    "o11_chunk_manifest": chunk_manifest,
    "o11_chunk_overflow": chunk_overflow,
    "o11_split_content": split_content,
    "o11_check_coverage": check_coverage,
    "o11_file_digests": file_digests,
    "o11_wrong_parts": wrong_parts,
    "o12_write_archive": archive_write,
    "o13_generate_log_corpus": generate_log_corpus,
    "o13_corpus_summary": corpus_summary,
    "o13_corpus_files": corpus_files,
    "o14_resolve_name_collisions": resolve_name_collisions,
    "o15_link_commits_to_prs": link_commits_to_prs,
    "o16_strategy_summary": strategy_summary,
    "o17_folder_rollup": folder_rollup,
    "o17_folder_rollup_local": folder_rollup_local,
    "o17_gist_rollup": gist_rollup,
    "o18_line_limit_report": line_limit_report,
    "o18_body_line_report": body_line_report,
    "o19_parse_changesets": parse_changesets,
    "o19_merge_changesets": merge_changesets,
    "o19_merged_entries": merged_entries,
    "o19_manual_changeset": manual_changeset,
    "o20_listed_changesets": listed_changesets,
    "o20_changeset_gate": changeset_gate,
    "o21_outcome_summary": outcome_summary,
    "o22_classify_failures": classify_failures,
    "o22_failure_counts": failure_counts,
    "o22_scan_failures": scan_failures,
    "o23_resolve_outcomes": resolve_outcomes,
    "o24_extract_urls": extract_urls,
    "o24_url_targets": url_targets,
    "o24_scan_url_targets": scan_url_targets,
    "o25_explode_changelog": explode_changelog,
    "o25_release_notes": release_notes,
    "o25_release_notes_legacy": release_notes_legacy,
    "o25_prepend_entries": prepend_entries,
    "o26_clean_release_notes": clean_release_notes,
    "o27_stream_archive": stream_archive_query,
    "o27_stream_files": stream_files_query,
}
