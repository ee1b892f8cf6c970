"""Limits, names and message texts shared by the operators.

Every limit is only a default: the operators take it as a parameter.
"""

MIB = 1024 * 1024

# --- Fixed values -----------------------------------------------------------
# These must stay exactly as they are for results to be right.

SMALL_TIER_LIMIT = 25 * MIB
CHUNK_SIZE = 100 * MIB
CHUNK_GRANULARITY = MIB
# Part numbers have two digits at least, more where a file has more parts.
LEAST_PART_DIGITS = 2

GIST = "gist"
REPO = "repo"

PRIVATE_REPOSITORY = "private-logs"
PUBLIC_REPOSITORY = "public-logs"
DEFAULT_BRANCH = "main"

LOG_TEXT_SUFFIX = ".log.txt"
FOLDER_PREFIX = "log-"
PART_INFIX = ".part-"
DESCRIPTION_PREFIX = "Log file: "

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")

REASON_GIST = "File fits within GitHub Gist API limit (25MB)"
REASON_REPO = "File exceeds Gist limit, will upload as repository"
REASON_SPLIT_HEAD = "File exceeds Gist limit, will be split into "
REASON_SPLIT_TAIL = " chunks"

DRY_GIST_URL = "[DRY MODE] Would create gist"
DRY_SHARED_URL_HEAD = "[DRY MODE] Would upload to "
DRY_DEDICATED_URL = "[DRY MODE] Would create repository"

GITHUB_URL = "https://github.com/"
GIST_URL = "https://gist.github.com/"
TOKEN_MARK = "?token="

NO_SPACE_CODE = "ENOSPC"
NO_SPACE_PHRASE = "no space left on device"
NAME_CONFLICT_PHRASE = "already exists"
NOT_FOUND_PHRASES = ("not found", "http 404")
MISSING_REF_PHRASES = ("couldn't find remote ref", "could not find remote branch")
NO_SPACE_HEAD = "No space left on device during "
NO_SPACE_TAIL = (
    ". Suggestion: Free disk space and retry. "
    "Check large files in ~/.claude/debug, /tmp, or system logs."
)
HINT_HEAD = " Hint: This file ("
HINT_TAIL = (
    ") fits in a gist. Try --only-gist to upload without requiring temp disk space."
)
GIST_OPERATION = "gist upload"
REPO_OPERATION = "repository upload"
REPO_FALLBACK_OPERATION = "repository upload (requires temp disk space)"
GIST_FAILURE_HEAD = "Failed to create gist: "
UNKNOWN_ERROR = "Unknown error"

STATUS_DRY = "would be created"
STATUS_DUPLICATE = "already exists"
STATUS_CREATED = "created"

AUDIT_SUFFIXES = (".js", ".mjs", ".cjs")
AUDIT_EXCLUDES = ("node_modules", "coverage", "dist", ".git", "build")
AUDIT_MAX_LINES = 1000

CHANGESET_PREFIX = ".changeset/"
CHANGESET_SUFFIX = ".md"
CHANGESET_README = "README.md"
VERSION_BUMP_TITLE = "version packages"
BADGE_HOST = "img.shields.io"

LINE_MARK = "%LINE%"
NUMBERED_LINE = (
    "[2025-01-07T12:00:00.000Z] INFO  Application log entry #%LINE% - "
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit. "
    "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.\n"
)
CONSTANT_LINE = (
    "[2025-01-07T12:00:00.000Z] INFO  Test log entry - Lorem ipsum dolor sit amet.\n"
)

BROKEN_LISTING = "The listing of this folder cannot be parsed"
