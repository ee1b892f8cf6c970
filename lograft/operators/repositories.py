"""Archive repositories: shared-target checks and dedicated-name collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lograft.constants import DEFAULT_BRANCH, REPO
from lograft.functions.naming import folder_name
from lograft.functions.text import first_non_empty
from lograft.session import stored


def uses_shared() -> Column:
    """Plan rows that go to a shared repository and are not a dry run."""
    return (F.col("type") == REPO) & F.col("shared_repository") & ~F.col("dry_mode")


def check_shared_repositories(plan: DataFrame, repositories: DataFrame) -> DataFrame:
    """Per distinct shared target: reuse it, create it, or a visibility error."""
    targets = plan.where(uses_shared()).select("owner", "repository_name", "is_public").distinct()
    known = repositories.select(
        "owner",
        F.col("name").alias("repository_name"),
        F.col("visibility").alias("_found"),
        "default_branch",
    )
    expected = F.when(F.col("is_public"), "public").otherwise("private")
    action = (
        F.when(F.col("_found").isNull(), "create")
        .when(F.col("_found") == expected, "reuse")
        .otherwise("error")
    )
    branch = F.when(action != "error", first_non_empty(F.col("default_branch"), F.lit(DEFAULT_BRANCH)))
    message = F.when(
        action == "error",
        F.concat(
            F.lit("Shared repository "),
            F.col("repository_name"),
            F.lit(" exists with visibility "),
            F.col("_found"),
            F.lit(", expected "),
            expected,
        ),
    )
    return targets.join(known, ["owner", "repository_name"], "left").select(
        "owner",
        "repository_name",
        action.alias("action"),
        branch.alias("branch"),
        message.alias("error"),
    )


def resolve_name_collisions(plan: DataFrame, repositories: DataFrame) -> DataFrame:
    """Final names of dedicated repositories, as if requests ran in time order.

    A request whose bare name is taken retries once under ``name-<epoch ms>`` and
    fails if that is taken too. Names are taken by existing repositories and by
    earlier requests of the batch, whether these claimed them bare or suffixed.

    Who comes first under a name is a ``min`` that is combined before the
    shuffle; no group is sorted or gathered, however often a name is asked for.
    The two small tables of firsts are stored, as several steps read them.
    ``plan`` is read three times; hand in a stored one where it is costly.
    """
    claims = plan.where(
        (F.col("type") == REPO) & ~F.col("shared_repository") & ~F.col("dry_mode")
    ).select(
        "owner",
        folder_name(F.col("path")).alias("name"),
        F.unix_millis("requested_at").alias("ms"),
        F.struct("requested_at", "request_id").alias("turn"),
    )
    taken = repositories.select("owner", "name").distinct().withColumn("taken", F.lit(True))

    names = stored(
        claims.groupBy("owner", "name")
        .agg(F.min("turn").alias("first"), F.min_by("ms", "turn").alias("first_ms"))
        .join(taken, ["owner", "name"], "left")
        .withColumn("taken", F.coalesce("taken", F.lit(False))),
        "names",
    )
    # The earliest retry under each suffixed name by a request that was not first.
    retries = stored(
        claims.join(names.select("owner", "name", "first"), ["owner", "name"])
        .where(F.col("turn") != F.col("first"))
        .groupBy("owner", "name", "ms")
        .agg(F.min("turn").alias("later")),
        "retries",
    )
    settled = names.join(_lost_first_turn(names, retries), ["owner", "name"], "left").withColumn(
        "first_lost", F.col("taken") | F.coalesce("lost", F.lit(False))
    )
    # Suffixed names: who retries first, and who has them already.
    suffixed = F.concat_ws("-", "name", F.col("ms").cast("string"))
    first_retries = settled.where("first_lost").select(
        "owner", "name", F.col("first_ms").alias("ms"), F.col("first").alias("later")
    )
    rivals = names.select("owner", F.col("name").alias("retry"), F.col("first").alias("bare"))
    gone = taken.select("owner", F.col("name").alias("retry"), F.col("taken").alias("retry_taken"))
    state = (
        retries.unionByName(first_retries)
        .groupBy("owner", "name", "ms")
        .agg(F.min("later").alias("first_retry"))
        .withColumn("retry", suffixed)
        .join(rivals, ["owner", "retry"], "left")
        .join(gone, ["owner", "retry"], "left")
    )
    collided = (F.col("turn") != F.col("first")) | F.col("first_lost")
    failed = (
        F.coalesce("retry_taken", F.lit(False))
        | F.coalesce(F.col("first_retry") < F.col("turn"), F.lit(False))
        | F.coalesce(F.col("bare") < F.col("turn"), F.lit(False))
    )
    return (
        claims.join(settled.select("owner", "name", "first", "first_lost"), ["owner", "name"])
        .join(state, ["owner", "name", "ms"], "left")
        .select(
            F.col("turn.request_id").alias("request_id"),
            F.col("name").alias("base_name"),
            F.when(collided, F.col("retry")).otherwise(F.col("name")).alias("final_name"),
            collided.alias("collided"),
            (collided & failed).alias("failed"),
        )
    )


def _lost_first_turn(names: DataFrame, retries: DataFrame) -> DataFrame:
    """Names whose first bare claim came after a suffixed claim on the same name.

    Whether the first request under ``a`` retried as ``a-<ms>`` can itself hang on
    a suffixed claim on ``a``. Each such name is therefore set beside its own stems
    (``a-1-2``, ``a-1``, ``a``): it is lost if a certain loss is reached before the
    chain of first requests breaks. The stems of a name are bounded by its length.
    """
    numbered = names.where(F.col("name").rlike(r"-\d+\z")).withColumns(
        {
            "stem": F.regexp_replace("name", r"-\d+\z", ""),
            "tail": F.regexp_extract("name", r"-(\d+)\z", 1).try_cast("bigint"),
        }
    )
    certain = retries.select(
        "owner", F.col("name").alias("stem"), F.col("ms").alias("tail"), F.col("later").alias("certain")
    )
    parents = names.select(
        "owner",
        F.col("name").alias("stem"),
        F.col("first_ms").alias("tail"),
        F.col("first").alias("stem_first"),
        F.col("taken").alias("stem_taken"),
    )
    before = F.coalesce(F.col("stem_first") < F.col("first"), F.lit(False))
    steps = (
        numbered.join(certain, ["owner", "stem", "tail"], "left")
        .join(parents, ["owner", "stem", "tail"], "left")
        .select(
            "owner",
            "name",
            (
                F.col("taken")
                | F.coalesce(F.col("certain") < F.col("first"), F.lit(False))
                | (before & F.coalesce("stem_taken", F.lit(False)))
            ).alias("hard"),
            before.alias("linked"),
        )
    )
    n_tails = F.regexp_count(F.regexp_extract("name", r"(?:-\d+)+\z", 0), F.lit("-"))
    # A name without its last i numbers is its first pieces, put together again.
    pieces = F.split("name", "-", -1)
    stems = F.transform(
        F.sequence(F.lit(0), F.when(F.col("linked"), n_tails).otherwise(0)),
        lambda i: F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - i), "-"),
    )
    chains = steps.where("hard or linked").select("owner", "name", F.posexplode(stems).alias("level", "link"))
    seen = steps.select("owner", F.col("name").alias("link"), "hard", "linked").unionByName(
        names.where(~F.col("name").rlike(r"-\d+\z")).select(
            "owner", F.col("name").alias("link"), F.col("taken").alias("hard"), F.lit(False).alias("linked")
        )
    )
    return (
        chains.join(seen, ["owner", "link"], "left")
        .groupBy("owner", "name")
        .agg(
            F.min(F.when(F.col("hard"), F.col("level"))).alias("hit"),
            F.min(F.when(~F.coalesce("linked", F.lit(False)), F.col("level"))).alias("broken"),
        )
        .select("owner", "name", (F.col("hit") <= F.coalesce("broken", "hit")).alias("lost"))
        .where("lost")
    )
