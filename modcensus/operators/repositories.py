"""Repository listings: filters, first occurrences, limits and counters."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modcensus.fixed import GITHUB, GITLAB_PLATFORMS, OWNER_REQUIRED, PUBLIC_HOSTS, REPOSITORY_REQUIRED
from modcensus.functions.text import strip_space
from modcensus.operators.joins import join_single, never_broadcast
from modcensus.operators.limits import first_per_group

KEY = ["host", "full_name"]


def skip_archived(repositories: DataFrame, skip: bool = True) -> DataFrame:
    return repositories.where(~F.col("archived")) if skip else repositories


def match_name(repositories: DataFrame, pattern: str | None) -> DataFrame:
    """Keep repositories whose short name contains a match of a (Java) regular expression.

    A pattern that is none raises here and not in the first task.
    """
    check_pattern(repositories.sparkSession, pattern)
    return repositories if pattern is None else repositories.where(F.col("name").rlike(pattern))


def check_pattern(spark: SparkSession, pattern: str | None) -> None:
    if pattern is not None:
        try:
            spark.range(1).select(F.lit("").rlike(pattern)).collect()  # one row
        except Exception as error:
            raise ValueError(f"Invalid name pattern: {pattern!r}") from error


def match_visibility(repositories: DataFrame, visibility: str = "all") -> DataFrame:
    if visibility == "all":
        return repositories
    if visibility not in ("public", "private"):
        raise ValueError(f"visibility must be public, private or all, not {visibility!r}")
    return repositories.where(F.col("private") == F.lit(visibility == "private"))


def first_listed(repositories: DataFrame, per: list[str] | None = None) -> DataFrame:
    """First occurrence of every (host, full name), in each ``per`` group, in listing order.

    A minimum over structs combines before the shuffle, so a name listed any number of
    times reaches its task once per input partition; a window would move all copies.
    """
    keys = list(dict.fromkeys([*KEY, *(per or [])]))
    others = [c for c in repositories.columns if c not in ("list_pos", *keys)]
    first = F.min(F.struct("list_pos", *others)).alias("_first")
    return repositories.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in repositories.columns]
    )


def limit_repositories(repositories: DataFrame, n: int | None, per: list[str] | None = None) -> DataFrame:
    """First ``n`` in listing order, of the whole listing or of each ``per`` group."""
    if n is None:
        return repositories
    if n < 1:
        raise ValueError("limit must be a positive number")
    if per is None:
        return repositories.orderBy("list_pos").limit(n)
    return first_per_group(repositories, per, [F.col("list_pos")], n, spread=KEY)


def owned_by(repositories: DataFrame, owners: DataFrame) -> DataFrame:
    """Repositories with each (``host``, ``owner``, ``is_group``) row that owns them, as ``_owner``.

    An owner has what carries its name; a GitLab group also has all that lies below its path.
    Each repository lists the owners it could have, so this is an equi-join and not a prefix
    comparison of every repository with every owner.
    """
    parts = F.split("full_name", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    is_nested = F.col("provider").isin(GITLAB_PLATFORMS) & (F.size(parts) > 1)
    candidates = F.when(is_nested, F.array_distinct(F.concat(F.array("owner"), above))).otherwise(F.array("owner"))
    wanted = owners.select("host", F.col("owner").alias("_owner"), "is_group")
    return (
        join_single(
            repositories.withColumn("_owner", F.explode(candidates)), never_broadcast(wanted), ["host", "_owner"], "inner", spread=KEY
        )
        .where((F.col("owner") == F.col("_owner")) | F.col("is_group"))
    )


def list_repositories(
    repositories: DataFrame,
    archived: bool = False,
    name_pattern: str | None = None,
    visibility: str = "all",
    max_repositories: int | None = None,
    per: list[str] | None = None,
) -> DataFrame:
    """A listing as a scan uses it.

    With ``per``, duplicates and limits are those of each group. Order matters: duplicates go first, then archived ones (unless ``archived``), then names
    that do not match; the limit counts what is left; visibility is tested last and may leave
    fewer than the limit.
    """
    rows = match_name(skip_archived(first_listed(repositories, per), not archived), name_pattern)
    return match_visibility(limit_repositories(rows, max_repositories, per), visibility)


def skip_counters(
    repositories: DataFrame, archived: bool = False, name_pattern: str | None = None, per: list[str] | None = None
) -> DataFrame:
    """Kept, archived, pattern-filtered and duplicate listings; each row is in one of them.

    The first occurrence of a name on its host decides; later ones only count as duplicates.
    """
    keys = per or []
    matches = F.lit(True) if name_pattern is None else F.col("_first.name").rlike(name_pattern)
    status = (
        F.when(F.lit(not archived) & F.col("_first.archived"), "archived")
        .when(~matches, "pattern")
        .otherwise("kept")
    )
    per_name = repositories.groupBy(*dict.fromkeys([*keys, *KEY])).agg(
        F.min(F.struct("list_pos", "archived", "name")).alias("_first"), F.count(F.lit(1)).alias("_listed")
    )
    return (
        per_name.withColumn("_status", status)
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("_status") == "kept").alias("kept"),
            F.count_if(F.col("_status") == "archived").alias("skipped_archived"),
            F.count_if(F.col("_status") == "pattern").alias("skipped_pattern"),
            F.sum(F.col("_listed") - 1).alias("duplicates"),
        )
    )


def single_repository(
    repositories: DataFrame, owner: str, name: str, archived: bool = False, host: str = PUBLIC_HOSTS[GITHUB]
) -> DataFrame:
    """One repository of a host by its exact name; pattern and limit do not apply. Empty when not found."""
    chosen = repositories.where((F.col("host") == host) & (F.col("full_name") == f"{owner}/{name}"))
    return skip_archived(first_listed(chosen), not archived)


def name_error(owner: Column, name: Column) -> Column:
    """Message when the owner or the repository name is blank, else NULL."""
    def blank(text: Column) -> Column:
        return text.isNull() | (strip_space(text) == "")

    return F.when(blank(owner), OWNER_REQUIRED).when(blank(name), REPOSITORY_REQUIRED)


def repository_exists(wanted: DataFrame, repositories: DataFrame, archived: bool = False) -> DataFrame:
    """Adds ``found`` (true, false, or NULL when archived and skipped) and ``error`` to (host, owner, name) rows.

    Any number of rows may ask for the same name. Distinct names are looked up, and what was found, never more
    than is listed or asked for, is joined back to the rows.
    """
    listed = first_listed(repositories).select(*KEY, F.col("archived").alias("_archived"))
    error = name_error(F.col("owner"), F.col("name"))
    found = (
        F.when(error.isNotNull(), F.lit(None).cast("boolean"))
        .when(F.col("_archived").isNull(), False)
        .when(F.lit(not archived) & F.col("_archived"), F.lit(None).cast("boolean"))
        .otherwise(True)
    )
    named = wanted.withColumn("full_name", F.concat_ws("/", "owner", "name"))
    asked = named.where(error.isNull()).select(*KEY).distinct()
    answers = listed.join(never_broadcast(asked), KEY, "left_semi")
    return (
        join_single(named, never_broadcast(answers), KEY, "left")
        .withColumn("found", found)
        .withColumn("error", error)
        .drop("full_name", "_archived")
    )
