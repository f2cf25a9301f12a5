"""From landed listings, trees and contents to files and module calls."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modcensus.fixed import GITHUB_PLATFORMS, GITLAB, PUBLIC_HOSTS
from modcensus.functions.classify import file_type
from modcensus.functions.text import looked_up, none_if_empty
from modcensus.operators.extract import module_calls
from modcensus.operators.files import attach_contents, candidate_files, decoded_content
from modcensus.operators.joins import never_broadcast
from modcensus.operators.repositories import first_listed, list_repositories, owned_by, skip_archived
from modcensus.runtime import evaluated
from modcensus.sources.layout import of_listed_owners


def selected_repositories(targets: DataFrame, repositories: DataFrame, archived: bool = False, **listing) -> DataFrame:
    """Repositories that parsed targets ask for.

    A target with a repository takes exactly that one; name pattern, visibility and limit
    (see ``list_repositories``) only apply to targets that name a whole owner, to each target on
    its own. A target without a host means the public one of its platform. GitLab owners count
    as groups unless the targets say otherwise in ``is_group``.
    """
    wanted = targets.where(F.col("error").isNull()).select(
        F.coalesce(F.col("host"), looked_up(F.col("platform"), PUBLIC_HOSTS)).alias("host"),
        F.col("identifier").alias("owner"),
        none_if_empty(F.col("repository")).alias("_repository"),
        (F.col("is_group") if "is_group" in targets.columns else F.lit(True)).alias("is_group"),
    )
    owners = wanted.where(F.col("_repository").isNull()).select("host", "owner", "is_group").distinct()
    singles = wanted.where(F.col("_repository").isNotNull()).select(
        "host", F.concat_ws("/", "owner", "_repository").alias("full_name")
    )
    # the host and the owner asked for are the target
    owned = owned_by(repositories, owners).select(*repositories.columns, "_owner").distinct()
    whole = list_repositories(owned, archived=archived, per=["host", "_owner"], **listing)
    exact = skip_archived(
        first_listed(repositories.join(never_broadcast(singles), ["host", "full_name"], "left_semi")), not archived
    )
    return first_listed(whole.select(*repositories.columns).unionByName(exact.select(*repositories.columns)))


def scan_files(repositories: DataFrame, tree: DataFrame, contents: DataFrame, **files) -> DataFrame:
    """Files of all given repositories with content or error, and with their places in scan order."""
    return attach_contents(candidate_files(tree, repositories, **files), contents)


def scan_module_calls(
    repositories: DataFrame, tree: DataFrame, contents: DataFrame, owner_buckets: int | None = None, **files
) -> DataFrame:
    """Module calls of all given repositories, the way for large contents.

    Same rows as extraction after ``scan_files``. Here contents are searched where they are
    read and then dropped, so the joins move small call rows and never a file's text. For contents of a
    ``ContentsLayout`` give its ``owner_buckets``: partitions of other owners are not read.
    """
    encoding = F.col("encoding")
    if owner_buckets is not None:
        contents = of_listed_owners(contents, repositories, owner_buckets)
    landed = evaluated(
        contents.where(file_type(F.col("path")).isNotNull()).withColumnRenamed("content", "_raw"),
        content=decoded_content(F.lit(GITLAB), encoding, F.col("_raw")),
    ).select(
        file_type(F.col("path")).alias("file_type"),
        F.col("full_name").alias("repository"),
        "host",
        "path",
        "content",
        F.lit(None).cast("string").alias("url"),
        encoding.eqNullSafe("base64").alias("_is_base64"),
    )
    calls = module_calls(landed, carry=["_is_base64", "host"])
    columns = [c for c in calls.columns if c not in ("_is_base64", "host")]
    wanted = candidate_files(tree, repositories, **files).select(
        "host", "repository", F.col("path").alias("file_path"), F.col("url").alias("file_url"), "provider"
    )
    # the GitLab reading also takes plain text; from GitHub that is a failed file
    readable = F.col("_is_base64") | ~F.col("provider").isin(GITHUB_PLATFORMS)
    found = calls.drop("file_url").join(never_broadcast(wanted), ["host", "repository", "file_path"])
    return found.where(readable).select(*columns)
