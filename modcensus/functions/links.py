"""Web addresses of files and lines, and text for report headers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from modcensus.fixed import (
    GITHUB_PLATFORMS,
    GITLAB_PLATFORMS,
    LOCAL,
    LOCAL_SCOPE,
    OWNER_SCOPE,
    PLATFORM_NAMES,
    REPOSITORY_SCOPE,
)
from modcensus.functions.text import filled, looked_up, none_if_empty


def blob_url(
    provider: Column, repository_url: Column, full_name: Column, branch: Column, path: Column
) -> Column:
    """Address of a file. GitHub links always use the public host; nothing is percent-encoded."""
    return F.when(
        provider.isin(GITHUB_PLATFORMS),
        F.concat(F.lit("https://github.com/"), full_name, F.lit("/blob/"), branch, F.lit("/"), path),
    ).when(
        provider.isin(GITLAB_PLATFORMS),
        F.concat(repository_url, F.lit("/-/blob/"), branch, F.lit("/"), path),
    )


def file_link(file_url: Column, line_number: Column) -> Column:
    return F.concat(file_url, F.lit("#L"), line_number.cast("string"))


def platform_name(platform: Column) -> Column:
    """Display name; an unlisted platform keeps its own name."""
    return F.coalesce(looked_up(platform, PLATFORM_NAMES), platform)


def target_text(identifier: Column, repository: Column) -> Column:
    return F.concat_ws("/", identifier, none_if_empty(repository))


def scope_text(platform: Column, identifier: Column, repository: Column) -> Column:
    base = F.regexp_extract(identifier, r"([^/]*)/*\z", 1)
    return (
        F.when(platform == LOCAL, filled(LOCAL_SCOPE, base))
        .when(
            none_if_empty(repository).isNotNull(),
            filled(REPOSITORY_SCOPE, repository),
        )
        .otherwise(filled(OWNER_SCOPE, identifier))
    )
