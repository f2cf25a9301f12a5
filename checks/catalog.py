"""One query per operator, each over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus
from modcensus.fixed import TERRAFORM, TERRAGRUNT
from modcensus.functions.classify import file_type, normalize_source, source_type, terragrunt_name
from modcensus.operators import calls as call_ops
from modcensus.operators import fetchlog, files, repositories, targets, usage
from modcensus.operators.extract import (
    call_sources,
    module_calls,
    terraform_calls,
    terragrunt_calls,
    union_calls,
)
from modcensus.plans.scan import scan_files, scan_module_calls, selected_repositories
from modcensus.runtime import land
from modcensus.sinks import documents
from modcensus.sources import payloads

Query = Callable[[SparkSession, str], DataFrame]

NAME_PATTERN = "infra|live"
INFO = documents.ScanInfo(
    platform="GitHub",
    source="github:acme",
    target="acme",
    scope="All repositories in acme",
    timestamp="2024-01-01T00:00:00.000Z",
)


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    return module_calls(corpus.iac_files(spark, folder))


def _usage(spark: SparkSession, folder: str) -> DataFrame:
    return usage.usage_counts(call_sources(corpus.iac_files(spark, folder)))


def _listed(spark: SparkSession, folder: str, **options) -> DataFrame:
    return repositories.list_repositories(corpus.repositories(spark, folder), **options)


def _candidates(spark: SparkSession, folder: str, **options) -> DataFrame:
    return files.candidate_files(corpus.tree_entries(spark, folder), _listed(spark, folder), **options)


def _attached(spark: SparkSession, folder: str) -> DataFrame:
    return scan_files(
        _listed(spark, folder), corpus.tree_entries(spark, folder), corpus.file_contents(spark, folder)
    )


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return files.attach_outcomes(_candidates(spark, folder), corpus.file_contents(spark, folder))


# --- columns -------------------------------------------------------------------------


def q_file_type(spark, folder):
    return corpus.tree_entries(spark, folder).select(
        "host", "full_name", "path", file_type(F.col("path")).alias("file_type")
    )


def q_skip_dirs(spark, folder):
    return files.outside_skipped_directories(corpus.tree_entries(spark, folder)).select("host", "full_name", "path")


def q_source_type(spark, folder):
    sources = _usage(spark, folder).groupBy("source").agg(F.sum("n").alias("n"))
    return sources.select("source", source_type(F.col("source")).alias("source_type"), "n")


def q_version(spark, folder):
    return _usage(spark, folder)


def q_normalize(spark, folder):
    sources = _usage(spark, folder).groupBy("source").agg(F.sum("n").alias("n"))
    return sources.select("source", normalize_source(F.col("source")).alias("normalized"), "n")


def q_tg_name(spark, folder):
    path, source = F.col("file_path"), F.col("source")
    return _calls(spark, folder).select(
        "repository",
        "file_path",
        "block_pos",
        terragrunt_name(path, source).alias("name_by_path"),
        terragrunt_name(F.lit("live.hcl"), source).alias("name_by_source"),
    )


# --- extraction ------------------------------------------------------------------------


def q_terraform_calls(spark, folder):
    return terraform_calls(corpus.iac_files(spark, folder))


def q_terragrunt_calls(spark, folder):
    return terragrunt_calls(corpus.iac_files(spark, folder))


def q_module_calls(spark, folder):
    return _calls(spark, folder)


def q_union_calls(spark, folder):
    rows = corpus.iac_files(spark, folder)
    return union_calls(terraform_calls(rows), terragrunt_calls(rows)).drop("file_url")


# --- order and summaries -----------------------------------------------------------------


def _landed_calls(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Calls as a table: the sampling of a range sort then does not extract them again."""
    rows = _calls(spark, folder)
    return land(rows.select(*columns) if columns else rows, "calls")


def q_sorted_calls(spark, folder):
    columns = ["source", "version", "repository", "file_path", "line_number", "block_pos"]
    return call_ops.positioned_calls(_landed_calls(spark, folder, *columns)).select("position", *columns)


def q_raw_summary(spark, folder):
    return usage.raw_summary(_usage(spark, folder))


def q_merged_summary(spark, folder):
    return usage.merged_summary(land(_usage(spark, folder), "usage"))


def q_normalized_summary(spark, folder):
    return usage.normalized_summary(_usage(spark, folder))


def q_summary_rank(spark, folder):
    return usage.ranked_summary(_usage(spark, folder)).select("position", "module", "entry", "version", "n")


def q_source_type_share(spark, folder):
    return usage.source_type_share(_usage(spark, folder))


def q_file_type_share(spark, folder):
    return usage.file_type_share(_usage(spark, folder))


def q_metadata(spark, folder):
    return usage.scan_counts(corpus.iac_files(spark, folder), _usage(spark, folder))


def q_unique_sources(spark, folder):
    return usage.unique_sources(_usage(spark, folder))


def q_csv_file_type(spark, folder):
    """Calls whose type does not follow from their path: every seventh line has the other one."""
    other = F.when(F.col("type") == TERRAFORM, TERRAGRUNT).otherwise(TERRAFORM)
    kind = F.when(F.col("line_number") % 7 == 0, other).otherwise(F.col("type"))
    rows = _calls(spark, folder).select(
        "source", kind.alias("type"), "repository", "file_path", "line_number", "block_pos"
    )
    return call_ops.listed_file_type(land(rows, "calls"))


def q_repo_file_counts(spark, folder):
    return files.repository_file_counts(corpus.hosted_files(spark, folder))


# --- documents ---------------------------------------------------------------------------


def q_csv_rows(spark, folder):
    return documents.csv_rows(_calls(spark, folder))


def q_csv_lines(spark, folder):
    placed = call_ops.positioned_calls(_landed_calls(spark, folder))
    return placed.select("position", documents.csv_line().alias("line"))


def q_json_modules(spark, folder):
    placed = call_ops.positioned_calls(_landed_calls(spark, folder))
    return placed.select("position", documents.json_object().alias("line"))


def q_json_document(spark, folder):
    rows = corpus.iac_files(spark, folder)
    return documents.json_lines(_landed_calls(spark, folder), rows, INFO)


def q_report_lines(spark, folder):
    return documents.numbered_report(
        corpus.iac_files(spark, folder), land(_usage(spark, folder), "usage"), INFO
    )


# --- repositories ------------------------------------------------------------------------


def q_github_repos(spark, folder):
    return payloads.github_repositories(payloads.github_payloads(corpus.github_pages(spark, folder)))


def q_gitlab_repos(spark, folder):
    """The names of a listing, and of single lookups beside them, out of one parse."""
    rows = payloads.gitlab_payloads(corpus.gitlab_pages(spark, folder))
    listed = payloads.gitlab_repositories(rows.withColumn("_single", payloads.single_name()), carry=["_single"])
    return listed.withColumnRenamed("_single", "single_name")


def q_ownership(spark, folder):
    rows = payloads.gitlab_payloads(corpus.gitlab_pages(spark, folder))
    # owners out of the listing itself: namespaces and first path segments, every other length a group
    named = rows.select(
        F.explode(F.array("namespace.path", F.substring_index("path_with_namespace", "/", 1))).alias("owner")
    )
    owners = named.distinct().withColumn("is_group", F.length("owner") % 2 == 0)
    return payloads.owned_projects(rows, owners).select("list_pos", "owner", "is_group", "path_with_namespace")


def q_repo_filter(spark, folder):
    return _listed(spark, folder, name_pattern=NAME_PATTERN, visibility="private").select(
        "host", "full_name", "list_pos", "provider", "archived", "private"
    )


def q_repo_limit(spark, folder):
    """The first five per owner, then the public ones among them."""
    rows = _listed(spark, folder, name_pattern=NAME_PATTERN, visibility="public", max_repositories=5, per=["owner"])
    return rows.select("owner", "host", "full_name", "list_pos")


def q_repo_limit_listing(spark, folder):
    rows = _listed(spark, folder, archived=True, max_repositories=50)
    return rows.select("host", "full_name", "list_pos", "archived")


def q_repo_dedup(spark, folder):
    return repositories.first_listed(corpus.repositories(spark, folder)).select("host", "full_name", "list_pos")


def q_skip_counters(spark, folder):
    return repositories.skip_counters(
        corpus.repositories(spark, folder), name_pattern=NAME_PATTERN, per=["owner"]
    )


def q_repo_exists(spark, folder):
    """Asked for: every customer's repository, some of them under a name that is not listed or blank."""
    name = (
        F.when(F.col("c") % 6 == 5, "missing")
        .when(F.col("c") % 11 == 10, " ")
        .otherwise(F.substring_index("full_name", "/", -1))
    )
    listed = corpus.scan_inputs(spark, folder).selectExpr("c", f"{corpus.rules.OWN_HOST} AS h")
    listed = listed.selectExpr("c", f"{corpus.rules.REPO_HOST} AS host", f"{corpus.rules.REPO_FULL_NAME} AS full_name")
    wanted = listed.select("c", "host", F.substring_index("full_name", "/", 1).alias("owner"), name.alias("name"))
    return repositories.repository_exists(wanted, corpus.repositories(spark, folder))


# --- targets -----------------------------------------------------------------------------


def q_scan_targets(spark, folder):
    return targets.scan_targets(corpus.scan_inputs(spark, folder), base_dir="/work/base")


def q_target_header(spark, folder):
    rows = targets.described_targets(q_scan_targets(spark, folder))
    return rows.select("c", "platform_name", "supported", "target", "scope")


def q_single_repo(spark, folder):
    """Repositories that the parsed targets select, whole owners and single ones."""
    rows = selected_repositories(q_scan_targets(spark, folder), corpus.repositories(spark, folder))
    return rows.select("provider", "host", "full_name", "list_pos")


# --- files -------------------------------------------------------------------------------


def q_tree_files(spark, folder):
    return _candidates(spark, folder).select("file_type", "host", "repository", "path", "url", "sha", "tree_pos")


def q_type_filter(spark, folder):
    return files.keep_file_types(corpus.tree_entries(spark, folder), [TERRAGRUNT]).select("host", "full_name", "path")


def q_path_patterns(spark, folder):
    rows = files.match_paths(
        corpus.tree_entries(spark, folder), include=[r"\.tf$", "env[12]/"], exclude=["node_modules", "svc.*9/"]
    )
    return rows.select("host", "full_name", "path")


def q_max_files(spark, folder):
    return _candidates(spark, folder, max_files=3).select("host", "repository", "path", "tree_pos")


def q_content_decode(spark, folder):
    rows = files.fetched_files(_attached(spark, folder))
    return rows.select("file_type", "repository", "path", F.md5("content").alias("content_md5"))


def q_partial_failures(spark, folder):
    return files.fetch_errors(_outcomes(spark, folder))


def q_fetch_counts(spark, folder):
    return files.fetch_counts(_outcomes(spark, folder))


def q_repo_failures(spark, folder):
    return files.repository_outcomes(_listed(spark, folder), corpus.landed_trees(spark, folder), _outcomes(spark, folder))


def q_scan_errors(spark, folder):
    outcomes = _outcomes(spark, folder).select("host", "repository", "path", "provider", "error")
    attached = land(outcomes, "outcomes", compact=True)
    repositories_of = files.repository_outcomes(_listed(spark, folder), corpus.landed_trees(spark, folder), attached)
    return files.scan_errors(repositories_of, attached)


def q_scan_totals(spark, folder):
    return files.scan_totals(q_repo_failures(spark, folder))


def q_target_limit(spark, folder):
    """Repositories that the parsed targets select, at most two for each target that names an owner."""
    rows = selected_repositories(q_scan_targets(spark, folder), corpus.repositories(spark, folder), max_repositories=2)
    return rows.select("host", "full_name", "list_pos")


def q_scan_owner(spark, folder):
    """Calls of all listed repositories, found where the contents are read; other owners' partitions are not."""
    layout = corpus.contents_layout(spark, folder)
    return scan_module_calls(
        _listed(spark, folder), corpus.tree_entries(spark, folder), layout.read(spark), owner_buckets=layout.owner_buckets
    )


# --- request log ---------------------------------------------------------------------------


def q_fetch_errors(spark, folder):
    return fetchlog.classified_errors(corpus.fetch_log(spark, folder)).drop("code", "message", "body_message")


def q_error_summary(spark, folder):
    return fetchlog.error_summary(corpus.fetch_log(spark, folder))


def q_request_summary(spark, folder):
    return fetchlog.request_summary(corpus.fetch_log(spark, folder))


def all_queries() -> dict[str, Query]:
    return {name: query for name, query in globals().items() if name.startswith("q_")}
