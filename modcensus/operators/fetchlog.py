"""Classes and counts of failed requests, from a landed request log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.fixed import (
    GITHUB_PLATFORMS,
    GITLAB_PLATFORMS,
    SCANNABLE_PLATFORMS,
    STATUS_ERRORS,
    USER_MESSAGES,
)
from modcensus.functions.text import looked_up


def classified_errors(log: DataFrame) -> DataFrame:
    """Failed requests with class, retry flags, platform flags and messages.

    A request failed when its status is 400 or more, or when it got no response at all.
    """
    status, code, platform = F.col("status"), F.col("code"), F.col("platform")
    by_status = F.coalesce(looked_up(status, STATUS_ERRORS), F.lit("platform_error"))
    error_type = (
        F.when(status.isNotNull(), by_status).when(code.isNotNull(), "network_error").otherwise("unknown_error")
    )
    limited = F.col("error_type") == "rate_limit_exceeded"
    retryable = limited | F.coalesce(status >= 500, F.lit(False)) | (F.col("error_type") == "network_error")
    known = platform.isin(SCANNABLE_PLATFORMS)

    def flag(*statuses: int) -> Column:
        return known & F.coalesce(status.isin(*statuses), F.lit(False))

    message = F.when(platform.isin(GITHUB_PLATFORMS), F.col("message")).when(
        platform.isin(GITLAB_PLATFORMS), F.coalesce("body_message", "message")
    ).otherwise(F.col("message"))

    failed = log.where(F.coalesce(status >= 400, F.lit(True)))
    return (
        failed.withColumn("error_type", error_type)
        .withColumn("retryable", retryable)
        .withColumn("is_retryable", F.col("retryable") | limited)
        .withColumn("not_found", flag(404))
        .withColumn("rate_limited", flag(429))
        .withColumn("auth_failed", flag(401, 403))
        .withColumn("error_message", message)
        .withColumn("user_message", F.coalesce(looked_up(F.col("error_type"), USER_MESSAGES), "message"))
    )


def request_summary(log: DataFrame) -> DataFrame:
    """Requests per platform and operation: successes and failures."""
    failed = F.coalesce(F.col("status") >= 400, F.lit(True))
    return log.groupBy("platform", "operation").agg(
        F.count_if(~failed).alias("success_count"), F.count_if(failed).alias("error_count")
    )


def error_summary(log: DataFrame) -> DataFrame:
    """Failures per platform, operation and class."""
    return (
        classified_errors(log)
        .groupBy("platform", "operation", "error_type")
        .agg(F.count(F.lit(1)).alias("errors"), F.count_if("is_retryable").alias("retryable_errors"))
    )
