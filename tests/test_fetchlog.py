"""Classes of failed requests."""

import pytest

from modcensus.operators import fetchlog
from modcensus.schemas import FETCH_LOG

CASES = {  # (status, code): class, retryable
    (401, None): ("authentication_failed", False),
    (403, None): ("authorization_failed", False),
    (404, None): ("resource_not_found", False),
    (429, None): ("rate_limit_exceeded", True),
    (422, None): ("platform_error", False),
    (500, "X"): ("platform_error", True),
    (503, None): ("platform_error", True),
    (None, "ECONNRESET"): ("network_error", True),
    (None, None): ("unknown_error", False),
}


def log(spark, rows):
    return spark.createDataFrame(
        [(platform, "list", "o/r", None, 1, status, code, "message", body) for platform, status, code, body in rows],
        FETCH_LOG,
    )


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(p, s, c, None) for p in ("github", "bitbucket") for s, c in CASES] + [("github", 200, None, None)]
    return fetchlog.classified_errors(log(spark, rows)).collect()


def test_classes(classified):
    assert len(classified) == 2 * len(CASES)  # a success is not in it
    for r in classified:
        assert (r.error_type, r.retryable) == CASES[(r.status, r.code)]
        assert r.is_retryable == r.retryable


def test_flags_are_false_for_other_platforms(classified):
    for r in classified:
        known = r.platform == "github"
        assert r.not_found == (known and r.status == 404)
        assert r.rate_limited == (known and r.status == 429)
        assert r.auth_failed == (known and r.status in (401, 403))


def test_messages(spark):
    rows = [("github", 404, None, "body"), ("gitlab", 404, None, "body"), ("gitlab", 422, None, None), ("local", 422, None, "body")]
    got = {(r.platform, r.status): (r.error_message, r.user_message) for r in fetchlog.classified_errors(log(spark, rows)).collect()}
    assert got == {
        ("github", 404): ("message", "The requested resource was not found."),
        ("gitlab", 404): ("body", "The requested resource was not found."),
        ("gitlab", 422): ("message", "message"),
        ("local", 422): ("message", "message"),
    }


def test_summaries(spark):
    rows = [("github", 200, None, None)] * 3 + [("github", 429, None, None)] * 2 + [("gitlab", None, None, None)]
    got = sorted(map(tuple, fetchlog.error_summary(log(spark, rows)).collect()))
    assert got == [("github", "list", "rate_limit_exceeded", 2, 2), ("gitlab", "list", "unknown_error", 1, 0)]
    got = sorted(map(tuple, fetchlog.request_summary(log(spark, rows)).collect()))
    assert got == [("github", "list", 3, 2), ("gitlab", "list", 0, 1)]
