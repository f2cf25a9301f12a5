"""Listings, payloads and ownership."""

import json

import pytest

from modcensus.operators import repositories as repos
from modcensus.operators.limits import first_per_group
from modcensus.plans.scan import selected_repositories
from modcensus.schemas import REPOSITORIES
from modcensus.sources import payloads


def listing(spark, rows):
    """rows: (full_name, list_pos, archived, private)"""
    full = [
        ("gitlab" if "/sub/" in name else "github", "https://gitlab.com" if "/sub/" in name else "https://github.com", pos, name.split("/")[0], name.split("/")[-1], name, "main", archived,
         private, f"https://h/{name}", f"https://h/{name}.git")
        for name, pos, archived, private in rows
    ]
    return spark.createDataFrame(full, REPOSITORIES)


ROWS = [
    ("o/infra-a", 5, False, False),
    ("o/infra-b", 1, False, True),
    ("o/infra-c", 2, True, False),
    ("o/infra-a", 9, True, False),  # listed again
    ("o/infra-c", 0, False, False),  # listed before: this one counts
    ("o/app", 3, False, False),
    ("o/infra-d", 7, False, True),
]


def names(frame):
    return [r.full_name for r in frame.orderBy("list_pos").collect()]


def test_first_listed(spark):
    got = {r.full_name: r.list_pos for r in repos.first_listed(listing(spark, ROWS)).collect()}
    assert got == {"o/infra-a": 5, "o/infra-b": 1, "o/infra-c": 0, "o/app": 3, "o/infra-d": 7}


def test_filters(spark):
    rows = listing(spark, ROWS)
    assert names(repos.list_repositories(rows)) == ["o/infra-c", "o/infra-b", "o/app", "o/infra-a", "o/infra-d"]
    assert names(repos.list_repositories(rows, name_pattern="^infra")) == ["o/infra-c", "o/infra-b", "o/infra-a", "o/infra-d"]
    assert names(repos.list_repositories(rows, name_pattern="nfr")) == ["o/infra-c", "o/infra-b", "o/infra-a", "o/infra-d"]
    assert names(repos.list_repositories(rows, name_pattern="^o/")) == []
    assert names(repos.match_visibility(rows, "private")) == ["o/infra-b", "o/infra-d"]
    assert names(repos.skip_archived(rows, False)) == names(rows)
    with pytest.raises(ValueError):
        repos.match_visibility(rows, "secret")
    with pytest.raises(ValueError):
        repos.limit_repositories(rows, 0)


def test_limit_comes_before_visibility(spark):
    rows = listing(spark, ROWS)
    assert names(repos.list_repositories(rows, name_pattern="infra", max_repositories=3, visibility="private")) == ["o/infra-b"]
    assert names(repos.list_repositories(rows, max_repositories=2, per=["owner"])) == ["o/infra-c", "o/infra-b"]


def test_skip_counters(spark):
    row = repos.skip_counters(listing(spark, ROWS), name_pattern="infra").first().asDict()
    assert row == {"kept": 4, "skipped_archived": 0, "skipped_pattern": 1, "duplicates": 2}
    late = [("o/x", 0, True, False), ("o/x", 1, False, False)]
    row = repos.skip_counters(listing(spark, late)).first().asDict()
    assert row == {"kept": 0, "skipped_archived": 1, "skipped_pattern": 0, "duplicates": 1}
    row = repos.skip_counters(listing(spark, late), archived=True).first().asDict()
    assert row == {"kept": 1, "skipped_archived": 0, "skipped_pattern": 0, "duplicates": 1}


def test_single_repository(spark):
    rows = listing(spark, ROWS + [("o/old", 8, True, False)])
    assert names(repos.single_repository(rows, "o", "app")) == ["o/app"]
    assert names(repos.single_repository(rows, "o", "ap")) == []
    assert names(repos.single_repository(rows, "o", "old")) == []
    assert names(repos.single_repository(rows, "o", "old", archived=True)) == ["o/old"]


def test_repository_exists(spark):
    wanted = spark.createDataFrame(
        [("o", "app"), ("o", "old"), ("o", "none"), (" ", "app"), ("o", ""), (None, "x")], "owner STRING, name STRING"
    ).selectExpr("'https://github.com' AS host", "*")
    rows = listing(spark, ROWS + [("o/old", 8, True, False)])
    got = {(r.owner, r.name): (r.found, r.error) for r in repos.repository_exists(wanted, rows).collect()}
    owner = "Owner name is required and must be a non-empty string"
    name = "Repository name is required and must be a non-empty string"
    assert got == {
        ("o", "app"): (True, None),
        ("o", "old"): (None, None),
        ("o", "none"): (False, None),
        (" ", "app"): (None, owner),
        ("o", ""): (None, name),
        (None, "x"): (None, owner),
    }
    found = repos.repository_exists(wanted, rows, archived=True).where("name = 'old'").first().found
    assert found is True


def test_first_per_group_with_one_hot_group(spark):
    rows = spark.sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'g' || id % 50 END AS g FROM range(3000)")
    got = sorted((r.g, r.id) for r in first_per_group(rows, ["g"], [rows.id], 4, spread=["id"]).collect())
    groups = {}
    for i in range(3000):
        groups.setdefault("hot" if i % 3 == 0 else f"g{i % 50}", []).append(i)
    assert got == sorted((g, i) for g, ids in groups.items() for i in ids[:4])


def test_payload_pages(spark, tmp_path):
    def github(i, **owner):
        return {"name": f"r{i}", "full_name": f"o/r{i}", "default_branch": "main", "archived": False, "private": i % 2 == 0,
                "html_url": f"https://h/o/r{i}", "clone_url": f"https://h/o/r{i}.git", "owner": owner, "extra": 1}

    (tmp_path / "page-2.json").write_text(json.dumps([github(3, login="o")]))
    (tmp_path / "page-1.json").write_text(json.dumps([github(1, login="", path="p"), github(2, name="n")], indent=1))
    pages = payloads.read_pages(spark, str(tmp_path))
    rows = payloads.github_repositories(payloads.github_payloads(pages)).orderBy("list_pos").collect()
    assert [(r.list_pos, r.owner, r.name, r.private) for r in rows] == [
        (100, "p", "r1", False), (101, "n", "r2", True), (200, "o", "r3", False),
    ]


def test_gitlab_payloads_and_ownership(spark):
    def project(i, path, namespace, full, **more):
        return {"id": i, "name": f"Shown {i}", "path": path, "path_with_namespace": full, "visibility": "internal",
                "web_url": "w", "http_url_to_repo": "c", "namespace": {"name": "N", "path": namespace}, **more}

    body = [
        project(1, "a", "grp", "grp/a"),
        project(2, "", "sub", "grp/sub/b", default_branch="dev", visibility="public", archived=True),
        project(3, "c", "grp2", "grp2/c", default_branch=""),
    ]
    rows = payloads.gitlab_payloads(spark.createDataFrame([(0, json.dumps(body))], "page BIGINT, body STRING"))
    listed = payloads.gitlab_repositories(rows).orderBy("list_pos").collect()
    assert [(r.name, r.default_branch, r.private, r.archived) for r in listed] == [
        ("a", "main", True, False), ("", "dev", False, True), ("c", "main", True, False),
    ]
    single = payloads.gitlab_repositories(rows, listing=False).orderBy("list_pos").collect()
    assert [r.name for r in single] == ["a", "Shown 2", "c"]

    owners = spark.createDataFrame([("grp", True), ("sub", False), ("grp2", False), ("gr", True)], "owner STRING, is_group BOOLEAN")
    got = sorted((r.owner, r.id) for r in payloads.owned_projects(rows, owners).collect())
    assert got == [("grp", 1), ("grp", 2), ("grp2", 3), ("sub", 2)]
    user = spark.createDataFrame([("grp", False)], "owner STRING, is_group BOOLEAN")
    assert [r.id for r in payloads.owned_projects(rows, user).collect()] == [1]


TARGETS = "platform STRING, identifier STRING, repository STRING, host STRING, error STRING"


def test_equal_names_on_several_hosts(spark):
    hosts = ["https://github.com", "https://gitlab.com", "https://git.corp.io"]
    kinds = ["github", "gitlab", "gitlab-self-hosted"]
    rows = spark.createDataFrame(
        [(kind, host, i, "acme", name, f"acme/{name}", "main", False, False, f"{host}/acme/{name}", "c")
         for kind, host in zip(kinds, hosts) for i, name in enumerate(["x", "y", "z"])] * 2,
        REPOSITORIES,
    )
    assert repos.first_listed(rows).count() == 9
    assert repos.skip_counters(rows).first().asDict() == {"kept": 9, "skipped_archived": 0, "skipped_pattern": 0, "duplicates": 9}
    assert [r.host for r in repos.single_repository(rows, "acme", "x", host=hosts[2]).collect()] == [hosts[2]]

    def selected(*targets, **options):
        frame = spark.createDataFrame(list(targets), TARGETS)
        return sorted((r.host, r.full_name) for r in selected_repositories(frame, rows, **options).collect())

    assert selected(("gitlab-self-hosted", "acme", None, hosts[2], None)) == [(hosts[2], f"acme/{n}") for n in "xyz"]
    both = [("gitlab", "acme", None, None, None), ("github", "acme", None, None, None)]
    assert selected(*both) == sorted((h, f"acme/{n}") for h in hosts[:2] for n in "xyz")
    assert selected(*both, max_repositories=1) == sorted((h, "acme/x") for h in hosts[:2])
    wanted = spark.createDataFrame([(hosts[2], "acme", "x"), ("https://other", "acme", "x")] * 3, "host STRING, owner STRING, name STRING")
    found = repos.repository_exists(wanted, rows).collect()
    assert sorted((r.host, r.found) for r in found) == sorted([(hosts[2], True), ("https://other", False)] * 3)


def test_bad_name_pattern_fails_at_once(spark):
    with pytest.raises(ValueError, match="Invalid name pattern"):
        repos.match_name(listing(spark, ROWS), "infra(")


def test_pages_with_too_many_items_fail(spark):
    body = json.dumps([{"name": f"r{i}"} for i in range(101)])
    rows = payloads.github_payloads(spark.createDataFrame([(0, body)], "page BIGINT, body STRING"))
    with pytest.raises(Exception, match="too many items"):
        rows.collect()


def test_selected_repositories(spark):
    rows = listing(spark, ROWS + [("p/x", 20, False, False), ("g/sub/y", 21, False, False), ("o/old", 22, True, False)])
    rows = rows.withColumn("owner", rows.owner)
    targets = spark.createDataFrame(
        [("github", "o", None, None, None), ("github", "p", "x", None, None), ("gitlab", "g", "", None, None),
         ("github", "o", "old", "https://github.com", None), (None, None, None, None, "bad")],
        TARGETS,
    )
    got = names(selected_repositories(targets, rows, name_pattern="infra-[ab]|y"))
    assert got == ["o/infra-b", "o/infra-a", "p/x", "g/sub/y"]
